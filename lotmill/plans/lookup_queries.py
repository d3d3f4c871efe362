"""Catalogue, lookup, aggregation and production-time queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.functions.names import SQL_BLANKS, folded, plain_lot, sql_folded, sql_plain_lot
from lotmill.functions.text import bank_version
from lotmill.operators import distribution as dist
from lotmill.operators import lookups, production
from lotmill.operators import records as rec
from lotmill.operators.skew import skew_join
from lotmill.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.to_records(table(spark, sf_dir, "manifest"))


def _ton(c: str) -> str:
    return f"nullif(trim({c}, {SQL_BLANKS}), '')"


_HEAD = f"substr(trim(date_str, {SQL_BLANKS}), 1, 10)"
REC = rf"""with rec as (select row_id,
  concat_ws('-', upper({_ton("object_name")}), {_ton("lot_id")}, regexp_extract({_ton("image_path")}, '(?:^|[/\\])([^/\\]+?)(?:\.[^./\\]*)?$', 1)) as product_id,
  {_ton("image_path")} as path, {_ton("line")} as line, {_ton("object_name")} as object_name, {_ton("lot_id")} as lot,
  case when regexp_matches({_HEAD}, '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_strptime({_HEAD}, '%Y-%m-%d')::date end as captured_at,
  case {sql_folded("label")} when 'normal' then 'pass' when 'defect' then 'defect' end as truth,
  {sql_folded("split")} as split, {_ton("equipment_id")} as equipment from manifest)
"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(REC + "select * from rec")
def records_clean(spark, sf_dir):
    return _records(spark, sf_dir)


@query(REC + "select row_id, path, product_id from rec where line = 'line_03' and object_name = 'busbar'")
def catalog_find(spark, sf_dir):
    return rec.find(_records(spark, sf_dir), line="line_03", object_name="busbar").select("row_id", "path", "product_id")


@query(REC + ", p as (select min(product_id) as product from rec where lot is not null) select row_id, product_id, lot, product_id = product as hit from rec, p where lot in (select lot from rec, p where product_id = product)")
def catalog_lot_expand(spark, sf_dir):
    r = _records(spark, sf_dir)
    product = r.where("lot is not null").agg(F.min("product_id")).first()[0]
    return rec.whole_lot(r, product).select("row_id", "product_id", "lot", "hit")


@query(REC + """, j as (select r.object_name, r.truth, case when i.score::varchar = 'nan' then null else i.score end as s from rec r join inference_results i on i.image = r.path),
v as (select *, case when s >= 2 then 'defect' when s < 2 then 'pass' end as verdict, case when s >= 2 then 'above' when s >= 0.9*2 then 'near' when s < 0.9*2 then 'below' end as position from j)
select object_name, verdict, position, truth = 'defect' and verdict = 'pass' as missed, truth = 'pass' and verdict = 'defect' as overkill, count(*) as n from v group by all""")
def verdicts(spark, sf_dir):
    v = rec.with_verdict(_records(spark, sf_dir), table(spark, sf_dir, "inference_results"), F.lit(2.0))
    return v.groupBy("object_name", "verdict", "position", "missed", "overkill").agg(F.count(F.lit(1)).alias("n"))


@query("select result_id, case when max_patch_distance >= 2.5 then 'defect' when max_patch_distance >= 1.5 then 'review' else 'pass' end as area_verdict from inference_results")
def area_verdicts(spark, sf_dir):
    return table(spark, sf_dir, "inference_results").select("result_id", rec.area_verdict(F.col("max_patch_distance"), F.lit(2.5), F.lit(1.5)).alias("area_verdict"))


@query(REC + "select row_id, path from rec where split = 'pending'")
def pending_rows(spark, sf_dir):
    return _records(spark, sf_dir).where("split = 'pending'").select("row_id", "path")


@query(REC + """, b as (select distinct source_image as path from bank_patches where source_image is not null),
f as (select * from rec where (truth is null or truth <> 'defect') and not exists (select 1 from b where b.path = rec.path)),
x as (select line, object_name, 'date' as axis, captured_at::varchar as value from f union all select line, object_name, 'lot', lot from f union all select line, object_name, 'equipment', equipment from f)
select line, object_name, axis, value, count(*) as images from x where value is not null group by all""")
def supplement_candidates(spark, sf_dir):
    bank = table(spark, sf_dir, "bank_patches").select(F.col("source_image").alias("path")).where("path is not null")
    return rec.supplements(_records(spark, sf_dir), bank)


@query(REC + ", n as (select row_id, object_name, row_number() over (partition by object_name order by path nulls first, row_id) as i from rec where truth = 'pass') select row_id, object_name, case when i <= 50 then 'bank' else 'holdout' end as slice from n where i <= 75")
def sample_slices(spark, sf_dir):
    r = _records(spark, sf_dir).where("truth = 'pass'")
    return rec.sample_slices(r, ["object_name"], ["path", "row_id"], {"bank": 50, "holdout": 25}).select("row_id", "object_name", "slice")


_MEMBERS = REC + """, a as (select distinct split_part(b.k, '-', 1) as object_name, source_image as m from (select lower(trim(bank_version)) as k, source_image from bank_patches) b where source_image is not null and k is not null),
c as (select distinct object_name, path as m from rec where split = 'bank' and path is not null),
z as (select object_name, m, max(a) as a, max(b) as b from (select object_name, m, 1 as a, 0 as b from a union all select object_name, m, 0, 1 from c) group by all)
select object_name, count(*) filter (a > b) as only_a, count(*) filter (b > a) as only_b, count(*) filter (a > b) = 0 and count(*) filter (b > a) = 0 as same from z group by 1"""


@query(_MEMBERS)
def stale_composition(spark, sf_dir):
    bank = table(spark, sf_dir, "bank_patches").where("source_image is not null and bank_version is not null").select(F.split(F.lower(F.trim("bank_version")), "-")[0].alias("object_name"), F.col("source_image").alias("m"))
    cat = _records(spark, sf_dir).where("split = 'bank' and path is not null").select("object_name", F.col("path").alias("m"))
    return rec.same_members(bank, cat, ["object_name"], "m")


@query(f"select {sql_folded('bank_version')} as bank_version, count(*) filter (matches[1].bank_image = image) as self_matched, count(*) as results from inference_results where len(matches) > 0 group by 1")
def self_matches(spark, sf_dir):
    r = table(spark, sf_dir, "inference_results").where(F.size("matches") > 0)
    same = F.element_at("matches", 1)["bank_image"] == F.col("image")
    return r.groupBy(folded(F.col("bank_version")).alias("bank_version")).agg(F.count_if(same).alias("self_matched"), F.count(F.lit(1)).alias("results"))


_RULES = [("line_01", "relay", 1.9, 0), ("line_03", "busbar", 2.1, 1), ("line_03", "busbar", 9.9, 2), ("line_05", "lensring", 2.4, 3), (None, "toggle", 1.0, 4)]
_RULES_SQL = "(values " + ", ".join(f"({'null' if a is None else repr(a)}, '{b}', {c}::double, {d})" for a, b, c, d in _RULES) + ") r(line, object_name, value, ord)"


@query(REC + f", f as (select distinct line, object_name from rec), b as (select line, object_name, min_by(value, ord) as value from {_RULES_SQL} group by all) select f.line, f.object_name, b.value from f left join b using (line, object_name)")
def threshold_lookup(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "line string, object_name string, value double, ord int")
    facts = _records(spark, sf_dir).select("line", "object_name").distinct()
    return lookups.first_match(facts, rules, ["line", "object_name"], "ord", ["value"])


_CRIT = [("C1", None, None, None, None, 0), ("C2", "line_03", None, "2025-04-01", None, 1), ("C3", "line_03", "busbar", "2025-05-01", "2025-06-15", 2), ("C4", None, "relay", None, "2025-05-31", 3), ("C5", "line_03", None, "2025-04-01", "2025-07-01", 4)]
_CRIT_SQL = "(values " + ", ".join("(" + ", ".join("null" if v is None else (f"date '{v}'" if i in (3, 4) else repr(v)) for i, v in enumerate(r)) + ")" for r in _CRIT) + ") c(rule_id, line, object_name, effective_from, effective_to, rule_order)"


@query(REC + f""", m as (select r.row_id, c.rule_id, (c.line is not null)::int + (c.object_name is not null)::int as specificity, c.rule_order from rec r join {_CRIT_SQL}
 on (c.line is null or c.line = r.line) and (c.object_name is null or c.object_name = r.object_name) and (c.effective_from is null or c.effective_from <= r.captured_at) and (c.effective_to is null or c.effective_to >= r.captured_at)),
b as (select * from (select *, row_number() over (partition by row_id order by specificity desc, rule_order) as rn from m) where rn = 1)
select r.row_id, b.rule_id, b.specificity from rec r left join b using (row_id)""")
def criteria_asof(spark, sf_dir):
    rules = spark.createDataFrame(_CRIT, "rule_id string, line string, object_name string, effective_from string, effective_to string, rule_order int").withColumn("effective_from", F.to_date("effective_from")).withColumn("effective_to", F.to_date("effective_to"))
    facts = _records(spark, sf_dir).select("row_id", "line", "object_name", "captured_at")
    return lookups.criteria_asof(facts, rules, ["row_id"], "captured_at", ["line", "object_name"], ["rule_id"]).select("row_id", "rule_id", "specificity")


@query(f"""with m as (select row_id, {sql_plain_lot("lot_id")} as lot, arrived_at from manifest), e as (select {sql_plain_lot("lot_id")} as lot, registered_at, planned_count from lot_register),
j as (select m.row_id, e.registered_at, e.planned_count, row_number() over (partition by m.row_id order by e.registered_at desc, e.planned_count desc nulls last) as rn from m join e on e.lot = m.lot and e.registered_at <= m.arrived_at)
select m.row_id, j.registered_at, j.planned_count from m left join j on j.row_id = m.row_id and j.rn = 1 where m.lot is not null""")
def register_asof(spark, sf_dir):
    lot = plain_lot(F.col("lot_id")).alias("lot")
    facts = table(spark, sf_dir, "manifest").select(lot, "row_id", "arrived_at").where("lot is not null")
    entries = table(spark, sf_dir, "lot_register").select(lot, "registered_at", "planned_count").where("lot is not null")
    return lookups.asof_backward(facts, entries, ["lot"], "arrived_at", "registered_at", ["registered_at", "planned_count"], ["planned_count"], F.col("row_id")).select("row_id", "registered_at", "planned_count")


@query(f"""with a as (select distinct {sql_plain_lot("lot_id")} as k from manifest), b as (select distinct {sql_plain_lot("lot_id")} as k from mes)
select 'mes' as missing_in, k as ref_key from a where k is not null and k not in (select k from b where k is not null) union all select 'manifest', k from b where k is not null and k not in (select k from a where k is not null)""")
def lots_missing_both_ways(spark, sf_dir):
    return lookups.missing_both_ways(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "mes"), plain_lot(F.col("lot_id")), ("manifest", "mes"))


@query(f"""with m as (select row_id, {sql_plain_lot("lot_id")} as lot, line, date_str, object_name from manifest), e as (select distinct {sql_plain_lot("lot_id")} as lot, line, date_str, object_name from mes)
select m.row_id, e.lot is not null as has_record from m left join e on m.lot = e.lot and m.line = e.line and m.date_str = e.date_str and m.object_name = e.object_name""")
def record_exists(spark, sf_dir):
    lot = plain_lot(F.col("lot_id"))
    facts = table(spark, sf_dir, "manifest").select("row_id", lot.alias("lot"), "line", "date_str", "object_name")
    on = {"lot": lot, "line": F.col("line"), "date_str": F.col("date_str"), "object_name": F.col("object_name")}
    return lookups.exists_on(facts, table(spark, sf_dir, "mes"), on, "has_record").select("row_id", "has_record")


_OVER = [("line_01", "min_detection", 0.95), ("line_03", "max_fpr", 0.1), ("line_03", "unknown", 7.0), ("line_05", None, None)]
# The limits a line has unless its own say otherwise.
_DEF = {"min_detection": 0.90, "max_fpr": 0.05, "min_auroc": 0.85}


@query(f"""with o(line, key, value) as (values {", ".join(f"('{a}', {'null' if b is None else repr(b)}, {'null' if c is None else c}::double)" for a, b, c in _OVER)}), d(key, v) as (values {", ".join(f"('{k}', {v}::double)" for k, v in _DEF.items())})
select l.line, d.key, coalesce(o.value, d.v) as value from (select distinct line from o) l cross join d left join o on o.line = l.line and o.key = d.key""")
def gate_criteria_merge(spark, sf_dir):
    return lookups.with_defaults(spark.createDataFrame(_OVER, "line string, key string, value double"), _DEF)


@query(REC + "select line, object_name, count(*) as n_rows, count(distinct captured_at) as n_dates, count(distinct equipment) as n_equipment, max(captured_at) as last_date, object_name || '-' || split_part(line, '_', -1) || '-v1' as bank_version from rec where split = 'bank' group by all")
def bank_profile(spark, sf_dir):
    return dist.bank_profiles(_records(spark, sf_dir)).withColumn("bank_version", bank_version(F.col("object_name"), F.col("line")))


@query(REC + """, b as (select line, object_name, list(distinct captured_at) as d, list(distinct equipment) as e from rec where split = 'bank' group by all)
select r.line, r.object_name, case when r.captured_at is null then null else coalesce(list_contains(b.d, r.captured_at), false) end as covers_date, case when r.equipment is null then null else coalesce(list_contains(b.e, r.equipment), false) end as covers_equipment, cast(null as boolean) as covers_lot, count(*) as n
from rec r join b using (line, object_name) where r.split = 'operation' group by all""")
def coverage_check(spark, sf_dir):
    r = _records(spark, sf_dir)
    both = r.where("split = 'operation'").join(lookups.small(dist.conditions(r)), ["line", "object_name"])
    c = lambda axis, v: rec.covers(F.col("conditions"), F.lit(axis), v)
    out = both.select("line", "object_name", c("date", F.col("captured_at").cast("string")).alias("covers_date"), c("equipment", F.col("equipment")).alias("covers_equipment"), c("lot", F.col("lot")).alias("covers_lot"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


_DIST = """, h as (select * from rec where truth = 'defect' and captured_at >= date '2025-04-01'),
d as (select object_name, case grouping_id(lot, line, equipment) when 3 then 'lot' when 5 then 'line' when 6 then 'equipment' else 'total' end as axis, coalesce(lot, line, equipment) as value, count(*) as n
  from h group by grouping sets ((object_name, lot), (object_name, line), (object_name, equipment), (object_name))), g as (select * from d where axis = 'total' or value is not null)
"""


def _distribution(spark, sf_dir):
    return dist.defect_distribution(_records(spark, sf_dir), ["object_name"], F.lit("2025-04-01").cast("date"))


@query(REC + _DIST + "select * from g")
def defect_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir)


@query(REC + _DIST + """, t as (select object_name, n as total from g where axis = 'total'), m as (select *, row_number() over (partition by object_name, axis order by n desc, value) as rn from g where axis <> 'total')
select m.object_name, axis, value, n / total as share from m join t on t.object_name is not distinct from m.object_name where rn = 1 and n / total >= 0.6 and m.object_name is not null""")
def defect_concentration(spark, sf_dir):
    return dist.concentrated(_distribution(spark, sf_dir), ["object_name"])


@query(REC + ", t as (select line, captured_at, lot, count(*) as inspected, count(*) filter (truth = 'defect') as defects from rec group by all) select r.row_id, t.inspected, t.defects from rec r join t on r.line = t.line and r.captured_at = t.captured_at and r.lot = t.lot")
def lot_totals(spark, sf_dir):
    r = _records(spark, sf_dir)
    out = skew_join(r, dist.lot_totals(r).where("line is not null and captured_at is not null and lot is not null"), ["line", "captured_at", "lot"], F.col("row_id"))
    return out.select("row_id", "inspected", "defects")


@query("with n as (select line, ercd, count(*) as n from mes where ercd is not null group by all) select line, ercd, n from (select *, row_number() over (partition by line order by n desc, ercd) as rn from n) where rn = 1")
def most_common_code(spark, sf_dir):
    return dist.most_common(table(spark, sf_dir, "mes"), ["line"], "ercd")


@query(REC + ", c as (select line, count(*) filter (split = 'bank' and truth = 'defect') as n_bad from rec group by 1) select line, n_bad, n_bad * 100.0::double / (n_bad + 150) as rate, n_bad * 100.0::double / (n_bad + 150) > 0 and n_bad * 100.0::double / (n_bad + 150) < 1 as warn from c")
def contamination_rate(spark, sf_dir):
    return dist.contamination(_records(spark, sf_dir), ["line"], (F.col("split") == "bank") & (F.col("truth") == "defect"))


@query("select distinct nullif(trim(operator_shift), '') as value from mes where nullif(trim(operator_shift), '') is not null")
def known_shifts(spark, sf_dir):
    return dist.known_values(table(spark, sf_dir, "mes"), F.col("operator_shift"))


@query("select printf('ISS-%04d', max(p_partkey) + 1) as next_id from part")
def next_issue(spark, sf_dir):
    return dist.next_number(table(spark, sf_dir, "part"), F.concat(F.lit("ISS-"), F.col("p_partkey").cast("string")))


_MISS = REC + """, j as (select r.line, r.path, r.row_id, r.truth, r.split, i.score from rec r join inference_results i on i.image = r.path where i.score::varchar <> 'nan' and i.score is not null),
m as (select *, coalesce(truth = 'defect' and score < 2, false) as missed from j),
t as (select line, path, row_id, score, row_number() over (partition by line order by score, path, row_id) as place from m where missed)
"""


def _missed(spark, sf_dir):
    r = table(spark, sf_dir, "inference_results").where("score is not null and not isnan(score)").select(F.col("image").alias("path"), "score")
    both = _records(spark, sf_dir).join(r, "path")
    flag = production.missed_in_batch(F.col("truth"), F.lit(None).cast("string"), F.col("split") == "pending", F.col("score"), F.lit(2.0))
    return both.withColumn("missed", flag)


@query(_MISS + "select line, path, row_id, score, place::int as place from t where place <= 5")
def nightly_triage(spark, sf_dir):
    return production.triage(_missed(spark, sf_dir).where("missed"), ["line"]).select("line", "path", "row_id", "score", "place")


@query(_MISS + "select m.line, count(*) as scanned, count(*) filter (missed) as missed, least(count(*) filter (missed), 5) as handled, greatest(count(*) filter (missed) - 5, 0) as deferred from m group by 1")
def nightly_counters(spark, sf_dir):
    m = F.count_if("missed")
    return _missed(spark, sf_dir).groupBy("line").agg(F.count(F.lit(1)).alias("scanned"), m.alias("missed"), F.least(m, F.lit(5)).alias("handled"), F.greatest(m - 5, F.lit(0)).alias("deferred"))


@query(REC + ", d as (select distinct line, captured_at from rec where captured_at is not null), n as (select *, count(*) over (partition by line) as n, row_number() over (partition by line order by captured_at desc) as r from d) select line, captured_at, case when r <= least(greatest(1, round_even(n * 0.3::double, 0)::bigint), n - 1) then 'holdout' else 'operation' end as split from n")
def split_calendar(spark, sf_dir):
    return production.split_calendar(_records(spark, sf_dir), ["line"], "captured_at")


@query(REC + ", e as (select line, min(captured_at) as a, max(captured_at) as z from rec where captured_at is not null group by 1) select line, 'bank' as kind, (a - i::int)::date as day from e, range(8, 11) t(i) union all select line, 'pending', (z + 1)::date from e")
def date_windows(spark, sf_dir):
    return production.date_windows(_records(spark, sf_dir), ["line"], "captured_at")


@query(rf"""with m as (select row_id, line, try_strptime({_HEAD}, '%Y-%m-%d')::date as day, 30 + row_id % 60 as d, row_id % 5 as g from mes where regexp_matches({_HEAD}, '^\d{{4}}-\d{{2}}-\d{{2}}$') and line is not null),
o as (select *, row_number() over (partition by line order by day, row_id) as i from m where day is not null),
p as (select *, coalesce(sum(d) over (partition by line order by i rows between unbounded preceding and 1 preceding), 0) + sum(case when i = 1 then 0 else g end) over (partition by line order by i) as p from o),
s as (select *, p + max(epoch(day)::bigint + 1 - p) over (partition by line order by i) as st from p)
select row_id, line, st::bigint as start_s, (st + d)::bigint as end_s from s""")
def production_clock(spark, sf_dir):
    """The clock over every row of a line whose day :func:`records.date_or_null` reads, blanks around it and a time behind it included.

    Rows without a day have no place on the clock and are left out: date_str null, blank, written otherwise (2025/03/03, 2025.03.03, 20250303) or no day.
    """
    m = table(spark, sf_dir, "mes").where("line is not null").select("row_id", "line", rec.date_or_null(F.col("date_str")).alias("day")).where("day is not null")
    out = production.production_clock(m, ["line"], ["day", "row_id"], "day", 30 + F.col("row_id") % 60, F.col("row_id") % 5)
    return out.select("row_id", "line", "start_s", "end_s")


@query("with m as (select try_strptime(started_at, '%Y-%m-%dT%H:%M:%S') as t from mes) select case when hour(t) < 8 then 'night' when hour(t) < 16 then 'day' when hour(t) >= 16 then 'swing' end as shift, count(*) as n from m group by 1")
def shift_buckets(spark, sf_dir):
    t = F.try_to_timestamp("started_at", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "mes").groupBy(production.shift_of(t).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


@query(REC + ", n as (select row_id, line, captured_at, row_number() over (partition by line, captured_at order by path nulls first, row_id) as i, count(*) over (partition by line, captured_at) as n from rec where captured_at is not null) select row_id, i > n - least(greatest(round_even(n * 0.4::double, 0)::bigint, 1), n - 1) as night from n")
def day_night_split(spark, sf_dir):
    return production.day_night(_records(spark, sf_dir).where("captured_at is not null"), ["line", "captured_at"], ["path", "row_id"], 0.4).select("row_id", "night")


@query("select result_id, case when date_trunc('day', scored_at) + interval 2 hour > scored_at then date_trunc('day', scored_at) + interval 2 hour else date_trunc('day', scored_at) + interval 26 hour end as next_at from inference_results where scored_at is not null")
def next_runs(spark, sf_dir):
    r = table(spark, sf_dir, "inference_results").where("scored_at is not null")
    return r.select("result_id", production.next_run(F.col("scored_at"), 2).cast("timestamp_ntz").alias("next_at"))


@query(REC + """select 'split' as check_name, count(*) as violations from rec where split is not null and split not in ('bank', 'operation', 'holdout', 'pending')
union all select 'label', count(*) from rec where truth is null union all select 'bank_normal', count(*) from rec where split = 'bank' and truth = 'defect'
union all select 'date_overlap', count(*) from (select line, captured_at from rec where captured_at is not null group by all having count(*) filter (split = 'bank') > 0 and count(*) filter (split = 'operation') > 0)
union all select 'duplicate_path', count(*) from (select path from rec where path is not null group by 1 having count(*) > 1)""")
def rule_dq_checks(spark, sf_dir):
    r = _records(spark, sf_dir)
    ok = ["bank", "operation", "holdout", "pending"]
    flat = r.agg(F.count_if(~F.col("split").isin(*ok)).alias("split"), F.count_if(F.col("truth").isNull()).alias("label"), F.count_if((F.col("split") == "bank") & (F.col("truth") == "defect")).alias("bank_normal"))
    rows = flat.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in flat.columns))).alias("x")).select("x.*")
    days = r.where("captured_at is not null").groupBy("line", "captured_at").agg(F.count_if(F.col("split") == "bank").alias("b"), F.count_if(F.col("split") == "operation").alias("o"))
    days = days.agg(F.count_if((F.col("b") > 0) & (F.col("o") > 0)).alias("violations")).select(F.lit("date_overlap").alias("check_name"), "violations")
    paths = r.where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("duplicate_path").alias("check_name"), "violations")
    return rows.unionByName(days).unionByName(paths)


@query(REC + """, lots as (select distinct {m} as k from manifest), logs as (select distinct {m} as k from mes),
d as (select line, captured_at, bool_or(split = 'bank') as b, bool_or(split = 'operation') as o from rec where captured_at is not null and line is not null group by all)
select 'manifest_split' as check_name, count(*) filter (split not in ('bank', 'operation', 'holdout', 'pending')) as found, count(*) filter (split not in ('bank', 'operation', 'holdout', 'pending')) = 0 as passed from rec
union all select 'manifest_label', count(*) filter (truth is null), count(*) filter (truth is null) = 0 from rec
union all select 'lots_without_record', count(*), count(*) = 0 from lots where k is not null and k not in (select k from logs where k is not null)
union all select 'lots_without_image', count(*), count(*) = 0 from logs where k is not null and k not in (select k from lots where k is not null)
union all select 'bank_rows', count(*) filter (split = 'bank'), count(*) filter (split = 'bank') > 0 from rec
union all select 'operation_rows', count(*) filter (split = 'operation'), count(*) filter (split = 'operation') > 0 from rec
union all select 'lines_with_shared_days', count(distinct line) filter (b and o), count(distinct line) filter (b and o) = 0 from d
union all select 'bank_not_normal', count(*) filter (split = 'bank' and truth is distinct from 'pass'), count(*) filter (split = 'bank' and truth is distinct from 'pass') = 0 from rec
union all select 'days', count(distinct captured_at), count(distinct captured_at) > 1 from rec union all select 'lots', count(distinct lot), count(distinct lot) > 1 from rec
union all select 'equipment', count(distinct equipment), count(distinct equipment) > 1 from rec union all select 'lines', count(distinct line), count(distinct line) >= 3 from rec""".replace("{m}", sql_plain_lot("lot_id")))
def factory_checks(spark, sf_dir):
    """Every check of a catalogue and its production records: values, references both ways, separation of bank and operation days, spread of the conditions."""
    r = _records(spark, sf_dir)
    is_, ok = (lambda s: F.col("split") == s), ["bank", "operation", "holdout", "pending"]
    counts = {
        "manifest_split": F.count_if(~F.col("split").isin(*ok)), "manifest_label": F.count_if(F.col("truth").isNull()), "bank_rows": F.count_if(is_("bank")), "operation_rows": F.count_if(is_("operation")),
        "bank_not_normal": F.count_if(is_("bank") & ~F.col("truth").eqNullSafe("pass")),
    }
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).cast("bigint").alias("found")) for c in df.columns))).alias("x")).select("x.*")
    flat = long(r.agg(*(c.alias(k) for k, c in counts.items())))
    # one distinct value a row, so that no task holds the values of a column
    values = r.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(c).cast("string").alias("v")) for n, c in (("days", "captured_at"), ("lots", "lot"), ("equipment", "equipment"), ("lines", "line"))))).alias("x")).select("x.*")
    spread = values.where("v is not null").distinct().groupBy("check_name").agg(F.count(F.lit(1)).alias("found"))
    lots = lookups.missing_both_ways(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "mes"), plain_lot(F.col("lot_id")), ("manifest", "mes"))
    lots = long(lots.agg(F.count_if(F.col("missing_in") == "mes").alias("lots_without_record"), F.count_if(F.col("missing_in") == "manifest").alias("lots_without_image")))
    days = r.where("captured_at is not null and line is not null").groupBy("line", "captured_at").agg(F.count_if(is_("bank")).alias("b"), F.count_if(is_("operation")).alias("o"))
    days = days.where("b > 0 and o > 0").select("line").distinct().agg(F.count(F.lit(1)).alias("lines_with_shared_days"))
    out, n = flat.unionByName(spread).unionByName(lots).unionByName(long(days)), F.col("found")
    passed = F.when(F.col("check_name").isin("bank_rows", "operation_rows"), n > 0).when(F.col("check_name").isin("days", "lots", "equipment"), n > 1).when(F.col("check_name") == "lines", n >= 3).otherwise(n == 0)
    return out.withColumn("passed", passed)
