"""Pointer, action, upsert, display and release queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.functions import text as tx
from lotmill.functions.names import folded, sql_folded
from lotmill.operators import decide as dc
from lotmill.operators import distribution as dist
from lotmill.operators import governance as gov
from lotmill.operators import grid, lookups, versions
from lotmill.operators.records import to_records
from lotmill.plans.bank_queries import _CELLS, _LIMITS, _cells
from lotmill.plans.lookup_queries import REC
from lotmill.plans.text_queries import _cases, _DECIDE
from lotmill.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("with f as (select distinct bank_version as version, bank_version || '_' || substr(sha256(bank_version), 1, 6) as folder from sweep_points), p as (select bank_version, case when keep_permille % 2 = 0 then bank_version || '_' || substr(sha256(bank_version), 1, 6) else 'stale' end as folder from keep_targets) select p.bank_version, f.folder, f.version from p left join f on f.folder = p.folder and f.version = p.bank_version")
def current_folders(spark, sf_dir):
    name = F.concat("bank_version", F.lit("_"), F.substring(F.sha2("bank_version", 256), 1, 6))
    folders = table(spark, sf_dir, "sweep_points").select("bank_version", name.alias("folder"), F.col("bank_version").alias("version"))
    pointers = table(spark, sf_dir, "keep_targets").select("bank_version", F.when(F.col("keep_permille") % 2 == 0, name).otherwise("stale").alias("folder"))
    return gov.current_folders(pointers, folders, ["bank_version"])


# What each cause asks for, and what it rules out.
RECOMMENDED = {
    "threshold": ["adjust_threshold", "shadow_compare"],
    "bank_contamination": ["remove_contaminated_samples", "rebuild_bank", "shadow_compare"],
    "coverage_gap": ["add_normal_images_for_condition", "rebuild_bank", "shadow_compare"],
    "normal_overlap": ["redefine_criteria", "add_dedicated_detector", "improve_imaging"],
    "equipment_optics": ["request_equipment_check"],
    "criteria": ["redefine_criteria"],
}
FORBIDDEN = {
    "threshold": ["rebuild_bank"],
    "bank_contamination": ["lower_threshold"],
    "coverage_gap": [],
    "normal_overlap": ["rebuild_bank", "lower_threshold"],
    "equipment_optics": ["rebuild_bank", "lower_threshold"],
    "criteria": ["rebuild_bank", "lower_threshold"],
}


@query(_DECIDE + """, a(cause, recommended, forbidden) as (values
  ('threshold', 'adjust_threshold,shadow_compare', 'rebuild_bank'),
  ('bank_contamination', 'remove_contaminated_samples,rebuild_bank,shadow_compare', 'lower_threshold'),
  ('coverage_gap', 'add_normal_images_for_condition,rebuild_bank,shadow_compare', ''),
  ('normal_overlap', 'redefine_criteria,add_dedicated_detector,improve_imaging', 'rebuild_bank,lower_threshold'),
  ('equipment_optics', 'request_equipment_check', 'rebuild_bank,lower_threshold'),
  ('criteria', 'redefine_criteria', 'rebuild_bank,lower_threshold'))
select r.case_id, coalesce(a.recommended, case when outcome = 'duplicate' then 'review_past_issue' when candidates = '' then 'request_correct_image' else '' end) as recommended, coalesce(a.forbidden, '') as forbidden, 0::int as violated from r left join a using (cause)""")
def case_actions(spark, sf_dir):
    """The actions of the decided cases; a fixture, the same at every size."""
    cases, truth = _cases(spark)
    actions = spark.createDataFrame([(c, RECOMMENDED[c], FORBIDDEN[c]) for c in dc.CAUSES], "cause string, recommended array<string>, forbidden array<string>")
    out = gov.finalized(dc.decide(cases), actions)
    ruled = truth.join(lookups.small(actions.withColumnRenamed("cause", "expected_cause")), "expected_cause").select("case_id", "forbidden")
    bad = gov.violations(out, ruled)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.join(bad, "case_id", "left").select("case_id", text("recommended"), text("forbidden"), F.coalesce("forbidden_actions", F.lit(0)).alias("violated"))


@query(f"with n as (select {sql_folded('lang')} as lang, count(*) as n from documents group by 1) select l.lang, coalesce(n.n, 0) as n, coalesce(n.n, 0) < 100 as short from (values ('en'), ('ko'), ('de'), ('fr')) l(lang) left join n using (lang)")
def language_frequencies(spark, sf_dir):
    return gov.frequencies(table(spark, sf_dir, "documents").select(folded(F.col("lang")).alias("lang")), "lang", ["en", "ko", "de", "fr"], 100)


@query("select lot_id, registered_at, count(*) as n from lot_register where lot_id is not null and registered_at is not null group by all having count(*) > 1")
def repeated_entries(spark, sf_dir):
    return gov.repeated(table(spark, sf_dir, "lot_register"), ["lot_id", "registered_at"])


@query(REC + ", c as (select row_id, path, 'changed' as line from rec where truth = 'defect' and path is not null) select row_id, path, line from rec where path is null or path not in (select path from c) union all select * from c")
def catalogue_upsert(spark, sf_dir):
    r = to_records(table(spark, sf_dir, "manifest")).select("row_id", "path", "line", "truth")
    changes = r.where("truth = 'defect' and path is not null").select("row_id", "path", F.lit("changed").alias("line"))
    return gov.upsert(r.select("row_id", "path", "line"), changes, "path")


@query("select image_path, row_id, arrived_at from (select *, row_number() over (partition by image_path order by arrived_at desc nulls last, row_id desc) as rn from manifest) where rn = 1 and image_path is not null")
def newest_rows(spark, sf_dir):
    return gov.newest(table(spark, sf_dir, "manifest").where("image_path is not null"), ["image_path"], ["arrived_at", "row_id"], ["row_id", "arrived_at"])


@query("with n as (select event_type, count(*) as n from events group by 1) select event_type, n, row_number() over (order by n desc, event_type)::int as place from n")
def calls_by_kind(spark, sf_dir):


    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "event_type")))


@query("with n as (select line, row_id, row_number() over (partition by line order by row_id) as p, count(*) over (partition by line) as c from mes) select line, p::int as place, case when p <= 5 then row_id::varchar else '... ' || (c - 5)::varchar || ' more' end as cell from n where p <= 6")
def shown_rows(spark, sf_dir):
    return gov.shown_rows(table(spark, sf_dir, "mes"), ["line"], ["row_id"], "row_id", 5)


@query(REC + ", e as (select line, min(captured_at) as a, max(captured_at) as z from rec group by 1) select line, (a + i::int)::date as day from e, range(0, 400) t(i) where a + i::int <= z")
def production_days(spark, sf_dir):
    ends = to_records(table(spark, sf_dir, "manifest")).groupBy("line").agg(F.min("captured_at").alias("a"), F.max("captured_at").alias("z"))
    return gov.date_range(ends, ["line"], "a", "z")


@query("with t as (select lower(trim(ercd)) as term, object_name from mes where trim(ercd) <> '') select term, string_agg(distinct object_name, ',' order by object_name) as aliases from t where object_name is not null group by 1 union all select distinct term, '' from t where term not in (select term from t where object_name is not null)")
def merged_vocabulary(spark, sf_dir):
    m = table(spark, sf_dir, "mes").select(F.lower(F.trim("ercd")).alias("term"), "object_name").where("term <> ''")
    return gov.merged_vocabulary(m, "term", "object_name")


@query(REC + r""", f as (select line, min_by(object_name, row_id) as object_name from rec where line is not null group by 1)
select d.doc_id as report_id, d.line, case when contains(regexp_replace(lower(d.text), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(f.object_name), '[^\p{L}\p{N}]', '', 'g')) then f.object_name end as object_name from documents d left join f using (line)""")
def resolved_objects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "line", F.col("text").alias("words"))
    return gov.first_object(to_records(table(spark, sf_dir, "manifest")), d)


_BLOCK = f"""with s as (select {sql_folded("bank_version")} as bank_version, max(detection_rate) as detection_rate, min(false_positive_rate) as false_positive_rate from sweep_points group by 1),
v as (select {sql_folded("bank_version")} as bank_version, image, score from inference_results where score is not null and score::varchar <> 'nan' and bank_version is not null),
m as (select bank_version, count(*) filter (score >= 2 and score < 2.2) as missed from v group by 1), r as (select bank_version, image, count(*) as runs, count(distinct score) as outcomes from v group by all), u as (select bank_version, bool_and(outcomes = 1) as ok from r where runs >= 2 group by 1)
select bank_version, 'gate: detection_rate' as reason from s where not coalesce(detection_rate >= 0.9, false) union all select bank_version, 'gate: false_positive_rate' from s where not coalesce(false_positive_rate <= 0.05, false)
union all select bank_version, 'newly missed: ' || missed::varchar from m where missed > 0 union all select bank_version, 'not reproducible' from u where not ok"""


@query(_BLOCK)
def release_blocks(spark, sf_dir):
    k = folded(F.col("bank_version")).alias("bank_version")
    points = table(spark, sf_dir, "sweep_points").groupBy(k).agg(F.max("detection_rate").alias("detection_rate"), F.min("false_positive_rate").alias("false_positive_rate"))
    r = table(spark, sf_dir, "inference_results").where("score is not null and not isnan(score) and bank_version is not null").select(k, "result_id", "image", "score")
    v = lambda t: r.select("bank_version", "result_id", F.when(F.col("score") >= t, "defect").otherwise("pass").alias("verdict"))
    shadow = versions.agreement_report(versions.agreements(v(2.0), v(2.2), ["bank_version", "result_id"]), ["bank_version"])
    runs = versions.reproducible(r, ["bank_version", "image"], F.col("score")).where("runs >= 2").groupBy("bank_version").agg(F.bool_and("reproducible").alias("reproducible"))
    return gov.blocking_reasons(versions.gate(points, _LIMITS, ["bank_version"]), shadow, runs, ["bank_version"])


@query(_DECIDE + "select count(*) as cases, count(*) filter (needs_rebuild) / count(*) as rebuild_rate, count(*) * 4.0::double as hours_before, count(*) * 0.5::double as hours_after, (count(*) * 4.0::double - count(*) * 0.5::double) / (count(*) * 4.0::double) as saved_share from r")
def impact_estimate(spark, sf_dir):
    return gov.impact(dc.decide(_cases(spark)[0]), [], F.col("needs_rebuild"), 4.0, 0.5)


@query(_CELLS + "select row, count(distinct map) as images, count(distinct map) >= 8 as attach from cells group by 1")
def attachable_baselines(spark, sf_dir):
    return gov.attachable(_cells(spark, sf_dir), ["row"], "map")


@query(REC + """, c as (select line, object_name, list(distinct captured_at::varchar) as d, list(distinct equipment) as e from rec where split = 'bank' group by all)
select r.row_id, concat_ws(',', case when not coalesce(list_contains(c.d, r.captured_at::varchar), true) or (r.captured_at is not null and not coalesce(list_contains(c.d, r.captured_at::varchar), false)) then 'date' end,
 case when r.equipment is not null and not coalesce(list_contains(c.e, r.equipment), false) then 'equipment' end) as missing from rec r join c using (line, object_name) where r.split = 'holdout'""")
def missing_axes(spark, sf_dir):
    r = to_records(table(spark, sf_dir, "manifest"))
    both = r.where("split = 'holdout'").join(lookups.small(dist.conditions(r)), ["line", "object_name"])
    asked = F.create_map(F.lit("date"), F.col("captured_at").cast("string"), F.lit("equipment"), F.col("equipment"), F.lit("lot"), F.col("lot"))
    return both.select("row_id", F.array_join(F.array_sort(F.map_keys(dc.missing_axes(F.col("conditions"), asked))), ",").alias("missing"))


@query("with m as (select result_id, grid_h, grid_w, unnest(matches) as x from inference_results), c as (select result_id, x.q_index as q_index, greatest(x.q_row - 2, 0) as r0, greatest(x.q_col - 2, 0) as c0, least(x.q_row + 2, grid_h - 1) as r1, least(x.q_col + 2, grid_w - 1) as c1, grid_h as h, grid_w as w from m where x.q_row >= 0 and x.q_row < grid_h and x.q_col >= 0 and x.q_col < grid_w) select result_id, q_index, least(round_even(c0 * 512::double / w, 0)::int, 511) as x0, least(round_even(r0 * 512::double / h, 0)::int, 511) as y0, round_even((c1 + 1) * 512::double / w, 0)::int as x1, round_even((r1 + 1) * 512::double / h, 0)::int as y1 from c")
def context_boxes(spark, sf_dir):
    m = table(spark, sf_dir, "inference_results").select("result_id", "grid_h", "grid_w", F.explode("matches").alias("x"))
    inside = "x.q_row >= 0 and x.q_row < grid_h and x.q_col >= 0 and x.q_col < grid_w"
    b = grid.context_box(F.col("x.q_row"), F.col("x.q_col"), F.col("grid_h"), F.col("grid_w"), 512, 512)
    return m.where(inside).select("result_id", "x.q_index", b.alias("b")).select("result_id", "q_index", "b.*")


@query(_CELLS + ", b as (select map, greatest(min(row) - 1, 0) as row0, greatest(min(col) - 1, 0) as col0, max(row) + 1 as row1, max(col) + 1 as col1 from cells where value >= 200 group by 1), k as (select map, row, col from cells where value >= 150) select k.map, bool_or(row = (row0 + row1) // 2 and col = (col0 + col1) // 2) as centre_hit, count(*) filter (row between row0 and row1 and col between col0 and col1) / count(*) as captured, count(*) filter (row between row0 and row1 and col between col0 and col1) > 0 as any_hit from k join b using (map) group by 1")
def crop_overlap(spark, sf_dir):
    c = cut(_cells(spark, sf_dir))
    return grid.overlap_with_mask(grid.mask_box(c, ["map"], 200.0, 1), c.where("value >= 150").select("map", "row", "col"), ["map"])


_ANSWERS = ['{"verdict": "Defect", "confidence": 0.7}', '```json\n{"verdict": "genuine_normal", "confidence": 3}\n```', "no idea", '{"verdict": "maybe"}', '{"confidence": -1}']


@query("select * from (values (1, 'defect', 0.7::double, 'defect', 'bank_contamination'), (2, 'genuine_normal', 1.0, 'normal', 'normal_overlap'), (3, 'unknown', null, 'withheld', null), (4, 'unknown', null, 'withheld', null), (5, 'unknown', 0.0, 'withheld', null)) t(id, verdict, confidence, axis, cause)")
def parsed_answers(spark, sf_dir):
    a = spark.createDataFrame(list(enumerate(_ANSWERS, 1)), "id int, answer string")
    v = a.select("id", tx.parsed_verdict(F.col("answer"), ["defect", "genuine_normal"]).alias("x")).select("id", "x.*")
    return v.withColumn("axis", tx.common_axis(F.col("verdict"), ["defect"], ["genuine_normal"])).withColumn("cause", gov.patch_cause(F.col("verdict")))


@query(_DECIDE + "select case_id, case when sweep is null then 'no record' when sweep::boolean then 'yes' else 'no' end as sweep, case when position = 'above' then position else 'no record' end as position from c")
def rendered_evidence(spark, sf_dir):
    cases, _ = _cases(spark)
    return cases.select("case_id", tx.rendered(F.col("sweep_achievable")).alias("sweep"), tx.rendered(dc.usable(F.col("position"), F.col("position") == "above")).alias("position"))
