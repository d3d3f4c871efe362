"""Text, decision, source and streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.functions import text as tx
from lotmill.functions.names import folded, sql_folded
from lotmill.operators import decide as dc
from lotmill.operators import distribution as dist
from lotmill.operators import knn
from lotmill.operators.records import to_records
from lotmill.plans import bank_queries as banks
from lotmill.plans import lookup_queries as lookups
from lotmill.session import cut, new_table_path, table
from lotmill.sources import files
from lotmill.streaming import inspection

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select distinct doc_id, x as product_id from (select doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9-]+')) as x from documents) where regexp_matches(x, '^[A-Za-z]') and contains(x, '-') and not contains(x, '--') and not ends_with(x, '-') and regexp_matches(x, '[0-9]') and not starts_with(upper(x), 'LOT-')")
def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(tx.product_ids(F.col("text"))).alias("product_id")).distinct()


@query("select distinct line, case when regexp_extract(line, '(\\d{1,3})', 1) <> '' then printf('line_%02d', regexp_extract(line, '(\\d{1,3})', 1)::int) end as line_name, regexp_matches(line, '^[a-z][a-z0-9_]*$') as identifier from mes")
def line_names(spark, sf_dir):
    return table(spark, sf_dir, "mes").select("line", tx.line_name(F.col("line")).alias("line_name"), tx.is_identifier(F.col("line")).alias("identifier")).distinct()


_VOCAB = [("scratch", "scratches"), ("scratch", "kratzer"), ("foreign fibre", "faser"), ("bent pin", "핀 휨"), ("solder", "excess solder"), ("solder", "납 과다"), ("discolouration", "변색"), ("chipped corner", "모서리 깨짐")]
_VOCAB_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _VOCAB) + ") v(term, alias)"


@query(f"""with h as (select doc_id, term, case when lower(text) = lower(term) then 1 when contains(lower(text), lower(alias)) then 2 when contains(lower(text), lower(term)) then 3 end as stage,
 case when lower(text) = lower(term) then length(term) when contains(lower(text), lower(alias)) then length(alias) else length(term) end as len from documents, {_VOCAB_SQL})
select doc_id, term, stage::int as stage from (select *, row_number() over (partition by doc_id order by stage, len desc, term) as rn from h where stage is not null) where rn = 1""")
def defect_terms(spark, sf_dir):
    vocabulary = spark.createDataFrame(_VOCAB, "term string, alias string")
    return tx.match_terms(table(spark, sf_dir, "documents"), vocabulary, "doc_id", "text")


@query("select event_id, json_extract_string(case when regexp_extract(props, '(?s)(\\{.*\\})', 1) <> '' then regexp_extract(props, '(?s)(\\{.*\\})', 1) else '{}' end, '$.k') as k from events")
def json_lenient(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.lenient_json(F.col("props"), "k").alias("k"))


@query(f"""with v as (select distinct {sql_folded("bank_version")} as v from inference_results where bank_version is not null)
select v as version, case when regexp_matches(v, 'v\\d+$') then regexp_replace(v, '\\d+$', '') || (regexp_extract(v, 'v(\\d{{1,9}})$', 1)::int + 1)::varchar else v || '-rebuilt' end as next_version,
 v || '_20250304-0506_' || substr(sha256('{{"k":9}}'), 1, 6) as folder from v""")
def version_names(spark, sf_dir):
    v = table(spark, sf_dir, "inference_results").where("bank_version is not null").select(folded(F.col("bank_version")).alias("version")).distinct()
    at = F.lit("2025-03-04 05:06:07").cast("timestamp")
    return v.select("version", tx.next_version(F.col("version")).alias("next_version"), tx.folder_name(F.col("version"), at, F.lit('{"k":9}')).alias("folder"))


@query("""with e as (select distinct ercd, line from mes where line is not null)
select ercd, line, case when ercd is null then '0000' when ercd = 'E1' then '0100' else printf('ESB%02d', (('0x' || substr(sha256(ercd), 1, 16))::ubigint % 100)::int) end as code,
 'EQ-' || split_part(line, '_', -1) || '-' || (('0x' || substr(sha256(concat_ws('||', line, ercd)), 1, 16))::ubigint % 4)::varchar as equipment from e""")
def hashed_codes(spark, sf_dir):
    e = table(spark, sf_dir, "mes").where("line is not null").select("ercd", "line").distinct()
    return e.select("ercd", "line", tx.error_code(F.col("ercd"), {"E1": "0100"}).alias("code"), tx.equipment_id(F.col("line"), F.col("ercd")).alias("equipment"))


@query(r"select row_id, regexp_extract(image_path, '(?:^|[/\\])([^/\\]+(?:[/\\][^/\\]+)?)$', 1) as shown, case when starts_with(image_path, 'data/factory/') then substr(image_path, 14) else image_path end as relative, 'APR-' || case when regexp_extract(lot_id, '-(\d+)$', 1) <> '' then regexp_extract(lot_id, '-(\d+)$', 1) else substr(sha1(coalesce(line, '')), 1, 6) end as document_no from manifest where image_path is not null")
def display_names(spark, sf_dir):
    m = table(spark, sf_dir, "manifest").where("image_path is not null")
    return m.select("row_id", tx.display_path(F.col("image_path")).alias("shown"), tx.relative_path(F.col("image_path"), "data/factory/").alias("relative"), tx.document_number(F.coalesce("lot_id", F.lit("")), F.col("line")).alias("document_no"))


@query("select result_id, case when score is null or score::varchar = 'nan' then 'no record' else printf('%.6f', score) end as shown from inference_results")
def display_numbers(spark, sf_dir):
    return table(spark, sf_dir, "inference_results").select("result_id", tx.display_number(F.col("score"), 6).alias("shown"))


# What an equal object, defect type and line add to a similarity.
_W = {"object_name": 0.45, "defect_type": 0.40, "line": 0.15}


@query("""with i as (select p_partkey as issue_id, p_brand as object_name, p_type as defect_type, p_size::varchar as line from part), p as (select issue_id as probe_id, object_name, defect_type, line from i where issue_id % 20 = 0),
s as (select probe_id, issue_id, round((case when i.object_name = p.object_name then 0.45::double else 0 end) + (case when i.defect_type = p.defect_type then 0.4::double else 0 end) + (case when i.line = p.line then 0.15::double else 0 end), 4) as similarity,
 concat_ws(',', case when i.object_name = p.object_name then 'object_name' end, case when i.defect_type = p.defect_type then 'defect_type' end, case when i.line = p.line then 'line' end) as matched_on from p, i)
select probe_id, issue_id, similarity, matched_on, place::int as place from (select *, row_number() over (partition by probe_id order by similarity desc, issue_id) as place from s where similarity > 0) where place <= 5""")
def similar_issues(spark, sf_dir):
    """The five most similar issues of every probe; probes are the ids divisible by 20, searched in all issues."""
    issues = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("issue_id"), F.col("p_brand").alias("object_name"), F.col("p_type").alias("defect_type"), F.col("p_size").cast("string").alias("line"))
    return tx.similar(issues, issues.where("issue_id % 20 = 0").withColumnRenamed("issue_id", "probe_id"), _W)


# The documented cases, (ids, visible, quality ok, position, patch defect, coverage, criteria, sweep achievable, expected cause).
CASES = [
    (["TH-001", "TH-003"], True, True, "below", False, True, "defect", True, "threshold"),
    (["TH-002", "TH-004"], True, True, "near", False, True, "defect", True, "threshold"),
    (["BC-001", "BC-002", "BC-003", "BC-004"], True, True, "below", True, True, "defect", None, "bank_contamination"),
    (["CV-001", "CV-002", "CV-003", "CV-004"], True, True, "below", False, False, "defect", None, "coverage_gap"),
    (["NO-001"], True, True, "below", False, True, "review", False, "normal_overlap"),
    (["NO-002", "NO-003"], False, True, "below", False, True, "pass", False, "normal_overlap"),
    (["NO-004"], True, True, "near", False, True, "review", False, "normal_overlap"),
    (["EQ-001", "EQ-002", "EQ-004"], True, False, "below", False, True, "defect", None, "equipment_optics"),
    (["EQ-003"], True, False, "near", False, True, "defect", None, "equipment_optics"),
    (["CR-001", "CR-002", "CR-003", "CR-004"], True, True, "above", True, True, "pass", None, "criteria"),
]


# Cases of our own for what the documented ones do not reach: (id, similarity, visible, quality ok, position, nearest, patch defect, coverage, criteria, sweep achievable).
MORE = [
    ("MORE-01", 0.85, None, False, None, None, None, None, None, None),
    ("MORE-02", 0.84, False, False, None, None, None, None, None, None),
    ("MORE-03", None, None, None, "below", True, False, None, None, True),
    ("MORE-04", None, None, True, None, False, True, True, None, None),
    ("MORE-05", None, None, True, None, None, None, True, None, None),
    ("MORE-06", None, True, None, "near", True, None, False, None, True),
    ("MORE-07", None, True, None, "near", True, None, None, None, True),
    ("MORE-08", None, None, None, None, True, False, True, "review", None),
    ("MORE-09", None, None, None, "near", True, False, None, None, None),
    ("MORE-10", None, None, None, None, True, False, None, None, None),
    ("MORE-11", None, None, True, "above", False, None, None, "pass", None),
]


def _flat():
    return [(i, None, v, q, p, True, d, c, k, s, e) for ids, v, q, p, d, c, k, s, e in CASES for i in ids] + [(*x, None) for x in MORE]


def _cases(spark):
    rows = spark.createDataFrame(_flat(), dc.EVIDENCE + ", expected_cause string")
    return rows.drop("expected_cause"), rows.select("case_id", "expected_cause").where("expected_cause is not null")


def _lit(v):
    return "null" if v is None else str(v).lower() if isinstance(v, (bool, float)) else f"'{v}'"


def _decided(source: str) -> str:
    """The decision of the rows of ``source`` (case_id, dup, visible, quality, position, nearest, patch, coverage, criteria, sweep, expected), as ``r``."""
    return f"""d as (select case_id, expected, case when dup::double >= 0.85 then 'duplicate||high|f|' when visible is false then 'withheld|||t|' when quality is false then 'decided|equipment_optics|high|f|' when position = 'above' and criteria = 'pass' then 'decided|criteria|high|f|'
 when nearest is not true then 'withheld|||t|bank_contamination,coverage_gap,normal_overlap,threshold' when patch then 'decided|bank_contamination|high|f|' when patch is null and coverage is false then 'withheld|||t|bank_contamination,normal_overlap,coverage_gap'
 when patch is null then 'withheld|||t|bank_contamination,normal_overlap' when coverage is false then 'decided|coverage_gap|high|f|'
 when sweep::boolean then 'decided|threshold|high|f|' when sweep::boolean is false then 'decided|normal_overlap|high|f|' when criteria = 'defect' then 'decided|threshold|low|t|' when criteria in ('review', 'pass') then 'decided|normal_overlap|low|t|'
 when position = 'near' then 'decided|threshold|low|t|' else 'decided|normal_overlap|medium|t|' end as x from {source}),
r as (select case_id, expected, split_part(x, '|', 1) as outcome, nullif(split_part(x, '|', 2), '') as cause, nullif(split_part(x, '|', 3), '') as confidence, split_part(x, '|', 4) = 't' as needs_human,
 coalesce(nullif(split_part(x, '|', 2), '') in ('bank_contamination', 'coverage_gap'), false) as needs_rebuild, split_part(x, '|', 5) as candidates from d)
"""


_DECIDE = "with c(case_id, dup, visible, quality, position, nearest, patch, coverage, criteria, sweep, expected) as (values " + ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in _flat()) + "),\n" + _decided("c")


@query(_DECIDE + "select * exclude (expected) from r")
def decide_cases(spark, sf_dir):
    """The documented cases and some of our own; a fixture, the same at every size. diagnosed_rows decides over the tables."""
    return dc.decide(_cases(spark)[0]).withColumn("candidates", F.array_join("candidates", ","))


@query(_DECIDE + "select count(*) as cases, count(*) filter (outcome = 'decided') as decided, count(*) filter (cause = expected) as right, count(*) filter (cause = expected) / count(*) as accuracy, count(*) filter (needs_rebuild = (expected in ('bank_contamination', 'coverage_gap'))) as rebuild_agrees from r where expected is not null")
def decide_accuracy(spark, sf_dir):
    cases, truth = _cases(spark)
    return dc.scored(dc.decide(cases), truth)


_DIAG = lookups.REC + f""", b as (select line, object_name, list(distinct captured_at::varchar) filter (captured_at is not null) as d, list(distinct equipment) filter (equipment is not null) as e from rec where split = 'bank' group by all),
t as (select path, bool_or(truth = 'defect') as is_defect from rec where truth is not null and path is not null group by path),
p as (select {sql_folded("bank_version")} as k, * from sweep_points where bank_version is not null), w as (select k, threshold, false_positive_rate as f, row_number() over (partition by k order by threshold desc, false_positive_rate desc) as rn from p where detection_rate >= 1 - 1e-9 and threshold is not null and false_positive_rate is not null),
a as (select distinct p.k, coalesce(w.f <= 0.05, false) as achievable from p left join w on w.k = p.k and w.rn = 1),
m as (select i.result_id::varchar || '-' || r.row_id::varchar as case_id, r.*, i.score, i.max_patch_distance as area, matches[1].bank_image as top_image, {sql_folded("i.bank_version")} as k from rec r join inference_results i on i.image = r.path where r.truth = 'defect' and i.score < 2 and i.score::varchar <> 'nan'),
v as (select m.case_id, m.line, m.object_name, m.captured_at, m.equipment, case when b.d is null or m.captured_at is null then null else list_contains(b.d, m.captured_at::varchar) end as on_date, case when b.e is null or m.equipment is null then null else list_contains(b.e, m.equipment) end as on_equipment,
  case when m.score >= 0.9 * 2 then 'near' else 'below' end as position, m.top_image is not null as nearest, t.is_defect as patch, case when area is not null then case when area >= 2.5 then 'defect' when area >= 1.5 then 'review' else 'pass' end end as criteria, a.achievable as sweep
  from m left join b on b.line = m.line and b.object_name = m.object_name left join t on t.path = m.top_image left join a on a.k = m.k),
c as (select *, null as dup, null::boolean as visible, null::boolean as quality, case when on_date is null and on_equipment is null then null else coalesce(on_date, true) and coalesce(on_equipment, true) end as coverage, concat_ws(',', case when not on_date then 'date' end, case when not on_equipment then 'equipment' end) as missing, null::varchar as expected from v),
"""


def _evidence(spark, sf_dir):
    """The evidence of every missed image: a defect of the catalogue that a bank scored below the threshold.

    Whether the defect can be seen and how good the picture is are judged by nobody in these tables and stay unknown; the nearest
    patch is judged by the label its image has in the catalogue.
    """
    r = to_records(table(spark, sf_dir, "manifest"))
    i = table(spark, sf_dir, "inference_results").where("score < 2 and not isnan(score)").select("result_id", F.col("image").alias("path"), folded(F.col("bank_version")).alias("bank_version"), "score", F.col("max_patch_distance").alias("area"), F.try_element_at("matches", F.lit(1))["bank_image"].alias("top_image"))
    asked = F.create_map(F.lit("date"), F.col("captured_at").cast("string"), F.lit("equipment"), F.col("equipment"), F.lit("lot"), F.col("lot"))
    missed = r.where("truth = 'defect'").join(i, "path").withColumn("asked", asked).withColumn("case_id", F.concat_ws("-", "result_id", "row_id"))
    missed = missed.withColumns({"threshold": F.lit(2.0), "defect_area": F.lit(2.5), "review_area": F.lit(1.5)})
    labels = r.where("truth is not null and path is not null").groupBy(F.col("path").alias("image")).agg(F.bool_or(F.col("truth") == "defect").alias("is_defect"))
    points = table(spark, sf_dir, "sweep_points").select(folded(F.col("bank_version")).alias("bank_version"), "threshold", "detection_rate", "false_positive_rate").where("bank_version is not null")
    ok = F.when((F.col("detection_rate") >= 1 - 1e-9) & F.col("threshold").isNotNull() & F.col("false_positive_rate").isNotNull(), F.struct("threshold", "false_positive_rate"))
    sweeps = points.groupBy("bank_version").agg(F.coalesce(F.max(ok)["false_positive_rate"] <= 0.05, F.lit(False)).alias("achievable"))
    return cut(dc.collect_evidence(cut(missed), cut(dist.conditions(r)), cut(sweeps), cut(labels)))


@query(_DIAG + _decided("c") + "select r.* exclude (expected), c.missing from r join c using (case_id)")
def diagnosed_rows(spark, sf_dir):
    """The cause of every missed image and the axes its bank lacks."""
    e = _evidence(spark, sf_dir)
    return dc.decide(e).join(e.select("case_id", F.array_join("missing_axes", ",").alias("missing")), "case_id").withColumn("candidates", F.array_join("candidates", ","))


@query(_DIAG + "z as (select 1) select case_id, x.i as item_no, x.n as name, x.v as value, x.v is not null as usable from (select case_id, unnest([{'i': 1, 'n': 'defect_visible', 'v': null::varchar}, {'i': 2, 'n': 'quality_within_baseline', 'v': null}, {'i': 3, 'n': 'score_position', 'v': position}, {'i': 4, 'n': 'nearest_patch', 'v': case when nearest then 'true' end}, {'i': 5, 'n': 'nearest_patch_is_defect', 'v': patch::varchar}, {'i': 6, 'n': 'coverage_present', 'v': coverage::varchar}, {'i': 7, 'n': 'criteria_verdict', 'v': criteria}]) as x from c)")
def evidence_items(spark, sf_dir):
    """Seven rows of evidence for every missed image."""
    return dc.evidence_rows(_evidence(spark, sf_dir))


@query("""with r as (select doc_id as report_id, line, object_name, nullif(regexp_extract(text, '(LOT-[A-Z]{3}-[0-9]{8})', 1), '') as lot, nullif(regexp_extract(text, '(img_[0-9]{4})', 1), '') as img from documents),
s as (select a.doc_id as report_id, min(b.doc_id) as issue_id from documents a join documents b on a.text = b.text and a.line = b.line and b.doc_id < a.doc_id where a.text <> '' group by 1)
select r.report_id, case when line is null or object_name is null or (lot is null and img is null) then 'need_more_info' when s.issue_id is not null then 'duplicate' else 'proceed' end as verdict,
 case when not (line is null or object_name is null or (lot is null and img is null)) then s.issue_id end as duplicate_of from r left join s using (report_id)""")
def intake_verdict(spark, sf_dir):
    """Covers equal texts only, as its SQL does: a report is a duplicate if an earlier one of its line has the same whole text.

    Similarity is then 1.0 and the issue taken as resolved; reports that are alike but differ in text (D4's 0.95) come out as proceed.
    """
    d = table(spark, sf_dir, "documents")
    lot, img = (F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ("(LOT-[A-Z]{3}-[0-9]{8})", "(img_[0-9]{4})"))
    reports = d.select(F.col("doc_id").alias("report_id"), "line", "object_name", img.isNotNull().cast("int").alias("attachments"), F.lit(None).cast("string").alias("product_id"), lot.alias("lot"))
    # an earlier report of the same line with the same text is the same issue: only the first of each text is paired
    keyed = d.where("text <> '' and line is not null").select("doc_id", "line", F.md5("text").alias("h"))
    first = keyed.groupBy("line", "h").agg(F.min("doc_id").alias("issue_id"))
    similar = keyed.join(first, ["line", "h"]).where("issue_id < doc_id").select(F.col("doc_id").alias("report_id"), "issue_id", F.lit(1.0).alias("similarity"), F.lit(True).alias("same_line"), F.lit(True).alias("resolved"))
    return dc.intake(reports, similar)


_REMOVE = banks._IMG + f""", h as (select {sql_folded("bank_version")} as bank_version, matches[1].bank_image as bank_image from inference_results where len(matches) > 0 and score < 2 and bank_version is not null),
n as (select *, count(*) as hits from h where bank_image is not null group by all),
j as (select n.*, round(i.z_mean, 6) as z, 1 + coalesce((round(i.z_mean, 6) >= 1)::int, 0) as evidence_count from n left join i on n.bank_version = i.key and n.bank_image = i.source_image),
o as (select bank_version, bank_image, hits, z, evidence_count, place::int as place from (select *, row_number() over (partition by bank_version order by evidence_count desc, hits desc, coalesce(z, 0) desc, bank_image) as place from j) where place <= 10)"""


@query(_REMOVE + " select * from o")
def removal_candidates(spark, sf_dir):
    """Images that missed results point at, annotated by the mean isolation z of their rows in the bank; null where the bank is too small or lacks the image."""
    r = table(spark, sf_dir, "inference_results").where("score < 2 and bank_version is not null and not isnan(score)").where(F.size("matches") > 0)
    hits = r.select(folded(F.col("bank_version")).alias("bank_version"), F.element_at("matches", 1)["bank_image"].alias("bank_image")).where("bank_image is not null")
    z = knn.image_isolation(*banks._isolated(spark, sf_dir)).select(F.col("key").alias("bank_version"), F.col("source_image").alias("bank_image"), F.round("z_mean", 6).alias("z"))
    return dc.removal_candidates(hits, z, ["bank_version"], "bank_image")


@query(_REMOVE + f""", p as (select {sql_folded("bank_version")} as bank_version, source_image as bank_image, count(*) as n from bank_patches where source_image is not null and bank_version is not null group by all),
w as (select bank_version, sum(n)::bigint as patches, count(*) as images from p group by 1),
h2 as (select o.bank_version, count(p.n) as removed_images, coalesce(sum(p.n), 0)::bigint as removed_patches, count(*) filter (o.evidence_count < 2) as weak from o left join p using (bank_version, bank_image) group by 1)
select h2.bank_version, removed_images, removed_patches, coalesce(patches, 0) as patches, coalesce(images, 0) as images, coalesce(removed_patches / patches, 0.0) as patch_share, coalesce(removed_patches / patches, 0.0) >= 0.20 as heavy, weak, weak > 0 or coalesce(removed_patches / patches, 0.0) >= 0.20 as needs_human from h2 left join w using (bank_version)""")
def removal_costs(spark, sf_dir):
    """What removing each bank's candidates would take out of it."""
    bank = table(spark, sf_dir, "bank_patches").where("bank_version is not null").select(folded(F.col("bank_version")).alias("bank_version"), F.col("source_image").alias("bank_image"))
    return dc.removal_cost(removal_candidates(spark, sf_dir), bank, ["bank_version"], "bank_image")


@query(_DIAG + _decided("c") + ", x as (select c.line, c.object_name, unnest([{'axis': 'date', 'value': case when not on_date then captured_at::varchar end}, {'axis': 'equipment', 'value': case when not on_equipment then equipment end}]) as m from r join c using (case_id) where cause = 'coverage_gap') select line, object_name, m.axis as axis, m.value as value, count(*) as cases, 20 as min_images from x where m.value is not null group by all")
def addition_requests(spark, sf_dir):
    """The conditions that missed images ask their banks to be filled up with."""
    e = _evidence(spark, sf_dir)
    return dc.additions(dc.decide(e), e)


_TERM = SQL["defect_terms"]


@query("with t as (" + _TERM + """), r as (select d.doc_id as report_id, line, object_name, t.term, nullif(regexp_extract(text, '(LOT-[A-Z]{3}-[0-9]{8})', 1), '') as lot, nullif(regexp_extract(text, '(img_[0-9]{4})', 1), '') as img from documents d left join t using (doc_id)),
s as (select report_id, min(report_id) over (partition by line, object_name, term) as issue_id from r where line <> '' and object_name <> '' and term <> ''),
p as (select report_id, issue_id from s where issue_id < report_id)
select r.report_id, case when line is null or object_name is null or (lot is null and img is null) then 'need_more_info' when p.issue_id is not null then 'duplicate' else 'proceed' end as verdict,
 case when not (line is null or object_name is null or (lot is null and img is null)) then p.issue_id end as duplicate_of from r left join p using (report_id)""")
def intake_similar(spark, sf_dir):
    """Intake over the similarity of issues: a report is a duplicate of the earliest one that shares object, defect type and line with it (0.95 or more).

    Past issues count as resolved. With these weights no two keys alone reach 0.95, so the most similar issue is the least id of the same three.
    """
    d = table(spark, sf_dir, "documents")
    lot, img = (F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ("(LOT-[A-Z]{3}-[0-9]{8})", "(img_[0-9]{4})"))
    reports = d.select(F.col("doc_id").alias("report_id"), "line", "object_name", img.isNotNull().cast("int").alias("attachments"), F.lit(None).cast("string").alias("product_id"), lot.alias("lot"))
    typed = cut(d.select("doc_id", "line", "object_name").join(defect_terms(spark, sf_dir).select("doc_id", F.col("term").alias("defect_type")), "doc_id", "left"))
    near = tx.similar(typed.withColumnRenamed("doc_id", "issue_id"), typed.withColumnRenamed("doc_id", "probe_id"), _W, 1)
    near = near.where("issue_id < probe_id").select(F.col("probe_id").alias("report_id"), "issue_id", "similarity", F.lit(True).alias("same_line"), F.lit(True).alias("resolved"))
    return dc.intake(reports, near)


@query("""with l as (select coalesce(lower(trim(split_part(coalesce(ercd, 'normal'), ',', 1))), 'normal') as f, line from mes) select line, case when f in ('normal', '') then 'normal' else 'anomaly' end as kind, count(*) as n from l group by all""")
def first_label_pools(spark, sf_dir):
    return files.first_labels(table(spark, sf_dir, "mes"), "line", "ercd")


@query("select distinct line, lower(trim(t)) as term from (select line, unnest(string_split(ercd, ',')) as t from mes) where trim(t) <> '' and lower(trim(t)) not in ('other', 'normal')")
def label_vocabulary(spark, sf_dir):
    return files.vocabulary(table(spark, sf_dir, "mes"), "line", "ercd")


@query("select row_id, lot_id, cell_id, started_at from mes")
def jsonl_round_trip(spark, sf_dir):
    """Appended as JSON lines and read back with a given schema."""
    path = new_table_path(spark, "jsonl")
    files.append_jsonl(table(spark, sf_dir, "mes").select("row_id", "lot_id", "cell_id", "started_at"), path)
    return files.read_jsonl(spark, path, "row_id bigint, lot_id string, cell_id string, started_at string")


# streams: drained once into a table of the shared folder, then read back ---------------------------------------
def _drain(spark, sf_dir, build, mode, name):
    path = new_table_path(spark, name)
    src = inspection.read_stream(spark, sf_dir, inspection.EVENTS.replace("timestamp", "timestamp_ntz"), "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # complete mode hands the whole result to each batch, so the last write is the answer
    out = build(src)
    q = out.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


@query("select event_type, time_bucket(interval 1 hour, ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, sf_dir):
    out = _drain(spark, sf_dir, lambda s: inspection.windowed(s, ["event_type"]), "complete", "tumbling")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("select time_bucket(interval 15 minutes, ts) - i * interval 15 minutes as window_start, count(*) as n, round(sum(value), 4) as total from events, range(4) t(i) group by 1")
def stream_sliding(spark, sf_dir):
    out = _drain(spark, sf_dir, lambda s: inspection.windowed(s, [], "1 hour", "15 minutes"), "complete", "sliding")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours, true) as first from events), s as (select *, sum(first::int) over (partition by user_id order by ts) as s from e) select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as n from s group by user_id, s")
def stream_sessions(spark, sf_dir):
    out = _drain(spark, sf_dir, lambda s: inspection.sessions(s, ["user_id"], "6 hours"), "complete", "sessions")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select event_id, ts from events")
def stream_once(spark, sf_dir):
    out = _drain(spark, sf_dir, lambda s: inspection.once(s.unionAll(s), ["event_id"]).select("event_id", "ts"), "append", "once")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
