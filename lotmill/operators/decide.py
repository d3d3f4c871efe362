"""Evidence in, cause out: one wide row per case, one CASE chain, dimension tables for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.records import area_verdict
from lotmill.operators.skew import skew_join

#: The causes, in the order of the documentation.
CAUSES = ["threshold", "bank_contamination", "coverage_gap", "normal_overlap", "equipment_optics", "criteria"]
#: Causes whose remedy is a rebuilt bank.
REBUILD = ["bank_contamination", "coverage_gap"]

#: Columns of a case; all may be null, and null means unknown, never false.
EVIDENCE = "case_id string, duplicate_similarity double, defect_visible boolean, quality_ok boolean, position string, has_nearest boolean, patch_is_defect boolean, coverage boolean, criteria_verdict string, sweep_achievable boolean"
#: The names of the seven checks, in their order.
CHECKS = ["defect_visible", "quality_within_baseline", "score_position", "nearest_patch", "nearest_patch_is_defect", "coverage_present", "criteria_verdict"]


def usable(value: Column, ok: Column) -> Column:
    """A check's value, null unless the check is usable."""
    return F.when(ok, value)


def collect_evidence(cases: DataFrame, conditions: DataFrame, sweeps: DataFrame, labels: DataFrame) -> DataFrame:
    """The EVIDENCE columns, ``line, object_name``, ``missing`` (map of axis to value) and ``missing_axes`` (its sorted keys) of each case, from tables.

    ``cases`` has (case_id string, line, object_name, bank_version, score, threshold, area, defect_area, review_area, top_image, asked
    map of axis to value) and, where they were judged, (duplicate_similarity, defect_visible, quality_ok); ``conditions``
    (line, object_name, conditions map of axis to values), ``sweeps`` (bank_version, achievable), ``labels`` (image, is_defect), each
    with one row a key. What a table does not have stays null. Coverage looks at every asked axis: axes that
    are not recorded or not asked for are left out, and without any other it is null.
    """
    given = [f.split()[0] for f in EVIDENCE.split(", ")[1:4]]
    kinds = {f.split()[0]: f.split()[1] for f in EVIDENCE.split(", ")}
    cases = cases.withColumns({c: F.lit(None).cast(kinds[c]) for c in given if c not in cases.columns})
    out = skew_join(cases, conditions.select("line", "object_name", "conditions"), ["line", "object_name"], F.col("case_id"), "left")
    out = skew_join(out, sweeps.select("bank_version", F.col("achievable").alias("sweep_achievable")), ["bank_version"], F.col("case_id"), "left")
    out = skew_join(out, labels.select(F.col("image").alias("top_image"), F.col("is_defect").alias("patch_is_defect")), ["top_image"], F.col("case_id"), "left")
    score = F.when(~F.isnan("score"), F.col("score"))
    known = F.map_filter("asked", lambda k, v: v.isNotNull() & F.element_at("conditions", k).isNotNull())
    lacking = F.map_filter(known, lambda k, v: ~F.array_contains(F.element_at("conditions", k), v))
    answered = F.coalesce(F.size(F.map_keys(known)), F.lit(0)) > 0
    out = out.withColumn("position", F.when(score >= F.col("threshold"), "above").when(score >= 0.9 * F.col("threshold"), "near").when(score < 0.9 * F.col("threshold"), "below"))
    out = out.withColumn("has_nearest", F.col("top_image").isNotNull()).withColumn("coverage", F.when(answered, F.size(F.map_keys(lacking)) == 0))
    verdict = F.when(F.col("area").isNotNull() & F.col("defect_area").isNotNull(), area_verdict(F.col("area"), F.col("defect_area"), F.col("review_area")))
    out = out.withColumn("criteria_verdict", verdict).withColumn("missing", lacking).withColumn("missing_axes", F.coalesce(F.array_sort(F.map_keys(lacking)), F.array().cast("array<string>")))
    return out.select(*(F.col(k).cast(v).alias(k) for k, v in kinds.items()), "line", "object_name", "missing", "missing_axes")


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """``case_id, item_no, name, value, usable``: seven rows for each case, those that could not be checked too."""
    cols = ["defect_visible", "quality_ok", "position", "has_nearest", "patch_is_defect", "coverage", "criteria_verdict"]
    value = lambda c: F.when(F.col(c), "true") if c == "has_nearest" else F.col(c).cast("string")
    items = F.array(*(F.struct(F.lit(i).alias("item_no"), F.lit(n).alias("name"), value(c).alias("value")) for i, (n, c) in enumerate(zip(CHECKS, cols, strict=True), 1)))
    return evidence.select("case_id", F.explode(items).alias("x")).select("case_id", "x.*").withColumn("usable", F.col("value").isNotNull())


def decide(cases: DataFrame, duplicate_at: float = 0.85) -> DataFrame:
    """``case_id, outcome, cause, confidence, needs_human, needs_rebuild, candidates`` of cases with the EVIDENCE columns.

    Evaluated in order: a duplicate; a defect that is seen not to be there is withheld; bad quality; above the threshold and passed by the
    criteria; no nearest patch is withheld; a defect in the patch; an unknown patch is withheld; for a genuine patch
    coverage, then the sweep, then the criteria, then the position. Unknown evidence never counts as a yes or a no.
    ``candidates`` are the causes that a withheld case is still open to.
    """
    c = F.col
    genuine = c("patch_is_defect") == F.lit(False)
    rules = [
        (c("duplicate_similarity") >= duplicate_at, "duplicate", None, "high", False, []),
        (~c("defect_visible"), "withheld", None, None, True, []),
        (~c("quality_ok"), "decided", "equipment_optics", "high", False, []),
        ((c("position") == "above") & (c("criteria_verdict") == "pass"), "decided", "criteria", "high", False, []),
        (c("has_nearest").isNull() | ~c("has_nearest"), "withheld", None, None, True, ["bank_contamination", "coverage_gap", "normal_overlap", "threshold"]),
        (c("patch_is_defect"), "decided", "bank_contamination", "high", False, []),
        (genuine & ~c("coverage"), "decided", "coverage_gap", "high", False, []),
        (genuine & c("sweep_achievable"), "decided", "threshold", "high", False, []),
        (genuine & ~c("sweep_achievable"), "decided", "normal_overlap", "high", False, []),
        (genuine & (c("criteria_verdict") == "defect"), "decided", "threshold", "low", True, []),
        (genuine & c("criteria_verdict").isin("review", "pass"), "decided", "normal_overlap", "low", True, []),
        (genuine & (c("position") == "near"), "decided", "threshold", "low", True, []),
        (genuine, "decided", "normal_overlap", "medium", True, []),
        (~c("coverage"), "withheld", None, None, True, ["bank_contamination", "normal_overlap", "coverage_gap"]),
    ]

    def result(outcome: str, cause: str | None, confidence: str | None, human: bool, candidates: list[str]) -> Column:
        open_ = F.array(*(F.lit(x) for x in candidates)).cast("array<string>")
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(cause).cast("string").alias("cause"), F.lit(confidence).cast("string").alias("confidence"), F.lit(human).alias("needs_human"), open_.alias("candidates"))

    pick = None
    for when, *rest in rules:
        pick = F.when(when, result(*rest)) if pick is None else pick.when(when, result(*rest))
    out = cases.select("case_id", pick.otherwise(result("withheld", None, None, True, ["bank_contamination", "normal_overlap"])).alias("x")).select("case_id", "x.*")
    return out.select("case_id", "outcome", "cause", "confidence", "needs_human", F.coalesce(c("cause").isin(*REBUILD), F.lit(False)).alias("needs_rebuild"), "candidates")


def scored(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """``cases, decided, right, accuracy, rebuild_agrees`` against (case_id, expected_cause)."""
    both = decided.join(truth, "case_id")
    right = F.count_if(F.col("cause") == F.col("expected_cause"))
    want = F.col("expected_cause").isin(*REBUILD)
    return both.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("outcome") == "decided").alias("decided"), right.alias("right"), (right / F.count(F.lit(1))).alias("accuracy"), F.count_if(F.col("needs_rebuild") == want).alias("rebuild_agrees"))


def intake(reports: DataFrame, similar: DataFrame, duplicate_at: float = 0.95) -> DataFrame:
    """``report_id, verdict, duplicate_of``: need_more_info without line, object, or anything to look at; duplicate of a resolved similar issue; else proceed.

    ``similar`` has (report_id, issue_id, similarity, same_line, resolved); the most similar counts, then the lesser id.
    """
    dup = similar.where(F.col("same_line") & F.col("resolved") & (F.col("similarity") >= duplicate_at)).groupBy("report_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "issue_id")).alias("x")).select("report_id", F.col("x.issue_id").alias("duplicate_of"))
    bare = F.col("line").isNull() | F.col("object_name").isNull() | (F.coalesce(F.col("attachments"), F.lit(0)) + F.col("product_id").isNotNull().cast("int") + F.col("lot").isNotNull().cast("int") == 0)
    out = reports.join(dup, "report_id", "left")
    verdict = F.when(bare, "need_more_info").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("proceed")
    return out.select("report_id", verdict.alias("verdict"), F.when(verdict == "duplicate", F.col("duplicate_of")).alias("duplicate_of"))


def missing_axes(conditions: Column, asked: Column) -> Column:
    """Map of asked axes (axis to value) that are recorded and do not hold the value; axes that are not recorded are unknown, not missing."""
    return F.map_filter(asked, lambda k, v: F.coalesce(~F.array_contains(F.element_at(conditions, k), v), F.lit(False)))


def removal_candidates(hits: DataFrame, isolation: DataFrame, by: list[str], image: str, top: int = 10) -> DataFrame:
    """``by, image, hits, z, evidence_count, place``: images that missed results point at, annotated by isolation, at most ``top`` of each group.

    Isolation adds evidence to candidates (z of at least 1), never candidates of its own.
    """
    n = hits.groupBy(*by, image).agg(F.count(F.lit(1)).alias("hits"))
    out = n.join(isolation.select(*by, image, "z"), [*by, image], "left")
    out = out.withColumn("evidence_count", 1 + F.coalesce((F.col("z") >= 1).cast("int"), F.lit(0)))
    w = Window.partitionBy(*by).orderBy(F.desc("evidence_count"), F.desc("hits"), F.desc(F.coalesce("z", F.lit(0.0))), image)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def additions(decided: DataFrame, evidence: DataFrame, least: int = 20) -> DataFrame:
    """``line, object_name, axis, value, cases, min_images``: what cases decided as a coverage gap ask to be added to their bank, one row a missing condition."""
    gaps = decided.where("cause = 'coverage_gap'").select("case_id").join(evidence.select("case_id", "line", "object_name", "missing"), "case_id")
    each = gaps.select("line", "object_name", F.explode("missing").alias("axis", "value"))
    return each.groupBy("line", "object_name", "axis", "value").agg(F.count(F.lit(1)).alias("cases"), F.lit(least).alias("min_images"))


def removal_cost(candidates: DataFrame, bank: DataFrame, by: list[str], image: str, heavy_at: float = 0.20) -> DataFrame:
    """``by, removed_images, removed_patches, patches, images, patch_share, heavy, weak, needs_human`` of removing the candidates of each group.

    ``bank`` has a row a patch (by, image); candidates that the bank does not have cost nothing. A person is needed
    where the share of patches is ``heavy_at`` or more, or any candidate rests on one piece of evidence.
    """
    own = bank.where(F.col(image).isNotNull()).groupBy(*by, image).agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy(*by).agg(F.sum("n").alias("patches"), F.count(F.lit(1)).alias("images"))
    hit = candidates.join(own, [*by, image], "left").groupBy(*by).agg(F.count("n").alias("removed_images"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("removed_patches"), F.count_if(F.col("evidence_count") < 2).alias("weak"))
    out = hit.join(whole, by, "left").withColumn("patch_share", F.coalesce(F.col("removed_patches") / F.col("patches"), F.lit(0.0)))
    out = out.withColumn("heavy", F.col("patch_share") >= heavy_at).withColumn("needs_human", (F.col("weak") > 0) | F.col("heavy"))
    return out.select(*by, "removed_images", "removed_patches", F.coalesce("patches", F.lit(0)).cast("bigint").alias("patches"), F.coalesce("images", F.lit(0)).cast("bigint").alias("images"), "patch_share", "heavy", "weak", "needs_human")
