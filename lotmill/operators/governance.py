"""Pointers, action tables, upserts, truncated displays and the reasons that block a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.lookups import small


def current_folders(pointers: DataFrame, folders: DataFrame, by: list[str]) -> DataFrame:
    """``by, folder, version``: the folder each pointer names; nulls where the pointer is stale or there is none. Pointers: (by, folder)."""
    there = folders.select(*by, "folder", "version").distinct()
    return pointers.join(there, [*by, "folder"], "left").select(*by, F.when(F.col("version").isNotNull(), F.col("folder")).alias("folder"), "version")


def finalized(decided: DataFrame, actions: DataFrame) -> DataFrame:
    """``case_id, cause, recommended, forbidden``: the action lists of a decided case's cause.

    A duplicate asks for a look at the past issue, a case withheld without candidates for the right picture; other cases
    without cause have empty lists. ``actions`` is a dimension (cause, recommended array, forbidden array), counted before it is broadcast.
    """
    none = F.array().cast("array<string>")
    own = F.when(F.col("outcome") == "duplicate", F.array(F.lit("review_past_issue"))).when((F.col("outcome") == "withheld") & (F.size("candidates") == 0), F.array(F.lit("request_correct_image"))).otherwise(none)
    out = decided.select("case_id", "cause", "outcome", "candidates").join(small(actions), "cause", "left")
    return out.select("case_id", "cause", F.coalesce("recommended", own).alias("recommended"), F.coalesce("forbidden", none).alias("forbidden"))


def violations(recommended: DataFrame, truth: DataFrame) -> DataFrame:
    """``case_id, forbidden_actions``: how many recommended actions a case's own truth (case_id, forbidden) rules out."""
    both = recommended.select("case_id", "recommended").join(truth.select("case_id", "forbidden"), "case_id")
    return both.select("case_id", F.size(F.array_intersect("recommended", "forbidden")).alias("forbidden_actions"))


def frequencies(rows: DataFrame, key: str, expected: list[str], target: int) -> DataFrame:
    """``key, n, short``: count of each expected value, those that never occur included, and whether it is under the target."""
    want = rows.sparkSession.createDataFrame([(k,) for k in expected], f"{key} string")
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = want.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.withColumn("short", F.col("n") < target)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of the non-null keys that occur more than once."""
    ok = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the rows of ``changes`` in place of those with the same key, or added; null keys are only ever added."""
    stay = rows.join(changes.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return stay.select(*rows.columns).unionByName(changes.select(*rows.columns))


def newest(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``key, values`` of each key's last row in ``order``, by a map-side combined maximum rather than a sort."""
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("x"))
    return best.select(*key, *(F.col(f"x.{v}").alias(v) for v in values))


def shown_rows(rows: DataFrame, by: list[str], order: list[str], cells: str, limit: int) -> DataFrame:
    """``by, place, cell``: the first ``limit`` cells of each group and, where more are left, one row that says how many."""
    w = Window.partitionBy(*by)
    head = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= limit).select(*by, "place", F.col(cells).cast("string").alias("cell"))
    more = rows.groupBy(*by).agg((F.count(F.lit(1)) - limit).alias("n")).where("n > 0")
    rest = more.select(*by, F.lit(limit + 1).alias("place"), F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" more")).alias("cell"))
    return head.unionByName(rest)


def date_range(rows: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """``by, day``: each day from first to last, both included; none if either is null or they are reversed."""
    ok = rows.where((F.col(first) <= F.col(last)))
    return ok.select(*by, F.explode(F.sequence(F.col(first), F.col(last))).alias("day"))


def merged_vocabulary(rows: DataFrame, term: str, alias: str) -> DataFrame:
    """``term, aliases``: all aliases of a term over all objects, distinct, sorted and joined; nulls are ignored."""
    return rows.where(F.col(term).isNotNull()).groupBy(term).agg(F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"))


def first_object(records: DataFrame, spoken: DataFrame) -> DataFrame:
    """``report_id, line, object_name``: the object of the first record (by row id) of the spoken line, if the spoken words mention it.

    ``spoken`` has (report_id, line, words). Signs and case are ignored on both sides; without a mention the object is null.
    """
    first = records.where("line is not null").groupBy("line").agg(F.min_by("object_name", "row_id").alias("object_name"))
    both = spoken.join(small(first), "line", "left")
    squeezed = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    said = squeezed(F.col("words")).contains(squeezed(F.col("object_name")))
    return both.select("report_id", "line", F.when(said, F.col("object_name")).alias("object_name"))


def blocking_reasons(gate: DataFrame, shadow: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """``by, reason``: failed checks, newly missed images and outcomes that are not reproducible; a group without any has no row."""
    failed = gate.where("not passed").select(*by, F.concat(F.lit("gate: "), "check_name").alias("reason"))
    missed = shadow.where("newly_missed > 0").select(*by, F.concat(F.lit("newly missed: "), F.col("newly_missed").cast("string")).alias("reason"))
    unsure = runs.where("not reproducible").select(*by, F.lit("not reproducible").alias("reason"))
    return failed.unionByName(missed).unionByName(unsure)


def impact(cases: DataFrame, by: list[str], rebuild: Column, hours_before: float, hours_after: float) -> DataFrame:
    """``by, cases, rebuild_rate, hours_before, hours_after, saved_share``: plain arithmetic on counted cases."""
    out = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(rebuild).alias("rebuilds"))
    before, after = F.col("cases") * F.lit(hours_before), F.col("cases") * F.lit(hours_after)
    return out.select(*by, "cases", (F.col("rebuilds") / F.col("cases")).alias("rebuild_rate"), before.alias("hours_before"), after.alias("hours_after"), ((before - after) / before).alias("saved_share"))


def attachable(maps: DataFrame, by: list[str], image: str, least: int = 8) -> DataFrame:
    """``by, images, attach``: whether there are maps of enough distinct images for a baseline."""
    return maps.groupBy(*by).agg(F.countDistinct(image).alias("images")).withColumn("attach", F.col("images") >= least)


def patch_cause(judgement: Column) -> Column:
    """The cause that a judged patch points to; null for anything but a defect or a genuine normal."""
    return F.when(judgement == "defect", "bank_contamination").when(judgement == "genuine_normal", "normal_overlap")
