"""Version lists: differences, retention, best copies, switch decisions and rebuilt compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def version_number(c: Column) -> Column:
    """N of ...vN at the end of a version or folder name's version part; null if it has none."""
    return F.nullif(F.regexp_extract(c, r"v(\d{1,9})(?:_.*)?$", 1), F.lit("")).cast("int")


def version_diff(members: DataFrame, old: str, new: str) -> DataFrame:
    """``change, member`` (added, removed, kept) between two versions of (version, member). A version without members counts as empty."""
    m = members.where(F.col("version").isin(old, new)).groupBy("member").agg(F.max((F.col("version") == old).cast("int")).alias("a"), F.max((F.col("version") == new).cast("int")).alias("b"))
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), "kept").when(F.col("b") == 1, "added").otherwise("removed")
    return m.select(kind.alias("change"), "member")


def consecutive_changes(members: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, added, removed, kept``: each version n (an integer) of (by, n, member) against version n - 1 of the same group."""
    d = members.select(*by, "n", "member").distinct()
    both = d.select(*by, "n", "member", F.lit(1).alias("now"), F.lit(0).alias("was")).unionAll(d.select(*by, F.col("n") + 1, "member", F.lit(0), F.lit(1)))
    each = both.groupBy(*by, "n", "member").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    out = each.groupBy(*by, "n").agg(F.count_if(F.col("now") > F.col("was")).alias("added"), F.count_if(F.col("was") > F.col("now")).alias("removed"), F.count_if(F.col("was") + F.col("now") == 2).alias("kept"), F.max("now").alias("there"))
    return out.where("there = 1").drop("there")


def rebuilt(kept: DataFrame, added: DataFrame, removed: DataFrame, by: list[str], member: str) -> DataFrame:
    """``by, member, origin``: kept less removed, and added ones that are not kept; each member once."""
    stay = kept.select(*by, member).distinct().join(removed.select(*by, member).distinct(), [*by, member], "left_anti")
    new = added.select(*by, member).distinct().join(stay, [*by, member], "left_anti")
    return stay.withColumn("origin", F.lit("kept")).unionByName(new.withColumn("origin", F.lit("added")))


def keep_best(copies: DataFrame, by: list[str], prefer: list[Column]) -> DataFrame:
    """``copies`` with ``status`` kept or skipped: the first of each group in the order given is kept."""
    return copies.withColumn("status", F.when(F.row_number().over(Window.partitionBy(*by).orderBy(*prefer)) == 1, "kept").otherwise("skipped"))


def retention(versions: DataFrame, by: list[str], order: list[Column], keep: int, current: Column) -> DataFrame:
    """``versions`` with ``place`` and ``pruned``: all but the newest max(1, keep) and the current one are pruned."""
    out = versions.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.withColumn("pruned", (F.col("place") > max(1, keep)) & ~F.coalesce(current, F.lit(False)))


def rollbacks(decisions: DataFrame, by: list[str], order: list[str], version: Column) -> DataFrame:
    """``decisions`` with ``previous`` (number) and ``rollback``: a switch to a lower number than the one before."""
    out = decisions.withColumn("number", version)
    out = out.withColumn("previous", F.lag("number").over(Window.partitionBy(*by).orderBy(*order)))
    return out.withColumn("rollback", F.coalesce(F.col("number") < F.col("previous"), F.lit(False)))


def agreements(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``on, old_verdict, new_verdict, kind``: both banks' verdicts on the same images; kind is null where they agree, newly_detected or newly_missed else."""
    both = old.select(*on, F.col("verdict").alias("old_verdict")).join(new.select(*on, F.col("verdict").alias("new_verdict")), on)
    kind = F.when(F.col("old_verdict") == F.col("new_verdict"), F.lit(None).cast("string")).when(F.col("new_verdict") == "defect", "newly_detected").when(F.col("old_verdict") == "defect", "newly_missed")
    return both.withColumn("kind", kind)


def agreement_report(cases: DataFrame, by: list[str]) -> DataFrame:
    """``by, total, agreed, agreement_rate, newly_detected, newly_missed``."""
    out = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind").isNull()).alias("agreed"), F.count_if(F.col("kind") == "newly_detected").alias("newly_detected"), F.count_if(F.col("kind") == "newly_missed").alias("newly_missed"))
    return out.withColumn("agreement_rate", F.col("agreed") / F.col("total"))


def gate(measures: DataFrame, limits: list[tuple[str, str, float]], by: list[str]) -> DataFrame:
    """``by, check_name, value, bound, passed`` of wide measures; ``limits`` has (column, '>=' or '<=', bound). A null value fails."""
    rows = F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(F.col(c) >= b if op == ">=" else F.col(c) <= b, F.lit(False)).alias("passed")) for c, op, b in limits))
    return measures.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def gate_result(checks: DataFrame, by: list[str]) -> DataFrame:
    """``by, passed, failures``: the conjunction of the checks and the names that failed, sorted and joined."""
    return checks.groupBy(*by).agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_name")))), ",").alias("failures"))


def reproducible(runs: DataFrame, by: list[str], outcome: Column, least: int = 2) -> DataFrame:
    """``by, runs, outcomes, reproducible``: one distinct outcome over at least ``least`` runs; null outcomes are one outcome."""
    h = F.coalesce(F.sha2(outcome.cast("string"), 256), F.lit(""))
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(h).alias("outcomes"))
    return out.withColumn("reproducible", (F.col("outcomes") == 1) & (F.col("runs") >= least))
