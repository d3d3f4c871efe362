"""Production time: clocks, calendars, shifts, nightly triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import skew_join


def shift_of(at: Column) -> Column:
    """night before 08:00, day before 16:00, else swing; null stays null."""
    return F.when(F.hour(at) < 8, "night").when(F.hour(at) < 16, "day").when(F.hour(at) >= 16, "swing")


def production_clock(rows: DataFrame, by: list[str], order: list[str], day: str, duration: Column, gap: Column) -> DataFrame:
    """``rows`` with ``start_s`` and ``end_s`` (epoch seconds): start = max(previous end + gap, day + 1 s), end = start + duration.

    Rows are taken by day, then by ``order``. The recursion unrolls to a running sum and a running maximum: with P the sum
    of all durations and gaps before, start = P + the greatest (day start - P) so far. Both are kept within a day first and
    carried over the table of days, so no task sorts more than a day of a group. Rows need a day.
    """
    keys = [*by, day]
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__d", duration.cast("bigint")).withColumn("__g", gap.cast("bigint"))
    rows = rows.withColumn("__p", F.coalesce(F.sum("__d").over(before), F.lit(0)) + F.sum("__g").over(upto))
    lead = F.unix_timestamp(F.col(day).cast("timestamp")) + 1 - F.col("__p")
    rows = rows.withColumn("__m", F.max(lead).over(upto))
    days = rows.groupBy(*keys).agg(F.sum(F.col("__d") + F.col("__g")).alias("__t"), F.max(lead).alias("__top"))
    past = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__p0", F.coalesce(F.sum("__t").over(past), F.lit(0)))
    days = days.withColumn("__m0", F.max(F.col("__top") - F.col("__p0")).over(past)).select(*keys, "__p0", "__m0")
    rows = skew_join(rows, days, keys, F.struct(*order))
    rows = rows.withColumn("start_s", F.col("__p0") + F.col("__p") + F.greatest(F.col("__m0"), F.col("__m") - F.col("__p0")))
    return rows.withColumn("end_s", F.col("start_s") + F.col("__d")).drop("__d", "__g", "__p", "__m", "__p0", "__m0")


def split_calendar(days: DataFrame, by: list[str], day: str, share: float = 0.3) -> DataFrame:
    """``by, day, split``: the last max(1, round-half-even(share * n)) of n distinct days are holdout, but one operation day stays."""
    d = days.where(F.col(day).isNotNull()).select(*by, day).distinct()
    w = Window.partitionBy(*by)
    n, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.desc(day)))
    hold = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("bigint")), n - 1)
    return d.select(*by, day, F.when(rank <= hold, "holdout").otherwise("operation").alias("split"))


def date_windows(days: DataFrame, by: list[str], day: str, before: int = 7, width: int = 3) -> DataFrame:
    """``by, kind, day``: bank days (``width`` of them, from first - before - 1 backwards) and the pending day after the last."""
    ends = days.groupBy(*by).agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first is not null")
    bank = ends.select(*by, F.lit("bank").alias("kind"), F.explode(F.sequence(F.date_sub("first", before + width), F.date_sub("first", before + 1))).alias("day"))
    return bank.unionByName(ends.select(*by, F.lit("pending").alias("kind"), F.date_add("last", 1).alias("day")))


def day_night(rows: DataFrame, by: list[str], order: list[str], share: float) -> DataFrame:
    """``rows`` with ``night``: the last round-half-even(n * share) of a group, at least 1 and at most n - 1."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    night = F.least(F.greatest(F.bround(n * F.lit(share)).cast("bigint"), F.lit(1)), n - 1)
    return rows.withColumn("night", F.row_number().over(w.orderBy(*order)) > n - night)


def missed_in_batch(truth: Column, verdict: Column, pending: Column, score: Column, threshold: Column) -> Column:
    """A recorded verdict decides for rows that are not pending; else a known defect that scores below the threshold is missed. Never null."""
    recorded = (truth == "defect") & (verdict == "pass")
    fresh = (truth == "defect") & (score < threshold)
    return F.coalesce(F.when(~pending & verdict.isNotNull(), recorded).otherwise(fresh), F.lit(False))


def triage(missed: DataFrame, by: list[str], cap: int = 5) -> DataFrame:
    """The first ``cap`` of ``missed`` in each group by ascending score, with ``place``; the rest is deferred.

    The cap is the feature; as only the first places are kept, each task passes on no more than ``cap`` rows of a group.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("score", "path", "row_id"))
    return missed.withColumn("place", place).where(F.col("place") <= cap)


def next_run(now: Column, hour: int, minute: int = 0) -> Column:
    """The first instant after ``now`` at that time of day."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today > now, today).otherwise(today + F.make_dt_interval(F.lit(1)))


def due(now: Column, last: Column, hour: int, minute: int = 0) -> Column:
    """True from that time of day on if there was no run on this day yet."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return (now >= today) & (last.isNull() | (F.to_date(last) < F.to_date(now)))
