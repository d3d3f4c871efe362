"""Counts of defects by axis, concentration, profiles and per-lot totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def defect_distribution(records: DataFrame, by: list[str], since: Column | None = None) -> DataFrame:
    """``by, axis, value, n``: defects by lot, line and equipment, and in total, in one pass of grouping sets.

    Rows with a null axis value count in the total only. Groups without defects give no row.
    """
    hit = records.where("truth = 'defect'")
    if since is not None:
        hit = hit.where(F.col("captured_at") >= since)
    src = hit.withColumn("line_", F.col("line"))
    out = src.groupingSets([[*(F.col(c) for c in by), F.col(x)] for x in ("lot", "line_", "equipment")] + [[F.col(c) for c in by]], *(F.col(c) for c in (*by, "lot", "line_", "equipment"))).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") % 8 == 3, "lot").when(F.col("g") % 8 == 5, "line").when(F.col("g") % 8 == 6, "equipment").otherwise("total")
    out = out.select(*by, axis.alias("axis"), F.coalesce("lot", "line_", "equipment").alias("value"), "n")
    return out.where("axis = 'total' or value is not null")


def concentrated(distribution: DataFrame, by: list[str], share: float = 0.6) -> DataFrame:
    """``by, axis, value, share``: axes of which one value holds at least ``share`` of the total; ties go to the lesser value."""
    total = distribution.where("axis = 'total'").select(*by, F.col("n").alias("total"))
    top = distribution.where("axis <> 'total'").groupBy(*by, "axis").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("x")).select(*by, "axis", "x.value", (-F.col("x.m")).alias("n"))
    out = top.join(total, by) if by else top.join(F.broadcast(total.limit(1)), F.lit(True))
    return out.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= share).select(*by, "axis", "value", "share")


def bank_profiles(records: DataFrame) -> DataFrame:
    """``line, object_name, n_rows, n_dates, n_equipment, last_date`` of the bank split of each line and object."""
    bank = records.where("split = 'bank'")
    return bank.groupBy("line", "object_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("captured_at").alias("n_dates"), F.countDistinct("equipment").alias("n_equipment"), F.max("captured_at").alias("last_date"))


def conditions(records: DataFrame) -> DataFrame:
    """``line, object_name, conditions``: map of axis to its sorted values in the bank split, for the three-valued coverage test."""
    bank = records.where("split = 'bank'").groupBy("line", "object_name").agg(F.array_sort(F.collect_set(F.col("captured_at").cast("string"))).alias("d"), F.array_sort(F.collect_set("equipment")).alias("e"))
    return bank.select("line", "object_name", F.create_map(F.lit("date"), "d", F.lit("equipment"), "e").alias("conditions"))


def lot_totals(records: DataFrame) -> DataFrame:
    """``line, captured_at, lot, inspected, defects``: the totals that are written on each production row.

    Aggregated once per lot; :func:`skew_join` puts them back on rows where they are wanted, so no window holds a lot.
    """
    return records.groupBy("line", "captured_at", "lot").agg(F.count(F.lit(1)).alias("inspected"), F.count_if(F.col("truth") == "defect").alias("defects"))


def most_common(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, n``: the most frequent non-null value of each group; ties go to the lesser value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("x")).select(*by, F.col(f"x.{value}").alias(value), (-F.col("x.m")).alias("n"))


def contamination(rows: DataFrame, by: list[str], bad: Column, normals: int = 150) -> DataFrame:
    """``by, n_bad, rate, warn``: bad rows per hundred of them and ``normals``; warns between 0 and 1."""
    out = rows.groupBy(*by).agg(F.count_if(bad).alias("n_bad"))
    out = out.withColumn("rate", F.col("n_bad") * F.lit(100.0) / (F.col("n_bad") + normals))
    return out.withColumn("warn", (F.col("rate") > 0) & (F.col("rate") < 1))


def known_values(rows: DataFrame, value: Column) -> DataFrame:
    """``value``: the distinct trimmed values that are not blank."""
    return rows.select(F.nullif(F.trim(value), F.lit("")).alias("value")).where("value is not null").distinct()


def next_number(rows: DataFrame, ident: Column, prefix: str = "ISS-") -> DataFrame:
    """``next_id``: the prefix with the highest numeric suffix so far plus one, four digits at least; 0001 for an empty table."""
    n = F.regexp_extract(ident, "^" + prefix + r"(\d{1,9})$", 1)
    top = rows.agg(F.coalesce(F.max(F.nullif(n, F.lit("")).cast("int")), F.lit(0)).alias("n"))
    return top.select(F.format_string(prefix + "%04d", F.col("n") + 1).alias("next_id"))
