"""References to records that do not exist, at the time they were made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import hot_keys, salted


@dataclass(frozen=True)
class Parent:
    """Keys that exist. ``since``/``until`` bound their validity (until exclusive); None = always."""

    name: str
    rows: DataFrame
    key: Column
    since: Column | None = None
    until: Column | None = None


@dataclass(frozen=True)
class Child:
    """Rows that refer to ``parent`` by ``key`` at ``at``."""

    name: str
    rows: DataFrame
    parent: str
    key: Column
    row_id: Column
    at: Column


def orphans(parents: list[Parent], children: list[Child], rows_per_group: int = 50_000) -> DataFrame:
    """``table_name, row_id, parent_table, ref_key, at``: the children whose key has no parent in force.

    Parents and children are laid out in one long table of (parent table, key, instant) and each key
    group is read once in time order, carrying the number of parents in force; a child that meets
    none is an orphan. Children of a hot key are spread over salts, to each of which the key's few
    parent events are repeated, so no task holds more than about ``rows_per_group`` children of it.

    Null keys refer to nothing and are dropped. A child without an instant is an orphan: nothing is
    known to be in force for it. A parent without ``since`` (where that is given) is never in force;
    empty or inverted validities count for nothing. Repeated children each count, repeated parents
    change nothing. Empty inputs give no rows. Other columns of the inputs are ignored.
    """
    spark = children[0].rows.sparkSession
    kid = None
    for c in children:
        one = c.rows.select(F.lit(c.parent).alias("parent_table"), c.key.cast("string").alias("ref_key"), F.lit(c.name).alias("table_name"), c.row_id.cast("bigint").alias("row_id"), c.at.cast("timestamp_ntz").alias("at"))
        kid = one if kid is None else kid.unionAll(one)
    kid = kid.where(F.col("ref_key").isNotNull())
    events = spark.createDataFrame([], "parent_table string, ref_key string, at timestamp_ntz, step int")
    start = F.lit("0001-01-01").cast("timestamp_ntz")
    for p in parents:
        since = start if p.since is None else p.since.cast("timestamp_ntz")
        until = F.lit(None).cast("timestamp_ntz") if p.until is None else p.until.cast("timestamp_ntz")
        spans = p.rows.select(p.key.cast("string").alias("ref_key"), since.alias("since"), until.alias("until"))
        spans = spans.where("ref_key is not null and since is not null and (until is null or until > since)").distinct()
        both = F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step")))
        spans = spans.select(F.lit(p.name).alias("parent_table"), "ref_key", F.explode(both).alias("e")).select("parent_table", "ref_key", "e.at", "e.step")
        events = events.unionAll(spans.where("at is not null"))
    keys = ["parent_table", "ref_key"]
    kid, events = salted(kid, events, keys, hot_keys(kid, keys, rows_per_group), F.col("row_id"))
    long = kid.withColumn("step", F.lit(0)).withColumn("kind", F.lit(1)).unionByName(events.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy(*keys, "__salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = long.withColumn("in_force", F.sum("step").over(sweep)).where("kind = 1 and in_force = 0")
    return found.select("table_name", "row_id", "parent_table", "ref_key", "at")


def orphan_report(found: DataFrame) -> DataFrame:
    """``table_name, month, orphan_rows, orphan_keys`` of the rows of :func:`orphans`; month is yyyy-MM, null where the instant is."""
    by_key = found.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month"), "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("table_name", "month").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))
