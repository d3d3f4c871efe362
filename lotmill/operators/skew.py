"""Helpers against hot keys: tables of all heavy hitters, salted joins, ranks without one big task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotmill.session import cut

#: Bounds of a broadcast table: rows, and bytes of its values. Beyond either a table is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8_000_000
#: So many of the largest hot keys are broadcast (12 bytes each, as keys are known by a 64-bit hash); the others are joined by a shuffle.
HEAD_KEYS = 100_000
#: Up to so many hot keys are written into the plan as a literal map instead of a broadcast table.
LITERAL_KEYS = 64


@dataclass(frozen=True)
class Hot:
    """All keys with over ``rows_per_group`` rows, by their hash: ``head`` holds the largest of them as (hash, salts), ``tail`` the rest as a table (__hk, __salts).

    Another key with the same hash is cut up too, which changes no result.
    """

    head: list[tuple[int, int]]
    tail: DataFrame | None = None


def _hash(df: DataFrame, keys: list[str]) -> Column:
    """A hash that equal keys share: whole numbers as BIGINT, minus zero as zero."""
    kinds = dict(df.dtypes)
    plain = lambda k: F.col(k).cast("bigint") if kinds[k] in ("tinyint", "smallint", "int") else F.col(k).cast("double") + 0.0 if kinds[k] in ("float", "double") else F.col(k)
    return F.xxhash64(*(plain(k) for k in keys))


def hot_keys(df: DataFrame, keys: list[str], rows_per_group: int, head_keys: int = HEAD_KEYS) -> Hot:
    """The keys having over ``rows_per_group`` rows, all of them, with the number of parts each has to be cut into.

    Counts are combined map-side. The ``head_keys`` largest reach the driver (16 bytes each). Any further ones stay
    a checkpointed table; each of them has under 1/head_keys of all rows, so a shuffle join on them is even.
    """
    counts = df.groupBy(_hash(df, keys).alias("__hk")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_group)
    salts = F.least(F.ceil(F.col("__n") / rows_per_group), F.lit(2**31 - 1)).cast("int").alias("__salts")
    top = counts.orderBy(F.desc("__n"), "__hk").limit(head_keys + 1).collect()
    parts = lambda n: min(-(-n // rows_per_group), 2**31 - 1)
    head = [(r["__hk"], parts(r["__n"])) for r in top[:head_keys]]
    if len(top) <= head_keys:
        return Hot(head)
    last = top[head_keys - 1]
    rest = counts.where((F.col("__n") < last["__n"]) | ((F.col("__n") == last["__n"]) & (F.col("__hk") > last["__hk"])))
    return Hot(head, cut(rest.select("__hk", salts)))


def with_salts(df: DataFrame, keys: list[str], hot: Hot, name: str = "__salts") -> DataFrame:
    """``df`` with the number of parts of its key, 1 where it is not hot."""
    if len(hot.head) <= LITERAL_KEYS and hot.tail is None:
        pick = F.lit(1)
        if hot.head:
            pick = F.coalesce(F.element_at(F.create_map(*(F.lit(v).cast(t) for h, n in hot.head for v, t in ((h, "bigint"), (n, "int")))), F.col("__hk")), F.lit(1))
        return df.withColumn("__hk", _hash(df, keys)).withColumn(name, pick).drop("__hk")
    schema = T.StructType([T.StructField("__hk", T.LongType()), T.StructField("__salts", T.IntegerType())])
    head = df.sparkSession.createDataFrame(hot.head, schema).withColumnRenamed("__salts", "__s0")
    out = df.withColumn("__hk", _hash(df, keys)).join(F.broadcast(head), "__hk", "left")
    if hot.tail is None:
        return out.withColumn(name, F.coalesce("__s0", F.lit(1))).drop("__hk", "__s0")
    # keys of the head do not meet the tail: their rows get a hash of their own each, so none of them gather in the shuffle
    out = out.withColumn("__hk", F.when(F.col("__s0").isNull(), F.col("__hk")).otherwise(F.monotonically_increasing_id()))
    tail = hot.tail.withColumnRenamed("__salts", "__s1")
    out = out.join(tail, "__hk", "left")
    return out.withColumn(name, F.coalesce("__s0", "__s1", F.lit(1))).drop("__hk", "__s0", "__s1")


def _one(salts: str, spread: Column) -> Column:
    return F.when(F.col(salts) == 1, 0).otherwise(F.pmod(F.xxhash64(spread), F.col(salts))).cast("int")


def _all(salts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(salts) - 1))


def salted(many: DataFrame, few: DataFrame, keys: list[str], hot: Hot, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__salt``: rows of ``many`` go to one salt of their key by ``spread``, rows of ``few`` to each."""
    a = with_salts(many, keys, hot).withColumn("__salt", _one("__salts", spread)).drop("__salts")
    b = with_salts(few, keys, hot).withColumn("__salt", _all("__salts")).drop("__salts")
    return a, b


def salted_grid(a: DataFrame, b: DataFrame, keys: list[str], hot_a: Hot, hot_b: Hot, spread_a: Column, spread_b: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__salt`` and ``__salt_b``, for keys that are hot on either side or both.

    A key's rows of a are cut into parts and those of b too; each part of a meets each part of b in a task of its own,
    so no task holds more than ``rows_per_group`` rows of either side, and each pair of rows meets exactly once.
    """
    x = with_salts(with_salts(a, keys, hot_a, "__na"), keys, hot_b, "__nb")
    y = with_salts(with_salts(b, keys, hot_a, "__na"), keys, hot_b, "__nb")
    x = x.withColumn("__salt", _one("__na", spread_a)).withColumn("__salt_b", _all("__nb")).drop("__na", "__nb")
    y = y.withColumn("__salt_b", _one("__nb", spread_b)).withColumn("__salt", _all("__na")).drop("__na", "__nb")
    return x, y


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is seen to have at most ``rows`` rows and ``size`` bytes of values; reads no more than the bound and one row."""

    def width(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 8
        return F.lit(16)

    whole = sum((width(f).cast("bigint") for f in df.schema), F.lit(0).cast("bigint"))
    n, held = df.select(whole.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and held <= size


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner", rows_per_group: int = 50_000, broadcast_rows: int = BROADCAST_ROWS, is_small: bool | None = None) -> DataFrame:
    """Equi join of a side with hot keys to a side with few rows per key.

    ``few`` is broadcast only if it is seen to be within the bounds of rows and bytes; beyond them the
    hot keys of ``many`` are salted and the matching rows of ``few`` repeated for each salt.
    ``how`` is inner, left, left_semi or left_anti. ``few`` is counted for it, so it should be cheap or
    checkpointed; a caller that has counted it already says so by ``is_small``.
    """
    if small_enough(few, broadcast_rows) if is_small is None else is_small:
        return many.join(F.broadcast(few), keys, how)
    a, b = salted(many, few, keys, hot_keys(many, keys, rows_per_group), spread)
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, groups: list[str], order: Column, tie: list[str], size: Column, bits: int | None = None, rows_per_range: int = 20_000) -> DataFrame:
    """``df`` with ``__rank`` (from 1) and ``__upto`` (sum of ``size`` so far, own included) within each group.

    The order is that of ``order``, a BIGINT hash spread evenly over its range, then of ``tie``. A group
    is cut into 2**bits ranges of the hash; the ranges' totals are summed first (a table of groups x
    ranges), so no task sorts more than a range of a group. Without ``bits`` their number follows the number
    of rows, so a range keeps about ``rows_per_range`` of them even if one group holds all rows.
    """
    df = df.withColumn("__h", order).withColumn("__s", size.cast("bigint"))
    if bits is None:
        bits = max(1, min(40, (-(-df.count() // rows_per_range) - 1).bit_length()))
    df = df.withColumn("__b", F.shiftright("__h", 64 - bits))
    part = df.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("__s").alias("__t"))
    part = running(part, groups, [F.col("__b")], ["__n", "__t"]) if bits > 16 else _running_small(part, groups, "__b", ["__n", "__t"])
    part = part.select(*groups, "__b", (F.col("__upto___n") - F.col("__n")).alias("__n0"), (F.col("__upto___t") - F.col("__t")).alias("__t0"))
    within = Window.partitionBy(*groups, "__b").orderBy("__h", *tie)
    inner = df.withColumn("__r", F.row_number().over(within)).withColumn("__u", F.sum("__s").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = inner.join(part, [*groups, "__b"])
    return out.withColumn("__rank", F.col("__n0") + F.col("__r")).withColumn("__upto", F.col("__t0") + F.col("__u")).drop("__h", "__s", "__b", "__n0", "__t0", "__r", "__u")


def _running_small(part: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """As :func:`running`, for groups of at most 2**16 rows."""
    upto = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return part.select("*", *(F.sum(c).over(upto).alias(f"__upto_{c}") for c in sums))


#: Up to so many rows in all, running sums are taken by one window over each group; the result is the same.
WINDOW_ROWS = 50_000


def running(df: DataFrame, groups: list[str], order: list[Column], sums: list[str], totals: bool = False, window_rows: int | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, ``__upto_<name>``: its sum within the group over all rows up to this one in ``order``.

    ``totals`` adds ``__all_<name>``, the sum over the whole group. ``order`` must be unique within a group. ``df`` is
    checkpointed and counted; with over ``window_rows`` (WINDOW_ROWS) rows it is range-partitioned by group and order, summed within each partition and
    offset by the totals of the partitions before (a table of groups x partitions), so a group may span any number of tasks.
    """
    laid = cut(df)
    if laid.count() <= (WINDOW_ROWS if window_rows is None else window_rows):
        whole = Window.partitionBy(*groups)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = laid.select("*", *(F.sum(c).over(upto).alias(f"__upto_{c}") for c in sums))
        return out.select("*", *(F.sum(c).over(whole).alias(f"__all_{c}") for c in sums)) if totals else out
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(laid.repartitionByRange(n, *groups, *order).withColumn("__p", F.spark_partition_id()))
    keys = [*groups, "__p"]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*groups)
    before = every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = laid.groupBy(*keys).agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    more = [F.sum(f"__t_{c}").over(every).alias(f"__all_{c}") for c in sums] if totals else []
    part = part.select(*keys, *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums), *more)
    inner = laid.select("*", *(F.sum(c).over(within).alias(f"__w_{c}") for c in sums))
    out = inner.join(part, keys)
    return out.select(*df.columns, *((F.col(f"__b_{c}") + F.col(f"__w_{c}")).alias(f"__upto_{c}") for c in sums), *(f"__all_{c}" for c in sums if totals))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups, n, <name>...``: for each name its quantile of ``value``, exact and with linear interpolation, nulls ignored.

    Values are counted by value first, then ranked by running counts over ranges of the values, so neither a task nor a
    hash map holds the values of a whole group. NaN counts as the greatest value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    both = running(counts, groups, [F.col("__v")], ["__n"], totals=True).withColumnRenamed("__all___n", "n")
    below, upto, at = F.col("__upto___n") - F.col("__n"), F.col("__upto___n"), {}
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("n") - 1)
        for end, spot in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            at[f"__{end}_{name}"] = F.max(F.when((below <= spot) & (spot < upto), F.col("__v")))
        at[f"__f_{name}"] = F.max(place - F.floor(place))
    out = both.groupBy(*groups, "n").agg(*(c.alias(k) for k, c in at.items()))
    mix = lambda k: F.col(f"__lo_{k}") + F.col(f"__f_{k}") * (F.col(f"__hi_{k}") - F.col(f"__lo_{k}"))
    return out.select(*groups, "n", *(F.when(F.col(f"__lo_{k}") == F.col(f"__hi_{k}"), F.col(f"__lo_{k}")).otherwise(mix(k)).alias(k) for k in shares))
