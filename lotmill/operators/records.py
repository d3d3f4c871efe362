"""Typed records out of the all-string catalogue, and the filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.functions.names import BLANKS, folded

#: How catalogue labels are called in records.
VERDICTS = {"normal": "pass", "defect": "defect"}


def text_or_null(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def date_or_null(c: Column) -> Column:
    """The date in the first ten characters, if they are yyyy-MM-dd and name a day; else null."""
    head = F.substring(F.btrim(c, F.lit(BLANKS)), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


def product_id(object_name: Column, lot: Column, path: Column) -> Column:
    """OBJECT-lot-stem; parts that are null are left out."""
    return F.concat_ws("-", F.upper(object_name), lot, F.regexp_extract(path, r"(?:^|[/\\])([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def to_records(manifest: DataFrame) -> DataFrame:
    """``row_id, product_id, path, line, object_name, lot, captured_at, truth, split, equipment`` of catalogue rows.

    Blank texts and dates that are none become null, labels become pass or defect (null if neither), and no
    row is dropped. Columns beyond the catalogue's are ignored.
    """
    lot, obj, path = text_or_null(F.col("lot_id")), text_or_null(F.col("object_name")), text_or_null(F.col("image_path"))
    label = folded(F.col("label"))
    truth = F.coalesce(*(F.when(label == k, v) for k, v in VERDICTS.items()))
    return manifest.select("row_id", product_id(obj, lot, path).alias("product_id"), path.alias("path"), text_or_null(F.col("line")).alias("line"), obj.alias("object_name"), lot.alias("lot"), date_or_null(F.col("date_str")).alias("captured_at"), truth.alias("truth"), folded(F.col("split")).alias("split"), text_or_null(F.col("equipment_id")).alias("equipment"))


def find(records: DataFrame, limit: int | None = None, **equals: str | None) -> DataFrame:
    """Rows equal in every filter that is given; none given finds nothing. A limit applies in order of path and row id."""
    given = {k: v for k, v in equals.items() if v}
    if not given:
        return records.limit(0)
    for k, v in given.items():
        records = records.where(F.col(k) == v)
    return records.orderBy("path", "row_id").limit(limit) if limit else records


def whole_lot(records: DataFrame, product: str) -> DataFrame:
    """All rows of the lots in which a product lies, with ``hit`` marking the product itself."""
    lots = records.where(F.col("product_id") == product).select("lot").distinct()
    return records.join(lots, "lot", "left_semi").withColumn("hit", F.coalesce(F.col("product_id") == product, F.lit(False)))


def with_verdict(records: DataFrame, results: DataFrame, threshold: Column) -> DataFrame:
    """Records joined to (image, score) with verdict, position, and the miss and overkill flags.

    The verdict is defect at or above the threshold; position is above, near (at least nine tenths of it) or below.
    A NaN or null score, or a null threshold, gives null in all of them.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    out = records.join(results.select(F.col("image").alias("path"), score.alias("score")), "path")
    t = threshold
    verdict = F.when(F.col("score") >= t, "defect").when(F.col("score") < t, "pass")
    position = F.when(F.col("score") >= t, "above").when(F.col("score") >= 0.9 * t, "near").when(F.col("score") < 0.9 * t, "below")
    out = out.withColumn("verdict", verdict).withColumn("position", position)
    return out.withColumn("missed", (F.col("truth") == "defect") & (F.col("verdict") == "pass")).withColumn("overkill", (F.col("truth") == "pass") & (F.col("verdict") == "defect"))


def area_verdict(area: Column, defect_area: Column, review_area: Column) -> Column:
    """defect from defect_area on, review from review_area on where that is given, else pass."""
    return F.when(area >= defect_area, "defect").when(review_area.isNotNull() & (area >= review_area), "review").otherwise("pass")


def covers(conditions: Column, key: Column, value: Column) -> Column:
    """Three-valued: null if the axis is not recorded, else whether the value is among its values."""
    return F.array_contains(F.element_at(conditions, key), value)


def sample_slices(rows: DataFrame, by: list[str], order: list[str], sizes: dict[str, int]) -> DataFrame:
    """The first rows of each group in order, cut into consecutive slices of the given sizes (column ``slice``); the rest is dropped."""
    n, upto, pick = F.row_number().over(Window.partitionBy(*by).orderBy(*order)), 0, F.lit(None).cast("string")
    rows, cuts = rows.withColumn("__n", n), []
    for name, size in sizes.items():
        cuts.append((name, upto, upto := upto + size))
    for name, a, b in cuts:
        pick = F.when((F.col("__n") > a) & (F.col("__n") <= b), name).otherwise(pick)
    return rows.where(F.col("__n") <= upto).withColumn("slice", pick).drop("__n")


def supplements(records: DataFrame, bank_paths: DataFrame) -> DataFrame:
    """``line, object_name, axis, value, images``: what could be added to each bank, by date, lot and equipment.

    Candidates are rows that are not known defects and whose path is not in ``bank_paths`` (path); an axis value that
    is null offers nothing. The three axes are unpivoted from one scan.
    """
    free = records.where("truth is null or truth <> 'defect'").join(bank_paths.select("path").distinct(), "path", "left_anti")
    axes = F.array(F.struct(F.lit("date").alias("axis"), F.col("captured_at").cast("string").alias("value")), F.struct(F.lit("lot").alias("axis"), F.col("lot").alias("value")), F.struct(F.lit("equipment").alias("axis"), F.col("equipment").alias("value")))
    return free.select("line", "object_name", F.explode(axes).alias("x")).where("x.value is not null").groupBy("line", "object_name", "x.axis", "x.value").agg(F.count(F.lit(1)).alias("images"))


def same_members(a: DataFrame, b: DataFrame, keys: list[str], member: str) -> DataFrame:
    """``keys, only_a, only_b, same``: whether two member lists agree as sets, for each group in either."""
    both = a.select(*keys, member, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionAll(b.select(*keys, member, F.lit(0), F.lit(1)))
    each = both.groupBy(*keys, member).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    out = each.groupBy(*keys).agg(F.count_if(F.col("__a") > F.col("__b")).alias("only_a"), F.count_if(F.col("__b") > F.col("__a")).alias("only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))
