"""Readers and writers of the file formats the catalogue arrives in.

Schemas are given, never inferred. A path that does not exist gives an empty frame with the schema.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "image_path string, line string, object string, date string, lot_id string, equipment_id string, split string, label string, mask_path string, visa_source string"
MES = "lot_id string, cell_id string, line string, object string, date string, started_at string, end_at string, equipment_id string, inspected_count string, defect_count string, operator_shift string, ERCD string"
ISSUES = "issue_id string, line string, object_name string, defect_type string, cause string, action string, resolved boolean, occurred_at string, summary string, bank_version string, document_no string, approved_by string"
DECISIONS = "at string, to string, previous string, by string, reason string, rollback boolean"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def read_csv(spark: SparkSession, path: str, ddl: str = MANIFEST) -> DataFrame:
    """A CSV with header; columns are taken by name, empty is null."""
    schema = _schema(ddl)
    try:
        got = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)
    return got.select(*((F.nullif(F.col(f"`{f.name}`"), F.lit("")) if f.name in got.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_jsonl(spark: SparkSession, path: str, ddl: str = ISSUES, strict: bool = False) -> DataFrame:
    """JSON lines without blank lines and comment objects (any with ``_comment``). Malformed lines are skipped, or raise if ``strict``."""
    schema = _schema(ddl)
    wide = T.StructType([*schema.fields, T.StructField("_comment", T.StringType()), T.StructField("_bad", T.StringType())])
    try:
        got = spark.read.schema(wide).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)
    return got.where("_comment is null").where("_bad is null").select(*schema.names)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision log; lines without a time or a target are skipped."""
    return read_jsonl(spark, path, DECISIONS).where("at is not null and to is not null")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; what is there is never rewritten."""
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A CSV folder with header, sorted across its files by range partitions rather than by one task."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def read_rules(spark: SparkSession, path: str, key: str, ddl: str) -> DataFrame:
    """The list under ``key`` of a YAML or JSON rule file, with ``rule_order``; missing or empty gives no rows. Rule files are small and read on the driver."""
    schema = _schema(ddl + ", rule_order int")
    local = Path(path.removeprefix("file://"))
    if not local.exists():
        return spark.createDataFrame([], schema)
    raw = local.read_text(encoding="utf-8")
    if local.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML rule files need PyYAML; JSON works without") from e
        data = yaml.safe_load(raw) or {}
    else:
        data = json.loads(raw or "{}")
    rows = [{**{k: r.get(k) for k in schema.names}, "rule_order": i} for i, r in enumerate((data or {}).get(key) or [])]
    return spark.createDataFrame(rows, schema)


def scan_banks(spark: SparkSession, root: str) -> DataFrame:
    """``folder, status, built_at``: folders below root with a bank_meta.json (recorded), or with a bank.npz only (inferred)."""

    def files(name: str) -> DataFrame:
        got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        return got.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.col("modificationTime").alias("built_at"))

    meta, arrays = files("bank_meta.json"), files("bank.npz")
    inferred = arrays.join(meta.select("folder"), "folder", "left_anti")
    return meta.withColumn("status", F.lit("recorded")).unionByName(inferred.withColumn("status", F.lit("inferred"))).select("folder", "status", "built_at")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """``name, path``: image files below root by lower-cased name, the least path of each name."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    got = got.where(F.lower("path").rlike(r"\.(png|jpe?g|bmp|webp)$")).withColumn("name", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)))
    return got.groupBy("name").agg(F.min("path").alias("path"))


def first_labels(annotations: DataFrame, by: str, label: str) -> DataFrame:
    """``by, kind, n``: rows by whether the first label of a comma list is normal or names a defect; null labels are normal."""
    first = F.lower(F.trim(F.element_at(F.split(F.coalesce(label, F.lit("normal")), ","), 1)))
    return annotations.groupBy(by, F.when(first.isin("normal", ""), "normal").otherwise("anomaly").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(rows: DataFrame, by: str, labels: str, skip: tuple[str, ...] = ("other", "normal")) -> DataFrame:
    """``by, term``: the distinct labels of comma lists, less those to skip."""
    return rows.select(by, F.explode(F.split(labels, ",")).alias("t")).select(by, F.lower(F.trim("t")).alias("term")).where(F.col("term") != "").where(~F.col("term").isin(*skip)).distinct()
