"""Memory banks as tables: saved by version, loaded with their settings checked, switched by a person only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.operators.distribution import next_number
from lotmill.operators.versions import version_number


class BankStore:
    """``root/bank`` partitioned by bank_version, ``root/meta`` one row a version, ``root/decisions`` append-only.

    Saving never changes which version is current; only :meth:`switch` does, and it demands who and why.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, version: str, rows: DataFrame, settings: dict[str, str], built_at: str) -> None:
        """Write a version's rows and meta; a version that exists is refused."""
        if self._rows("meta", "bank_version string").where(F.col("bank_version") == version).limit(1).count():
            raise ValueError(f"version {version} exists")
        rows.drop("bank_version").withColumn("bank_version", F.lit(version)).write.mode("append").partitionBy("bank_version").parquet(f"{self.root}/bank")
        n = self.spark.read.parquet(f"{self.root}/bank").where(F.col("bank_version") == version).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_image").alias("images"))
        meta = n.select(F.lit(version).alias("bank_version"), "n", "images", F.lit(built_at).cast("timestamp_ntz").alias("built_at"), F.create_map(*(F.lit(x) for kv in sorted(settings.items()) for x in kv)).alias("settings"))
        meta.write.mode("append").parquet(f"{self.root}/meta")

    def load(self, version: str, settings: dict[str, str]) -> DataFrame:
        """A version's rows; raises if it is unknown or any key of either settings differs."""
        meta = self._rows("meta", "bank_version string, settings map<string,string>").where(F.col("bank_version") == version).select("settings").first()
        if meta is None:
            raise ValueError(f"no bank {version}")
        stored = dict(meta["settings"] or {})
        bad = sorted(k for k in stored.keys() | settings.keys() if stored.get(k) != settings.get(k))
        if bad:
            raise ValueError(f"bank {version} was built with other settings: {', '.join(bad)}")
        return self.spark.read.parquet(f"{self.root}/bank").where(F.col("bank_version") == version)

    def switch(self, to: str, by: str, reason: str, at: str) -> None:
        """Record the decision that makes a version current."""
        if not by or not reason:
            raise ValueError("a switch needs a person and a reason")
        now = self.current()
        row = self.spark.createDataFrame([(at, to, now, by, reason)], "at string, to string, previous string, by string, reason string")
        row.write.mode("append").json(f"{self.root}/decisions")

    def adopt(self, version: str, at: str) -> bool:
        """Make a first build current without a person: only while none is, or one whose number is 1 at most. True if it did."""
        now = self.current()
        if now is not None:
            number = self.spark.range(1).select(version_number(F.lit(now))).first()[0]
            if number is None or number > 1:
                return False
        self.switch(version, "first build", "no later version in use", at)
        return True

    def approve(self, to: str, by: str, reason: str, approved: bool, at: str, issue: dict[str, str]) -> str:
        """Append a handled issue to ``root/history`` and return its id; it is resolved only if it was approved.

        ``issue`` holds any of line, object_name, defect_type, cause, action, summary. An approval never changes which version is current.
        """
        if not by.strip() or not reason.strip():
            raise ValueError("an approval needs a person and a reason")
        fields = ["line", "object_name", "defect_type", "cause", "action", "summary"]
        past = self._rows("history", "issue_id string")
        number = next_number(past, F.col("issue_id")).first()[0]
        row = (number, *(issue.get(f) for f in fields), approved, to, by.strip(), reason.strip(), at)
        ddl = "issue_id string, " + ", ".join(f"{f} string" for f in fields) + ", resolved boolean, bank_version string, approved_by string, reason string, at string"
        self.spark.createDataFrame([row], ddl).write.mode("append").json(f"{self.root}/history")
        return number

    def history(self) -> DataFrame:
        return self._rows("history", "issue_id string, line string, object_name string, defect_type string, cause string, action string, summary string, resolved boolean, bank_version string, approved_by string, reason string, at string")

    def current(self) -> str | None:
        """The target of the latest decision; None before the first."""
        log = self._rows("decisions", "at string, to string").where("at is not null and to is not null")
        return log.agg(F.max(F.struct("at", "to")).alias("x")).select("x.to").first()[0]

    def _rows(self, name: str, ddl: str) -> DataFrame:
        from lotmill.sources.files import read_jsonl

        if name in ("decisions", "history"):
            return read_jsonl(self.spark, f"{self.root}/{name}", ddl)
        try:
            got = self.spark.read.parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)
        return got
