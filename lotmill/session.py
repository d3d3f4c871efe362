"""Session defaults and the one place that knows where lineage may be cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "lotmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, but only on a local master: on a cluster a
    machine-local folder would be lost with its machine, so that case is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not (now := spark.sparkContext.getCheckpointDir()):
        now = "file://" + tempfile.mkdtemp(prefix="lotmill-")
        spark.sparkContext.setCheckpointDir(now)
    return now


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, unless they find it by themselves: installed, on their PYTHONPATH or in their folder."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    found = sc.master.startswith("local") and (str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root)
    if found or "site-packages" in root.parts:
        return
    path = Path(tempfile.mkdtemp(prefix="lotmill-")) / "lotmill.zip"  # read from here by the driver, which serves it to the executors
    with zipfile.PyZipFile(path, "w") as z:
        z.writepy(str(Path(__file__).parent))
    sc.addPyFile(str(path))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder that no other run uses, below a folder of this application's own."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application wrote under paths of :func:`new_table_path`; results that read them must be stored before.

    Checkpoints go as soon as nothing refers to them (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
