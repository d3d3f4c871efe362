"""Score cutoffs that keep a target fraction of each source.

Scores are coded as integers (order kept, several scores may share a code). A persistent dyadic tree holds,
for each source and each prefix of the code, how many scores lie below that prefix; every batch adds its node
counts to the tree's folder, under its own name. The score at a source's target rank is found by descending from the root, and the leaf
it ends in is refined to its distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import skew_join, small_enough
from lotmill.session import cut, new_table_path

#: A code has BITS bits: the power of two that a score lies above, then MANTISSA bits of where it lies between that and the next.
BITS, MANTISSA = 32, 21
#: Levels of the dyadic tree that are stored: every STEP-th, so a descent chooses among 2**STEP children. A parameter of the
#: tree; with 1 every level is stored. The answers are the same; 4 stores 4.1 instead of 14.9 nodes a distinct score (sf0.1) and reads 8 levels, not 32.
STEP = 4


def code(score: Column) -> Column:
    """Order-preserving integer code of a score that is not negative, as fine for small scores as for large ones."""
    near = F.floor(F.log2(score)).cast("double")  # may be one off beside a power of two
    power = near + F.when(score >= F.pow(F.lit(2.0), near + 1), 1.0).when(score < F.pow(F.lit(2.0), near), -1.0).otherwise(0.0)
    part = F.floor((score / F.pow(F.lit(2.0), power) - 1) * F.lit(float(2**MANTISSA)))
    whole = (power.cast("bigint") + 1023) * F.lit(2**MANTISSA) + part.cast("bigint")
    small, large = F.lit(2.0**-1022), F.lit(float("inf"))
    return F.when(score < small, 0).when(score == large, 2**BITS - 1).otherwise(whole).cast("bigint")


class CountTree:
    """The persistent tree: node counts (source, node, n) by level and batch in a folder, to be opened again by its path.

    Each batch has folders of its own, which a replay of the batch overwrites, so a batch counts once however often it
    is written. :meth:`compact` sums the batches up into one; from then on a replay of them is left out.
    """

    SCHEMA = "source string, node bigint, n bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, step: int = STEP):
        if BITS % step:
            raise ValueError(f"a step divides {BITS}")
        self.spark, self.path, self.step = spark, (path or new_table_path(spark, "tree")).rstrip("/"), step

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _log(self) -> DataFrame:
        """``generation, step, batch``: batches that are part of a compacted generation."""
        schema = "generation int, step int, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/log") if self._exists(f"{self.path}/log") else self.spark.createDataFrame([], schema)

    def _generation(self) -> int:
        return self._log().agg(F.max("generation")).first()[0] or 0 if self._exists(f"{self.path}/log") else 0

    def add(self, batch: DataFrame, name: str | Column = "0") -> CountTree:
        """Add a batch (source, score) or (source, score, weight); weight -1 takes a score back that was added before.

        ``name`` is the batch's, or a column that names the batch of each row: all of them are then added in one pass.
        A batch that was added before is replaced as a whole. Scores that are null, NaN or negative and rows of no source are skipped.
        """
        label = name if isinstance(name, Column) else F.lit(name)
        if "weight" not in batch.columns:
            batch = batch.withColumn("weight", F.lit(1))
        batch = batch.withColumn("batch", F.coalesce(label.cast("string"), F.lit("none"))).where("source is not null and score >= 0 and not isnan(score)")
        now = self._generation()
        if now:
            done = self._log().where(F.col("batch") != "").select("batch").distinct()
            batch = skew_join(batch, done, ["batch"], F.col("score"), "left_anti")
        leaves = batch.groupBy("batch", "source", code(F.col("score")).alias("leaf")).agg(F.sum("weight").alias("n"))
        nodes = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright("leaf", BITS - self.step * v).alias("node")) for v in range(BITS // self.step + 1))))
        grown = leaves.select("batch", "source", nodes.alias("x"), "n").groupBy("batch", "source", "x.node", "x.level").agg(F.sum("n").alias("n"))
        # a level's nodes of a batch lie together, so there are as many files as levels and batches; Spark cuts up a large one while it is shuffled
        grown = grown.select("source", "node", "n", "level", "batch").hint("rebalance", "level", "batch")
        grown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "batch").parquet(f"{self.path}/nodes-{now}")
        return self

    def compact(self) -> CountTree:
        """Sum all batches up into a new generation; readers change over when its log is written."""
        now = self._generation()
        if not self._exists(f"{self.path}/nodes-{now}"):
            return self
        old = self.spark.read.schema(f"{self.SCHEMA}, level int, batch string").parquet(f"{self.path}/nodes-{now}")
        merged = old.groupBy("source", "node", "level").agg(F.sum("n").alias("n")).where("n <> 0").select("source", "node", "n", "level", F.lit("all").alias("batch"))
        merged.hint("rebalance", "level").write.mode("overwrite").partitionBy("level", "batch").parquet(f"{self.path}/nodes-{now + 1}")
        names = old.select("batch").distinct().where("batch <> 'all'").unionAll(self._log().select("batch").where("batch <> ''")).distinct()
        row = self.spark.createDataFrame([("",)], "batch string")  # a generation without batches of its own is one too
        names.unionAll(row).select(F.lit(now + 1).alias("generation"), F.lit(self.step).alias("step"), "batch").write.mode("append").parquet(f"{self.path}/log")
        return self

    def _nodes(self, v: int) -> DataFrame:
        """``source, node, n`` of one level, a row a batch; reads that level's folders only."""
        path = f"{self.path}/nodes-{self._generation()}/level={v}"
        return self.spark.read.schema(self.SCHEMA).parquet(path) if self._exists(path) else self.spark.createDataFrame([], self.SCHEMA)

    def level(self, v: int) -> DataFrame:
        """``source, node, n`` of one level, over all batches."""
        return self._nodes(v).groupBy("source", "node").agg(F.sum("n").alias("n")).where("n > 0")

    def descend(self, ranks: DataFrame) -> DataFrame:
        """``source, leaf, rest``: the leaf of the score at each asked ``rank`` (1 = highest) of a source, and its rank within the leaf.

        Ranks under 1 or beyond a source's count give no row. A level is one join on (source, parent): only the children of
        nodes that a descent is at are summed over the batches.
        """
        at = ranks.select("source", F.col("rank").cast("bigint").alias("rest"), F.lit(0).cast("bigint").alias("node"))
        few = small_enough(at)  # no level has more rows than there are ranks
        above = Window.partitionBy("source", "node", "rest").orderBy(F.desc("child")).rowsBetween(Window.unboundedPreceding, -1)  # at most 2**step children
        for v in range(1, BITS // self.step + 1):
            kids = self._nodes(v).select("source", F.shiftright("node", self.step).alias("node"), F.col("node").alias("child"), "n")
            met = skew_join(kids, at, ["source", "node"], F.col("child"), is_small=few)
            met = met.groupBy("source", "node", "rest", "child").agg(F.sum("n").alias("n")).where("n > 0").withColumn("over", F.coalesce(F.sum("n").over(above), F.lit(0)))
            at = met.where("rest > over and rest <= over + n").select("source", F.col("child").alias("node"), (F.col("rest") - F.col("over")).alias("rest"))
            if v % 4 == 0:  # a row a rank; keeps the plan small
                at = cut(at)
        return at.select("source", F.col("node").alias("leaf"), "rest")


def latest(rows: DataFrame, source: Column, item: Column, score: Column, at: Column, row_id: Column) -> DataFrame:
    """``source, row_id, score, at``: the usable row of each source and item with the latest ``at``, then the largest id.

    Null, NaN and negative scores are unusable, rows of no source are dropped; a null ``at`` is earlier than any;
    rows without item count as one item. Combined map-side, so an item with many rows costs one group row a task.
    """
    base = rows.select(source.alias("source"), item.cast("string").alias("item"), score.cast("double").alias("score"), at.alias("at"), row_id.cast("bigint").alias("row_id"))
    base = base.where("source is not null and score >= 0 and not isnan(score)")
    last = base.groupBy("source", "item").agg(F.max(F.struct("at", "row_id", "score")).alias("x"))
    return last.select("source", "x.row_id", "x.score", "x.at")


def cutoffs(tree: CountTree, scored: DataFrame, targets: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``source, n, keep_permille, rank, cutoff`` for each row of ``targets`` (source, keep_permille).

    ``scored`` (source, score) is what the tree has counted; it is read again only for the scores of the leaves that
    the descents end in. ``rank`` is the least number of scores whose thousandfold is at least keep_permille times n;
    a threshold keeps that many exactly if it does not exceed the score at that rank, so the cutoff is the largest
    such one of ``thresholds`` (source, threshold). It is null where there is none, or no target; with a target of
    nothing every threshold does. Null and NaN thresholds are ignored, repeated ones count once.
    """
    counts = tree.level(0).select("source", "n")
    goal = targets.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "keep_permille")
    goal = cut(goal.withColumn("rank", F.ceil(F.col("keep_permille").cast("bigint") * F.col("n") / 1000).cast("bigint")))
    leaf = tree.descend(goal.where("rank > 0").select("source", "rank"))
    inside = skew_join(scored.select("source", "score", code(F.col("score")).alias("leaf")), leaf, ["source", "leaf"], F.col("score"))
    inside = inside.groupBy("source", "rest", "score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    met = cut(inside.withColumn("upto", F.sum("n").over(down)).where("upto >= rest").groupBy("source").agg(F.max("score").alias("met")))
    points = thresholds.where("threshold is not null and not isnan(threshold)").select("source", "threshold").distinct()
    goal = goal.join(met, "source", "left")
    hit = points.join(goal.select("source", "met", "rank"), "source").where("rank <= 0 or threshold <= met")
    best = hit.groupBy("source").agg(F.max("threshold").alias("cutoff"))
    return goal.drop("met").join(best, "source", "left")


def kept(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """``source, row_id, score`` of the rows at or above their source's cutoff; without one a source keeps nothing."""
    line = chosen.where("cutoff is not null").select("source", "cutoff")
    return skew_join(scored, line, ["source"], F.col("row_id")).where("score >= cutoff").select("source", "row_id", "score")
