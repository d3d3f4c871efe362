"""Threshold curves, AUROC and feasibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmill.operators.skew import running


def score_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by, score, pos, neg``: defects and normals at each distinct score of (by, score, defect); null or NaN scores and null labels are left out."""
    ok = scores.where("score is not null and not isnan(score) and defect is not null")
    return ok.groupBy(*by, "score").agg(F.count_if(F.col("defect")).alias("pos"), F.count_if(~F.col("defect")).alias("neg"))


def auroc(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_pos, n_neg, auroc``: exact, with average ranks on ties; null where a class is empty.

    Ranks are running sums over distinct scores after counting, cut into ranges of the scores.
    """
    n = running(score_counts(scores, by), by, [F.col("score")], ["neg"])
    n = n.withColumn("under", F.col("__upto_neg") - F.col("neg"))
    out = n.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0)).alias("wins"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def curve(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by, threshold, detected, missed, false_positives, true_negatives, detection_rate, false_positive_rate``.

    A point for each distinct score and one just above the greatest; a rate of an empty class is null. Counts are
    running sums over the distinct scores, not a comparison of every threshold with every row.
    """
    n = score_counts(scores, by)
    top = n.groupBy(*by).agg(F.max("score").alias("m")).select(*by, (F.col("m") + F.greatest(F.lit(1e-9), F.abs("m") * 1e-6)).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    n = n.unionByName(top)
    n = running(n, by, [F.desc("score")], ["pos", "neg"], totals=True).withColumnsRenamed({"__upto_pos": "detected", "__upto_neg": "false_positives", "__all_pos": "np", "__all_neg": "nn"})
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return n.select(*by, F.col("score").alias("threshold"), "detected", (F.col("np") - F.col("detected")).alias("missed"), "false_positives", (F.col("nn") - F.col("false_positives")).alias("true_negatives"), rate("detected", "np").alias("detection_rate"), rate("false_positives", "nn").alias("false_positive_rate"))


def threshold_for(points: DataFrame, by: list[str], detection: float = 1.0) -> DataFrame:
    """``by, threshold, detection_rate, false_positive_rate``: the greatest threshold that reaches the detection (less 1e-9)."""
    hit = points.where(F.col("detection_rate") >= detection - 1e-9)
    return hit.groupBy(*by).agg(F.max(F.struct("threshold", "detection_rate", "false_positive_rate")).alias("x")).select(*by, "x.*")


def feasibility(scores: DataFrame, by: list[str], detection: float = 1.0, max_fpr: float = 0.05, least: int = 3) -> DataFrame:
    """``by, n_pos, n_neg, threshold, resulting_fpr, achievable``; null where a class has fewer than ``least`` scores."""
    pick = threshold_for(curve(scores, by), by, detection)
    n = score_counts(scores, by).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    enough = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    out = n.join(pick, by, "left")
    fpr = F.when(enough, F.col("false_positive_rate"))
    return out.select(*by, "n_pos", "n_neg", F.when(enough, F.col("threshold")).alias("threshold"), fpr.alias("resulting_fpr"), (fpr <= max_fpr).alias("achievable"))


def thinned(points: DataFrame, by: list[str], rows: int = 20) -> DataFrame:
    """At most ``rows`` points of each curve by descending threshold, evenly spaced by rank, the first and last among them.

    Of n points those at the ranks round-half-even(i * (n - 1) / (rows - 1)); all of them if there are no more than ``rows``.
    Thresholds are distinct within a curve. Ranks are running counts over ranges of the thresholds.
    """
    p = running(points.withColumn("__one", F.lit(1)), by, [F.desc("threshold")], ["__one"], totals=True).withColumnRenamed("__all___one", "__n")
    step = (F.col("__n") - 1) / F.lit(float(max(1, rows - 1)))
    spots = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.bround(i * step).cast("bigint"))
    return p.where((F.col("__n") <= rows) | F.array_contains(spots, (F.col("__upto___one") - 1).cast("bigint"))).select(*points.columns)
