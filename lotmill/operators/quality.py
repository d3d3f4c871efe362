"""Quality metrics: baselines, interval assessment and metrics of pixel arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmill.operators.skew import quantiles, skew_join
from lotmill.session import cut


def long_metrics(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """``by, metric, value`` of wide rows, in one scan."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return rows.select(*by, cells.alias("x")).select(*by, "x.metric", "x.value")


def baseline(long: DataFrame, by: list[str], widen: float = 0.0) -> DataFrame:
    """``by, metric, n, mean, std, p01, p99``: sample deviation (0 for one value), percentiles with linear interpolation.

    ``widen`` keeps std at that share of |mean| at least. Nulls are ignored. Percentiles are exact, by running counts
    over ranges of the values: no task holds the values of a whole group.
    """
    keys = [*by, "metric"]
    out = long.where("value is not null").groupBy(*keys).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    at = quantiles(long, keys, "value", {"p01": 0.01, "p99": 0.99})
    std = F.greatest("std", F.abs("mean") * widen) if widen else F.col("std")
    return at.join(out, keys).select(*keys, "n", "mean", std.alias("std"), "p01", "p99")


def assess(long: DataFrame, stats: DataFrame, by: list[str], sigma: float = 3.0, ratio: float = 0.30, min_images: int = 1) -> DataFrame:
    """``by, metric, images, outliers, outlier_ratio, breached``: values further than sigma deviations, and whether their share exceeds the ratio.

    Metrics without stats or with a deviation of 0 are skipped; with fewer than ``min_images`` values nothing is breached.
    """
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    on = [*[c for c in by if c in stats.columns], "metric"]
    known = cut(stats.where("std > 0").select(*on, "mean", "std"))
    hit = skew_join(long.where("value is not null"), known, on, F.struct(*by, "value"))
    out = hit.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("images"), F.count_if(z > sigma).alias("outliers"))
    share = F.col("outliers") / F.col("images")
    return out.select(*by, "metric", "images", "outliers", share.alias("outlier_ratio"), ((share > ratio) & (F.col("images") >= min_images)).alias("breached"))


def within(assessed: DataFrame, by: list[str], metrics_required: int = 1) -> DataFrame:
    """``by, breached_metrics, within``: whether fewer metrics than required are breached."""
    out = assessed.groupBy(*by).agg(F.count_if("breached").alias("breached_metrics"))
    return out.withColumn("within", F.col("breached_metrics") < metrics_required)


def pixel_metrics(image: np.ndarray) -> tuple[float, float, float, float]:
    """(brightness, contrast, sharpness, noise) of a gray image.

    Mean; population deviation; population variance of the 3x3 Laplacian; median of the lowest 30 % of the 7x7 local
    deviations. Borders are mirrored without repeating the edge.
    """
    g = image.astype(np.float64)
    p = np.pad(g, 1, mode="reflect")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    q = np.pad(g, 3, mode="reflect")

    def box(a: np.ndarray) -> np.ndarray:
        c = np.pad(a.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return (c[7:, 7:] - c[:-7, 7:] - c[7:, :-7] + c[:-7, :-7]) / 49

    local = np.sqrt(np.maximum(box(q * q) - box(q) ** 2, 0.0)).ravel()
    low = np.sort(local)[: max(1, int(len(local) * 0.3))]
    return float(g.mean()), float(g.std()), float(laplace.var()), float(np.median(low))


def metrics_of_images(images: DataFrame, ident: str = "image") -> DataFrame:
    """``image, brightness, contrast, sharpness, noise`` of (image, height, width, pixels array, row-major); null or short arrays give nulls."""
    kind = dict(images.dtypes)[ident]

    def run(batches):
        for b in batches:
            out = [pixel_metrics(np.asarray(p, float).reshape(h, w)) if p is not None and h and w and len(p) == h * w and min(h, w) > 3 else (None,) * 4 for p, h, w in zip(b["pixels"], b["height"], b["width"], strict=True)]
            yield pd.concat([b[[ident]].reset_index(drop=True), pd.DataFrame(out, columns=["brightness", "contrast", "sharpness", "noise"], dtype=float)], axis=1)

    return images.select(ident, "height", "width", "pixels").mapInPandas(run, f"`{ident}` {kind}, brightness double, contrast double, sharpness double, noise double")
