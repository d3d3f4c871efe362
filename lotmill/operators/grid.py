"""Distance maps: cell baselines, residuals, hot cells, upsampling, blobs and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import quantiles, skew_join
from lotmill.session import cut

EPS = 1e-6


def cell_baseline(cells: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """``by, row, col, median, mad, n`` over (by, map, row, col, value); cells of fewer than ``least`` values are left out. Nulls are ignored.

    Both medians are exact, by running counts over ranges of the values, so a cell may have any number of maps.
    """
    keys = [*by, "row", "col"]
    med = cut(quantiles(cells, keys, "value", {"median": 0.5}).where(F.col("n") >= least))
    dev = skew_join(cells.where("value is not null").select(*keys, "value"), med.select(*keys, "median"), keys, F.col("value"))
    mad = quantiles(dev.select(*keys, F.abs(F.col("value") - F.col("median")).alias("value")), keys, "value", {"mad": 0.5}).drop("n")
    return med.join(mad, keys).select(*keys, "median", "mad", "n")


def residuals(cells: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` with ``residual`` (less the cell's median) and ``robust`` (that over MAD + 1e-6); without a baseline both are the value."""
    keys = [*by, "row", "col"]
    out = cells.join(baseline.select(*keys, "median", "mad"), keys, "left")
    res = F.coalesce(F.col("value") - F.col("median"), F.col("value"))
    rob = F.coalesce((F.col("value") - F.col("median")) / (F.col("mad") + EPS), F.col("value"))
    return out.withColumn("residual", res).withColumn("robust", rob).drop("median", "mad")


def hottest_cell(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``by, row, col, value``: the greatest cell; the first in row-major order on ties."""
    top = cells.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("x"))
    return top.select(*by, (-F.col("x.r")).alias("row"), (-F.col("x.c")).alias("col"), F.col("x.v").alias(value))


def hottest_cells(cells: DataFrame, by: list[str], k: int = 3, apart: int = 3) -> DataFrame:
    """``by, place, row, col``: descending greedy picks, none within ``apart`` of an earlier one on both axes.

    A map's cells are one sorted array of bounded size (its grid) and the picks fold over it, all JVM-side.
    """
    cell = F.struct((-F.col("value")).alias("m"), "row", "col")
    arr = cells.where("value is not null").groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("a"))
    empty = F.array().cast("array<struct<row:int,col:int>>")

    def take(acc: Column, c: Column) -> Column:
        near = F.exists(acc, lambda p: (F.abs(p["row"] - c["row"]) < apart) & (F.abs(p["col"] - c["col"]) < apart))
        mine = F.array(F.struct(c["row"].cast("int").alias("row"), c["col"].cast("int").alias("col")))
        return F.when((F.size(acc) < k) & ~near, F.concat(acc, mine)).otherwise(acc)

    picks = arr.select(*by, F.posexplode(F.aggregate("a", empty, take)).alias("p", "x"))
    return picks.select(*by, (F.col("p") + 1).alias("place"), "x.row", "x.col")


def upsample(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, end points on end points: source position i * (n - 1) / (m - 1)."""

    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(to) * ((n - 1) / (to - 1) if to > 1 else 0.0)
        lo = np.minimum(np.floor(at).astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    r0, r1, fr = axis(m.shape[0], height)
    c0, c1, fc = axis(m.shape[1], width)
    top = m[r0][:, c0] * (1 - fc) + m[r0][:, c1] * fc
    low = m[r1][:, c0] * (1 - fc) + m[r1][:, c1] * fc
    return top * (1 - fr[:, None]) + low * fr[:, None]


def components(mask: np.ndarray) -> np.ndarray:
    """Sizes of the 4-connected components, descending, by union-find over runs of set cells."""
    h, w = mask.shape
    parent = np.arange(h * w)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r, c in zip(*np.nonzero(mask), strict=True):
        i = r * w + c
        for j in ((i - 1) if c and mask[r, c - 1] else -1, (i - w) if r and mask[r - 1, c] else -1):
            if j >= 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(int(i)) for i in np.flatnonzero(mask)]
    return np.sort(np.unique(roots, return_counts=True)[1])[::-1] if roots else np.empty(0, int)


def blobs(cells: DataFrame, by: list[str], cutoff: float, value: str = "value", scale: tuple[int, int] | None = None) -> DataFrame:
    """``by, blob_count, largest_area, total_area`` of the cells at or above ``cutoff``, per map.

    With ``scale`` (height, width) maps are upsampled first. A map is a grid of bounded size, so it is one group;
    cells that are missing or null count as below. Maps without a cell have no row.
    """
    kinds = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), -np.inf)
        m[pdf["row"], pdf["col"]] = pdf[value].fillna(-np.inf)
        if scale:
            m = upsample(np.where(np.isfinite(m), m, 0.0), *scale)
        s = components(m >= cutoff)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(s), int(s[0]) if len(s) else 0, int(s.sum())]], columns=[*by, "blob_count", "largest_area", "total_area"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", blob_count bigint, largest_area bigint, total_area bigint"
    return cells.select(*by, "row", "col", value).groupBy(*by).applyInPandas(run, schema)


def patch_box(row: Column, col: Column, grid_h: Column, grid_w: Column, height: int, width: int, margin: int = 0) -> Column:
    """Struct (x0, y0, x1, y1): a grid cell in pixels, half-even rounding, widened by ``margin``, clamped, at least one pixel; null out of the grid."""
    inside = (row >= 0) & (row < grid_h) & (col >= 0) & (col < grid_w)

    def span(i: Column, n: Column, size: int) -> tuple[Column, Column]:
        lo = F.greatest(F.lit(0), F.bround(i * size / n).cast("int") - margin)
        hi = F.least(F.lit(size), F.bround((i + 1) * size / n).cast("int") + margin)
        lo = F.least(lo, F.lit(size - 1))
        return lo, F.greatest(hi, lo + 1)

    (x0, x1), (y0, y1) = span(col, grid_w, width), span(row, grid_h, height)
    return F.when(inside, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def context_box(row: Column, col: Column, grid_h: Column, grid_w: Column, height: int, width: int, around: int = 2) -> Column:
    """The box of a cell and ``around`` cells on each side, clamped to the grid."""
    a = patch_box(F.greatest(row - around, F.lit(0)), F.greatest(col - around, F.lit(0)), grid_h, grid_w, height, width)
    b = patch_box(F.least(row + around, grid_h - 1), F.least(col + around, grid_w - 1), grid_h, grid_w, height, width)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a["x0"].alias("x0"), a["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))


def mask_box(cells: DataFrame, by: list[str], cutoff: float, margin: int = 0) -> DataFrame:
    """``by, row0, col0, row1, col1``: the bounding box of the cells at or above ``cutoff``, widened by ``margin`` but not below 0."""
    hit = cells.where(F.col("value") >= cutoff).groupBy(*by)
    return hit.agg(*(F.greatest(F.min(c) - margin, F.lit(0)).alias(f"{c}0") for c in ("row", "col")), *((F.max(c) + margin).alias(f"{c}1") for c in ("row", "col")))


def overlap_with_mask(boxes: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """``by, centre_hit, captured, any_hit``: how much of a mask's cells (by, row, col) lies in a box (by, row0, col0, row1, col1; inclusive)."""
    inside = (F.col("row") >= F.col("row0")) & (F.col("row") <= F.col("row1")) & (F.col("col") >= F.col("col0")) & (F.col("col") <= F.col("col1"))
    centre = (F.col("row") == F.expr("cast((row0 + row1) div 2 as int)")) & (F.col("col") == F.expr("cast((col0 + col1) div 2 as int)"))
    out = boxes.join(mask, by).groupBy(*by).agg(F.max(centre).alias("centre_hit"), F.count_if(inside).alias("k"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "centre_hit", (F.col("k") / F.col("n")).alias("captured"), (F.col("k") > 0).alias("any_hit"))


def normalised(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` with ``heat``: value between the map's least (0) and greatest (1); 0 on a flat map."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return cells.withColumn("heat", (F.col("value") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))
