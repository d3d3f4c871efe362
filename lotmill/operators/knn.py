"""Exact nearest-bank scoring and the measures over a memory bank.

The distance kernel works on blocks: bank vectors of a key are cut into blocks of bounded size and each block is
compared with all queries of that key as one matrix product in an Arrow-batched task. No pair of a query and a
bank row is ever a row of a DataFrame; each block returns its k best and the blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import hot_keys, salted_grid, skew_join, small_enough
from lotmill.session import cut, new_table_path


def usable(c: Column, dim: int) -> Column:
    """True where a vector is not null, has ``dim`` numbers and none of them is null, NaN or infinite."""
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & good, F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def block_best(b: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of a block; ties go to the lower id; ``own`` ids are left out for their query."""
    order = np.argsort(ids, kind="stable")
    b, ids = b[order], ids[order]
    out = []
    squares = (b * b).sum(axis=1)
    for i in range(0, len(q), step):
        x = q[i : i + step]
        own_norm = (x * x).sum(axis=1)[:, None]
        d = own_norm + squares[None, :] - 2.0 * (x @ b.T)  # close enough to choose whom to measure
        if own is not None:
            d[ids[None, :] == own[i : i + step, None]] = np.inf
        kk = min(k, len(b))
        far = np.partition(d, kk - 1, axis=1)[:, kk - 1 : kk]
        row, col = np.nonzero((d <= far + 1e-9 * (1.0 + own_norm + squares.max())) & np.isfinite(d))
        exact = np.zeros(len(row))
        for c in range(b.shape[1]):  # summed in the order of the numbers, as SQL engines do
            exact += (x[row, c] - b[col, c]) ** 2
        by = np.lexsort((ids[col], exact, row))
        row, col, exact = row[by], col[by], exact[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[keep], col[keep]
        out.append((row + i, ids[col], np.sqrt(exact[keep])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def nearest_exact(bank: DataFrame, queries: DataFrame, k: int = 1, block_rows: int = 20_000, query_rows: int = 4_000, skip_self: bool = False, vectors: bool = False) -> DataFrame:
    """``key, query_id, bank_row, distance, place``: the k nearest bank rows of each query with the same key, exactly.

    ``bank`` has (key, bank_row, embedding), ``queries`` (key, query_id, embedding); ids are unique within a key and
    vectors have one length. Null keys match nothing; null vectors must be filtered before. Ties go to the lower
    bank_row. ``skip_self`` leaves out the bank row whose id is the query's. Fewer than k rows: all of them.
    ``vectors`` adds the vectors of the bank row and of the query, ``near_vector`` and ``query_vector``.
    """
    bank = bank.where(F.col("key").isNotNull()).select("key", F.col("bank_row").cast("bigint"), F.col("embedding").cast("array<double>"))
    queries = queries.where(F.col("key").isNotNull()).select(F.col("key").alias("key"), F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    kind = dict(bank.dtypes)["key"]

    def run(b: pa.Table, q: pa.Table) -> pa.Table:
        if len(b) and len(q):
            rows, ids = b["bank_row"].to_numpy(), q["query_id"].to_numpy()
            i, row, d = block_best(matrix(b["embedding"]), matrix(q["embedding"]), rows, k, ids if skip_self else None)
            order = np.argsort(rows, kind="stable")
            at = order[np.searchsorted(rows[order], row)] if len(row) else np.empty(0, np.int64)
        else:
            ids, i, row, d, at = (np.empty(0, np.int64),) * 5
        key = (b if len(b) else q)["key"]
        out = {"key": pa.array([key[0].as_py()] * len(i), key.type), "query_id": pa.array(ids[i], pa.int64()), "bank_row": pa.array(row, pa.int64()), "distance": pa.array(d, pa.float64())}
        if vectors:
            kinds = pa.list_(pa.float64())
            out |= {n: t["embedding"].combine_chunks().take(pa.array(x, pa.int64())).cast(kinds) if len(x) else pa.array([], kinds) for n, t, x in (("near_vector", b, at), ("query_vector", q, i))}
        return pa.table(out)

    hot_b, hot_q = hot_keys(bank, ["key"], block_rows), hot_keys(queries, ["key"], query_rows)
    b, q = salted_grid(bank, queries, ["key"], hot_b, hot_q, F.col("bank_row"), F.col("query_id"))
    on = ["key", "__salt", "__salt_b"]
    more = ", near_vector array<double>, query_vector array<double>" if vectors else ""
    best = b.groupBy(*on).cogroup(q.groupBy(*on)).applyInArrow(run, f"key {kind}, query_id bigint, bank_row bigint, distance double{more}")
    w = Window.partitionBy("key", "query_id").orderBy("distance", "bank_row")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def image_scores(nearest: DataFrame, patches: DataFrame) -> DataFrame:
    """``image, raw, worst_patch``: the greatest nearest distance of each image and its patch; ties go to the lower patch.

    ``nearest`` is place 1 of :func:`nearest_exact`, ``patches`` (query_id, image, patch).
    """
    both = nearest.where("place = 1").join(patches, "query_id")
    top = both.groupBy("image").agg(F.max(F.struct("distance", (-F.col("patch")).alias("m"))).alias("x"))
    return top.select("image", F.col("x.distance").alias("raw"), (-F.col("x.m")).alias("worst_patch"))


def top_patches(nearest: DataFrame, patches: DataFrame, grid_w: int, k: int = 5) -> DataFrame:
    """``key, image, place, patch, q_row, q_col, bank_row, distance``: the k patches of each image that lie furthest, with the bank and row they are nearest to."""
    both = nearest.where("place = 1").select("key", "query_id", "bank_row", "distance").join(patches, "query_id")
    w = Window.partitionBy("image").orderBy(F.desc("distance"), "patch", "query_id")
    out = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.select("key", "image", "place", "patch", F.expr(f"cast(patch div {grid_w} as int)").alias("q_row"), (F.col("patch") % grid_w).cast("int").alias("q_col"), "bank_row", "distance")


def reweighted(bank: DataFrame, queries: DataFrame, k: int = 9) -> DataFrame:
    """``key, query_id, anchor, raw, score``: raw distance times one minus the softmax weight of the anchor.

    The anchor is the nearest bank row, its neighbourhood the k bank rows nearest to it (itself included), the softmax
    runs over the query's distances to them. With k or the bank at 1 the raw distance is kept.

    The neighbourhood is searched once for each anchor, not for each query, and comes out of the kernel with its
    vectors: a query then meets one row, its anchor's k vectors. Queries of an anchor that many share are salted.
    """
    first = cut(nearest_exact(bank, queries, 1, vectors=True).select("key", "query_id", F.col("bank_row").alias("anchor"), F.col("distance").alias("raw"), "near_vector", "query_vector"))
    anchors = first.groupBy("key", "anchor").agg(F.any_value("near_vector").alias("embedding"))
    near = nearest_exact(bank, anchors.select("key", F.col("anchor").alias("query_id"), "embedding"), k, vectors=True)
    hood = cut(near.groupBy("key", F.col("query_id").alias("anchor")).agg(F.collect_list("near_vector").alias("hood")))  # k vectors
    both = skew_join(first.drop("near_vector"), hood, ["key", "anchor"], F.col("query_id"))
    kind = dict(bank.dtypes)["key"]

    def score(batches):
        for t in batches:
            n = np.diff(t["hood"].offsets.to_numpy())
            if len(t):
                x = t["hood"].flatten().flatten().to_numpy(zero_copy_only=False).reshape(n.sum(), -1)
                q = np.repeat(t["query_vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1), n, axis=0)
                d, at = np.sqrt(((x - q) ** 2).sum(axis=1)), np.concatenate([[0], np.cumsum(n)[:-1]])
                low, top = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
                raw, total = t["raw"].to_numpy(), np.add.reduceat(np.exp(d - np.repeat(top, n)), at)
                out = np.where(n <= 1, raw, (1 - np.exp(low - top) / total) * raw)
            else:
                out = np.empty(0)
            yield pa.RecordBatch.from_arrays([t["key"], t["query_id"], t["anchor"], t["raw"], pa.array(out, pa.float64())], ["key", "query_id", "anchor", "raw", "score"])

    return both.select("key", "query_id", "anchor", "raw", "query_vector", "hood").mapInArrow(score, f"key {kind}, query_id bigint, anchor bigint, raw double, score double")


def contributions(bank: DataFrame) -> DataFrame:
    """``key, source_image, n_rows, amplification``: bank rows of each image and its share against an even one; null images are left out."""
    n = bank.where("source_image is not null").groupBy("key", "source_image").agg(F.count(F.lit(1)).alias("n_rows"))
    whole = n.groupBy("key").agg(F.count(F.lit(1)).alias("__images"), F.sum("n_rows").alias("__rows"))
    out = skew_join(n, whole, ["key"], F.col("source_image"))
    return out.select("key", "source_image", "n_rows", (F.col("n_rows") * F.col("__images") / F.col("__rows")).alias("amplification"))


def isolation(bank: DataFrame, k: int = 8) -> DataFrame:
    """``key, bank_row, isolation, z``: mean distance to the k nearest other rows, and its z-score in the bank.

    z uses the population deviation and is 0 where that is under 1e-12; banks of at most k + 1 rows are left out.
    """
    big = bank.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("key")
    bank = bank.join(big, "key", "left_semi")
    near = nearest_exact(bank, bank.select("key", F.col("bank_row").alias("query_id"), "embedding"), k, skip_self=True)
    mean = near.groupBy("key", F.col("query_id").alias("bank_row")).agg(F.avg("distance").alias("isolation"))
    per = mean.groupBy("key").agg(F.avg("isolation").alias("m"), F.stddev_pop("isolation").alias("s"))
    return skew_join(mean, per, ["key"], F.col("bank_row")).select("key", "bank_row", "isolation", F.when(F.col("s") < 1e-12, 0.0).otherwise((F.col("isolation") - F.col("m")) / F.col("s")).alias("z"))


def image_isolation(scored: DataFrame, bank: DataFrame, hot: float = 2.0, ranked_rows: int = 3) -> DataFrame:
    """``key, source_image, n_rows, z_mean, z_max, hot_rows, hot_share, ranked`` of the images of a bank."""
    both = scored.join(bank.select("key", "bank_row", "source_image"), ["key", "bank_row"]).where("source_image is not null")
    out = both.groupBy("key", "source_image").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("z").alias("z_mean"), F.max("z").alias("z_max"), F.count_if(F.col("z") >= hot).alias("hot_rows"))
    return out.withColumn("hot_share", F.col("hot_rows") / F.col("n_rows")).withColumn("ranked", F.col("n_rows") >= ranked_rows)


def suspects(images: DataFrame, z: float = 1.0, top: int | None = None) -> DataFrame:
    """The ranked images with ``z_mean`` of at least z, and any with hot rows; ranked first, then by z_mean, then by name; the first ``top`` of each bank if given."""
    hit = images.where((F.col("ranked") & (F.col("z_mean") >= z)) | (F.col("hot_rows") > 0))
    out = hit.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ranked"), F.desc("z_mean"), "source_image")))
    return out.where(F.col("place") <= top) if top else out


def greedy_coreset(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of a greedy k-centre subset, ascending: starts at row 0, then always the row furthest from those taken (the lowest on ties)."""
    if size < 1:
        raise ValueError("a coreset has at least one row")
    if size >= len(x):
        return np.arange(len(x))
    taken, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    for _ in range(size - 1):
        i = int(near.argmax())
        taken.append(i)
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    return np.sort(np.array(taken))


def nearer(x: np.ndarray, near: np.ndarray, centres: np.ndarray, step: int = 512) -> np.ndarray:
    """``near`` lowered to the squared distance of each row of x to its nearest centre, summed as in :func:`greedy_coreset`."""
    centres, near = np.unique(centres, axis=0), near.copy()
    squares = (centres * centres).sum(axis=1)
    for i in range(0, len(x), step):
        v, best = x[i : i + step], near[i : i + step]
        own = (v * v).sum(axis=1)[:, None]
        d = own + squares[None, :] - 2.0 * (v @ centres.T)  # close enough to choose whom to measure
        row, col = np.nonzero(d <= np.minimum(d.min(axis=1), best)[:, None] + 1e-9 * (1.0 + own + squares.max()))
        for j in range(0, len(row), 100_000):
            r, c = row[j : j + 100_000], col[j : j + 100_000]
            np.minimum.at(best, r, ((v[r] - centres[c]) ** 2).sum(axis=1))
    return near


def greedy_steps(x: np.ndarray, ids: np.ndarray, near: np.ndarray, left: int, bound: tuple[float, int] | None) -> list[int]:
    """The next rows of a greedy run, as far as these candidates decide them; ids ascend.

    ``bound`` is the greatest (near, -id) that a row outside the candidates may have. Distances only fall, so
    a candidate at or above the bound is the next row of the whole bank, whatever lies outside.
    """
    taken = []
    while len(taken) < left:
        i = int(near.argmax())
        if bound is not None and (near[i], -ids[i]) < bound:
            break
        if near[i] == 0:  # no row is away from those taken: the lowest again, as greedy_coreset does
            return taken + [i] * (left - len(taken))
        taken.append(i)
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    return taken


def coreset(bank: DataFrame, ratio: float, cap: int = 20_000, group_rows: int = 50_000) -> DataFrame:
    """``key, bank_row, capped`` of the rows kept: max(1, round-half-even(n * ratio)) of each bank, at most ``cap``.

    One greedy run over each bank, in order of bank_row, whatever its size. A bank of up to ``group_rows`` runs in one
    task; a larger one is run in rounds over parts of that size (:func:`_coreset_rounds`) and gives the same rows.
    """
    n = cut(bank.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    want = n.select("key", F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("bigint")).alias("want"), F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    want = want.withColumn("capped", F.col("want") > cap).withColumn("want", F.least("want", F.lit(cap)))
    b = bank.select("key", F.col("bank_row").cast("bigint"), F.col("embedding").cast("array<double>"))
    kind = dict(bank.dtypes)["key"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bank_row")
        return t.take(pa.array(greedy_coreset(matrix(t["embedding"]), t["want"][0].as_py()))).select(["key", "bank_row", "capped"])

    small = b.join(want.where("parts = 1"), "key").groupBy("key").applyInArrow(run, f"key {kind}, bank_row bigint, capped boolean")
    big = want.where("parts > 1")
    return small if big.isEmpty() else small.unionByName(_coreset_rounds(b, big, kind, group_rows))


def _coreset_rounds(b: DataFrame, big: DataFrame, kind: str, group_rows: int) -> DataFrame:
    """The greedy run over the banks in ``big`` (key, want, parts, capped), a round at a time.

    In a round each part lowers its rows' distances by the rows taken last and offers those furthest away, about
    ``group_rows`` / 5 in all parts of a bank; one task a bank takes rows from these while no row that was not offered
    can be further (:func:`greedy_steps`). At least one row is taken in a round, and no task holds more than a part.
    What is left to take is a table too, so any number of banks may be large.
    """
    spark, vec = b.sparkSession, "key {0}, part int, bank_row bigint, embedding array<double>, near double".format(kind)
    parts = cut(big.select("key", "parts"))
    state = skew_join(b, parts, ["key"], F.col("bank_row"))
    state = state.select("key", F.pmod(F.xxhash64("bank_row"), F.col("parts")).cast("int").alias("part"), "bank_row", "embedding", F.lit(float("inf")).alias("near"))
    picks = state.groupBy("key").agg(F.min_by("embedding", "bank_row").alias("embedding"), F.min("bank_row").alias("bank_row")).select("key", "bank_row", "embedding")
    state, picks = cut(state), cut(picks)

    def lower(t: pa.Table, c: pa.Table) -> pa.Table:
        if not len(t):
            return t
        near = nearer(matrix(t["embedding"]), t["near"].to_numpy(), matrix(c["embedding"]))
        return t.set_column(t.schema.get_field_index("near"), "near", pa.array(near, pa.float64()))

    def offer(t: pa.Table) -> pa.Table:
        share = max(1, group_rows // 5 // t["parts"][0].as_py())
        t = t.sort_by([("near", "descending"), ("bank_row", "ascending")])
        return t.slice(0, share).append_column("last", pa.array([i == share - 1 and len(t) > share for i in range(min(share, len(t)))], pa.bool_()))

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("bank_row")
        ids, near = t["bank_row"].to_numpy(), t["near"].to_numpy()
        ends = np.nonzero(t["last"].to_numpy(zero_copy_only=False))[0]
        bound = max(((near[i], -ids[i]) for i in ends), default=None)
        return t.take(pa.array(greedy_steps(matrix(t["embedding"]), ids, near, t["left"][0].as_py(), bound), pa.int64())).select(["key", "bank_row", "embedding"])

    taken, left = [picks], cut(big.select("key", (F.col("want") - 1).alias("left")).where("left > 0"))
    while not left.isEmpty():
        todo = F.broadcast(left) if small_enough(left) else left
        centres = picks.distinct().join(parts, "key").select(F.col("key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("embedding").alias("embedding"))
        state = cut(state.join(todo, "key", "left_semi").groupBy("key", "part").cogroup(centres.groupBy("key", "part")).applyInArrow(lower, vec))
        offered = state.join(parts, "key").groupBy("key", "part").applyInArrow(offer, f"{vec}, parts int, last boolean")
        # written, as a checkpoint keeps the size that was guessed for it: a product of both sides, squared again in each round
        chosen, path = offered.join(todo, "key").groupBy("key").applyInArrow(choose, f"key {kind}, bank_row bigint, embedding array<double>"), new_table_path(spark, "coreset")
        chosen.write.parquet(path)
        picks = spark.read.parquet(path)
        taken.append(picks)
        now = picks.groupBy("key").agg(F.count(F.lit(1)).alias("__k"))
        left = cut(left.join(now, "key", "left").select("key", (F.col("left") - F.coalesce("__k", F.lit(0))).alias("left")).where("left > 0"))
    kept = taken[0].select("key", "bank_row")
    for p in taken[1:]:
        kept = kept.unionByName(p.select("key", "bank_row"))
    return kept.join(big.select("key", "capped"), "key").select("key", "bank_row", "capped")


def top_match_counts(results: DataFrame) -> DataFrame:
    """``bank_version, bank_image, n``: how often an image is the source of a result's top match (the first of its matches)."""
    top = results.where(F.size("matches") > 0).select("bank_version", F.element_at("matches", 1)["bank_image"].alias("bank_image"))
    return top.where("bank_image is not null").groupBy("bank_version", "bank_image").agg(F.count(F.lit(1)).alias("n"))


def patch_index(row: Column, col: Column, width: int) -> Column:
    return row * width + col
