"""The k most similar vectors of the same bank, by collision-counting hashing.

Each block of a bank keeps m random projections, each a sorted array. A query looks up its own projection
in every array and takes the vectors within a window around it. The first windows are narrow; the rows that most of
them reach tell a radius that the k-th best does not exceed, and the windows are widened to what that radius asks
for, and on while fewer than k vectors are found (virtual rehashing: the same arrays serve every radius). A vector met
in at least l of the m windows has reached the collision threshold and is verified by its exact distance. A query ends once the windows
are so wide that a vector as near as its k-th best would have reached the threshold with probability 1 - delta.

The index is built once and kept as a table: a bank is laid out by its first projection, cut into blocks along it,
and each block is a row with its sorted arrays. A query is searched in its home block first. The k-th distance
found there says how wide its windows must be, and only blocks that at least l of these windows reach are searched after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import hot_keys, salted, skew_join
from lotmill.session import cut, new_table_path

#: Rows of a cell: rows that lie together and are passed over together where too few windows reach them.
CELL = 32


def usable_first(df: DataFrame, dim: int, a: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``embedding`` is not null, has ``dim`` numbers and none that is null or NaN, with ``first``, its first projection.

    Told in one pass over Arrow batches, as expressions on arrays are slow in the JVM.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(pa.chunked_array([b.column("embedding")]), dim)
            good = ~np.isnan(x).any(axis=1)
            p = np.full(len(x), np.nan)
            p[good] = project(x[good], a[:, :1]).ravel()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "first"]).filter(pa.array(good))

    return df.where(F.size("embedding") == dim).mapInArrow(run, f"{kinds}, first double")


def _phi(x: float) -> float:
    """P(|N(0,1)| <= x)."""
    return math.erf(x / math.sqrt(2))


def reach(m: int, share: float, delta: float) -> tuple[int, float]:
    """(l, z): the threshold l = share * m, and the least half-width z, in units of a vector's distance, at which it collides l times with probability 1 - delta."""
    l, lo, hi = max(1, round(share * m)), 0.0, 8.0
    for _ in range(50):
        z = (lo + hi) / 2
        p = _phi(z)
        miss = sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(l))
        lo, hi = (z, hi) if miss > delta else (lo, z)
    return l, hi


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def project(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Projections; infinities are taken as the largest number there is, so that they sort and never give NaN."""
    big = np.finfo(np.float32).max
    return np.clip(x.astype(np.float64), -big, big) @ a


def lay_out(proj: np.ndarray, cell: int = CELL) -> np.ndarray:
    """An order of the rows in which each ``cell`` of them lies close together: halved by one projection after another."""
    n = len(proj)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    for level in range(max(0, math.ceil(math.log2(max(1, n) / cell)))):
        order = np.lexsort((proj[:, level % proj.shape[1]], group))
        start = np.searchsorted(group[order], group[order])
        size = np.searchsorted(group[order], group[order], side="right") - start
        group[order] = group[order] * 2 + (np.arange(n) - start >= size / 2)
    return np.argsort(group, kind="stable")


class CollisionIndex:
    """The sorted projections of one block of vectors: ``order`` has each projection's rows in order, ``vals`` their values."""

    def __init__(self, x: np.ndarray, order: np.ndarray, a: np.ndarray, share: float = 0.5, delta: float = 1e-4, growth: float = 4.0):
        self.x, self.a, self.growth = x.astype(np.float64), a, growth
        self.vals = np.take_along_axis(np.ascontiguousarray(project(x, a).T), order.astype(np.int64), axis=1)
        self.n, self.m = len(x), a.shape[1]
        self.l, self.z = reach(self.m, share, delta)
        self.kind = np.uint16 if self.n < 2**16 - 1 else np.uint32
        cells = -(-self.n // CELL)
        ranks = np.full((self.m, cells * CELL), np.iinfo(self.kind).max, dtype=self.kind)  # the padding is in no window
        np.put_along_axis(ranks, order.astype(np.int64), np.broadcast_to(np.arange(self.n, dtype=self.kind), order.shape), axis=1)
        self.ranks = np.ascontiguousarray(ranks.reshape(self.m, cells, CELL))
        self.low = self.ranks.min(axis=2).astype(np.int64)
        self.high = np.where(self.ranks == np.iinfo(self.kind).max, 0, self.ranks).max(axis=2).astype(np.int64)

    @staticmethod
    def built(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, order, range): rows is the layout, ``order`` the sorted arrays of x[rows], range the least and greatest of each projection."""
        proj = project(x, a)
        rows = lay_out(proj)
        proj = proj[rows].T
        order = np.argsort(proj, axis=1, kind="stable")
        return rows, order.astype(np.uint16 if len(x) < 2**16 else np.int32), np.stack([proj.min(axis=1), proj.max(axis=1)]) if len(x) else np.empty((2, 0))

    def search(self, queries: np.ndarray, k: int, tie: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance) of the k best of each query; ties go to the lower ``tie``. ``within``: distances beyond which nothing is asked for."""
        size = max(1, 4_000_000 // (self.ranks.shape[1] * self.m))
        within = np.full(len(queries), np.inf) if within is None else within
        parts = [self._search(queries[i : i + size], k, tie, within[i : i + size], i) for i in range(0, len(queries), size)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))

    def _collided(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that lie in at least l of the windows [a, b) of ranks, cell by cell."""
        reached = np.zeros((len(a), self.ranks.shape[1]), dtype=np.int16)
        for j in range(self.m):
            reached += (self.high[j] >= a[:, j : j + 1]) & (self.low[j] < b[:, j : j + 1])
        q, c = np.nonzero(reached >= self.l)
        found_q, found_r, step = [], [], 8192
        lo, width = a.astype(self.kind), (b - a).astype(self.kind)
        for i in range(0, len(q), step):
            qi, ci = q[i : i + step], c[i : i + step]
            hits = np.zeros((len(qi), CELL), dtype=np.uint8)
            for j in range(self.m):
                hits += (self.ranks[j, ci] - lo[qi, j, None]) < width[qi, j, None]
            p, o = np.nonzero(hits >= self.l)
            found_q.append(qi[p])
            found_r.append(ci[p] * CELL + o)
        return (np.concatenate(found_q), np.concatenate(found_r)) if found_q else (np.empty(0, int), np.empty(0, int))

    def _near(self, q: np.ndarray, proj: np.ndarray, at: np.ndarray, k: int, cells: int = 3) -> np.ndarray:
        """A distance that the k-th best does not exceed: the k-th among the rows of those cells that most of the first windows reach."""
        lo, hi = np.maximum(at - k, 0), at + k
        reached = np.zeros((len(q), self.ranks.shape[1]), dtype=np.int16)
        for j in range(self.m):
            reached += (self.high[j] >= lo[:, j : j + 1]) & (self.low[j] < hi[:, j : j + 1])
        cells = min(max(cells, -(-k // CELL) + 1), reached.shape[1])
        best = np.argpartition(-reached, cells - 1, axis=1)[:, :cells]
        rows = (best[:, :, None] * CELL + np.arange(CELL)).reshape(len(q), -1)
        d = np.empty(rows.shape)
        with np.errstate(invalid="ignore"):
            for i in range(0, len(q), 64):
                away = self.x[np.minimum(rows[i : i + 64], self.n - 1)] - q[i : i + 64, None, :]
                d[i : i + 64] = np.einsum("ijk,ijk->ij", away, away)
        d = np.where((rows >= self.n) | np.isnan(d), np.inf, d)
        return np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])

    def _search(self, queries: np.ndarray, k: int, tie: np.ndarray, within: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m, want = self.n, self.m, min(k, self.n)
        q, proj = queries.astype(np.float64), project(queries, self.a)
        at = np.stack([np.searchsorted(self.vals[j], proj[:, j]) for j in range(m)], axis=1)
        within = np.minimum(within, self._near(q, proj, at, want))
        half = np.where(np.isfinite(within), np.maximum(within * self.z, 1e-9), 1.0)
        live, out = np.arange(len(q)), []
        while len(live):
            a = np.stack([np.searchsorted(self.vals[j], proj[live, j] - half[live]) for j in range(m)], axis=1)
            b = np.stack([np.searchsorted(self.vals[j], proj[live, j] + half[live], side="right") for j in range(m)], axis=1)
            i, row = self._collided(a, b)
            d = np.empty(len(i))
            with np.errstate(invalid="ignore"):
                for s in range(0, len(i), 4096):  # verified now
                    away = self.x[row[s : s + 4096]] - q[live[i[s : s + 4096]]]
                    d[s : s + 4096] = np.einsum("ij,ij->i", away, away)
            d = np.where(np.isnan(d), np.inf, d)
            by = np.lexsort((tie[row], d, i))
            i, row, d = i[by], row[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = np.full(len(live), np.inf)
            best[i[place == want - 1]] = d[place == want - 1]
            need = np.minimum(np.sqrt(best), within[live]) * self.z
            going = (half[live] < need) & ((b - a).min(axis=1) < n)
            keep = (place < k) & ~going[i]
            out.append((live[i[keep]] + first, row[keep], d[keep]))
            # straight to the radius that settles the present k-th best; without one, wider by a step
            half[live] = np.where(need < np.inf, need, np.minimum(half[live] * self.growth, np.finfo(float).max))
            live = live[going]
        i, row, d = (np.concatenate(c) for c in zip(*out, strict=True))
        by = np.lexsort((tie[row], d, i))
        return i[by], row[by], d[by]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float32())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(bank: DataFrame, path: str, dim: int = 32, block_rows: int = 20_000, m: int = 32, seed: int = 7) -> DataFrame:
    """Write the index of ``bank`` (bank_key, near_id, near_rank, embedding) to ``path`` and read it back; unusable vectors are left out.

    ``bank_key, block, lo, hi, rows, ids, ranks, x, order``: a row a block of about ``block_rows`` vectors, with the
    range of each projection, the vectors in their layout and the sorted arrays. Blocks are ranges of the first
    projection (then of the id, so that equal vectors are cut up too): one shuffle, in which each vector lies once.
    """
    kind, a = dict(bank.dtypes)["bank_key"], directions(dim, m, seed)
    n = bank.count()

    schema = f"bank_key {kind}, block int, lo array<double>, hi array<double>, rows int, ids binary, ranks binary, x binary, order binary"

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("bank_key")
        keys = t["bank_key"].combine_chunks()
        codes = keys.dictionary_encode().indices.to_numpy()
        x, ids, ranks = _matrix(t["embedding"], dim), t["near_id"].to_numpy(), t["near_rank"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
        for i, j in zip(edges, edges[1:], strict=False):
            rows, order, span = CollisionIndex.built(x[i:j], a)
            blob = lambda v: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
            arrays = [keys.slice(i, 1), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([span[0].tolist()]), pa.array([span[1].tolist()]), pa.array([j - i], pa.int32())]
            arrays += [blob(ids[i:j][rows].astype(np.int64)), blob(ranks[i:j][rows].astype(np.int64)), blob(x[i:j][rows].astype(np.float32)), blob(order)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    laid = usable_first(bank, dim, a).repartitionByRange(max(1, -(-n // block_rows)), "bank_key", "first", "near_id")
    laid.mapInArrow(block, schema).write.mode("overwrite").parquet(path)
    return bank.sparkSession.read.parquet(path)


def nearest(bank: DataFrame, queries: DataFrame, k: int = 5, dim: int = 32, block_rows: int = 20_000, query_rows: int = 5_000, m: int = 32, share: float = 0.5, delta: float = 1e-4, seed: int = 7, path: str | None = None) -> DataFrame:
    """``query_id, near_id, near_rank, distance, place``: the k nearest bank vectors of the query's own bank.

    ``bank`` has (bank_key, near_id, near_rank, embedding), ``queries`` (bank_key, query_id, embedding);
    other columns are ignored. Null keys belong to no bank. Unusable vectors (null, another length, a null or NaN in them)
    are left out on both sides; infinities are kept, their distances are infinite. Ties of distance go to the lower
    ``near_rank``, then ``near_id``; identical vectors all count; banks with fewer than k usable vectors give all
    of them; a query of an unknown bank gives no row. Distances are exact. ``query_id`` is unique.

    Every vector is indexed, once; the index stays at ``path``. A block is shuffled once to its queries, and again only for
    each further ``query_rows`` queries that come to it. A neighbour is missed with probability ``delta`` at most for each block.
    """
    bank = bank.where(F.col("bank_key").isNotNull()).select("bank_key", F.col("near_id").cast("bigint"), F.col("near_rank").cast("bigint"), F.col("embedding").cast("array<float>"))
    queries = queries.where(F.col("bank_key").isNotNull()).select(F.col("bank_key").alias("bank_key"), F.col("query_id").cast("bigint"), F.col("embedding").cast("array<float>"))
    index = build_index(bank, path or new_table_path(bank.sparkSession, "vectors"), dim, block_rows, m, seed)
    a, (l, z) = directions(dim, m, seed), reach(m, share, delta)
    kind = dict(index.dtypes)["bank_key"]
    out = pa.schema([("query_id", pa.int64()), ("near_id", pa.int64()), ("near_rank", pa.int64()), ("d2", pa.float64())])

    def search(b: pa.Table, q: pa.Table) -> pa.Table:
        if not len(b) or not len(q):
            return out.empty_table()
        r = {c: np.frombuffer(b[c][0].as_py(), dtype=t) for c, t in (("ids", np.int64), ("ranks", np.int64), ("x", np.float32), ("order", np.uint16 if b["rows"][0].as_py() < 2**16 else np.int32))}
        one = CollisionIndex(r["x"].reshape(-1, dim), r["order"].reshape(m, -1), a, share, delta)
        tie = np.argsort(np.lexsort((r["ids"], r["ranks"])))
        i, row, d = one.search(_matrix(q["embedding"], dim), k, tie, q["within"].to_numpy())
        return pa.table([q["query_id"].to_numpy()[i], r["ids"][row], r["ranks"][row], d], schema=out)

    def searched(q: DataFrame, every: bool) -> DataFrame:
        """q: (bank_key, block, query_id, embedding, within). Unless nearly ``every`` block is asked for, only those that are leave the index."""
        keys = ["bank_key", "block"]
        own = index if every else skew_join(index, cut(q.select(*keys).distinct()), keys, F.col("block"), "left_semi")
        many, few = salted(q, own, keys, hot_keys(q, keys, query_rows), F.col("query_id"))
        return few.groupBy(*keys, "__salt").cogroup(many.groupBy(*keys, "__salt")).applyInArrow(search, "query_id bigint, near_id bigint, near_rank bigint, d2 double")

    # home: the last block of the bank that begins at or before the query's first projection
    blocks = cut(index.select("bank_key", "block", "lo", "hi"))
    starts = blocks.groupBy("bank_key").agg(F.array_sort(F.collect_list(F.struct(F.col("lo")[0].alias("lo"), "block"))).alias("starts"))

    laid = usable_first(queries, dim, a)
    laid = skew_join(laid, starts, ["bank_key"], F.col("query_id"))
    before = F.filter("starts", lambda s: s["lo"] <= F.col("first"))
    home = F.coalesce(F.try_element_at(before, F.lit(-1)), F.element_at("starts", 1))["block"]
    laid = cut(laid.select("bank_key", home.alias("block"), "query_id", "embedding", F.lit(float("inf")).alias("within"), (F.size("starts") > 1).alias("more")))
    best = searched(laid.drop("more"), True)
    if not blocks.groupBy("bank_key").count().where("count > 1").isEmpty():
        best = cut(best)
        kth = best.groupBy("query_id").agg(F.max("d2").alias("d2"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_id", F.sqrt("d2").alias("__within"))
        asked = laid.where("more").drop("within", "more").withColumnRenamed("block", "home").join(kth, "query_id", "left")
        asked = skew_join(asked, blocks, ["bank_key"], F.col("query_id")).where("block <> home")

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                lo, hi = (np.asarray(b.column(c).flatten()).reshape(-1, m) for c in ("lo", "hi"))
                p, within = project(_matrix(pa.chunked_array([b.column("embedding")]), dim), a), np.nan_to_num(b.column("__within").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                half = (within * z)[:, None]
                met = (((lo - p) <= half) & ((p - hi) <= half)).sum(axis=1) >= l
                names = ["bank_key", "block", "query_id", "embedding"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(within)], [*names, "within"]).filter(pa.array(met))

        asked = asked.mapInArrow(reached, f"bank_key {kind}, block int, query_id bigint, embedding array<float>, within double")
        best = best.unionByName(searched(cut(asked), False))
    place = Window.partitionBy("query_id").orderBy("d2", "near_rank", "near_id")
    best = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return best.select("query_id", "near_id", "near_rank", F.sqrt("d2").alias("distance"), "place")
