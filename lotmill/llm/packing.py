"""Filling fixed-capacity containers with texts.

First-fit decreasing, run independently in randomised groups: the open containers are the leaves of a
tournament tree whose inner nodes hold the larger free capacity of their children, so the first container
that an item fits into is found in as many steps as the tree is deep.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tournament:
    """Containers in order of opening; finds the first with enough free capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.leaves = capacity, 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first container with room for ``size`` (of at most the capacity), now holding it; containers never run out."""
        free, i = self.free, 1
        while i < self.leaves:
            i = 2 * i if free[2 * i] >= size else 2 * i + 1
        free[i] -= size
        at = i - self.leaves
        while i > 1:
            i //= 2
            free[i] = max(free[2 * i], free[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container (from 0) of each item; ties of size keep their order. Items must fit the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, out = Tournament(capacity, len(sizes)), [0] * len(sizes)
    for i in order:
        out[i] = bins.put(sizes[i])
    return out


def pack(items: DataFrame, specs: DataFrame, group_items: int = 20_000, seed: int = 3) -> DataFrame:
    """``spec_id, doc_id, piece, tokens, container_id``: a row for each piece of each text and container size.

    ``items`` has (doc_id, tokens), ``specs`` (spec_id, capacity_tokens). A text over the capacity is split into
    full containers' worth and one rest; every other text is a single piece 0. Texts of null or no tokens take a
    container's place but no room, so they too come out. Repeated ids are packed each. Specs without a positive
    capacity are skipped. Full pieces have containers of their own and never enter a group.

    Groups are drawn by a hash of id, tokens and seed; their number follows the number of items, so a group holds
    about ``group_items`` of them at any size. The waste this costs is at most one part-filled container or so a group.
    """
    items = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("size"))
    specs = specs.where("capacity_tokens > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("cap")).distinct()
    sizes = specs.collect()  # a row a container size
    empty = items.sparkSession.createDataFrame([], "spec_id int, doc_id bigint, piece bigint, tokens bigint, container_id string")
    groups = max(1, -(-items.count() // group_items)) if sizes else 1
    # container sizes are written into the plan, so many at a time
    for i in range(0, len(sizes), 1000):
        empty = empty.unionByName(_pack(items, sizes[i : i + 1000], groups, seed))
    return empty


def _pack(items: DataFrame, sizes: list, groups: int, seed: int) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(r["spec_id"]).alias("spec_id"), F.lit(r["cap"]).alias("cap")) for r in sizes)))
    laid = items.withColumn("s", each).select("s.spec_id", "s.cap", "doc_id", "size").withColumn("full", F.expr("size div cap"))
    laid = laid.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(groups)).cast("int"))

    whole = laid.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    whole = whole.select("spec_id", "doc_id", "piece", F.col("cap").alias("tokens"), F.concat_ws("-", F.lit("f"), "spec_id", "doc_id", "piece").alias("container_id"))
    rest = laid.where("full = 0 or size % cap > 0").select("spec_id", "grp", "cap", "doc_id", F.col("full").alias("piece"), (F.col("size") % F.col("cap")).alias("tokens"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at = first_fit_decreasing(pdf["tokens"].tolist(), int(pdf["cap"].iloc[0]))
        pdf["container_id"] = [f"g-{key[0]}-{key[1]}-{b}" for b in at]
        return pdf[["spec_id", "doc_id", "piece", "tokens", "container_id"]]

    filled = rest.groupBy("spec_id", "grp").applyInPandas(fill, "spec_id int, doc_id bigint, piece bigint, tokens bigint, container_id string")
    return whole.unionByName(filled)


def fills(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity_tokens, containers, pieces, tokens, fill``: what each container size came to."""
    one = packed.groupBy("spec_id", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    per = one.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    caps = specs.where("capacity_tokens > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    out = caps.join(F.broadcast(per), "spec_id")
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).select("spec_id", "capacity_tokens", "containers", "pieces", "tokens", "fill")
