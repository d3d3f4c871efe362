"""Splits that keep records together which share a lot or a source picture.

Boruvka-style contraction: in every round each component picks its least incident edge, the picked edges
join the spanning forest (a table in the shared folder) and the components they tie are contracted. The
roots of the forest are then stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import BROADCAST_ROWS, ranked, skew_join, small_enough
from lotmill.session import cut, new_table_path


def tie_edges(links: DataFrame) -> DataFrame:
    """``a, b``: a star for each ``tie`` of ``links`` (entity, tie): its least entity to each other one.

    It spans the same components as all pairs would, with one edge less than entities. Ties with a
    single entity give none; nulls on either side tie nothing; repeated links give one edge.
    """
    links = links.select("entity", "tie").where("entity is not null and tie is not null")
    hubs = links.groupBy("tie").agg(F.min("entity").alias("a"), F.max("entity").alias("z")).where("a < z").select("tie", "a")
    return skew_join(links, hubs, ["tie"], F.col("entity")).where("entity <> a").select("a", F.col("entity").alias("b")).distinct()


def spanning_forest(spark: SparkSession, edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of an undirected graph with edges ``a, b`` of strings.

    forest: ``a, b``, the edges of a spanning forest, read back from the table it was written to, ``path``/edges.
    roots: ``node, root`` for every node that has an edge; the root is the least node of its component; ``path``/roots.
    Self-loops and repeated edges change nothing; null ends are dropped; no edges give empty tables. A later run may
    read both by :func:`read_forest` instead of contracting again; without ``path`` a new folder of the shared folder is used.

    Edges are ordered by their ends, so each component's least edge is unique and picked edges can close
    cycles of two only, which are opened at the lesser end. A round at least halves the components that
    still have edges, so there are at most log2(nodes) rounds; every round's state is checkpointed.
    """
    path = path or new_table_path(spark, "forest")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    live = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"))
    spark.createDataFrame([], "a string, b string").write.mode("overwrite").parquet(f"{path}/edges")
    hops: list[DataFrame] = []  # for each round: component -> component it went into
    while (edges_left := live.count()) > 0:
        few = edges_left <= BROADCAST_ROWS // 2  # a component that has edges has one at least, so two ends an edge bound them all
        ends = F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("to")), F.struct(F.col("v").alias("c"), F.col("u").alias("to"))))
        picked = live.select(ends.alias("e"), "a", "b").groupBy("e.c").agg(F.min(F.struct("a", "b", "e.to")).alias("x")).select("c", "x.a", "x.b", "x.to")
        picked = cut(picked)
        small = few and small_enough(picked)
        picked.select("a", "b").distinct().write.mode("append").parquet(f"{path}/edges")
        # c -> to; of two that picked the same edge the lesser becomes the root
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = skew_join(picked.select("c", "to"), back, ["to"], F.col("c"), is_small=small).select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("r"))
        up, moved = cut(up), True
        while moved:  # pointer jumping, two doublings at a time
            for _ in range(2):
                up = _jump(up, small)
            up = cut(up)
            over = up.select(F.col("c").alias("r"), F.col("r").alias("rr"))
            moved = not skew_join(up, over, ["r"], F.col("c"), is_small=small).where("r <> rr").isEmpty()
        hops.append(up)
        for end in ("u", "v"):
            live = skew_join(live, up.select(F.col("c").alias(end), F.col("r").alias("__r")), [end], F.struct("a", "b"), is_small=small).drop(end).withColumnRenamed("__r", end)
        # of parallel edges only the least can be picked later
        live = cut(live.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("a", "b")).alias("x")).select("u", "v", "x.a", "x.b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("top", F.col("node"))
    for up in hops:
        nodes = skew_join(nodes, up.select(F.col("c").alias("top"), "r"), ["top"], F.col("node"), "left").select("node", F.coalesce("r", "top").alias("top"))
    nodes = cut(nodes)
    least = nodes.groupBy("top").agg(F.min("node").alias("root"))
    skew_join(nodes, least, ["top"], F.col("node")).select("node", "root").write.mode("overwrite").parquet(f"{path}/roots")
    return read_forest(spark, path)


def read_forest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) that :func:`spanning_forest` wrote to ``path``."""
    return spark.read.schema("a string, b string").parquet(f"{path}/edges"), spark.read.schema("node string, root string").parquet(f"{path}/roots")


def _jump(up: DataFrame, small: bool) -> DataFrame:
    over = up.select(F.col("c").alias("r"), F.col("r").alias("rr"))
    return skew_join(up, over, ["r"], F.col("c"), is_small=small).select("c", F.col("rr").alias("r"))


def groups(rows: DataFrame, row_id: Column, entity: Column, tie: Column, path: str | None = None) -> DataFrame:
    """``row_id, root``: the group of each row; all rows that share an entity or a tie, directly or through others, have one root.

    The root is ``e:`` and the least entity of the group, ``t:`` and the tie where no row of the group names an
    entity, ``r:`` and the row's own id where it names neither. The forest stays at ``path``.
    """
    spark = rows.sparkSession
    base = cut(rows.select(row_id.cast("bigint").alias("row_id"), entity.cast("string").alias("entity"), tie.cast("string").alias("tie")))
    links = base.select("entity", "tie").distinct()
    _, roots = spanning_forest(spark, tie_edges(links), path)
    hubs = links.where("entity is not null and tie is not null").groupBy("tie").agg(F.min("entity").alias("hub"))
    named = base.where("entity is not null").select("row_id", "entity")
    rest = skew_join(base.where("entity is null and tie is not null").select("row_id", "tie"), hubs, ["tie"], F.col("row_id"), "left")
    named = named.unionByName(rest.where("hub is not null").select("row_id", F.col("hub").alias("entity")))
    named = skew_join(named, roots.withColumnRenamed("node", "entity"), ["entity"], F.col("row_id"), "left")
    out = named.select("row_id", F.concat(F.lit("e:"), F.coalesce("root", "entity")).alias("root"))
    out = out.unionAll(rest.where("hub is null").select("row_id", F.concat(F.lit("t:"), "tie")))
    return out.unionAll(base.where("entity is null and tie is null").select("row_id", F.concat(F.lit("r:"), F.col("row_id").cast("string"))))


def draw(seed: int, root: Column) -> Column:
    """A number of 60 bits, spread over those of 64, from the md5 of seed and root: the same in any engine."""
    return F.shiftleft(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), root)), 1, 15), 16, 10).cast("bigint"), 4).bitwiseXOR(F.lit(-(2**63)))


def deal(grouped: DataFrame, targets: list[tuple[str, float]], seed: int = 11, one_by_one: float = 0.001) -> DataFrame:
    """``row_id, root, split_name`` for ``grouped`` (row_id, root) and (name, share) targets, which need not sum to one.

    Roots are stratified by size band (powers of two). Within a band they lie in an order drawn by hash and are dealt
    systematically along it, in the shares that are still open. Bands whose roots may have over ``one_by_one`` of the rows
    come first, largest first, and take up what was missed before, root by root: each goes to the split that lacks most. There are under
    1/one_by_one such roots at any size of input; every other root has less than that share of the rows, so each band
    of those misses its shares by less. With ``one_by_one`` of 1 all roots are dealt systematically.
    """
    spark = grouped.sparkSession
    weights = [(n, max(0.0, s or 0.0)) for n, s in targets]
    scale = sum(s for _, s in weights)
    if not scale:
        raise ValueError("the target shares sum to nothing")
    if not 0 < one_by_one <= 1:
        raise ValueError("one_by_one is a share of the rows")
    shares = {n: s / scale for n, s in weights}
    sizes = cut(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    sizes = sizes.withColumn("band", F.char_length(F.bin("size")) - 1)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    limit = max(1, int(total * one_by_one))
    heads = sizes.where(F.col("size") > limit).orderBy(F.desc("band"), draw(seed, F.col("root")), "root").collect()  # fewer than 1/one_by_one can be that large
    got, placed = dict.fromkeys(shares, 0), []
    for r in heads:
        name = max(shares, key=lambda s: shares[s] * total - got[s])
        got[name] += r["size"]
        placed.append((r["root"], name))
    open_ = {n: max(0.0, s * total - got[n]) for n, s in shares.items()}
    left = sum(open_.values()) or 1.0
    tail = ranked(sizes.where(F.col("size") <= limit), ["band"], draw(seed, F.col("root")), ["root"], F.col("size"))
    bands = sizes.where(F.col("size") <= limit).groupBy("band").agg(F.sum("size").alias("whole"))  # at most 63 rows
    at = (F.col("__upto") - F.col("size") / 2) / F.col("whole")
    upto, pick = 0.0, F.lit(list(shares)[-1])
    cuts = []
    for n, x in open_.items():
        upto += x / left
        cuts.append((n, upto))
    for n, u in reversed(cuts[:-1]):
        pick = F.when(at < u, n).otherwise(pick)
    tail = tail.join(F.broadcast(bands), "band").select("root", pick.alias("split_name"))
    dealt = tail.unionByName(spark.createDataFrame(placed, "root string, split_name string"))
    return skew_join(grouped.select("row_id", "root"), cut(dealt), ["root"], F.col("row_id"))


def shares_reached(dealt: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name, target_share, row_count, group_count, reached_share``, a row for each target."""
    by_root = dealt.groupBy("split_name", "root").agg(F.count(F.lit(1)).alias("n"))
    per = by_root.groupBy("split_name").agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("group_count"))
    out = targets.select("split_name", "target_share").join(F.broadcast(per), "split_name", "left")
    out = out.withColumn("total", F.sum("row_count").over(Window.partitionBy(F.lit(0))))  # as few rows as there are targets
    zero = F.lit(0).cast("bigint")
    return out.select("split_name", "target_share", F.coalesce("row_count", zero).alias("row_count"), F.coalesce("group_count", zero).alias("group_count"), (F.coalesce("row_count", zero) / F.col("total")).alias("reached_share"))
