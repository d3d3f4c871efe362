"""Records of evaluation splits that also appear, whole or in part, in the training split.

Normalised evaluation texts are cut into passages: each run of a few parts, and the text as a whole. Passages are
sharded; each shard builds an Aho-Corasick automaton of its passages and scans every training text that can hold
one of them. The matched positions are merged into intervals, which give the coverage of an evaluation record.

A passage goes to the shard of its rarest part, its anchor. Whoever holds the passage holds that part, in a run
whose rarest part it is, so a training text is sent to the shards of its own runs' anchors and to no other, and each
shard sees all texts that can match. How rare a part is comes from counts in a fixed number of buckets, so that
table has the same size at any scale; passages and texts of a part that is common all the same are cut into cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import hot_keys, salted_grid, skew_join, small_enough
from lotmill.session import cut

#: Stands before, between and behind the parts of a normalised text; names never hold it.
SEP = "\x1f"
TILE, WHOLE, TRAIN = 0, 1, 2


def spelled(name: Column, between: str = "|/") -> Column:
    """A name as parts between separators; null stays null."""
    return F.concat(F.lit(SEP), F.translate(name, between, SEP * len(between)), F.lit(SEP))


def parts(text: str) -> list[str]:
    return text[1:-1].split(SEP)


def tiles(text: str, width: int) -> list[tuple[int, str]]:
    """(position, passage) of each run of ``width`` parts of a text, separators included; of the whole text if it has fewer."""
    ps = parts(text)
    if len(ps) <= width:
        return [(0, text)]
    starts = [0, *accumulate(len(p) + 1 for p in ps)]
    return [(starts[i], text[starts[i] : starts[i + width] + 1]) for i in range(len(ps) - width + 1)]


def scan_shard(passages: list[str], texts: list[str]) -> Iterator[tuple[int, int]]:
    """(text, passage) for each occurrence of a passage in a text, from one automaton of all passages."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, p in enumerate(passages):
        automaton.add_word(p, i)
    if not len(automaton):
        return
    automaton.make_automaton()
    for t, text in enumerate(texts):
        for _, i in automaton.iter(text):
            yield t, i


def _bucket(part: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(part) % size


def matches(train: DataFrame, evaluation: DataFrame, width: int = 3, rows_per_shard: int = 50_000, buckets: int = 2**16) -> DataFrame:
    """``passage, whole, train_text`` of the evaluation passages that some training text holds.

    Both inputs have a column ``text`` of :func:`spelled` texts. ``whole`` passages are evaluation texts, each with every
    distinct training text that holds it; for other passages one row says that there is such a text. Repeats are removed
    map-side first. Texts of fewer than ``width`` parts are one passage and are looked for among texts that have the same
    anchor. Nulls match nothing; empty inputs give no rows.
    """
    both = train.select("text", F.lit(True).alias("train")).unionAll(evaluation.select("text", F.lit(False).alias("train")))
    both = cut(both.where("text is not null").distinct())
    schema = pa.schema([("bucket", pa.int64()), ("train", pa.bool_()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, is_train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
                held[is_train].update(set(parts(text)))
            for side in (0, 1):
                for p, n in held[side].items():
                    seen[side, _bucket(p, buckets)] += n
        side, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(side == 1), pa.array(seen[side, at])], schema=schema)

    rare = np.zeros((2, buckets), dtype=np.int64)
    counts = both.mapInArrow(count, "bucket bigint, train boolean, n bigint").groupBy("bucket", "train").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # at most two rows a bucket, whatever the input
        rare[int(r["train"]), r["bucket"]] = r["n"]
    shards = max(1, -(-2 * both.count() // rows_per_shard))
    cells = np.maximum(1, -(-rare // rows_per_shard))  # of an anchor: (evaluation, training)
    total = rare.sum(axis=0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def place(part: str) -> tuple[int, str, int, int, int]:
            """(how often it occurs, the part, where its shards begin, its cells of either side); the least is the anchor."""
            found = known.get(part)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                at = _bucket(part, buckets)
                found = known[part] = int(total[at]), part, xxhash.xxh3_64_intdigest(part, seed=1), int(cells[0, at]), int(cells[1, at])
            return found

        for b in batches:
            out: set = set()
            for text, is_train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
                at = [place(p) for p in parts(text)]
                runs = range(max(1, len(at) - width + 1))
                if is_train:
                    for _, _, h, ne, nt in {min(at[i : i + width]) for i in runs}:
                        own = xxhash.xxh3_64_intdigest(text) % nt if nt > 1 else 0
                        out.update(((h + own * ne + e) % shards, TRAIN, text) for e in range(ne))
                    continue
                asked = [(text, WHOLE, min(at))]
                if len(at) > width:
                    asked += [(p, TILE, min(at[i : i + width])) for i, (_, p) in zip(runs, tiles(text, width), strict=True)]
                for p, kind, (_, _, h, ne, nt) in asked:
                    mine = xxhash.xxh3_64_intdigest(p) % ne if ne > 1 else 0
                    out.update(((h + t * ne + mine) % shards, kind, p) for t in range(nt))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["shard", "kind", "text"])

    found = pa.schema([("passage", pa.string()), ("whole", pa.bool_()), ("train_text", pa.string())])

    def scan(t: pa.Table) -> pa.Table:
        kinds, texts = t["kind"].to_numpy(), t["text"].to_pylist()
        scanned = list({texts[i] for i in np.flatnonzero(kinds == TRAIN)})
        whole = {texts[i] for i in np.flatnonzero(kinds == WHOLE)}
        tile = {texts[i] for i in np.flatnonzero(kinds == TILE)}
        passages = list(whole | tile)
        held, seen = set(), set()
        for x, i in scan_shard(passages, scanned):
            p = passages[i]
            if p in whole:
                held.add((p, scanned[x]))
            if p in tile:
                seen.add(p)
        rows = [(p, True, x) for p, x in held] + [(p, False, None) for p in seen]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, found, strict=True)], schema=found)

    routed = both.mapInArrow(route, "shard bigint, kind int, text string")
    return cut(routed.groupBy("shard").applyInArrow(scan, "passage string, whole boolean, train_text string")).distinct()


@dataclass(frozen=True)
class Overlap:
    """What :func:`overlaps` found: rows of both sides with their texts (``keys``, a column for each kind), and the matches."""

    train: DataFrame
    evaluation: DataFrame
    hits: DataFrame
    kinds: list[str]
    width: int
    rows_per_group: int

    @property
    def keys(self) -> list[str]:
        return [f"n{i}" for i in range(len(self.kinds))]

    def _same(self, key: str) -> DataFrame:
        """The matched evaluation texts that a training text equals: the exact check behind the scan."""
        return self.hits.where(F.col("whole") & (F.col("passage") == F.col("train_text"))).select(F.col("passage").alias(key))

    def pairs(self) -> DataFrame:
        """``train_id, eval_id, split, kind``: rows with a matched text that is the same, each pair once, under the first kind that ties it.

        Both sides of a text that many rows share are cut into parts, and parts meet parts.
        """
        keys, out, few = self.keys, None, small_enough(self.hits)
        for i, kind in enumerate(self.kinds):
            earlier, same = keys[:i], self._same(keys[i])
            a = skew_join(self.train, same, [keys[i]], F.col("row_id"), is_small=few).select(F.col(keys[i]).alias("text"), F.col("row_id").alias("train_id"), *(F.col(c).alias(f"a_{c}") for c in earlier))
            b = skew_join(self.evaluation, same, [keys[i]], F.col("row_id"), is_small=few).select(F.col(keys[i]).alias("text"), F.col("row_id").alias("eval_id"), "split", *(F.col(c).alias(f"b_{c}") for c in earlier))
            hot = [hot_keys(x, ["text"], self.rows_per_group) for x in (a, b)]
            a, b = salted_grid(a, b, ["text"], *hot, F.col("train_id"), F.col("eval_id"))
            p = a.join(b, ["text", "__salt", "__salt_b"])
            for c in earlier:  # tied by an earlier kind already
                p = p.where(~F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)))
            p = p.select("train_id", "eval_id", "split", F.lit(kind).alias("kind"))
            out = p if out is None else out.unionAll(p)
        return out

    def partners(self) -> DataFrame:
        """``row_id, split, n0..., partners``: evaluation rows that have a pair, with the number of training rows they pair with.

        The number comes from counts of each kind less those of kinds together; no pair is made.
        """
        keys = self.keys
        out = self.evaluation.withColumn("partners", F.lit(0).cast("bigint"))
        for k in range(1, len(keys) + 1):
            for some in combinations(keys, k):
                rows = self.train
                for c in some:
                    rows = skew_join(rows, self._same(c), [c], F.col("row_id"))
                n = cut(rows.groupBy(*some).agg(F.count(F.lit(1)).alias("__c")))
                out = skew_join(out, n, list(some), F.col("row_id"), "left")
                out = out.withColumn("partners", F.col("partners") + F.lit((-1) ** (k + 1)) * F.coalesce("__c", F.lit(0))).drop("__c")
        return out.where("partners > 0").select("row_id", "split", *keys, "partners")

    def coverage(self) -> DataFrame:
        """``row_id, split, covered, held, length, coverage`` of every evaluation row that has a text.

        length: characters of its texts; covered: those within the merged intervals of passages that training texts hold,
        coverage the share of them; held: those of texts that a training text equals.
        """
        width, kinds = self.width, "text string, a int, z int, passage string"

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(t, a, a + len(p), p) for t in b.column("text").to_pylist() for a, p in tiles(t, width)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["text", "a", "z", "passage"])

        long = self.evaluation.select("row_id", "split", F.explode(F.array(*self.keys)).alias("text")).where("text is not null")
        texts = long.select("text").distinct()
        met = skew_join(texts.mapInArrow(cells, kinds), cut(self.hits.select("passage").distinct()), ["passage"], F.col("text"))
        # a part's characters and the separator behind it; intervals that touch or overlap are merged by what each adds
        before = Window.partitionBy("text").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
        gain = F.greatest(F.lit(0), F.col("z") - 1 - F.greatest(F.col("a"), F.coalesce(F.max(F.col("z") - 1).over(before), F.lit(0))))
        covered = met.withColumn("gain", gain).groupBy("text").agg(F.sum("gain").alias("__covered"))
        same = self._same("text").distinct().withColumn("__same", F.lit(True))
        out = skew_join(long, cut(covered), ["text"], F.col("row_id"), "left")
        out = skew_join(out, cut(same), ["text"], F.col("row_id"), "left").withColumn("__n", F.char_length("text") - 1)
        zero = F.lit(0)
        out = out.groupBy("row_id", "split").agg(F.sum(F.coalesce("__covered", zero)).alias("covered"), F.sum(F.when(F.col("__same"), F.col("__n")).otherwise(zero)).alias("held"), F.sum("__n").alias("length"))
        return out.withColumn("coverage", F.col("covered") / F.col("length"))


def overlaps(rows: DataFrame, row_id: Column, split: Column, names: dict[str, Column], train_split: str, evaluation_splits: list[str], width: int = 3, rows_per_group: int = 20_000) -> Overlap:
    """Scan the training rows' texts for the passages of the evaluation rows' texts.

    ``names`` maps a kind to the normalised name of that kind, in order of precedence; a name is a few parts between ``|`` or
    ``/``. All training texts are scanned for all evaluation passages, of whatever kind: a picture's name inside a
    training path counts towards coverage. Null names match nothing, rows of no split are ignored, repeated rows
    count each. A text's rows are cut up where a side has over ``rows_per_group`` of them; nothing is dropped. Empty
    inputs give no rows; other columns are ignored.
    """
    keys = [f"n{i}" for i in range(len(names))]
    wide = rows.select(row_id.cast("bigint").alias("row_id"), split.alias("split"), *(spelled(c.cast("string")).alias(n) for n, c in zip(keys, names.values(), strict=True)))
    # names are made out once: a filter on them before the checkpoint would make them out for itself
    wide = cut(wide.where(F.col("split").isin(train_split, *evaluation_splits))).where(F.coalesce(*keys).isNotNull())
    train, evaluation = wide.where(F.col("split") == train_split), wide.where(F.col("split").isin(evaluation_splits))
    text = lambda df: df.select(F.explode(F.array(*keys)).alias("text")).where("text is not null")
    hits = cut(matches(text(train), text(evaluation), width))
    return Overlap(train, evaluation, hits, list(names), width, rows_per_group)
