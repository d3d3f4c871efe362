"""Texts whose end was lost.

The corpus vocabulary is a trie of two storeys. Below are tokens by their characters, alone and after the token before
them, kept as a sorted table: the words under a node are a run of it, so a final token that is no word but begins one
is told by the word that follows it in that order. Above are runs of tokens: a node knows how often it goes on and how
often it ends, so a run that is known to go on and (almost) never to end is a proper prefix too, one of a sentence. The
lengths at which a source's texts pile up lower the bar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import BROADCAST_ROWS, skew_join, small_enough
from lotmill.session import cut

# Marks that software puts behind a cut. The first ones also end whole texts ("weird...").
SOFT_MARKS = ["...", "…"]
HARD_MARKS = ["[...]", "[…]", "[more]", "<snip>", "(cont.", "(cont.)", "=", "�"]
# White space as it may trail a text, and marks that close a sentence.
SPACES = r"\s\u00a0"
CLOSING = r"^[\"'”’»)\]]*[.!?。！？]"

# The end of a text is looked at on the reversed text, where it can be anchored: a search from the front would try every position.
# A lone = is a mark, a row of them is a ruled line. Three dots or more are one mark, but for a dot that belongs to "(cont.".
_DOTS = r"\.{3,}(?=\.tnoc\()|\.{3,}+"
_BACK = lambda marks: "|".join(_DOTS if m == "..." else re.escape(m[::-1]) + "(?!=)" * (m == "=") for m in marks)
# Possessive: any number of marks in one pass, without a frame on the stack for each.
TAIL = f"^[{SPACES}]*(?:(?:{_BACK(HARD_MARKS)}|{_BACK(SOFT_MARKS)})[{SPACES}]*)*+"
HARD_END = f"^[{SPACES}]*(?:{_BACK(HARD_MARKS)})"
#: A token: a line end, a word or identifier (inner - _ . : / kept, a final - _ : / too), or any other sign.
TOKEN = re.compile(r"\n\s*|[^\W_]+(?:[-_.:/][^\W_]+)*[-_:/]?|\S")
LINE = "\n"
N = 4


def _shape(token: str) -> str:
    return LINE if "\n" in token else re.sub(r"[A-Z]{2,}", lambda m: "A" * len(m[0]), re.sub(r"\d", "0", token))


def tokens(text: str) -> list[str]:
    """Tokens with digits as 0 and runs of capitals as A, so that numbers and identifiers are known by their shape."""
    return [_shape(t) for t in TOKEN.findall(text)]


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def _opens(token: str) -> bool:
    """True for what stands behind a sentence that ended: a line end, a capital, a letter of a script without cases, an opening bracket."""
    c = token[0]
    return token == LINE or c == "[" or c.isupper() or (c.isalpha() and not c.islower())


def _mix(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of several tokens' hashes, position by position."""
    h = np.zeros(len(hashes[0]), dtype=np.uint64)
    for x in hashes:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _gram(ts: list[str]) -> str:
    """Up to two tokens as they are, more as the key of their hashes."""
    return " ".join(ts) if len(ts) < 3 else f"{int(_mix([np.array([_hash(t)], dtype=np.uint64) for t in ts])[0]):016x}"


class _Counter:
    """N-grams of the texts seen so far, counted by what follows them; emptied when it has grown large."""

    def __init__(self):
        self.ids: dict[str, int] = {}  # of tokens as they are written: the number of their shape
        self.shapes: dict[str, int] = {}
        self.words: list[str] = []
        self.flat: list[int] = []
        self.sizes: list[int] = []

    def _new(self, token: str) -> int:
        shape = _shape(token)
        if shape not in self.shapes:
            self.shapes[shape] = len(self.words)
            self.words.append(shape)
        self.ids[token] = self.shapes[shape]
        return self.ids[token]

    def add(self, text: str) -> list[str]:
        """Count a text; its last tokens."""
        known, new = self.ids.get, self._new
        row = [i if (i := known(t)) is not None else new(t) for t in TOKEN.findall(text)]
        self.flat += row
        self.sizes.append(len(row))
        return [self.words[i] for i in row[-N:]]

    def _follows(self, ids: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
        """What follows each token: 0 more of the sentence, 1 a line end, 2 a sentence mark that ends it, 3 nothing; 4 for line ends themselves."""
        line, mark, opens = (np.array([f(w) for w in self.words], dtype=bool) for f in (lambda w: w == LINE, lambda w: w in (".", "!", "?"), _opens))
        first, second = ids[np.minimum(np.arange(len(ids)) + 1, len(ids) - 1)], ids[np.minimum(np.arange(len(ids)) + 2, len(ids) - 1)]
        ends = mark[first] & ((left == 1) | opens[second])  # a mark at the very end of a text ends a sentence too
        return np.select([line[ids], left == 0, line[first], ends], [4, 3, 1, 2], 0)

    def rows(self) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(n, grams, counts by what follows)."""
        ids, sizes = np.array(self.flat, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        if not len(ids):
            return
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - 1 - place
        what = self._follows(ids, place, left)
        hashes = np.array([_hash(w) for w in self.words], dtype=np.uint64)
        for n in range(1, N + 1):
            at = np.flatnonzero((what < 4) & (place >= n - 1))
            if not len(at):
                continue
            if n == 1:
                key = ids[at].astype(np.uint64)
            elif n == 2:
                key = (ids[at - 1] * len(self.words) + ids[at]).astype(np.uint64)
            else:
                key = _mix([hashes[ids[at - n + 1 + i]] for i in range(n)])
            back, uniq = pd.factorize(key)
            counts = np.bincount(back * 4 + what[at], minlength=4 * len(uniq)).reshape(-1, 4)
            if n == 1:
                grams = [self.words[int(k)] for k in uniq]
            elif n == 2:
                grams = [f"{self.words[int(k) // len(self.words)]} {self.words[int(k) % len(self.words)]}" for k in uniq]
            else:
                grams = [f"{int(k):016x}" for k in uniq]
            yield n, grams, counts


def _count(batches: Iterator[pa.RecordBatch], flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (n, gram, mid, line, close, last, key, ends): counts of n-grams by what follows them, and with n = 0 each text's last tokens."""
    schema = pa.schema([("n", pa.int32()), ("gram", pa.string()), ("mid", pa.int64()), ("line", pa.int64()), ("close", pa.int64()), ("last", pa.int64()), ("key", pa.string()), ("ends", pa.list_(pa.string()))])

    def batch(n: int, grams: list, counts: np.ndarray, keys: list, ends: list) -> pa.RecordBatch:
        k = max(len(grams), len(keys))
        none = [None] * k
        numbers = [pa.array(counts[:, i], pa.int64()) for i in range(4)] if grams else [pa.array(none, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array([n] * k, pa.int32()), pa.array(grams or none, pa.string()), *numbers, pa.array(keys or none, pa.string()), pa.array(ends or none, pa.list_(pa.string()))], schema=schema)

    seen = _Counter()
    for b in batches:
        keys, ends = [], []
        for key, text in zip(b.column("key").to_pylist(), b.column("core").to_pylist(), strict=True):
            last = seen.add(text or "")
            if not last:
                continue
            keys.append(key)
            ends.append(last)
            if len(seen.flat) > flush:
                yield from (batch(n, g, c, [], []) for n, g, c in seen.rows())
                seen = _Counter()
        if keys:
            yield batch(0, [], np.empty((0, 4)), keys, ends)
    yield from (batch(n, g, c, [], []) for n, g, c in seen.rows())


def _grams(ends: list[list[str]]) -> list[list[dict]]:
    """Of last tokens: what is looked up. ``n`` in 1..N for the end itself, 11 and 12 for the number before a final full stop."""
    out = []
    for ts in ends:
        own = [{"n": n, "look": n, "gram": _gram(ts[-n:])} for n in range(1, len(ts) + 1) if LINE not in ts[-1:]]
        if len(ts) > 1 and ts[-1] == "." and ts[-2][-1] == "0":
            own += [{"n": 10 + n, "look": n, "gram": _gram(ts[-1 - n : -1])} for n in range(1, min(3, len(ts)))]
        out.append(own)
    return out


#: Characters of an end that are looked at first; where what was put behind a cut goes on beyond most of them, the whole text is.
END = 256


def text_end(text: Column) -> Column:
    """Struct (tail, hard, closed) of a text: the length of what was put behind its end, whether marks that only software puts there begin it, and whether a sentence mark closes what is before it."""

    def of(back: Column, part: Column) -> Column:
        closed = F.substring(back, part + 1, F.char_length(back)).rlike(CLOSING)
        return F.struct(part.alias("tail"), back.rlike(HARD_END).alias("hard"), closed.alias("closed"))

    near, back = F.reverse(F.right(text, F.lit(END))), F.reverse(text)
    tail = F.char_length(F.regexp_extract(near, TAIL, 0))
    all_seen = (F.char_length(text) <= END) | ((tail < END * 3 // 4) & ~F.substring(near, tail + 1, F.lit(END)).rlike(r"^[\"'”’»)\]]*$"))
    return F.when(all_seen, of(near, tail)).otherwise(of(back, F.char_length(F.regexp_extract(back, TAIL, 0))))


def truncated(docs: DataFrame, ratio: float = 0.05, ratio_at_limit: float = 0.6, support: int = 3, closed_support: int = 50) -> DataFrame:
    """``doc_id, source, reason`` of the texts of ``docs`` (doc_id, text, source) that stop inside a word or sentence.

    What was put behind the cut (blanks, marks) is taken off first. A text is reported if
      mark   a mark that only software puts there follows an end that no sentence mark closes;
      word   its last token occurs nowhere inside a text and is a proper prefix of one that does;
      after  the same, of its last token after the token before it;
      open   of the places with the same last tokens (the longest run met ``support`` times elsewhere), less than
             ``ratio`` lie before the end of a sentence, line or text; ``ratio_at_limit`` where texts of that source pile up at the
             text's length. Ends closed by a sentence mark need ``closed_support`` places and ``ratio`` holds.
    Counts are over all distinct texts, so copies of a text neither add to them nor differ in judgement. Null and
    empty texts, and texts of blanks only, are not reported. ``doc_id`` must be unique; a null source is a source.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("end", text_end(F.col("text")))
    base = base.withColumn("core", F.substring("text", F.lit(1), F.char_length("text") - F.col("end.tail")))
    # ends are made out once: a filter on them before the checkpoint would make them out for itself. Texts without any end are dropped behind it, and by the counter
    facts = cut(base.select("doc_id", "source", F.md5("core").alias("key"), (F.col("end.hard") & ~F.col("end.closed")).alias("hard"), "end.closed", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), (F.char_length("text") - F.col("end.tail")).alias("left"))).where("left > 0").drop("left")

    # one text of each content: the ids of the others are found on ids alone. If they are few the texts stay where they are
    twice = cut(facts.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least"))
    others = cut(skew_join(facts.select("key", "doc_id"), twice, ["key"], F.col("doc_id")).where("doc_id > least").select("doc_id"))
    texts = skew_join(base, others, ["doc_id"], F.col("doc_id"), "left_anti", is_small=small_enough(others, 20 * BROADCAST_ROWS, 16_000_000)).select(F.md5("core").alias("key"), "core")
    counted = cut(texts.mapInArrow(_count, "n int, gram string, mid bigint, line bigint, close bigint, last bigint, key string, ends array<string>"))
    stats = cut(counted.where("n > 0").groupBy("n", "gram").agg(F.sum("mid").alias("mid"), F.sum("line").alias("line"), F.sum("close").alias("close"), F.sum("last").alias("last")))
    ends = counted.where("n = 0").select("key", "ends")

    @F.pandas_udf("array<struct<n: int, look: int, gram: string>>")
    def grams(e):
        return pd.Series(_grams([list(x) for x in e]))

    kinds = cut(ends.select("ends").distinct())  # the judgement depends on the last tokens only
    asked = kinds.select("ends", F.explode(grams("ends")).alias("x")).select("ends", "x.n", F.col("x.look").alias("look"), "x.gram")
    found = skew_join(asked, stats.withColumnRenamed("n", "look"), ["look", "gram"], F.col("ends"), "left")
    zero = F.lit(0).cast("bigint")
    found = found.select("ends", "n", "look", "gram", *(F.coalesce(c, zero).alias(c) for c in ("mid", "line", "close", "last")))
    found = cut(found.withColumn("inside", F.col("mid") + F.col("line") + F.col("close")))

    words = stats.where("n in (1, 2) and mid + line + close > 0").select(F.col("n").alias("look"), "gram")
    met = begun(found.where("look <= 2 and inside = 0").select("look", "gram").distinct(), words)
    found = skew_join(found, cut(met.withColumn("begun", F.lit(True))), ["look", "gram"], F.col("ends"), "left").withColumn("begun", F.coalesce("begun", F.lit(False)))

    ended = F.col("line") + F.col("close") + F.greatest(F.col("last") - 1, zero)
    enough = (F.col("n") <= N) & (ended + F.col("mid") >= support)
    judged = found.groupBy("ends").agg(
        F.max(F.col("begun") & (F.col("look") == 1)).alias("word"),
        F.max(F.col("begun") & (F.col("look") == 2)).alias("after"),
        F.max(F.when(enough, F.struct("n", ended.alias("ended"), "mid"))).alias("best"),
    )
    judged = judged.select("ends", "word", "after", (F.col("best.ended") / (F.col("best.ended") + F.col("best.mid"))).alias("share"), (F.col("best.ended") + F.col("best.mid")).alias("places"))
    by_key = skew_join(ends, judged, ["ends"], F.col("key")).drop("ends")

    out = skew_join(facts, by_key, ["key"], F.col("doc_id"))
    for unit in ("chars", "bytes"):
        piled = pile_ups(facts, unit).withColumn(f"at_{unit}", F.lit(True))
        out = skew_join(out.withColumn("s", F.coalesce("source", F.lit(""))), piled, ["s", unit], F.col("doc_id"), "left").drop("s")
    bar = F.when(F.col("at_chars") | F.col("at_bytes"), F.lit(ratio_at_limit)).otherwise(F.lit(ratio))
    opened = F.when(F.col("closed"), (F.col("share") < ratio) & (F.col("places") >= closed_support)).otherwise(F.col("share") < bar)
    reason = F.when(F.col("hard"), "mark").when(F.col("word"), "word").when(F.col("after"), "after").when(opened, "open")
    return out.select("doc_id", "source", reason.alias("reason")).where("reason is not null")


def begun(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """``look, gram`` of the ``unknown`` that are a proper prefix of one of ``words`` (both look, gram) of the same ``look``.

    In sorted order the words that a string begins follow right behind it, so the next word settles it: the trie is
    walked by one range partitioning, and no prefix of any word is written out, however long the words are. Only words
    that share their first characters with an unknown one take part.
    """
    first = lambda n: F.substring("gram", 1, n)
    heads = cut(unknown.select("look", first(3).alias("head")).distinct())
    own = words.select("look", "gram", F.explode(F.array_distinct(F.array(first(1), first(2), first(3)))).alias("head"))
    own = skew_join(own, heads, ["look", "head"], F.col("gram"), "left_semi").select("look", "gram").distinct()
    both = own.withColumn("word", F.lit(True)).unionAll(unknown.select("look", "gram").withColumn("word", F.lit(False)))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(both.repartitionByRange(n, "look", "gram").withColumn("__p", F.spark_partition_id()))
    behind = Window.partitionBy("__p").orderBy("look", "gram", F.desc("word")).rowsBetween(1, Window.unboundedFollowing)
    item = F.struct("look", "gram")
    # of the ranges behind it, which are as few as there are partitions
    tops = laid.where("word").groupBy("__p").agg(F.min(item).alias("__top"))
    ranges = both.sparkSession.range(n).select(F.col("id").cast("int").alias("__p")).join(F.broadcast(tops), "__p", "left")
    later = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.select("__p", F.first("__top", ignorenulls=True).over(later).alias("__later"))
    out = laid.withColumn("__next", F.first(F.when(F.col("word"), item), ignorenulls=True).over(behind)).where("not word").join(F.broadcast(ranges), "__p")
    follows = F.coalesce("__next", "__later")
    return out.where((follows["look"] == F.col("look")) & F.startswith(follows["gram"], F.col("gram")) & (follows["gram"] != F.col("gram"))).select("look", "gram")


def pile_ups(facts: DataFrame, unit: str, least: int = 10, times: float = 5.0) -> DataFrame:
    """``s, unit``: lengths that at least ``least`` texts of a source have, ``times`` as many as the mean of the ten lengths around."""
    n = facts.groupBy(F.coalesce("source", F.lit("")).alias("s"), unit).agg(F.count(F.lit(1)).alias("n"))
    near = n.select("s", F.explode(F.array(*(F.col(unit) + i for i in range(-5, 6) if i))).alias(unit), F.col("n").alias("m")).groupBy("s", unit).agg(F.sum("m").alias("m"))
    return n.where(F.col("n") >= least).join(near, ["s", unit], "left").where(F.col("n") >= times * F.coalesce("m", F.lit(0)) / 10).select("s", unit)


def truncation_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``source, documents, truncated, rate`` for each source; texts that are null or empty count as documents."""
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    bad = found.groupBy(F.col("source").alias("bad_source")).agg(F.count(F.lit(1)).alias("truncated"))
    out = per.join(bad, F.col("source").eqNullSafe(F.col("bad_source")), "left").select("source", "documents", F.coalesce("truncated", F.lit(0)).cast("bigint").alias("truncated"))
    return out.withColumn("rate", F.col("truncated") / F.col("documents"))
