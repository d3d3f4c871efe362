"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
#: The public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str, vocabulary: str):
    import tiktoken

    with open(f"{path}/{vocabulary}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZERS, vocabulary: str = "byte_bpe_multi_50k") -> DataFrame:
    """``keep`` columns and ``tokens``: the number of tokens of each whole text; null and empty texts have 0."""
    picked = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "tokens"])

    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")
