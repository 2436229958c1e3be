"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every executor.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The split pattern of this vocabulary, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_loaded: dict = {}


def encoder(path: str):
    """The byte-pair encoder of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, keep: list[str], text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of the whole text; 0 for NULL."""
    path = os.path.join(folder, vocabulary)
    narrow = df.select(*keep, F.col(text).alias("_text"))
    schema = narrow.drop("_text").withColumn("tokens", F.lit(0).cast("long")).schema

    def count(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return narrow.mapInArrow(count, schema)
