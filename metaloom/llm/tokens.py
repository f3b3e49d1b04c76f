"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from metaloom.util import arrow_map

#: Rank file of a byte-level BPE vocabulary; a parameter of every operator here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(ranks: str):
    """The tokenizer, loaded once in each Python worker, from the path or from what `share` sent."""
    import os

    import tiktoken
    from pyspark import SparkFiles

    with open(ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks)), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


_shared: set[tuple[str, str]] = set()


def share(spark, ranks: str) -> None:
    """Send the rank file to the executors, once for each application."""
    at = (spark.sparkContext.applicationId, ranks)
    if at not in _shared:
        spark.sparkContext.addFile(ranks)
        _shared.add(at)


def token_counts(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """All columns but the text, and n_tokens int of the whole text; 0 where it is null or empty."""
    from pyspark.sql import functions as F

    share(docs.sparkSession, ranks)
    keep = [c for c in docs.columns if c not in (text, "n_tokens")]
    src = docs.select(*keep, F.col(text).alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens int"
    out = out.lstrip(", ")

    def run(batches):
        enc = encoding(ranks).encode_ordinary
        for b in batches:
            n = [len(enc(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*keep, "n_tokens"])

    return arrow_map(src, run, out)
