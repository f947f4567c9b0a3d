"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def sized(table: DataFrame, keep: list[str], text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``(*keep, text_hash, n_tokens)``: null and empty texts have 0 tokens; the whole text is counted.

    ``keep`` names columns; text_hash is a 64-bit hash of the text, null for a null text.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column(len(keep) + 1))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep) + 1)), pa.array(n, pa.int64())], names=[*keep, "text_hash", "n_tokens"])

    text = F.col(text_col).cast("string")
    picked = table.select(*keep, F.when(text.isNotNull(), F.xxhash64(text)).alias("text_hash"), text.alias("_text"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text_hash bigint, n_tokens bigint")
