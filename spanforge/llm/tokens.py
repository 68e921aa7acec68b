"""Token counts with public tokenizers; their files stay where they are."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: folder of the vocabulary files; a parameter of every operator that counts tokens
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern of the byte-level BPE vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of whole texts; null and empty texts have 0 tokens."""
    path = f"{folder}/{name}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(count, "id bigint, n_tokens bigint")
