"""Variants of the test tables: without rows, and with null rows, repeated rows and extra columns."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

EXTRA = ["n", "path", "text", "key", "value", "words", "token", "mask", "share", "cell", "leader", "kind", "r", "x", "s"]


def write(src: str, dst: str, variant: str) -> str:
    os.makedirs(dst, exist_ok=True)
    for p in glob.glob(f"{src}/*.parquet"):
        t = pq.read_table(p)
        if variant == "empty":
            t = t.slice(0, 0)
        else:
            t = t.slice(0, 60)
            nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))
            t = pa.concat_tables([t.cast(nulls.schema), t.slice(0, 7).cast(nulls.schema), nulls])
            for name in EXTRA:
                if name not in t.column_names:
                    t = t.append_column(name, pa.array(["clash"] * len(t)))
        pq.write_table(t, f"{dst}/{os.path.basename(p)}")
    return dst
