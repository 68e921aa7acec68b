"""New batches against all accepted history (problem 5).

An incremental inverted index maps tokens to the records that hold them; it is
kept in files partitioned by a hash of the token.  A batch probes it with its
own tokens, candidates pass a length filter and a count of shared tokens, the
rest are verified exactly, and the postings of what is new are appended.

Tokens
    The (word, occurrence) pairs of a text.  Two texts with four fifths of the longer's
    words in common share at least one of the n - ceil(0.8 n) + 1 rarest of either, in
    any order of tokens that is the same for all texts; the order is by the count of a
    token's bucket of ``ORDER`` (a fixed size, so it fits any vocabulary), then token.

Candidates
    A posting list is joined in full.  A posting reaches texts of up to 5/4 of what is
    left of its text from the token's rank on, which is the length filter made sharper;
    then a parity sketch of 512 bits bounds the words that differ.  Neither drops a pair
    that is a repeat, whatever the spread of the changes; what is left is verified.

Skew
    Where a token is hot, as in texts of few words, its list would be compared again for every such token: records that
    hold one are compared once, all with all, in blocks sorted by length, by sketches of ``WIDE`` bits.
    Equal word sequences are one record before anything is indexed (pre-aggregated
    by digest).  A list of more than ``LIST`` postings is split into chunks and each
    pair of chunks is a group of its own, so no list is held in memory as a whole.

Defined results
    * texts are the contents of the steps in order; null and blank contents add
      nothing; records without words are never repeats and are not indexed;
    * a record's group is led by the lowest row_id that it repeats, followed
      to the end of the chain; repeated delivery of a row_id counts once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanforge.llm.words import Hasher, common_subsequence, words_of
from spanforge.session import cut, shared_dir

SIMILARITY = 0.8
#: buckets in which tokens are counted for their order by rarity
ORDER = 1 << 18
#: a longer posting list is split
LIST = 8192
#: a token is hot if more than one record in so many holds it, and more than ``HOT_LEAST``
HOT, HOT_LEAST = 64, 64
#: pairs that are compared in blocks in the time of one pair of a list
DENSE = 8
#: bits of the sketch of a record, and the most records of a block
WIDE, BLOCK = 1024, 1 << 17
_SKETCH = "row_id bigint, n int, wide binary"
_POSTING = "token bigint, row_id bigint, n int, reach int, sketch binary"


def conversations(traces: DataFrame) -> DataFrame:
    """(row_id, batch_no, text): the contents of the steps in order."""
    return traces.select("row_id", "batch_no", F.array_join("steps.content", " ").alias("text"))


def signatures(texts: DataFrame) -> DataFrame:
    """(row_id, n, digest, words) of (row_id, text); texts without words are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for b in batches:
            ids, ns, digests, words = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text) if text else []
                if not w:
                    continue
                ids.append(i)
                ns.append(len(w))
                digests.append(hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).digest())
                words.append(np.array(hashed(w), dtype=np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            flat = np.concatenate(words) if words else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["row_id", "n", "digest", "words"],
            )

    src = texts.where(F.col("row_id").isNotNull()).select(F.col("row_id").cast("bigint"), "text")
    return src.mapInArrow(sign, "row_id bigint, n int, digest binary, words array<int>")


def needed(n):
    """The words that a repeat has in common with a text of ``n`` words, the longer of the two."""
    return -(-4 * n // 5)


def tokens_of(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (word, occurrence) pairs of a text."""
    s = np.sort(words)
    at = np.arange(len(s))
    first = np.concatenate([[True], s[1:] != s[:-1]])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    with np.errstate(over="ignore"):
        h = s.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ nth.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _texts(b: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    lists = b.column(column)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield flat[lo:hi]


def rarity(records: DataFrame) -> DataFrame:
    """(slot, held): how many tokens fall into each of the ``ORDER`` buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ORDER, np.int64)
        for b in batches:
            for words in _texts(b, 0):
                np.add.at(held, tokens_of(words) & (ORDER - 1), 1)
        slot = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[slot])], names=["slot", "held"])

    return records.select("words").mapInArrow(count, "slot int, held bigint").groupBy("slot").agg(F.sum("held").alias("held"))


def postings(records: DataFrame, order: DataFrame) -> DataFrame:
    """(token, row_id, n, reach, sketch): the rarest-first prefix of every record.

    ``reach`` is the length of the longest text that can repeat the record if this
    is the first token that the two have in common.
    """
    held = np.zeros(ORDER, np.int64)
    counts = order.toArrow()
    held[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    sent = records.sparkSession.sparkContext.broadcast(held)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            for row_id, words in zip(b.column(0).to_pylist(), _texts(b, 1), strict=True):
                t, n = tokens_of(words), len(words)
                bits = np.bincount((t >> 40) & 511, minlength=512) & 1
                sketch = np.packbits(bits.astype(np.uint8)).tobytes()
                prefix = t[np.lexsort((t, held[t & (ORDER - 1)]))][: n - needed(n) + 1]
                k = len(prefix)
                reach = (n - np.arange(k)) * 5 // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix), pa.array(np.full(k, row_id, np.int64)), pa.array(np.full(k, n, np.int32)), pa.array(reach.astype(np.int32)), pa.array([sketch] * k, pa.binary())],
                    names=["token", "row_id", "n", "reach", "sketch"],
                )

    return records.select("row_id", "words").mapInArrow(post, _POSTING)


#: pairs that are compared at once
CHUNK = 1 << 15


def _meetings(lists: np.ndarray, ids: np.ndarray, n: np.ndarray, reach: np.ndarray, new: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one list with at least one new text, that length and sketch let pass; rows are sorted by (list, n)."""
    at = np.arange(len(n))
    hi = np.searchsorted((lists << 32) + n, (lists << 32) + reach, side="right")
    fresh = np.concatenate([[0], np.cumsum(new)])
    count = np.where((hi > at + 1) & (new | (fresh[np.maximum(hi, at + 1)] > fresh[at + 1])), hi - at - 1, 0)
    spare = n - 2 * needed(n)
    upto = np.cumsum(count)
    parts = list(np.ascontiguousarray(sketch.T))
    lo = 0
    while lo < len(n) and upto[-1] > (upto[lo - 1] if lo else 0):
        end = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
        c = count[lo:end]
        i = np.repeat(at[lo:end], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        lo = end
        ok = (new[i] | new[j]) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        room = n[i] + spare[j]
        for half in (parts[:3], parts[3:]):  # most pairs fail on the first bits
            for p in half:
                room -= np.bitwise_count(p[i] ^ p[j])
            ok = np.flatnonzero(room >= 0)
            i, j, room = i[ok], j[ok], room[ok]
        # an accepted text is the earlier one, else the lower row_id
        swap = np.where(new[j] == new[i], ids[j] < ids[i], new[i])
        pairs = np.unique(np.stack([np.where(swap, ids[j], ids[i]), np.where(swap, ids[i], ids[j]), new[i] != new[j]]), axis=1) if len(i) else np.empty((3, 0), np.int64)
        yield pairs[0], pairs[1], pairs[2].astype(bool)


def sketches(records: DataFrame) -> DataFrame:
    """(row_id, n, wide): the parity sketch of ``WIDE`` bits of every record."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide, n = [], []
            for words in _texts(b, 1):
                bits = np.bincount((tokens_of(words) >> 40) & (WIDE - 1), minlength=WIDE) & 1
                wide.append(np.packbits(bits.astype(np.uint8)).tobytes())
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(wide, pa.binary())], names=["row_id", "n", "wide"])

    return records.select("row_id", "words").mapInArrow(draw, _SKETCH)


class Block:
    """Records sorted by length, their sketches at full width and folded to a half and a quarter."""

    #: lengths up to which a quarter and a half of the bits tell most texts apart
    SHORT, MIDDLE = 240, 470

    def __init__(self, ids: np.ndarray, n: np.ndarray, wide: np.ndarray):
        o = np.argsort(n, kind="stable")
        self.ids, self.n, self.wide = ids[o], n[o].astype(np.int64), wide[o]
        self.bits = [np.ascontiguousarray(self.wide.T)]
        for _ in range(2):  # the parity of tokens by fewer bits of their hash
            w = self.bits[0]
            self.bits.insert(0, w[: len(w) // 2] ^ w[len(w) // 2 :])

    def level(self, n: int) -> int:
        return 0 if n <= self.SHORT else 1 if n <= self.MIDDLE else 2


def _close(x: Block, y: Block, rows: int = 32, cols: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of records of two blocks, or of one with itself, that length and sketch let pass."""
    need_x, need_y = needed(x.n), needed(y.n)
    differ, count, sums = np.empty(rows * cols, np.uint64), np.empty(rows * cols, np.uint8), np.empty(rows * cols, np.uint16)
    for lo in range(0, len(x.n), rows):
        hi = min(lo + rows, len(x.n))
        first = lo + 1 if x is y else int(np.searchsorted(y.n, need_x[lo]))
        last = int(np.searchsorted(y.n, x.n[hi - 1] * 5 // 4, side="right"))
        for c in range(first, last, cols):
            d = min(c + cols, last)
            level = x.level(max(x.n[hi - 1], y.n[d - 1]))
            most = x.n[hi - 1] + y.n[c:d] - 2 * np.maximum(need_x[lo], need_y[c:d])  # words that may differ, of any of the rows
            # a byte is enough below MIDDLE: where the count runs over, a pair is kept and looked at again
            shape = (hi - lo, d - c)
            size = shape[0] * shape[1]
            u, v, far = differ[:size].reshape(shape), count[:size].reshape(shape), sums.view(np.uint8 if level < 2 else np.uint16)[:size].reshape(shape)
            far[:] = 0
            for p, q in zip(x.bits[level], y.bits[level], strict=True):
                far += np.bitwise_count(np.bitwise_xor(p[lo:hi, None], q[None, c:d], out=u), out=v)
            i, j = np.divmod(np.flatnonzero(far <= np.clip(most, 0, np.iinfo(far.dtype).max).astype(far.dtype)), d - c)
            i, j = i + lo, j + c
            if x is y:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CHUNK):
                a, b = i[k : k + CHUNK], j[k : k + CHUNK]
                room = x.n[a] + y.n[b] - 2 * np.maximum(need_x[a], need_y[b])
                ok = (np.bitwise_count(x.wide[a] ^ y.wide[b]).sum(1, dtype=np.int64) <= room) & (x.ids[a] != y.ids[b])
                if ok.any():
                    yield a[ok], b[ok]


def in_blocks(drawn: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b, old) as of ``candidates`` of all records of (row_id, n, wide, new): each pair of blocks is a group."""
    k = max(min(12, -(-count // 2048)), -(-count // BLOCK))
    parts = drawn.withColumn("c", F.pmod(F.xxhash64("row_id"), F.lit(k)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    parts = parts.select((F.least("c", "o") * k + F.greatest("c", "o")).alias("pair"), (F.col("c") > F.col("o")).alias("second"), (F.col("c") == F.col("o")).alias("single"), "row_id", "n", "wide", "new")

    def meet(t: pa.Table) -> pa.Table:
        second, single, ids, n, new = (t.column(c).to_numpy() for c in ("second", "single", "row_id", "n", "new"))
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(len(ids), -1)
        (new_x, old_x), (new_y, old_y) = ([Block(ids[m], n[m], wide[m]) for m in (side & new, side & ~new)] for side in (~second, second))
        out = []
        for x, y, old in ((new_x, new_x, False), (old_x, new_x, True)) if single[0] else ((new_x, new_y, False), (old_x, new_y, True), (old_y, new_x, True)):
            for i, j in _close(x, y):
                a, b = x.ids[i], y.ids[j]
                out.append((a, b, np.ones(len(a), bool)) if old else (np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), bool)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        return pa.table(dict(zip(("a", "b", "old"), cols, strict=True)))

    return parts.repartition(k * (k + 1) // 2, "pair").groupBy("pair").applyInArrow(meet, "a bigint, b bigint, old boolean")


def candidates(posts: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pairs (a, b, old), b new and a old or new, that can have four fifths of the longer's words in common, of (token,
    row_id, n, reach, sketch, new) and the sketches (row_id, n, wide, new) of the same records.

    Records that hold a hot token are compared in blocks, all with all; the other lists count as far as they hold another record.
    """
    held = cut(posts.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1))
    hot = held.where(F.col("held") > max(HOT_LEAST, drawn.count() // HOT)).select("token", "held")
    pairs = hot.agg(F.sum(F.col("held").cast("double") ** 2)).first()[0]  # one number
    if pairs is None:
        return in_lists(posts, held)
    # hot tokens are few: each is held by more than one record in HOT
    rows = cut(posts.join(F.broadcast(hot), "token", "left_semi").select("row_id", "new").distinct())
    count = rows.count()
    if float(count) ** 2 > DENSE * pairs:
        return in_lists(posts, held)
    met = in_blocks(drawn.join(rows, ["row_id", "new"], "left_semi"), count)
    cold = cut(posts.select("token", "row_id", "new").join(rows, ["row_id", "new"], "left_anti").select("token").distinct().join(held, "token", "left_semi").join(F.broadcast(hot), "token", "left_anti"))
    if not cold.isEmpty():
        some = F.broadcast(cold) if cold.count() <= 1 << 19 else cold
        met = met.unionByName(in_lists(posts.join(some, "token", "left_semi"), held))
    return met.distinct()


def in_lists(posts: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs of ``candidates`` that meet in a posting list, of postings and the lengths of the lists."""
    long = held.where(F.col("held") > LIST)
    lists = posts.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    if not long.isEmpty():
        parts = posts.join(long, "token", "left").withColumn("k", F.ceil(F.coalesce("held", F.lit(1)) / LIST).cast("int"))
        parts = parts.withColumn("c", F.pmod(F.xxhash64("row_id"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        lists = parts.withColumns({"lo": F.least("c", "o"), "hi": F.greatest("c", "o")})
    key = ["token", "lo", "hi"]
    lists = lists.select(*key, "n", "row_id", "reach", "new", "sketch").repartition(*key).sortWithinPartitions(*key, "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows of the last list, which may go on

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x in _meetings(*cols):
                if len(x[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "old"])

        key: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            token, lo, hi, n, ids, reach, new = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            sketch = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, 8)
            turn = np.concatenate([[(token[0], lo[0], hi[0]) != key], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            key = (token[-1], lo[-1], hi[-1])
            cols = [np.cumsum(turn), ids, n.astype(np.int64), reach.astype(np.int64), new, sketch]
            if held is not None:
                held[0][:] = 0
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from pairs([c[:last] for c in cols])
            held = [c[last:].copy() for c in cols]
        if held is not None:
            yield from pairs(held)

    return lists.mapInArrow(meet, "a bigint, b bigint, old boolean").distinct()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether four fifths of the longer's words are common, in order; what both begin and end with is not compared word by word."""
    need, m = needed(max(len(a), len(b))), min(len(a), len(b))
    if m < need:
        return False
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    if head >= need or m - len(differ) >= need:  # word by word in the same places
        return True
    differ = np.flatnonzero(a[head:][::-1][: m - head] != b[head:][::-1][: m - head])
    tail = int(differ[0]) if len(differ) else m - head
    return head + tail + common_subsequence(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()) >= need


def verify(pairs: DataFrame, earlier: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs of which four fifths of the longer's words are common, in order; a is of ``earlier``, b of ``records``."""
    left = earlier.select(F.col("row_id").alias("a"), F.col("words").alias("wa"))
    right = records.select(F.col("row_id").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep_a, keep_b = [], []
            for a, b, wa, wb in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), _texts(t, 2), _texts(t, 3), strict=True):
                if alike(wa, wb):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def leaders(links: DataFrame) -> DataFrame:
    """(row_id, leader) for every record that repeats an earlier one.

    Each points at the lowest record that it repeats; pointers are halved until
    none moves, so the rounds are the logarithm of the longest chain.
    """
    up = cut(links.groupBy(F.col("b").alias("row_id")).agg(F.min("a").alias("leader")))
    while True:
        far = up.select(F.col("row_id").alias("leader"), F.col("leader").alias("next"))
        moved = up.join(far, "leader", "left").select("row_id", F.coalesce("next", "leader").alias("leader"), F.col("next").isNotNull().alias("moved"))
        moved = cut(moved)
        up = moved.select("row_id", "leader")
        if moved.where("moved").isEmpty():
            return up


def representatives(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record for each word sequence (its lowest row_id), and (row_id, rep) for all rows."""
    w = signed.groupBy("digest", "n").agg(F.min("row_id").alias("rep"))
    members = signed.select("row_id", "digest", "n").join(w, ["digest", "n"]).select("row_id", "rep").distinct()
    return members, signed.dropDuplicates(["row_id"]).join(w.select(F.col("rep").alias("row_id")), "row_id", "left_semi")


class HistoryIndex:
    """The index of the accepted records in a folder of Parquet files.

    Every accepted batch adds a folder of its own to each part, so accepting it again replaces what it wrote, and a
    batch whose writing was interrupted does not count (``accepted`` names those that are complete):

    * ``postings`` (token, row_id, n, reach, sketch), partitioned by the token's bucket;
    * ``sketches`` (row_id, n, wide), partitioned by the row's bucket, for records with hot tokens;
    * ``digests`` (digest, row_id, leader), partitioned by the digest's bucket, for equal texts;
    * ``records`` (row_id, words, leader), partitioned by the row's bucket, for verification;
    * ``order``, the rarity of tokens in the first batch, stays as it is: any fixed order is exact, and tokens
      unknown to it count as rare.

    A batch reads the partitions of its own tokens and digests, the words of the buckets that hold a candidate, and
    the sketches where tokens are hot.
    """

    def __init__(self, folder: str, buckets: int = 16):
        self.folder, self.buckets = folder, buckets

    def _read(self, spark, what: str, schema: str, batches: list[str], buckets: list[int]) -> DataFrame:
        """The buckets of a part of the index that ``batches`` wrote."""
        df = spark.read.schema(f"{schema}, batch string, bucket int").parquet(f"{self.folder}/{what}")
        return df.where(F.col("batch").isin(batches) & F.col("bucket").isin(buckets))

    def _accepted(self, spark) -> list[str]:
        try:
            return [r.batch for r in spark.read.schema("batch string").parquet(f"{self.folder}/accepted").distinct().collect()]  # one row a batch
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _order(self, records: DataFrame) -> DataFrame:
        spark, schema = records.sparkSession, "slot int, held bigint"
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/order").select("slot", "held")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rarity(records).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/order")
        return spark.read.schema(schema).parquet(f"{self.folder}/order")

    @staticmethod
    def _of(df: DataFrame, column: str = "bucket") -> list[int]:
        return [r[0] for r in df.select(column).distinct().collect()]  # at most as many as there are buckets

    def _match(self, batch: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(members, records with the leader they have or are and whether their text is known, postings, sketches) of a batch."""
        spark = batch.sparkSession
        signed = cut(signatures(batch).select("row_id", "n", "digest", "words"))
        members, records = representatives(signed)
        records = cut(records.select("row_id", "n", "digest", "words"))
        own = cut(postings(records, self._order(records)).withColumn("bucket", F.pmod("token", F.lit(self.buckets)).cast("int")))
        cols = ("token", "row_id", "n", "reach", "sketch")
        new = own.select(*cols, F.lit(True).alias("new"))
        drawn = cut(sketches(records).withColumn("bucket", self._bucket("row_id")))
        fresh = drawn.select("row_id", "n", "wide", F.lit(True).alias("new"))
        done = sorted(set(self._accepted(spark)) - {name})
        if not done:
            links = verify(candidates(new, fresh).select("a", "b"), records, records)
            records = records.join(leaders(links), "row_id", "left").select("row_id", "digest", "words", F.coalesce("leader", "row_id").alias("leader"), F.lit(False).alias("known"))
            return members, cut(records), own, drawn
        ids = records.select(F.col("row_id").alias("a"))
        old = self._read(spark, "postings", _POSTING, done, self._of(own))
        hit = old.join(own.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi")
        known = self._read(spark, "sketches", _SKETCH, done, list(range(self.buckets))).select("row_id", "n", "wide", F.lit(False).alias("new"))
        pairs = cut(candidates(hit.select(*cols, F.lit(False).alias("new")).unionByName(new), known.unionByName(fresh)))
        # a row that is delivered again is matched with the others only
        far = cut(pairs.where("old").join(ids, "a", "left_anti").select("a", "b").withColumn("bucket", self._bucket("a")))
        history = self._read(spark, "records", "row_id bigint, words array<int>, leader bigint", done, self._of(far)).dropDuplicates(["row_id"])
        keyed = records.withColumn("bucket", self._bucket("digest"))
        digests = self._read(spark, "digests", "digest binary, row_id bigint, leader bigint", done, self._of(keyed))
        same = digests.select(F.col("row_id").alias("a"), "digest", "bucket", "leader").join(keyed.select("digest", "bucket", F.col("row_id").alias("b")), ["bucket", "digest"])
        same = cut(same.select("a", "b", "leader"))
        near = verify(pairs.where("NOT old").select("a", "b"), records, records)
        led = verify(far.select("a", "b"), history, records).join(history.select(F.col("row_id").alias("a"), "leader"), "a").select("leader", "b")
        # an accepted record stands for its leader
        links = near.unionByName(led.unionByName(same.where("a <> b").select("leader", "b")).select(F.col("leader").alias("a"), "b")).where("a <> b")
        known = same.groupBy(F.col("b").alias("row_id")).agg(F.lit(True).alias("known"))
        records = records.join(leaders(links), "row_id", "left").join(known, "row_id", "left")
        return members, cut(records.select("row_id", "digest", "words", F.coalesce("leader", "row_id").alias("leader"), F.coalesce("known", F.lit(False)).alias("known"))), own, drawn

    def probe(self, batch: DataFrame) -> DataFrame:
        """(row_a, row_b) for the rows of ``batch`` that repeat an accepted record or an earlier row of the batch."""
        members, records, _, _ = self._match(batch, "")
        return self._found(members, records)

    @staticmethod
    def _found(members: DataFrame, records: DataFrame) -> DataFrame:
        rep_of = members.join(records.select(F.col("row_id").alias("rep"), "leader"), "rep").select(F.col("leader").alias("row_a"), "row_id")
        return rep_of.where(F.col("row_a") != F.col("row_id")).select("row_a", F.col("row_id").alias("row_b")).distinct()

    def accept(self, batch: DataFrame, name: str) -> DataFrame:
        """Probes with (row_id, text), appends all word sequences that are not indexed under the batch's name, returns the repeats.

        A batch that is accepted again is compared with the others and replaces what it wrote.
        """
        members, records, own, drawn = self._match(batch, name)
        # repeats are appended too: what is close to a repeat need not be close to its leader
        fresh = records.where("NOT known")
        self._write(own.join(fresh.select("row_id"), "row_id", "left_semi"), "postings", name)
        self._write(drawn.join(fresh.select("row_id"), "row_id", "left_semi"), "sketches", name)
        self._write(fresh.select("digest", "row_id", "leader").withColumn("bucket", self._bucket("digest")), "digests", name)
        self._write(fresh.select("row_id", "words", "leader").withColumn("bucket", self._bucket("row_id")), "records", name)
        spark = batch.sparkSession
        spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.folder}/accepted")
        return self._found(members, records)

    def _write(self, part: DataFrame, what: str, name: str) -> None:
        part.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{what}/batch={name}")


def deliveries(traces: DataFrame, most: int) -> list[DataFrame]:
    """The batches in order of batch_no, in at most ``most`` runs of batches of about as many rows; null batches come first."""
    n = traces.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("batch_no").asc_nulls_first()).collect()  # one row a batch
    total, upto, cuts = sum(r.n for r in n), 0, []
    for r in n:
        k = upto * most // max(total, 1)
        if not cuts or k > cuts[-1][0]:
            cuts.append((k, []))
        cuts[-1][1].append(r.batch_no)
        upto += r.n
    return [traces.where(F.col("batch_no").isin([b for b in bs if b is not None]) | (F.col("batch_no").isNull() if None in bs else F.lit(False))) for _, bs in cuts] or [traces]


#: deliveries in which a whole table is given to an index
DELIVERIES = 2


def repeats(traces: DataFrame, most: int = DELIVERIES, folder: str | None = None) -> DataFrame:
    """(row_a, row_b): every row that repeats an earlier one, with the first of its group.

    The batches are accepted in order by a ``HistoryIndex`` in the shared folder, ``most`` deliveries for all; how
    they are divided makes no difference for what is linked, only for what an index holds at a time.
    """
    spark = traces.sparkSession
    index = HistoryIndex(folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    found = [cut(index.accept(conversations(part).select("row_id", "text"), f"{k:06d}")) for k, part in enumerate(deliveries(traces, most))]
    return reduce(DataFrame.unionByName, found).distinct()


def batch_split(traces: DataFrame) -> DataFrame:
    """Rows, new rows, repeats and rows without words per batch."""
    found = repeats(traces).select(F.col("row_b").alias("row_id"), F.lit(1).alias("again"))
    rows = traces.select("batch_no", "row_id").distinct().join(found, "row_id", "left")
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count("again").alias("n_repeats"), (F.count(F.lit(1)) - F.count("again")).alias("n_new"))
