"""Evaluation items that leaked into documents (problem 7).

Pigeonhole edit matching on words.  A passage is a run of ``WINDOW`` words of an
item (or the whole of a shorter one) with an error budget of one word in ten.
A window with k errors, split into k + 1 pieces, keeps one piece unharmed, so a
common run of ceil((WINDOW - k) / (k + 1)) words is necessary; such runs are
looked up by hash, extended to their full length, and what can still be a
passage is verified by Myers' bit-parallel edit distance over words.

The items are a stated query set: they are sent to the executors in blocks of at
most ``BLOCK_BYTES`` (one block for test suites of usual size) and every document
is read once per block, with no shuffle of the texts.  Work per document is
linear in its words plus the hits; a hot document source is just more rows.

Defined results
    * words are compared without case, punctuation, markup, invisible characters
      and line breaks; words broken by a hyphen at a line end are joined;
    * the opening sentence that at least ``SHARED_OPENING`` items begin with is
      cut from these items and matches nothing;
    * null and empty texts and items match nothing; repeated documents are
      reported each; an item given twice under one id is reported once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.words import words_of

WINDOW = 20
#: three errors in a row of words can spoil all windows of 20 in a passage of 30, so that length is tested too
LONGER = 30
BUDGET = 10  # one error per so many words
SHARED_OPENING = 3
BLOCK_BYTES = 16 << 20

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]{0,15}(?:\s[^<>]{0,200})?/?>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-\u2010\u00ad]\s*[\r\n]+[\s>]*(?=[^\W\d_])")
_GLUE = re.compile(r"[|/\\\u2192\u2026\u2013\u2014]|\](?=\()|[\r\n]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def plain_words(text: str) -> list[str]:
    """The words of a text without markup."""
    if "-" in text or "\u00ad" in text or "\u2010" in text:
        text = _BREAK.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return words_of(_GLUE.sub(" ", text))


def piece_length(window: int) -> int:
    """Length of the common run that a passage of ``window`` words must keep."""
    k = window // BUDGET
    return -(-(window - k) // (k + 1))


def myers_within(pattern: list[int], text: list[int], k: int) -> bool:
    """Whether ``pattern`` occurs in ``text`` with at most ``k`` words changed, added or lost."""
    m = len(pattern)
    eq: dict[int, int] = {}
    for i, x in enumerate(pattern):
        eq[x] = eq.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for x in text:
        e = eq.get(x, 0)
        vertical = e | down
        horizontal = (((e & up) + up) ^ up) | e
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score <= k:
            return True
    return m <= k


class ItemIndex:
    """Words and pieces of a block of items, on an executor."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, words in items:
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64))
        pad = 4
        self.start = np.cumsum([pad] + [len(w) + pad for w in self.words])[:-1] if self.words else np.empty(0, np.int64)
        size = int(self.start[-1] + len(self.words[-1]) + pad) if self.words else pad
        self.flat = np.full(size, -2, np.int64)  # -2 never equals a document's word
        self.owner = np.full(size, -1, np.int64)
        for i, (s, w) in enumerate(zip(self.start, self.words, strict=True)):
            self.flat[s : s + len(w)] = w
            self.owner[s : s + len(w)] = i
        self.window = np.array([min(WINDOW, len(w)) for w in self.words], dtype=np.int64)
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in sorted({piece_length(int(w)) for w in self.window}):
            pos = np.concatenate([s + np.arange(max(0, len(w) - q + 1)) for s, w, n in zip(self.start, self.words, self.window, strict=True) if piece_length(int(n)) == q])
            h = gram_hashes(self.flat, q)[pos]
            order = np.argsort(h, kind="stable")
            self.tables[q] = (h[order], pos[order])


def gram_hashes(flat: np.ndarray, q: int) -> np.ndarray:
    n = len(flat) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = (flat + 7).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _passage(index: ItemIndex, flat: np.ndarray, doc_of: np.ndarray, x: int, y: int, run: int, own: int, n: int) -> bool:
    """Whether a passage of ``n`` words of an item stands around a common run of ``run`` words at x in the documents and y in the items."""
    doc, k, q, words = int(doc_of[x]), n // BUDGET, piece_length(n), index.words[own]
    at = y - int(index.start[own])
    first, last = max(0, at + q - n), min(len(words) - n, at + run - q)
    # a window within k errors keeps n - k of its words in the document's part around it
    left = max(0, x - (at - first) - k)
    around = flat[left : x + (last - at) + n + k]
    held = set(around[doc_of[left : left + len(around)] == doc].tolist())
    piece = words[first : last + n].tolist()
    there = np.cumsum([0] + [w in held for w in piece])
    for s in (np.flatnonzero(there[n:] - there[:-n] >= n - k) + first).tolist():
        lo = max(0, x - (at - s) - k)
        text = flat[lo : x + (n - (at - s)) + k]
        if myers_within(piece[s - first : s - first + n], text[doc_of[lo : lo + len(text)] == doc].tolist(), k):
            return True
    return False


def _match(index: ItemIndex, flat: np.ndarray, doc_of: np.ndarray) -> set[tuple[int, int]]:
    """(document number, item number) of the passages in the padded words ``flat``."""
    found: set[tuple[int, int]] = set()
    item = index.flat
    for q, (hashes, positions) in index.tables.items():
        g = gram_hashes(flat, q)
        if not len(g) or not len(hashes):
            continue
        lo = np.searchsorted(hashes, g, side="left")
        inside = lo < len(hashes)
        inside[inside] = hashes[lo[inside]] == g[inside]
        d = np.flatnonzero(inside)
        if not len(d):
            continue
        lo = lo[d]
        count = np.searchsorted(hashes, g[d], side="right") - lo
        dp = np.repeat(d, count)
        ip = positions[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        first = flat[dp - 1] != item[ip - 1]  # only the starts of common runs
        dp, ip = dp[first], ip[first]
        ok = np.ones(len(dp), bool)
        for j in range(q):
            ok &= flat[dp + j] == item[ip + j]
        dp, ip = dp[ok], ip[ok]
        run = np.full(len(dp), q)
        going = np.arange(len(dp))
        while len(going):
            same = flat[dp[going] + run[going]] == item[ip[going] + run[going]]
            going = going[same]
            run[going] += 1
        own = index.owner[ip]
        need = index.window[own]
        whole = run >= need
        found.update(zip(doc_of[dp[whole]].tolist(), own[whole].tolist(), strict=True))
        rest = ~whole & (need // BUDGET > 0)
        dp, ip, run, own, need = dp[rest], ip[rest], run[rest], own[rest], need[rest]
        if not len(dp):
            continue
        # a run of 15 words or more is verified; a passage of a shorter longest run has two words in a row
        # in common on one of its sides, behind at most two errors and a word between them
        near = (need < WINDOW) | (run >= WINDOW - 5)
        flat2, item2 = gram_hashes(flat, 2), gram_hashes(item, 2)
        de, ie = dp + run, ip + run
        for a in range(4):
            for b in range(max(0, a - 2), min(4, a + 3)):
                if a or b:
                    i, j = np.minimum(de + a, len(flat2) - 1), np.minimum(ie + b, len(item2) - 1)
                    near |= flat2[i] == item2[j]
                    i, j = dp - a - 2, ip - b - 2
                    near |= (i >= 0) & (j >= 0) & (flat2[np.maximum(i, 0)] == item2[np.maximum(j, 0)])
        longer = (run >= piece_length(LONGER)) & (index.length[own] >= LONGER) & (need == WINDOW)
        for pick, size in ((near, 0), (longer, LONGER)):
            for x, y, r, o, n in zip(dp[pick].tolist(), ip[pick].tolist(), run[pick].tolist(), own[pick].tolist(), need[pick].tolist(), strict=True):
                if (int(doc_of[x]), o) not in found and _passage(index, flat, doc_of, x, y, r, o, size or n):
                    found.add((int(doc_of[x]), o))
    return found


def _opening(text: str) -> tuple[str, str]:
    """Words of the first sentence, and the rest of the text."""
    first, *rest = _SENTENCE.split(text.strip(), maxsplit=1)
    return " ".join(words_of(first)), rest[0] if rest else ""


def cut_opening(text: str, shared: set[str]) -> str:
    key, rest = _opening(text)
    return rest if key in shared else text


def strip_openings(texts: list[str]) -> list[str]:
    """Texts without the instruction sentence that several of them begin with."""
    count = Counter(_opening(t)[0] for t in texts)
    return [cut_opening(t, {k for k, n in count.items() if n >= SHARED_OPENING and k}) for t in texts]


def shared_openings(items: DataFrame) -> set[str]:
    """The opening sentences that at least ``SHARED_OPENING`` items begin with, counted over all items by Spark.

    They are at most a third as many as the items and one sentence each.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_opening(t)[0] for t in b.column(0).to_pylist()], pa.string())], names=["opening"])

    counted = items.select("text").mapInArrow(keys, "opening string").groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    return {r.opening for r in counted.where((F.col("n") >= SHARED_OPENING) & (F.col("opening") != "")).collect()}


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most ``BLOCK_BYTES`` of text, one at a time on the driver."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").dropDuplicates(["item_id", "text"])
    shared = shared_openings(rows)
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, plain_words(cut_opening(r.text, shared))))
        size += len(r.text)
    yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item, one row each."""
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value)
            get = index.vocab.get
            for b in batches:
                ids = b.column(0).to_pylist()
                parts, owners = [np.array([-1], np.int64)], [np.array([-1], np.int64)]
                for n, text in enumerate(b.column(1).to_pylist()):
                    w = np.fromiter((get(x, -1) for x in plain_words(text)), np.int64)
                    parts += [w, np.full(4, -1, np.int64)]
                    owners.append(np.full(len(w) + 4, n, np.int64))
                flat, doc_of = np.concatenate(parts), np.concatenate(owners)
                pairs = sorted({(ids[d], index.ids[o]) for d, o in _match(index, flat, doc_of)}) if index.ids else []
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: suite and the number of documents that hold a passage of it (0 if it did not leak)."""
    hit = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(hit, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


