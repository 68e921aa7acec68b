"""Mixing sources to target weights (problem 8).

Weighted sampling without replacement after Efraimidis and Spirakis: a document
of weight w gets the key -ln(u) / w, u being a hash of its id, and a source takes
its documents in the order of the keys until its token budget is used.  A source
whose budget exceeds its tokens is repeated: complete epochs first, then a
fractional one by the keys.

The prefix sums are distributed: the keys of a source are cut at their quantiles
into ``CELLS`` cells of like size, whatever its documents' weights; the tokens per (source, cell) are summed before the shuffle, cells are summed up
along each source (a table of sources x cells), and only the order inside a cell
is settled by a sort, so a source with a third of all documents is spread over
all tasks.

Defined results
    * sources are compared without case and outer white space; documents of null
      or other sources, and documents without tokens, are not used;
    * sources with a target but no documents cannot contribute: the others keep
      their proportions (``wanted_share``), and the report says so;
    * the mixture is as large as the sources allow without a source beyond
      ``max_repeats`` epochs, unless ``total_tokens`` asks for less;
    * a document whose tokens cross the budget is left out, so a source stays
      below its target by less than one document; ties of keys go by doc_id;
    * null target shares count as 0, null repeats as 1; targets given twice for
      one source are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanforge.llm.tokens import TOKENIZER, TOKENIZER_DIR, load
from spanforge.session import cut

#: cells of a source; a power of two
CELLS = 1024
#: a larger table of sources is not broadcast but joined by its keys
BROADCAST_BYTES = 16 << 20
SEED = 17


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1]: share of letters and spaces, damped for very short texts."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), clean * F.least(F.lit(1.0), n / 200.0))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets_of(targets: DataFrame) -> DataFrame:
    return (
        targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
        .where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def sized_documents(documents: DataFrame, folder: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, key), written once to the shared folder."""
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    path = f"{folder}/{tokenizer}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("key"), pa.array(n, pa.int64())], names=["doc_id", "source", "key", "n_tokens"])

    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", "source", "text", sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"))
    return cut(keyed.mapInArrow(count, "doc_id bigint, source string, key double, n_tokens bigint").where(F.col("n_tokens") > 0).dropDuplicates(["doc_id"]))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source with a target: what it has, wants and may take.

    Columns source, target_share, max_repeats, n_documents, tokens_available,
    wanted_share, budget, epochs (complete ones), rest (tokens of the last one).
    """
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens_available"))
    t = targets_of(targets).join(have, "source", "left").fillna(0, ["n_documents", "tokens_available"])
    can = (F.col("tokens_available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    everything = W.Window.partitionBy(F.lit(1))  # one row per source
    t = t.withColumn("wanted_share", F.when(can, F.col("target_share") / F.sum(F.when(can, F.col("target_share"))).over(everything)).otherwise(0.0))
    most = F.min(F.when(F.col("wanted_share") > 0, F.col("tokens_available") * F.col("max_repeats") / F.col("wanted_share"))).over(everything)
    size = F.least(most, F.lit(float(total_tokens))) if total_tokens is not None else most
    t = t.withColumn("budget", F.coalesce(F.floor(size * F.col("wanted_share") + 1e-6), F.lit(0)).cast("bigint"))
    t = t.withColumn("epochs", F.when(F.col("tokens_available") > 0, F.floor(F.col("budget") / F.col("tokens_available"))).otherwise(0).cast("bigint"))
    return t.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens_available"))


def in_cells(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """The documents of the sources with a budget, with epochs, rest and the cell of their key."""
    # one row per source with a target: its budget and the quantiles of its keys
    bounds = sized.groupBy("source").agg(F.percentile_approx("key", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 10 * CELLS).alias("bounds"))
    per = cut(planned.where(F.col("budget") > 0).select("source", "epochs", "rest").join(bounds, "source"))
    small = per.count() * 8 * CELLS <= BROADCAST_BYTES
    docs = sized.join(F.broadcast(per) if small else per, "source")
    # the cell is the number of bounds below the key, found by halving
    return docs.withColumn("cell", F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(CELLS.bit_length() - 1))]), F.lit(0), lambda at, step: F.when(F.coalesce(F.get("bounds", at + step - 1) < F.col("key"), F.lit(False)), at + step).otherwise(at))).drop("bounds")


def mixture(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents used and how often."""
    docs = in_cells(sized, planned)
    cells = docs.groupBy("source", "cell").agg(F.sum("n_tokens").alias("t"))
    along = W.Window.partitionBy("source").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
    before = cells.select("source", "cell", F.coalesce(F.sum("t").over(along), F.lit(0)).alias("before"))
    inside = W.Window.partitionBy("source", "cell").orderBy("key", "doc_id").rowsBetween(W.Window.unboundedPreceding, 0)
    used = docs.join(before, ["source", "cell"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    used = used.withColumn("repeats", F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0))
    return used.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target source: target, wanted and reached share, tokens, documents, repeats."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    out = planned.join(got, "source", "left").fillna(0, ["documents_used", "tokens_used", "most_repeats"])
    total = F.sum("tokens_used").over(W.Window.partitionBy(F.lit(1)))
    reached = F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0)
    return out.select(
        "source", "target_share", "wanted_share", reached.alias("reached_share"), "budget", "tokens_used", "tokens_available", "documents_used", "n_documents", "max_repeats", "most_repeats",
        F.when(F.col("n_documents") == 0, "no documents").when(F.col("wanted_share") == 0, "no target").otherwise("met").alias("note"),
    )
