"""Packing into optimal length buckets.

A sequence is a document, or a piece of at most max_len tokens of a longer one. The histogram of
sequence lengths over the whole table has at most max_len + 1 entries; dynamic programming over
it picks the bucket boundaries of least total padding. Inside a bucket, sequences are numbered
and every budget // boundary of them form a batch, so a padded batch stays within the budget.

Numbering a bucket needs no task that sees all of it: sequences fall into hashed chunks, chunks
are numbered inside, and offsets come from the chunk sizes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 16_384
#: Mean sequences of a chunk.
CHUNK_ROWS = 8192
#: Chunks whose sizes one task adds up.
BLOCK_CHUNKS = 1024


def word_tokens(text: str = "text") -> Column:
    """Tokens of a text counted as whitespace-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least total padding.

    Lengths of zero pad nothing by themselves and belong to the first bucket. Among equal
    solutions the one with the smaller boundaries, and then with fewer buckets, is taken.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    m = len(lengths)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choice, totals = [], []
    for _ in range(min(buckets, m)):
        now, cut_at = np.full(m + 1, np.iinfo(np.int64).max // 4), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut_at[j] = cost.argmin()
            now[j] = cost[cut_at[j]]
        best = now
        choice.append(cut_at)
        totals.append(int(now[m]))
    k = totals.index(min(totals))
    out, j = [], m
    while j:
        out.append(int(lengths[j - 1]))
        j = int(choice[k][j])
        k -= 1
    return out[::-1]


def sequences(docs: DataFrame, tokens: Column, max_len: int) -> DataFrame:
    """doc_id, piece, first_token, n_tokens: documents, those beyond max_len in pieces."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("int")
    pieces = whole.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * max_len
    return pieces.select("doc_id", "piece", first.alias("first_token"), F.least(F.col("n") - first, F.lit(max_len)).alias("n_tokens"))


def pack(docs: DataFrame, tokens: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per sequence: doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot.

    batch numbers the batches of a bucket, slot the sequences of a batch; a batch holds at most
    budget // bucket_len sequences (at least one). A null or empty text is one sequence of no
    tokens in the first bucket; a very long one becomes many sequences. Repeated rows and rows
    without an id are packed each; which of two equal rows comes first makes no difference. An
    empty table gives an empty result; further columns are ignored, whatever their names.
    """
    if budget < max_len:
        raise ValueError("the budget must hold a sequence of max_len tokens")
    tokens = word_tokens() if tokens is None else tokens
    # a written number spreads rows that are alike, such as those without an id, over the chunks
    rows = cut(sequences(docs, tokens, max_len).withColumn("salt", F.monotonically_increasing_id()), "sequences")
    histogram = {r.n_tokens: r.n for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = boundaries(histogram, buckets) or [max_len]
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    chunks = max(1, sum(histogram.values()) // chunk_rows)
    order = ["doc_id", "piece", "n_tokens"]
    rows = rows.withColumn("bucket", bucket).withColumn("chunk", F.pmod(F.xxhash64(*order, "salt"), F.lit(chunks)))
    sizes = cut(rows.groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("size")), "chunks")
    # offsets in two levels, so no task sees all chunks of a bucket
    sizes = sizes.withColumn("block", F.floor(F.col("chunk") / BLOCK_CHUNKS))
    blocks = sizes.groupBy("bucket", "block").agg(F.sum("size").alias("block_size"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("bucket", "block", F.coalesce(F.sum("block_size").over(before(["bucket"], "block")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(before(["bucket", "block"], "chunk")), F.lit(0))
    offsets = cut(sizes.withColumn("within", within).join(blocks, ["bucket", "block"]).select("bucket", "chunk", (F.col("base") + F.col("within")).alias("offset")), "offsets")
    inside = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy(*order)) - 1
    numbered = rows.withColumn("at", inside).join(offsets, ["bucket", "chunk"]).withColumn("at", F.col("at") + F.col("offset"))
    lens = F.array(*[F.lit(x).cast("long") for x in bounds])
    caps = F.array(*[F.lit(budget // max(x, 1)).cast("long") for x in bounds])
    cap = F.element_at(caps, F.col("bucket") + 1)
    return numbered.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket",
        F.element_at(lens, F.col("bucket") + 1).alias("bucket_len"),
        F.floor(F.col("at") / cap).alias("batch"), F.pmod("at", cap).alias("slot"),
    )
