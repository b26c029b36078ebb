"""Packing by length buckets: boundaries by dynamic programming, token-budget batches inside each bucket.

Texts longer than ``max_length`` tokens are cut into pieces of that length and a rest, so that no token is lost and
the global length histogram has at most ``max_length`` bins, which is all that reaches the driver. The
programme finds the boundaries that minimise the padding summed over all pieces. Inside a
bucket the pieces are numbered without gaps, by counts per shard of bounded size; each batch
takes as many as its token budget holds at the bucket's length, and only a bucket's last batch may be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.llm import common

MAX_SHARDS = 65_536


def word_count(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least sum of count * (bound - length)."""
    lengths = np.array(sorted(k for k, n in histogram.items() if k > 0 and n > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    n, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    size, most = len(lengths), min(buckets, len(lengths))
    # best[j]: least padding of the first j lengths with the buckets so far; each bucket ends at a length.
    best = lengths[np.maximum(np.arange(size + 1) - 1, 0)] * n - tokens
    origin = [np.zeros(size + 1, np.int64)]
    for _ in range(1, most):
        nxt, back = best.copy(), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            back[j] = int(cost.argmin())
            nxt[j] = cost[back[j]]
        best = nxt
        origin.append(back)
    bounds, j = [], size
    for back in reversed(origin):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return sorted(bounds)


def pack(
    documents: DataFrame,
    length: Column | None = None,
    buckets: int = 8,
    max_length: int = 2048,
    token_budget: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket_len, batch_id, slot) of every piece of every document.

    ``length`` counts a row's tokens (default: words of the text). ``start`` is the piece's first token. Documents without
    tokens keep a row with n_tokens 0 and bucket_len 0 and null batch and slot, as they fill nothing. Repeated rows
    are packed each. An empty table gives no rows; further columns are ignored.
    """
    if token_budget < max_length:
        raise ValueError("token_budget must hold a piece of max_length")
    count = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0))
    sized = documents.select(F.col(id_col).alias("doc_id"), count.cast("long").alias("total"))
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / max_length), F.lit(1)).cast("int") - 1))
    sized = sized.select("doc_id", "total", pieces.alias("piece"))
    start = F.col("piece").cast("long") * max_length
    sized = common.materialize(sized.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_length), F.col("total") - start).cast("int").alias("n_tokens")))

    histogram = {r["n_tokens"]: r["n"] for r in sized.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # max_length + 1 rows
    bounds = optimal_boundaries(histogram, buckets)
    total = sum(n for k, n in histogram.items() if k > 0)
    per_shard = max(512, -(-total // MAX_SHARDS))
    in_bucket = [sum(n for k, n in histogram.items() if low < k <= high) for low, high in zip([0, *bounds], bounds, strict=False)]

    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]) if bounds else F.lit(None).cast("int")
    shards = F.coalesce(*[F.when(F.col("bucket_len") == b, F.lit(-(-n // per_shard))) for b, n in zip(bounds, in_bucket, strict=True)], F.lit(1)) if bounds else F.lit(1)
    full = sized.filter("n_tokens > 0").withColumn("bucket_len", bucket)
    full = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), shards).cast("int"))
    # Pieces before each shard: at most MAX_SHARDS rows and one for each bucket.
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("bucket_len", "shard").agg(F.count("*").alias("n")).select("bucket_len", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_len", "shard").orderBy("n_tokens", "doc_id", "piece")
    numbered = full.withColumn("row", F.row_number().over(inside)).join(F.broadcast(offsets), ["bucket_len", "shard"])
    at = F.col("offset") + F.col("row") - 1
    capacity = F.floor(F.lit(token_budget) / F.col("bucket_len")).cast("long")
    batch = F.shiftleft(F.col("bucket_len").cast("long"), 40) + F.floor(at / capacity).cast("long")
    columns = ("doc_id", "piece", "start", "n_tokens")
    packed = numbered.select(*columns, "bucket_len", batch.alias("batch_id"), (at % capacity).cast("int").alias("slot"))
    empty = sized.filter("n_tokens <= 0").select(*columns, F.lit(0).alias("bucket_len"), F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("int").alias("slot"))
    return packed.unionByName(empty)
