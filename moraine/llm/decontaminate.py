"""Benchmark decontamination by spaced seeds.

A mask names the token positions of a window that count; the others may differ. Every masked window of
every test item is hashed to a table of seeds. Training windows are hashed alike, and those whose hash no test window has are left out where they are read, by two
bitmaps of bounded size that go to the executors. What is left is joined with the seeds on the hash, and around each hit the
texts are laid on each other along the hit's diagonal and compared token by token, so overlaps with
substitutions are found and chance hits are not. The masks below hit every window of 13 tokens with at most two
substitutions, and shorter items with as many as they may have (the tests try all of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

#: Token positions that count.
MASKS = ((0, 1, 2, 5, 6), (0, 2, 3, 4, 5))
#: Besides, for whole items of 10 and 11 tokens, where some two substitutions touch all places of both masks.
BRIEF, BRIEF_MASK = (10, 11), (0, 1, 2, 4, 7)
WINDOW = 13
SIMILARITY = 0.8
#: Items of fewer tokens match only as a whole and exactly.
SHORT = 9
#: Bits of a bitmap: as many for each seed, and at most so many (the two take 64 MB).
BITS_PER_SEED, MOST_BITS = 64, 1 << 28
#: Words whose hashes a task keeps at hand.
_KNOWN = 1 << 20
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _multipliers(n: int) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(n)], np.uint64)


def token_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Signed 64-bit hash of each token; ``known`` keeps those of words seen before."""
    from xxhash import xxh64_intdigest

    if len(known) > _KNOWN:
        known.clear()
    words = tokens(text)
    for word in set(words):
        if word not in known:
            value = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            known[word] = value - (1 << 64) if value >> 63 else value
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def mask_of(number: int) -> tuple[int, ...]:
    """Masks by number: those above first, then ``-n`` for all of n tokens."""
    return tuple(range(-number)) if number < 0 else (*MASKS, BRIEF_MASK)[number]


def masks_for(size: int) -> tuple[int, ...]:
    """Numbers of the masks of an item of so many tokens."""
    if size < SHORT:
        return (-size,) if size else ()
    return (0, 1, 2) if size in BRIEF else (0, 1)


def masked_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked tokens of every window."""
    n = len(ids) - mask[-1]
    total = np.full(max(n, 0), len(mask), np.uint64)
    for at, factor in zip(mask, _multipliers(len(mask)), strict=True):
        if n > 0:
            mixed = (ids[at : at + n].view(np.uint64) + np.uint64(1)) * factor
            total = (total ^ (mixed ^ (mixed >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


class Bitmaps:
    """Whether a hash may be a seed's: two bitmaps by different bits of the hash; never wrong about those that are."""

    def __init__(self, seeds: int):
        self.log = max(16, min(BITS_PER_SEED * max(seeds, 1), MOST_BITS).bit_length() - 1)
        self.bits = np.zeros((2, 1 << self.log - 3), np.uint8)

    def _place(self, i: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Octet and bit of each hash in one bitmap."""
        place = (hashes * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[i])) >> np.uint64(64 - self.log)
        return (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for i in range(2):
            octet, bit = self._place(i, hashes)
            np.bitwise_or.at(self.bits[i], octet, bit)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be there."""
        left = np.arange(len(hashes))
        for i in range(2):
            octet, bit = self._place(i, hashes[left])
            left = left[(self.bits[i][octet] & bit) != 0]
        return left


def verify(ids: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(matching tokens, first token in the text, first token in the item, tokens laid on each other) of the overlap along a diagonal, if there is one."""
    low, high = max(0, -diagonal), min(len(item), len(ids) - diagonal)
    if len(item) < SHORT:
        whole = low == 0 and high == len(item) and bool((ids[diagonal : diagonal + high] == item).all())
        return (high, diagonal, 0, high) if whole else None
    size = min(WINDOW, len(item))
    if high - low < size:
        return None
    same = np.concatenate([[0], np.cumsum(ids[diagonal + low : diagonal + high] == item[low:high])])
    good = np.flatnonzero(same[size:] - same[:-size] >= SIMILARITY * size)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + size
    return int(same[last] - same[first]), diagonal + low + first, low + first, last - first


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, sequence, tokens) of the items that have tokens; equal sequences have equal numbers."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([token_hashes(t, known) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["item_id", "tokens"])

    found = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, tokens array<long>")
    return found.filter(F.size("tokens") > 0).select("item_id", F.xxhash64("tokens").alias("sequence"), "tokens")


def _seeds(sequences: DataFrame) -> DataFrame:
    """(mask, hash, sequence, place) of every masked window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids.values.to_numpy()
                for number in masks_for(len(ids)):
                    hashes = masked_hashes(ids, mask_of(number))
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.full(n, sequence)), pa.array(np.arange(n, dtype=np.int32))], names=["mask", "hash", "sequence", "place"])

    return sequences.select("sequence", "tokens").mapInArrow(run, "mask int, hash long, sequence long, place int")


def _hits(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, row, tokens, hits) of the texts with a window whose hash may be a seed's; hits are (mask, hash, place). ``rows``: id, text."""
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # eleven at most
    maps = Bitmaps(seeds.count())
    for part in batched(seeds.select("hash").distinct().toLocalIterator(), 1 << 16) if masks else ():
        maps.add(np.array([r["hash"] for r in part], np.int64).view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(maps)  # MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        maps = shared.value
        for batch in batches:
            keep, sequences, hits = [], [], []
            for at, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ids = token_hashes(text, known)
                found = []
                for number in masks:
                    hashes = masked_hashes(ids, mask_of(number))
                    some = maps.may_have(hashes)
                    found += zip([number] * len(some), hashes[some].view(np.int64).tolist(), some.tolist(), strict=True)
                if found:
                    keep.append(at)
                    sequences.append(ids)
                    hits.append([{"mask": m, "hash": h, "place": p} for m, h, p in found])
            columns = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences, pa.list_(pa.int64())), pa.array(hits, hit)], names=[*names, "tokens", "hits"])

    hit = pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("place", pa.int32())]))
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    found = rows.select(*names, "text").mapInArrow(run, f"{kinds}, tokens array<long>, hits array<struct<mask:int,hash:long,place:int>>")
    return common.materialize(found.withColumn("row", F.monotonically_increasing_id()))


def _overlaps(hits: DataFrame, seeds: DataFrame, sequences: DataFrame) -> DataFrame:
    """(row, sequence, best) of each text and token sequence that overlap; best: matched, doc_start, item_start, n_tokens, size."""
    at = hits.select("row", F.explode("hits").alias("x")).select("row", "x.mask", "x.hash", F.col("x.place").alias("at"))
    pairs = at.join(seeds, ["mask", "hash"]).select("row", "sequence", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    lengths = sequences.select("sequence", F.size("tokens").alias("size"))
    # Of a text only what the item lies on goes on.
    pairs = pairs.join(lengths, "sequence")
    first = F.greatest("diagonal", F.lit(0))
    laid = pairs.join(hits.select("row", F.col("tokens").alias("text")), "row")
    laid = laid.select("row", "sequence", "diagonal", first.alias("first"), F.slice("text", first + 1, F.greatest(F.col("diagonal") + F.col("size") - first, F.lit(0))).alias("part"))
    laid = laid.join(sequences.select("sequence", "tokens"), "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for sequence, row, diagonal, start, part, item in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if found := verify(np.array(part, np.int64), np.array(item, np.int64), diagonal - start):
                    for name, value in zip(names, (row, sequence, found[0], found[1] + start, found[2], found[3], len(item)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = ["row", "sequence", "matched", "doc_start", "item_start", "n_tokens", "size"]
    schema = pa.schema([(n, pa.int64() if n in ("row", "sequence") else pa.int32()) for n in names])
    good = laid.select("sequence", "row", "diagonal", "first", "part", "tokens").mapInArrow(run, "row long, sequence long, matched int, doc_start int, item_start int, n_tokens int, size int")
    order = F.struct("matched", -F.col("doc_start"), "item_start", "n_tokens", "size")
    best = good.groupBy("row", "sequence").agg(F.max(order).alias("o"))
    return best.select("row", "sequence", F.col("o.matched").alias("n_matched"), (-F.col("o.col2")).alias("doc_start"), F.col("o.item_start").alias("item_start"), F.col("o.n_tokens").alias("n_tokens"), F.col("o.size").alias("size"))


def _tables(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, their distinct token sequences, and the seeds of these."""
    items = common.materialize(_items(benchmark, id_col, text_col))
    sequences = common.materialize(items.groupBy("sequence").agg(F.first("tokens").alias("tokens")))
    return items, sequences, common.materialize(_seeds(sequences))


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_matched, coverage) of each pair that overlaps, with its best overlap.

    An overlap has a window of 13 tokens (or the whole item, if shorter) of which 0.8 agree; items of fewer than nine
    tokens must be there exactly. Tokens are runs of word characters, lower-cased. Items without tokens and null or empty texts match nothing.
    Items with equal texts are each reported; repeated rows each give their rows; null ids are kept. Empty tables give no rows. Further columns are ignored.
    """
    items, sequences, seeds = _tables(benchmark, item_col, item_text_col)
    hits = _hits(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), seeds)
    found = _overlaps(hits, seeds, sequences).join(hits.select("row", "doc_id"), "row").join(items.select("item_id", "sequence"), "sequence")
    return found.select("doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matched", (F.col("n_matched") / F.col("size")).alias("coverage"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no test item is found, with all their columns.

    Null and empty texts stay; rows that repeat id and text go or stay together, rows that share an id but not the text are judged
    each; empty tables drop nothing.
    """
    a, b = common.unused(documents.columns, "leak_a", "leak_b")
    keys = (F.xxhash64(F.col(id_col), F.col(text_col)), F.hash(F.col(text_col), F.col(id_col)))
    _, sequences, seeds = _tables(benchmark, "item_id", "text")
    hits = _hits(documents.select(keys[0].alias("a"), keys[1].alias("b"), F.col(text_col).alias("text")), seeds)
    leaked = _overlaps(hits, seeds, sequences).select("row").distinct().join(hits.select("row", "a", "b"), "row")
    leaked = common.materialize(leaked.select(F.col("a").alias(a), F.col("b").alias(b)).distinct())
    return documents.join(leaked, (keys[0] == F.col(a)) & (keys[1] == F.col(b)), "left_anti")
