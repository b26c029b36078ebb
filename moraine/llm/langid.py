"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to three bytes is learned: how often each byte followed each
context. A byte costs, in the longest context that the tree has, its share by escape method C; a byte that is new there
costs an escape and is coded in the context one byte shorter, without the bytes already excluded, down to a
uniform code over what is left of the 256 bytes. Statistics are frozen after training, so a byte's exact cost in
a language depends on itself and the three bytes before it. The language with the shortest code for the whole text wins.

The classifier is fitted on a bounded sample of the labelled rows that may be learned from: at most about ``max_rows`` of a language, chosen by a hash of the
row. Over these rows the counts are exact and the trees complete; nothing else is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

ORDER = 3
UNDETERMINED = "und"
#: Texts are scored in stretches of this many bytes, which carry their context over.
_STRETCH = 1 << 20
_SAMPLE_LOG = 30


def grams(data: bytes, before: bytes = b"\n" * ORDER) -> np.ndarray:
    """For each byte: itself in the low byte, the three before it above, in one uint32."""
    a = np.frombuffer(before + data, np.uint8).astype(np.uint32)
    return (a[:-3] << np.uint32(24)) | (a[1:-2] << np.uint32(16)) | (a[2:-1] << np.uint32(8)) | a[3:]


class Tree:
    """Frozen context tree of one language, from counts of four-byte paths."""

    def __init__(self, paths: np.ndarray, counts: np.ndarray):
        order = paths.argsort()
        path, count = paths[order].astype(np.uint64), counts[order].astype(np.float64)
        self.levels = []  # by context length: (gram, count), (context, total, distinct, total of the bytes below)
        for length in range(ORDER, -1, -1):
            gram, inverse = np.unique(path & np.uint64((1 << (8 * (length + 1))) - 1), return_inverse=True)
            n = np.bincount(inverse, count, minlength=len(gram))
            context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            self.levels.append([gram, n, context, np.bincount(at, n, minlength=len(context)), np.bincount(at, minlength=len(context)).astype(np.float64), None])
        for i, (level, below) in enumerate(zip(self.levels, self.levels[1:], strict=False)):
            # The count, one context down, of the bytes that this context has: they are excluded after an escape.
            gram, context = level[0], level[2]
            shorter = gram & np.uint64((1 << (8 * (ORDER - i))) - 1)
            n_below = below[1][np.searchsorted(below[0], shorter)]
            level[5] = np.bincount(np.searchsorted(context, gram >> np.uint64(8)), n_below, minlength=len(context))
        self.levels[-1][5] = np.zeros(len(self.levels[-1][2]))

    def bits(self, path: np.ndarray) -> np.ndarray:
        """Exact cost of the last byte of each four-byte path."""
        path = path.astype(np.uint64)
        cost = np.zeros(len(path))
        open_ = np.ones(len(path), bool)
        excluded_n = np.zeros(len(path))  # of the bytes excluded so far: their count in the context at hand, and their number
        excluded_d = np.zeros(len(path))
        for i, (gram, n, context, total, distinct, below) in enumerate(self.levels):
            length = ORDER - i
            here = path & np.uint64((1 << (8 * (length + 1))) - 1)
            if not len(context):
                continue
            c = np.minimum(np.searchsorted(context, here >> np.uint64(8)), len(context) - 1)
            known = open_ & (context[c] == here >> np.uint64(8))
            t, d = total[c] - excluded_n, distinct[c] - excluded_d
            usable = known & (d > 0)  # else all its bytes are excluded, and the escape is certain
            g = np.minimum(np.searchsorted(gram, here), len(gram) - 1)
            hit = usable & (gram[g] == here)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost[hit] += np.log2((t + d) / n[g])[hit]
                missed = usable & ~hit
                cost[missed] += np.log2((t + d) / d)[missed]
            open_ &= ~hit
            escaped = known & ~hit
            excluded_n = np.where(escaped, below[c], 0.0)
            excluded_d = np.where(escaped, distinct[c], 0.0)
        cost[open_] += np.log2(np.maximum(256.0 - excluded_d[open_], 1.0))
        return cost


@dataclass
class Model:
    """Languages and, for each, its paths with their counts."""

    languages: list[str]
    paths: list[np.ndarray]
    counts: list[np.ndarray]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The trees, and a table of the cost of every path that some tree has, in all languages."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.trees = [Tree(p, c) for p, c in zip(model.paths, model.counts, strict=True)]
        paths = np.unique(np.concatenate([*model.paths, np.zeros(1, np.uint32)])).astype(np.uint32)
        costs = np.stack([t.bits(paths) for t in self.trees] or [np.zeros(len(paths))], axis=1).astype(np.float32)
        # One probe: of paths that share a slot the table has one; the others are looked up in the sorted array.
        self.paths, self.costs = paths, costs
        self.log = min(max(16, len(paths).bit_length() + 1), 24)
        self.slots = np.zeros(1 << self.log, np.int32)
        self.slots[self._slot(paths)] = np.arange(len(paths), dtype=np.int32)

    def _slot(self, path: np.ndarray) -> np.ndarray:
        return (path * np.uint32(2654435761)) >> np.uint32(32 - self.log)

    def bits(self, text: str) -> np.ndarray:
        """Code length of the whole text in each language."""
        data = text.encode("utf-8", "surrogatepass")
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), _STRETCH):
            path = grams(data[at : at + _STRETCH], (b"\n" * ORDER + data[max(0, at - ORDER) : at])[-ORDER:])
            row = self.slots[self._slot(path)]
            wrong = np.flatnonzero(self.paths[row] != path)
            if len(wrong):
                other = path[wrong]
                found = np.minimum(np.searchsorted(self.paths, other), len(self.paths) - 1)
                row[wrong] = found
                new = self.paths[found] != other
                if new.any():
                    fresh, times = np.unique(other[new], return_counts=True)
                    for i, tree in enumerate(self.trees):
                        total[i] += tree.bits(fresh) @ times
                    row = np.delete(row, wrong[new])
            total += self.costs[row].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior share at a tenth of the code lengths' weight, as neighbouring bytes are far from independent."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        bits = self.bits(text)
        best = int(bits.argmin())
        share = 1 / np.exp2(np.clip((bits[best] - bits) / 10, -1000, 0)).sum()
        return self.languages[best], float(share)


def train(documents: DataFrame, max_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held_out: int = 1) -> Model:
    """Learn from texts with a language whose id's crc32 remainder is not ``held_out``.

    Of a language with more than ``max_rows`` such rows as large a share is taken, by a hash of id and text. Rows without an id may be learned from; null texts and null
    languages are left out; repeated rows count as often as they are chosen. An empty table gives a model without languages.
    """
    usable = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    usable = usable.filter(F.coalesce(common.crc_remainder(F.col("doc_id"), modulus) != held_out, F.lit(True)))
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if any(n > max_rows for n in sizes.values()):
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << _SAMPLE_LOG))
        shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << _SAMPLE_LOG) * min(1.0, max_rows / n)))])
        usable = usable.filter(place < shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def merge(lang: str) -> None:
            path, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], path])
                path, inverse = np.unique(both, return_inverse=True)
                n = np.bincount(inverse, np.concatenate([sums[lang][1], n]))
            sums[lang] = (path, n)
            sizes[lang] = 0

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(data), _STRETCH):
                    waiting.setdefault(lang, []).append(grams(data[at : at + _STRETCH], (b"\n" * ORDER + data[max(0, at - ORDER) : at])[-ORDER:]))
                    sizes[lang] = sizes.get(lang, 0) + len(waiting[lang][-1])
                    if sizes[lang] > 1 << 21:
                        merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, (path, n) in sums.items():
            for at in range(0, len(path), 10_000):
                part = path[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[at : at + 10_000].astype(np.int64))], names=["lang", "path", "n"])

    counted = usable.select("text", "lang").mapInArrow(count, "lang string, path long, n long")
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") if languages else F.lit(0)
    totals = counted.groupBy("lang", "path").agg(F.sum("n").alias("n")).select(number.alias("lang"), "path", "n").toArrow()  # the paths of max_rows rows a language
    lang, path, n = (totals.column(i).to_numpy() for i in range(3))
    of = [np.flatnonzero(lang == i + 1) for i in range(len(languages))]
    return Model(languages, [path[x].astype(np.uint32) for x in of], [n[x].astype(np.int64) for x in of])


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and a model without languages. Repeated rows each give a
    row; further columns are ignored.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # the paths of max_rows rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
