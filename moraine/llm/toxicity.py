"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width, accented letters) and digit or
symbol substitutions to plain letters, and turns everything else into single spaces. Entries are
whole words (``" idiot "``) or word beginnings (``" achlich"``) with a weight learned from labelled
rows. A hit inside an exception phrase does not count. The sum of the weights, normalised by the
length in words, goes through a logistic curve fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ı": "i", "ł": "l", "đ": "d",
}
#: Digits and symbols written for letters.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Within these (folded) phrases a hit is not an insult, by default.
EXCEPTIONS = ("trash can", "trash cans", "clown fish", "pond scum", "female dog", "idiot proof", "bastard sword", "bastard file")
#: The lexicon where there are too few labels to learn one.
SEEDS = ("idiot", "moron", "imbecile", "dumbass", "bastard", "asshole", "bitch", "fuck", "fucking", "shit", "whore", "retard", "scum")
#: Labelled rows of either kind below which nothing is learned.
LEAST_LABELLED = 8


def _folding() -> dict[int, str]:
    """For text in compatibility decomposition, so that full-width, mathematical and accented letters are plain ones with or without accents after them."""
    table: dict[int, str] = {}
    for point in range(0x250):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(c))
        table[point] = "".join(c if c.isalnum() else " " for c in base)
    for point in range(0x300, 0x370):  # accents that stand alone
        table[point] = ""
    for point in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):  # invisible
        table[point] = ""
    for point in range(0x2010, 0x2070):
        table.setdefault(point, " ")
    for looks, plain in HOMOGLYPHS.items():
        table[ord(looks)] = table[ord(looks.upper()) if len(looks.upper()) == 1 else ord(looks)] = plain
    return table


_FOLD = _folding()
#: Without what a substitution may stand for.
_FOLD_LETTERS = {k: v for k, v in _FOLD.items() if chr(k) not in SUBSTITUTIONS}
_SUBSTITUTE = str.maketrans(SUBSTITUTIONS)
#: A word with a digit or symbol and, by its letters, not a number.
_MIXED = re.compile(r"(?<![^\s])(?=\S*[a-z])(?=\S*[0-9@$!])[a-z0-9@$!]+(?<![!])")
_SPACES = re.compile(r"\s+")
_HAS_SUBSTITUTE = re.compile(r"[0-9@$!]")


def fold(text: str | None) -> str:
    """Folded text, its words between single spaces, with a space at both ends."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if _HAS_SUBSTITUTE.search(text):
        kept = text.lower()
        if not kept.isascii():
            kept = kept.translate(_FOLD_LETTERS)
        text = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTE), kept)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Model:
    """Entries with weights, and the logistic curve over (weights by length, hits, their logarithm)."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(f" {phrase} ", (None, len(phrase) + 2))
        for entry, weight in self.weights.items():
            automaton.add_word(entry, (weight, len(entry)))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def features_of(folded: str, automaton) -> tuple[float, float]:
    """(weight per hundred words, log of one plus the weight), without hits in exception phrases.

    Of entries that hit the same place the heaviest counts.
    """
    if not len(automaton):
        return 0.0, 0.0
    best: dict[int, float] = {}
    voided: list[tuple[int, int]] = []
    for end, (weight, size) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            voided.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if not best:
        return 0.0, 0.0
    if voided:
        voided.sort()
        starts, until = [a for a, _ in voided], list(accumulate((b for _, b in voided), max))
        # The phrases that start at or before a hit reach furthest to ``until``.
        best = {at: w for at, w in best.items() if not (i := bisect_right(starts, at)) or at >= until[i - 1]}
    total = sum(best.values())
    words = folded.count(" ") - 1
    return 100.0 * total / max(words, 20), math.log1p(total)


def _entries(folded: str, least: int, most: int) -> set[str]:
    out: set[str] = set()
    for word in set(folded.split()):
        if least <= len(word) <= 20:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(least, min(most, len(word) - 1) + 1))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    design = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((design * w[:, None]).T @ design + ridge * np.eye(len(beta)), design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(
    documents: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    held_out: int = 0,
    max_labelled: int = 8_000,
    max_entries: int = 3_000,
    least_toxic: int = 4,
    least_weight: float = 1.5,
    prefix: tuple[int, int] = (4, 9),
) -> Model:
    """Learn weights and curve from labelled documents whose crc32 remainder is not ``held_out``.

    The classifier is fitted on at most ``max_labelled`` labelled rows, those with the lowest hash of the id;
    counts are summed on the executors. A document labelled twice is toxic if one label says so; null ids and null labels are left out, null texts are empty, and each of repeated rows counts.
    With fewer than LEAST_LABELLED rows of either label (or empty tables) the lexicon is SEEDS and the curve the default one. Further columns are ignored.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    usable = usable.filter(common.crc_remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = chosen.collect()
    n_toxic = sum(1 for r in rows if r["toxic"])
    n_clean = len(rows) - n_toxic
    if min(n_toxic, n_clean) < LEAST_LABELLED:
        return Model({f" {w} ": 5.0 for w in SEEDS})
    sample = documents.sparkSession.createDataFrame(rows, chosen.schema)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_labelled rows
    texts = common.materialize(texts.repartition(24))
    low, high = prefix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean).update(_entries(fold(text), low, high))
        names = list(toxic)  # what no toxic row has can't get in
        others = [n for n in clean if n not in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + others, pa.string()), pa.array([toxic[n] for n in names] + [0] * len(others), pa.int64()), pa.array([clean[n] for n in names + others], pa.int64())],
            names=["entry", "toxic", "clean"],
        )

    weight = F.log((F.col("toxic") + 0.1) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 1.0) / F.lit(n_clean + 1.0))
    counted = texts.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counted.filter(F.col("toxic") >= least_toxic).withColumn("weight", weight).filter(F.col("weight") >= least_weight)
    found = best.orderBy((F.col("weight") * F.col("toxic")).desc(), "entry").limit(max_entries).collect()
    model = Model({r["entry"]: float(r["weight"]) for r in found})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            x = [features_of(fold(t), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("toxic").cast(pa.int32())], names=["rate", "size", "toxic"])

    measured = texts.mapInArrow(measure, "rate double, size double, toxic int").collect()  # max_labelled rows of numbers
    if measured and 0 < sum(r["toxic"] for r in measured) < len(measured):
        x = np.array([(r["rate"], r["size"]) for r in measured])
        model.curve = fit_curve(x, np.array([float(r["toxic"] > 0) for r in measured]))
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document from its whole text alone.

    Null and empty texts get the curve's lowest score. Repeated rows each give a row; other columns are left out.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            x = np.array([features_of(fold(t), automaton) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            scores = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def filter_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass.

    Each row is judged by its text alone, so repeated rows go or stay together; null and empty texts stay unless the curve says otherwise; an empty table stays empty.
    """
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        at = columns.index("text")
        for batch in batches:
            x = np.array([features_of(fold(t), automaton) for t in batch.column(at).to_pylist()]).reshape(-1, 2)
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return documents.mapInArrow(run, documents.schema)
