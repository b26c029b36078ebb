import random
from itertools import combinations

import numpy as np
import pytest

from moraine.llm import decontaminate, queries
from tests.llm.test_pipeline import plain_leak


@pytest.mark.parametrize("size", range(decontaminate.SHORT, decontaminate.WINDOW + 1))
def test_no_allowed_substitution_is_missed(size):
    """Every way to replace as many tokens of an item as may differ leaves a seed, and the overlap is verified."""
    item = decontaminate.token_hashes(" ".join(f"w{i}" for i in range(size)), {})
    seeds = {n: decontaminate.masked_hashes(item, decontaminate.mask_of(n)) for n in decontaminate.masks_for(size)}
    most = max(k for k in range(size) if size - k >= decontaminate.SIMILARITY * size)
    for k in range(most + 1):
        for places in combinations(range(size), k):
            ids = item.copy()
            ids[list(places)] = -5
            text = np.concatenate([[-1], ids, [-2]])
            hits = [n for n, hashes in seeds.items() if (decontaminate.masked_hashes(text, decontaminate.mask_of(n))[1 : len(hashes) + 1] == hashes).any()]
            assert hits, places
            assert decontaminate.verify(text, item, 1) == (size - k, 1, 0, size), places


def test_bitmaps_have_every_seed():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 5000, np.uint64)
    maps = decontaminate.Bitmaps(len(hashes))
    maps.add(hashes)
    assert (maps.may_have(hashes) == np.arange(5000)).all()
    assert len(maps.may_have(rng.integers(0, 1 << 63, 100_000, np.uint64))) < 200
    assert decontaminate.Bitmaps(10**12).bits.nbytes == 64 << 20


def test_leaks_against_all_alignments(spark):
    """Every document and item, laid on each other in every way."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 5, 8, 9, 10, 11, 12, 13, 14, 20, 60) for _ in range(3)]
    texts = []
    for _ in range(150):
        words_of = rng.choices(words, k=rng.randrange(30))
        item = rng.choice(items).split()
        start = rng.randrange(len(item))
        piece = item[start:] if rng.random() < 0.3 else item
        piece = [t if rng.random() > 0.15 else rng.choice(words) for t in piece]
        at = rng.randrange(len(words_of) + 1)
        texts.append(" ".join([*words_of[:at], *piece, *words_of[at:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if plain_leak(t, item)}
    assert got == want and len(want) > 100
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_leaks_of_documents(spark, sf_dir):
    docs, items = ({r[0]: r["text"] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()} for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_spaced_seeds(spark, sf_dir).collect()}
    assert got == {(i, j) for i, t in docs.items() for j, item in items.items() if plain_leak(t, item)}
