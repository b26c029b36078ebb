import itertools
import math
import random
import re

import numpy as np

import corpus_pipeline
from moraine.llm import secrets, simhash, toxicity


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_first(texts):
    """The smallest id of each document's component, by all pairs of shingle sets."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    first = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and first[i] != first[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = {k: new if x == old else x for k, x in first.items()}
    return first


def plain_leak(text, item):
    """Whether the texts, laid on each other in any way, agree in 0.8 of a window of 13 tokens (or of a shorter item, from nine tokens on; exactly below)."""
    a, b = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    size = min(13, len(b))
    least = size if len(b) < 9 else 0.8 * size
    if not size:
        return False
    places = {}
    for i, t in enumerate(a):
        places.setdefault(t, []).append(i)
    by_diagonal = {}
    for j, t in enumerate(b):
        for i in places.get(t, ()):
            by_diagonal.setdefault(i - j, []).append(j)
    for diagonal, at in by_diagonal.items():
        for start in range(len(b) - size + 1):
            if 0 <= diagonal + start and diagonal + start + size <= len(a) and sum(start <= j < start + size for j in at) >= least:
                return True
    return False


def plain_toxic(text, model):
    """By a search for every entry at every place of the folded text."""
    folded = toxicity.fold(text)
    best = {}
    for entry, weight in model.weights.items():
        for m in re.finditer(f"(?={re.escape(entry)})", folded):
            best[m.start()] = max(best.get(m.start(), 0), weight)
    for phrase in model.exceptions:
        for m in re.finditer(f"(?={re.escape(f' {phrase} ')})", folded):
            best = {at: w for at, w in best.items() if not m.start() <= at < m.start() + len(phrase) + 1}
    total = sum(best.values())
    x = np.array([[100 * total / max(len(folded.split()), 20), math.log1p(total)]])
    return model.score(x)[0] >= 0.5


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    """Each stage's decisions are those of a plain version on all that its predecessor kept, and take effect."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        want = dict(kept)
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {k: t for k, t in kept.items() if not plain_toxic(t, model)}
        elif name == "simhash":
            first = plain_first(kept)
            want = {k: t for k, t in kept.items() if first[k] == k}
        elif name == "decontamination":
            want = {k: t for k, t in kept.items() if not any(plain_leak(t, item) for item in items)}
        elif name == "secrets":
            found = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(before)).collect()}
            for k, text in kept.items():
                hidden = [False] * len(text)
                for _, a, b in (x.split(":") for x in found[k].split(",") if x):
                    hidden[int(a) : int(b)] = [True] * (int(b) - int(a))
                runs = [(h, "".join(c for _, c in g)) for h, g in itertools.groupby(zip(hidden, text, strict=True), key=lambda x: x[0])]
                want[k] = "".join("[SECRET]" if h else t for h, t in runs)
        assert now == want, name
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept = now
    got = docs.groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {k: len(re.findall(r"[^ \t-\r]+", t)) for k, t in kept.items()}
    assert docs.filter("n_tokens > 0 and batch_id is null").count() == 0


def test_stages_on_awkward_tables(spark, awkward, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table go through all stages."""
    sf_dir = str(tmp_path / "sf")
    spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "one item of nine tokens that is in no text")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    for k, docs in enumerate((awkward, awkward.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            assert name == "packing" or docs.columns == awkward.columns
        if k:
            assert docs.count() == 0
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} >= {1, 2, 8, None}


def test_simhash_stage_by_plain_shingles(spark):
    """Every copy of similarity 0.8 or more goes, also where many meet, and no pair below links."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(12):
        base = rng.choices(words, k=200)
        texts.append(base)
        for edits in (1, 2, 3, 4, 5, 8):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = f"x{rng.randrange(10**9)}"
            texts.append(copy)
    texts += [rng.choices(words, k=n) for n in (1, 3, 5, 6, 40)] + [[], [], ["a", "b"], ["A", "b"]]
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else set() for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = sorted((first[i], first[j]), reverse=True)
                first = [new if x == old else x for x in first]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {i for i, x in enumerate(first) if i == x} | {None}
    assert sum(i != x for i, x in enumerate(first)) > 40


def test_pairs_apart_in_tiles_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 5)
    draw = np.random.default_rng(7)
    nodes = draw.choice(10**12, 40, replace=False).tolist()
    keys = draw.integers(0, 2, (40, 6))
    keys = (keys * 1000 + np.arange(6)).tolist()
    marks = draw.integers(0, 2, (40, 26)).tolist()
    size, component = draw.integers(80, 120, 40).tolist(), draw.integers(0, 4, 40).tolist()
    buckets = {}
    for n in range(40):
        for key in keys[n]:
            buckets.setdefault(key, []).append(n)
    rows = [(part, len(b), nodes[n], component[n], size[n], marks[n], keys[n]) for part, b in buckets.items() for n in b]
    table = spark.createDataFrame(rows, "part long, n long, node long, component long, size int, marks array<long>, keys array<long>")
    monkeypatch.setattr(simhash, "MOST_APART", 12)
    plain = set()
    for x in range(40):
        for y in range(x):
            near = sum(a != b for a, b in zip(marks[x], marks[y], strict=True)) <= 12
            meet = any(a == b for a, b in zip(keys[x], keys[y], strict=True))
            if near and meet and component[x] != component[y] and min(size[x], size[y]) >= 0.8 * max(size[x], size[y]):
                plain.add((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
    found = [tuple(r) for r in simhash._apart(table, 0.8).collect()]
    assert len(found) == len(set(found)) and set(found) == plain and plain


def plain_set_fingerprint(values):
    """Bit by bit, as a whole number of each word."""
    words = []
    for odd, add in zip(simhash._WORD_ODD.tolist(), simhash._WORD_ADD.tolist(), strict=True):
        counts = [0] * 64
        for v in values:
            x = (v * odd + add) % 2**64
            x = (x ^ (x >> 29)) * 0x9E3779B97F4A7C15 % 2**64
            x ^= x >> 32
            counts = [n + (x >> bit & 1) for bit, n in enumerate(counts)]
        words.append(sum((2 * n > len(values)) << bit for bit, n in enumerate(counts)))
    return words


def hamming(a, b):
    return int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum())


def test_simhash_of_sets_selects_similar_pairs():
    """The stage's fingerprint is a SimHash, and its radius holds sets of similarity 0.8 and few of 0.5."""
    draw = np.random.default_rng(3)
    values = np.unique(draw.integers(0, 2**63, 601, np.uint64) * np.uint64(2) + np.uint64(1))
    assert simhash.set_fingerprint(values).view(np.uint64).tolist() == plain_set_fingerprint(values.tolist())
    for common_, a, b in [(12, 0, 3), (12, 1, 2), (20, 2, 3), (28, 3, 4), (80, 0, 20), (80, 10, 10), (400, 50, 50)]:
        for _ in range(20):
            values = draw.integers(0, 2**63, common_ + a + b, np.uint64) * np.uint64(2)
            x, y = simhash.set_fingerprint(values[: common_ + a]), simhash.set_fingerprint(np.concatenate([values[:common_], values[common_ + a :]]))
            assert hamming(x, y) <= simhash.MOST_APART
    far = [draw.integers(0, 2**63, 150, np.uint64) for _ in range(20)]
    assert all(hamming(simhash.set_fingerprint(x[:100]), simhash.set_fingerprint(x[50:])) > simhash.MOST_APART for x in far)


def test_pivots_discard_only_pairs_beyond_the_radius():
    draw = np.random.default_rng(4)
    base = [draw.integers(0, 2**63, 100, np.uint64) for _ in range(5)]
    sets = [np.concatenate([draw.permutation(b)[: 100 - k], draw.integers(0, 2**63, k, np.uint64)]) for b in base for k in (0, 2, 5, 8, 10)]
    marks = np.stack([simhash.set_fingerprint(s) for s in sets]).view(np.uint64)
    table = simhash._pivot_distances(marks)
    assert table.shape == (simhash.PIVOTS, len(sets))
    discarded = 0
    for x in range(len(sets)):
        for y in range(x):
            if (abs(table[:, x] - table[:, y]) > simhash.MOST_APART).any():
                discarded += 1
                assert hamming(marks[x], marks[y]) > simhash.MOST_APART
    assert discarded


def test_links_in_tiles_not_candidates(spark, monkeypatch):
    """A large group of texts just below 0.8 gives no rows but its links, at most one fewer than members, and the components of plain loops."""
    monkeypatch.setattr(simhash, "TILE", 30)
    rng = random.Random(8)
    base, rows, sets = list(range(1, 101)), [], {}
    for node in range(60):
        gone, new = rng.sample(base, 12), [1000 * (node + 1) + k for k in range(12)]
        sets[node] = set(base) - set(gone) | set(new)  # about 0.63 to each other
    for node in range(60, 80):  # near copies of the first, and of each other
        sets[node] = sets[0] - {max(sets[0])} | {10**6 + node}
    for node, x in sets.items():
        values = np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        values.sort()
        rows.append((7, 80, node, node, len(x), simhash.set_fingerprint(values).tolist(), [7], values.view(np.int64).tolist()))
    schema = "part long, n long, node long, component long, size int, marks array<long>, keys array<long>, `values` array<long>"
    monkeypatch.setattr(simhash, "MOST_APART", 64 * simhash.FINGERPRINT_WORDS)
    found = [tuple(r) for r in simhash._apart(spark.createDataFrame(rows, schema), 0.8).collect()]
    assert len(found) == len(set(found)) < 4 * 80
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found)
    first = {node: node for node in sets}
    for a, b in found:
        old, new = max(first[a], first[b]), min(first[a], first[b])
        first = {k: new if x == old else x for k, x in first.items()}
    assert first == {node: 0 if node >= 60 else node for node in sets}
