import random
from itertools import combinations

import numpy as np
import pytest

from moraine.llm import common, url_rules, vectors


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(spark):
    urls = [
        "https://www.Example.com/en/1", "http://example.com/en/x?q=/de/", "http://a.b.example.com/en/", "http://example.com", "http://notexample.com/en/1", "ftp://x.net/fr/#top", "net/fr/", None, "", "://", "a://b://c/d", "http://EXAMPLE.com/EN/", "http://example.com?x=/en/", "http://com/",
        "http://ünï.net/es/é", "http://.com/", "http://example.com./en/",
    ]
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "org", "x.www.example.com"]
    urls += [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'en/a', ''])}/{rng.randrange(9)}" for _ in range(300)] + ["http://hot.example.com/en/1"] * 200
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, key string, range string")
    more = [*url_rules.RULES, ("block", "www.example.com", "/"), ("allow", "x.www.example.com", "/en/a"), ("block", "example.com", "/")]
    for rules in (url_rules.RULES, more, []):
        got = url_rules.judge_urls(pages, rules, least_ranges=7).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], rules), urls[r["page_id"]]
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)] + [(900, 900), (1000, 1001), (1000, 1001)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if x in {n for e in edges if e[0] != e[1] for n in e}}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def sample_vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in range(3):
        centre = rng.normal(size=64)
        for i in range(500):
            v = rng.normal(size=64)
            if i % 4 == 0 and rows:
                v = np.array(rows[-1][1]) + rng.normal(size=64) * 0.12
            if label == 2 and i % 5 == 0:
                v = centre + rng.normal(size=64) * 0.12
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    rows += [(len(rows) + k, rows[7][1], rows[7][2]) for k in range(5)]
    return rows


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 200)
    monkeypatch.setattr(vectors, "CLUSTER", 150)
    rows = sample_vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    true = {(a, b) for a, b in zip(*np.nonzero(np.triu((x @ x.T >= 0.98) & (label[:, None] == label), 1)), strict=True)}
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, near string, rep string")
    found = vectors.audited_near_duplicates(frame)
    got = {r["vec_id"]: r for r in found.collect()}
    wanted = {i: sum(i in p for p in true) for i in range(len(rows))}
    assert all(got[i]["n_links"] <= wanted[i] for i in wanted)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * 2 * len(true)
    assert vectors.audit(frame, found) >= 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_links_and_graph():
    rows = sample_vectors()[:400]
    values = np.array([r[1] for r in rows])
    unit = values / np.linalg.norm(values, axis=1)[:, None]
    i, j = vectors.links_within(values, 0.98)
    true = {(a, b) for a, b in combinations(range(400), 2) if unit[a] @ unit[b] >= 0.98}
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= true and len(got) >= 0.95 * len(true)
    lists, medoids = vectors.flat_graph(unit)
    assert len(medoids) == 2 and all((lists[lists[p][lists[p] >= 0]] == p).any(axis=1).all() for p in range(0, 400, 37))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (11, [], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(frame).collect())
    want = [("1", 2, 1, True), ("10", 0, 10, True), ("11", 0, 11, True), ("12", 1, 12, True), ("13", 1, 12, False), ("2", 2, 1, False), ("2", 2, 1, False), ("3", 0, 3, True), ("4", 0, 4, True), ("5", 0, 5, True), ("6", 0, 6, True), ("7", 0, 7, True), ("8", 0, 8, True), ("9", 0, 9, True), ("None", 0, None, False)]
    assert got == want
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_a_dense_group_meet_across_clusters(spark, monkeypatch):
    """Nearly all pairs link, and the centres lie inside the group: every vector's nearest centres are almost random."""
    monkeypatch.setattr(vectors, "TILE", 60)
    monkeypatch.setattr(vectors, "CLUSTER", 30)
    rng = np.random.default_rng(4)
    x = rng.normal(size=64) + rng.normal(size=(900, 64)) * 0.13
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = unit @ unit.T >= 0.98
    wanted = true.sum(axis=1) - 1
    assert wanted.mean() > 300
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= wanted).all() and links.sum() >= 0.98 * wanted.sum()
    assert all(r["n_links"] > 0 for r in got.values() if not r["kept"])


def test_cells_in_reach_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    home, cells = vectors.cells_in_reach(x, unit[::20], 0.98)
    for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True):
        assert home[j] in cells[i] and home[i] in cells[j]
    assert sum(map(len, cells)) < len(x) * 40


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vectors, "audit", lambda *a, **b: 0.5)
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="0.500"):
        vectors.audited_near_duplicates(frame)


def test_links_found_count_for_both_ends(spark, monkeypatch):
    """Whatever the search finds between or within tiles is in n_links: with a search that finds all, none is lost."""
    monkeypatch.setattr(vectors, "TILE", 100)
    monkeypatch.setattr(vectors, "CLUSTER", 400)
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + rng.normal(size=(350, 64)) * 0.1
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    wanted = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame, beam=400).collect()}
    assert [got[i] for i in range(350)] == wanted.tolist()
