"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors of a label are one class, met by a grouped minimum. The classes of a label are dealt to clusters around
centres whose number grows with the label; a class lives in the cluster of its nearest centre and visits the others that a linked vector may
live in, so clusters overlap: few of them where vectors are spread out, all of a group of near copies.
Over the members of a cluster overlapping shards each get a graph whose candidate lists are robust-pruned (a neighbour that another
neighbour is closer to is left out); the shards' adjacency lists are united to one flat graph. Every member and every visitor
is searched for from the shards' medoids by greedy beam search, whose range is then expanded over all neighbours of what is near enough, and pairs
are verified by cosine in double precision. The links of every vector whose id is divisible by 100 are held against brute force over all rows; while too few
of them are found, the search is done again with clusters that overlap more, up to all in reach by the triangle inequality, and a wider beam.

Members of large clusters are dealt to tiles, each with a graph of its own, and visitors of a tile in parts, so a task holds one
tile and streams what is searched for. A pair is searched for in one task only: where both vectors visit each other's
cluster, in that of the lower number; between tiles of a cluster, in the higher tile. So a link counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

#: Classes of a label for each centre, members of a tile, and visitors of a tile that one task takes.
CLUSTER, TILE, VISITORS = 1024, 1024, 8192
#: All centres go to every executor: they are thinned out so that they take this many bytes at most.
CENTRE_BYTES = 32 << 20
#: A vector visits the clusters whose border with its own is nearer than the difference of two linked vectors reaches across it, in standard
#: deviations of a difference of random direction; as both may visit, a pair is kept apart only beyond twice as many.
REACH = 2.0
SHARD, DEGREE, CANDIDATES, ALPHA, BEAM = 256, 24, 48, 1.2, 32
#: The search goes on around vectors of at least the threshold less this.
SLACK = 0.03
#: Queries of the audit that meet all rows in one pass.
AUDIT_BLOCK = 16_384


def robust_prune(similar: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (-1: none) of each point of a shard, from its similarities: nearest first, without those that a chosen one is closer to."""
    m = len(similar)
    k = min(candidates, m - 1)
    if k < 1:
        return np.full((m, 1), -1, np.int64)
    masked = similar.copy()
    np.fill_diagonal(masked, -np.inf)
    near = np.argpartition(-masked, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(masked, near, 1), axis=1, kind="stable"), 1)
    distance = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(similar, near, 1), 0))
    alive = np.ones((m, k), bool)
    chosen = np.full((m, degree), -1, np.int64)
    count = np.zeros(m, np.int64)
    rows = np.arange(m)
    for i in range(k):
        take = alive[:, i] & (count < degree)
        who = rows[take]
        if not len(who):
            continue
        chosen[who, count[who]] = near[who, i]
        count[who] += 1
        between = np.sqrt(np.maximum(2 - 2 * similar[near[who, i][:, None], near[who]], 0))
        alive[who] &= alpha * between > distance[who]
    return chosen


def flat_graph(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency lists padded with -1, medoids): shards of overlapping clusters, their graphs united, edges in both directions."""
    m = len(unit)
    shards = max(1, -(-m // SHARD))
    seeds = unit[np.linspace(0, m - 1, shards).astype(np.int64)]
    for _ in range(2):  # two rounds of spherical k-means
        owner = (unit @ seeds.T).argmax(axis=1)
        for s in range(shards):
            if (owner == s).any():
                mean = unit[owner == s].mean(axis=0)
                seeds[s] = mean / max(np.linalg.norm(mean), 1e-12)
    nearest = np.argsort(-(unit @ seeds.T), axis=1)[:, : min(2, shards)]
    sources, targets, medoids = [], [], []
    for s in range(shards):
        members = np.flatnonzero((nearest == s).any(axis=1))
        if not len(members):
            continue
        inside = unit[members]
        medoids.append(int(members[(inside @ inside.mean(axis=0)).argmax()]))
        chosen = robust_prune(inside @ inside.T)
        at, slot = np.nonzero(chosen >= 0)
        sources.append(members[at])
        targets.append(members[chosen[at, slot]])
    source, target = np.concatenate(sources), np.concatenate(targets)
    edges = np.unique(np.concatenate([source * m + target, target * m + source]))
    source, target = edges // m, edges % m
    degree = np.bincount(source, minlength=m)
    lists = np.full((m, max(int(degree.max(initial=0)), 1)), -1, np.int64)
    lists[source, np.arange(len(source)) - np.repeat(np.cumsum(degree) - degree, degree)] = target
    return lists, np.array(medoids)


#: Pairs whose neighbour lists or vectors are in memory at once.
_PAIRS = 1 << 12


def _similarity(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 4 * _PAIRS):
        part = slice(at, at + 4 * _PAIRS)
        out[part] = np.einsum("ij,ij->i", unit[a[part]], unit[b[part]])
    return out


def range_search(unit: np.ndarray, lists: np.ndarray, medoids: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs of similarity ``least`` or more: greedy beam search, then expansion of the range."""
    n, m = len(queries), len(unit)
    seen = np.zeros((n, m), bool)
    beam = min(beam, m)
    starts = np.broadcast_to(medoids[:beam], (n, len(medoids[:beam])))
    size = beam
    nodes = np.full((n, size), -1, np.int64)
    score = np.full((n, size), -np.inf)
    done = np.zeros((n, size), bool)
    nodes[:, : starts.shape[1]] = starts
    score[:, : starts.shape[1]] = unit[queries] @ unit[medoids[:beam]].T
    rows = np.arange(n)
    seen[rows[:, None], starts] = True
    found_q, found_p = [], []

    def keep(q: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        near = s >= least
        found_q.append(q[near])
        found_p.append(p[near])

    keep(np.repeat(rows, starts.shape[1]), starts.ravel(), score[:, : starts.shape[1]].ravel())
    for _ in range(4 * beam):
        open_ = np.where(done | (nodes < 0), -np.inf, score)
        best = open_.argmax(axis=1)
        active = rows[open_[rows, best] > -np.inf]
        if not len(active):
            break
        done[active, best[active]] = True
        around = lists[nodes[active, best[active]]]
        fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        q, slot = np.nonzero(fresh)
        p = around[q, slot]
        q = active[q]
        seen[q, p] = True
        s = _similarity(unit, queries[q], p)
        keep(q, p, s)
        wide = np.full((n, around.shape[1]), -np.inf)
        wide_nodes = np.full((n, around.shape[1]), -1, np.int64)
        wide[q, slot], wide_nodes[q, slot] = s, p
        all_score = np.hstack([score[active], wide[active]])
        all_nodes = np.hstack([nodes[active], wide_nodes[active]])
        all_done = np.hstack([done[active], np.zeros_like(wide[active], bool)])
        top = np.argpartition(-all_score, size - 1, axis=1)[:, :size]
        score[active] = np.take_along_axis(all_score, top, 1)
        nodes[active] = np.take_along_axis(all_nodes, top, 1)
        done[active] = np.take_along_axis(all_done, top, 1)
    # Everything near enough is expanded until nothing new is near.
    q, p = np.concatenate(found_q), np.concatenate(found_p)
    out_q, out_p = [q], [p]
    waiting = [(q, p)]
    while waiting:
        q, p = waiting.pop()
        if len(q) > _PAIRS:
            waiting.append((q[_PAIRS:], p[_PAIRS:]))
            q, p = q[:_PAIRS], p[:_PAIRS]
        around = lists[p]
        fresh = (around >= 0) & ~seen[q[:, None], np.maximum(around, 0)]
        at, slot = np.nonzero(fresh)
        pairs = np.unique(q[at] * m + around[at, slot])
        q, p = pairs // m, pairs % m
        seen[q, p] = True
        near = _similarity(unit, queries[q], p) >= least
        q, p = q[near], p[near]
        if len(q):
            out_q.append(q)
            out_p.append(p)
            waiting.append((q, p))
    return np.concatenate(out_q), np.concatenate(out_p)


def links_within(values: np.ndarray, threshold: float, beam: int = BEAM, graph: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: pairs found and verified among the rows of ``values`` (double, distinct, of finite length above zero)."""
    length = np.linalg.norm(values, axis=1)
    unit = values / length[:, None]
    m = len(unit)
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists, medoids = graph or flat_graph(unit)
    pairs = []
    for at in range(0, m, 256):
        queries = np.arange(at, min(at + 256, m))
        q, p = range_search(unit, lists, medoids, queries, threshold - SLACK, beam)
        q = queries[q]
        pairs.append(np.minimum(q, p) * m + np.maximum(q, p))
    pair = np.unique(np.concatenate(pairs))
    i, j = pair // m, pair % m
    cosine = _similarity(values, i, j) / (length[i] * length[j])
    good = (i != j) & (cosine >= threshold)
    return i[good], j[good]


def links_to(points: np.ndarray, lists: np.ndarray, medoids: np.ndarray, others: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs found and verified of a row of ``others`` and a point of the graph (rows as in ``links_within``)."""
    both = np.concatenate([points, others])
    length = np.linalg.norm(both, axis=1)
    unit = both / length[:, None]
    m = len(points)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(m, len(both), 256):
        queries = np.arange(at, min(at + 256, len(both)))
        q, p = range_search(unit, lists, medoids, queries, threshold - SLACK, beam)
        pair = np.unique((queries[q] - m) * m + p)
        i, j = pair // m, pair % m
        good = np.einsum("ij,ij->i", both[i + m], both[j]) / (length[i + m] * length[j]) >= threshold
        out_i.append(i[good])
        out_j.append(j[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def cells_in_reach(vectors: np.ndarray, centres: np.ndarray, threshold: float, share: float = 1.0) -> tuple[np.ndarray, list[list[int]]]:
    """Each vector's home (its nearest unit centre), and the cells, home included, where vectors of cosine ``threshold`` to it can live.

    A vector of cell c is no nearer to another centre than to c, so one within reach of it lies at most the reach beyond the
    plane halfway between the two centres; ``share`` is the part of that distance that counts. With 1 no pair is kept apart.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    reach = share * np.sqrt(max(2 - 2 * threshold, 0.0))
    near = unit @ centres.T
    home = near.argmax(axis=1)
    cells: list[list[int]] = [[]] * len(unit)
    for h in np.unique(home).tolist():
        apart = np.linalg.norm(centres - centres[h], axis=1)
        at = np.flatnonzero(home == h)
        allowed = near[at, h][:, None] - near[at] <= reach * apart + 1e-9
        allowed[:, h] = True
        for row, some in zip(at.tolist(), allowed, strict=True):
            cells[row] = np.flatnonzero(some).tolist()
    return home, cells


def _lowest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lowest id of each row's component."""
    low = ids.copy()
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        if (low == before).all():
            break
    return low


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each label and distinct usable vector: (label, dim, h1, h2, rep, copies, embedding)."""
    return rows.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))


def _marked(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, embedding, good): good rows may link."""
    doubles = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # one kind of zero
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), doubles.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def _usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    good = _marked(embeddings, id_col, vector_col, label_col).filter("good").drop("good")
    return good.select("*", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _stretches(*columns: pa.Array) -> Iterator[tuple[tuple, slice]]:
    """Runs of rows with equal values in the columns."""
    values = list(zip(*(c.to_pylist() for c in columns), strict=True))
    start = 0
    for at in range(1, len(values) + 1):
        if at == len(values) or values[at] != values[start]:
            yield values[start], slice(start, at)
            start = at


class Cell:
    """One tile of a cluster: its members' graph, and the links found so far."""

    def __init__(self, threshold: float, beam: int):
        self.threshold, self.beam = threshold, beam
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, rep: np.ndarray, copies: np.ndarray, visits: list[list[int]], values: np.ndarray) -> None:
        self.parts.append((rep, copies, visits, values))

    def close(self, cluster: int, first: bool) -> None:
        """All members are in; ``first``: this task also finds the links among them."""
        self.ready = True
        if not self.parts:
            return
        self.cluster = cluster
        self.rep, self.copies, self.values = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1, 3))
        self.visits = [set(v) for p in self.parts for v in p[2]]
        self.parts.clear()
        self.number = np.zeros(len(self.rep), np.int64)
        # Pairs of members that visitors join, or that link.
        self.joined = np.arange(len(self.rep)), np.arange(len(self.rep))
        self.lists, self.medoids = flat_graph(self.values / np.linalg.norm(self.values, axis=1)[:, None])
        if first:
            i, j = links_within(self.values, self.threshold, self.beam, (self.lists, self.medoids))
            np.add.at(self.number, i, self.copies[j])
            np.add.at(self.number, j, self.copies[i])
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.concatenate([self.joined[0], i]), np.concatenate([self.joined[1], j])
        low = _lowest(np.arange(len(self.rep)), i, j)
        self.joined = low, np.arange(len(self.rep))

    def visit(self, rep: np.ndarray, copies: np.ndarray, homes: list[int], values: np.ndarray) -> tuple[list, list, list]:
        """(rep, links, a linked rep) of the visitors that link."""
        if not hasattr(self, "rep"):
            return [], [], []
        i, j = links_to(self.values, self.lists, self.medoids, values, self.threshold, self.beam)
        # Where the member visits the visitor's home as well, the pair is searched for there if its number is lower.
        own = np.array([homes[a] >= self.cluster or homes[a] not in self.visits[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[own], j[own]
        if not len(i):
            return [], [], []
        number = np.zeros(len(rep), np.int64)
        np.add.at(number, i, self.copies[j])
        np.add.at(self.number, j, copies[i])
        first = np.full(len(rep), len(self.rep))
        np.minimum.at(first, i, j)
        self._join(first[i], j)
        some = np.flatnonzero(number)
        return rep[some].tolist(), number[some].tolist(), self.rep[first[some]].tolist()

    def members(self) -> tuple[list, list, list]:
        if not hasattr(self, "rep"):
            return [], [], []
        low = self.rep.copy()
        group = self.joined[0]
        best = np.full(len(low), np.iinfo(np.int64).max)
        np.minimum.at(best, group, low)
        low = best[group]
        some = np.flatnonzero((self.number > 0) | (low != self.rep))
        return self.rep[some].tolist(), self.number[some].tolist(), low[some].tolist()


def _centres(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit centres by label and dimension: of each CLUSTER classes the one whose hash falls so, thinned out to CENTRE_BYTES in all.

    A label with one centre or none is one cluster and has no entry.
    """
    of = F.xxhash64("h1", "h2", F.lit("centre"))
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    takes = sum(8 * r["dim"] * r["n"] for r in sizes)
    every = max(CLUSTER, -(-takes // CENTRE_BYTES))
    chosen = classes.filter(F.pmod(of, F.lit(every)) == 0).select("label", "dim", "embedding").toLocalIterator()  # CENTRE_BYTES, about
    found: dict[tuple[str, int], list] = {}
    for r in chosen:
        found.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    centres = {}
    for key, rows in found.items():
        if len(rows) > 1:
            values = np.array(sorted(rows))
            centres[key] = values / np.linalg.norm(values, axis=1)[:, None]
    return centres


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, beam: int = BEAM, reach: float = REACH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only vectors of equal, non-null labels and equal dimension link. Vectors that are null, zero, or hold null or non-finite components, and rows
    with a null id, link with nothing. Equal vectors always link. Rows that repeat an id count as vectors of their own. Ids are integers. An empty table gives no rows; further columns are ignored.
    """
    spark = embeddings.sparkSession
    usable = _usable(embeddings, id_col, vector_col, label_col)
    classes = common.materialize(_classes(usable))
    shared = spark.sparkContext.broadcast(_centres(classes))  # CENTRE_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, cells = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            rows: dict[tuple[str, int], list[int]] = {}
            for at, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows.setdefault(key, []).append(at)
            for key, at in rows.items():
                if (points := shared.value.get(key)) is not None:
                    values = vectors_of(batch.column(2).take(pa.array(at)), key[1])
                    for start in range(0, len(at), 256):
                        some = at[start : start + 256]
                        home[some], found = cells_in_reach(values[start : start + 256], points, threshold, min(reach / np.sqrt(key[1]), 1.0))
                        for n, here in zip(some, found, strict=True):
                            cells[n] = here
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], names=["label", "dim", "embedding", "rep", "copies", "h1", "home", "cells"])

    dealt = classes.select("label", "dim", "embedding", F.col("rep").cast("long").alias("rep"), "copies", "h1").mapInArrow(deal, "label string, dim int, embedding array<double>, rep long, copies long, h1 long, home int, cells array<int>")
    dealt = common.materialize(dealt)
    places = ["label", "dim", "cluster"]
    counted = dealt.select("label", "dim", "home", F.explode("cells").alias("cluster")).groupBy(*places).agg(F.count_if(F.col("home") == F.col("cluster")).alias("members"), F.count("*").alias("all"))
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.lit(1)).cast("int")
    # Visitors of a tile: those of other clusters, and members of lower tiles.
    counted = common.materialize(counted.select(*places, tiles.alias("tiles"), F.ceil(F.col("all") / VISITORS).cast("int").alias("parts")))
    visits = dealt.withColumn("cluster", F.explode("cells")).join(counted.hint("merge"), places)
    at_home = F.col("home") == F.col("cluster")
    visits = visits.withColumn("own", F.pmod("h1", "tiles").cast("int")).withColumn("part", F.pmod(F.xxhash64("h1", F.lit(1)), "parts").cast("int"))
    visits = visits.withColumn("tile", F.explode(F.when(at_home, F.sequence("own", F.col("tiles") - 1)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    member = at_home & (F.col("tile") == F.col("own"))
    # A tile's members go to each of its parts.
    visits = visits.withColumn("member", member).withColumn("part", F.explode(F.when(member, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    keys = ("label", "dim", "cluster", "tile", "part")
    tiled = visits.select(*keys, F.when(F.col("member"), 0).otherwise(1).alias("role"), "rep", "copies", "home", "cells", "embedding")
    tiled = tiled.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), *keys).sortWithinPartitions(*keys, "role")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None

        def rows(found: tuple[list, list, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["rep", "links", "low"])

        for batch in batches:
            for (*now, role), part in _stretches(*batch.columns[:6]):
                if now != key:
                    if cell is not None:
                        if not cell.ready:
                            cell.close(key[2], key[4] == 0)
                        yield rows(cell.members())
                    key, cell = now, Cell(threshold, beam)
                if role and not cell.ready:
                    cell.close(key[2], key[4] == 0)
                size = part.stop - part.start
                rep, copies, home, cells, embedding = (c.slice(part.start, size) for c in batch.columns[6:])
                rep, copies, values = rep.to_numpy(), copies.to_numpy(), vectors_of(embedding, key[1])
                if role:
                    yield rows(cell.visit(rep, copies, home.to_pylist(), values))
                else:
                    cell.add(rep, copies, cells.to_pylist(), values)
        if cell is not None:
            if not cell.ready:
                cell.close(key[2], key[4] == 0)
            yield rows(cell.members())

    kind = embeddings.schema[id_col].dataType.simpleString()
    found = common.materialize(tiled.mapInArrow(link, "rep long, links long, low long"))
    components = common.connected_components(found.filter("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    mapping = classes.select("label", "dim", "h1", "h2", F.col("rep").cast("long").alias("rep"), "copies").join(links.hint("merge"), "rep", "left")
    mapping = mapping.join(components.hint("merge"), F.col("rep") == F.col("node"), "left")
    mapping = common.materialize(mapping.select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").cast(kind).alias("component")))

    rows = usable.select("vec_id", "label", "dim", "h1", "h2").join(mapping.hint("merge"), ["label", "dim", "h1", "h2"]).select("vec_id", "links", "component")
    unusable = _marked(embeddings, id_col, vector_col, label_col).filter("not good")
    both = rows.select("vec_id", "links", "component").unionByName(unusable.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return both.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def is_query(vec_id: Column) -> Column:
    """The vectors that the audit searches for: every id divisible by 100."""
    return F.pmod(vec_id, F.lit(100)) == 0


def audit(embeddings: DataFrame, found: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Recall of the links of all vectors whose id is divisible by 100, against brute force over all rows; 1 if they have no links.

    Every link counted in ``found`` is verified and counts once, so a query's links are the true ones exactly if they are as many.
    Queries meet all rows in blocks of AUDIT_BLOCK, each a pass over the table.
    """
    usable = _usable(embeddings, id_col, vector_col, label_col)
    queries = common.materialize(usable.filter(is_query(F.col("vec_id"))).select("vec_id", "label", "dim", "embedding"))
    blocks = -(-queries.count() // AUDIT_BLOCK)
    true = 0
    for block in range(blocks):
        by_label: dict[tuple[str, int], list] = {}
        for q in queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toLocalIterator():
            by_label.setdefault((q["label"], q["dim"]), []).append(q["embedding"])
        ready = embeddings.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in by_label.items()})

        def compare(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            n = 0
            lengths = {k: np.linalg.norm(v, axis=1) for k, v in ready.value.items()}
            for batch in batches:
                rows: dict[tuple[str, int], list[int]] = {}
                for at, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    rows.setdefault(key, []).append(at)
                for key, at in rows.items():
                    if (points := ready.value.get(key)) is not None:
                        values = vectors_of(batch.column(2).take(pa.array(at)), key[1])
                        for start in range(0, len(values), 256):
                            some = values[start : start + 256]
                            cosine = (points @ some.T) / (lengths[key][:, None] * np.linalg.norm(some, axis=1))
                            n += int((cosine >= threshold).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        true += usable.select("label", "dim", "embedding").mapInArrow(compare, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        ready.unpersist()
    true -= queries.count()  # each met itself
    got = found.join(queries.select(F.col("vec_id").alias("query")).distinct().hint("merge"), F.col("vec_id") == F.col("query"), "left_semi").agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    return min(got / true, 1.0) if true > 0 else 1.0


def audited_near_duplicates(embeddings: DataFrame, threshold: float = 0.98, least_recall: float = 0.9, most_rounds: int = 4, **columns: str) -> DataFrame:
    """``near_duplicates`` with the recall of the audit as a column.

    While it is below ``least_recall``, the search is done again with twice the reach and twice the beam; if it is still so after ``most_rounds``, that is an error.
    """
    beam, reach = BEAM, REACH
    for _ in range(most_rounds):
        found = common.materialize(near_duplicates(embeddings, threshold, beam, reach, **columns))
        recall = audit(embeddings, found, threshold, **columns)
        if recall >= least_recall:
            return found.withColumn("recall", F.lit(recall))
        beam, reach = 2 * beam, 2 * reach
    raise RuntimeError(f"recall of links stays at {recall:.3f}, below {least_recall}")
