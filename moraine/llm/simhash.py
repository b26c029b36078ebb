"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

Documents with equal fingerprints are one class, met by a grouped minimum before anything is
joined. For each distinct fingerprint a table of Hamming distances to fixed reference fingerprints (pivots) is
computed once. By the triangle inequality a pair whose distances to any pivot differ by more than
the threshold can't link; the pairs that no pivot discards are verified on the fingerprints.

In 64-bit Hamming space pivot distances lie within a few units of 32, so that they alone leave a
constant share of all pairs; therefore only pairs that share bit blocks meet at all, which loses
nothing: of ``m`` blocks at least ``m - threshold`` are equal in a linked pair. ``m`` follows from the
number of fingerprints, so that chance meetings stay in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

SEED = 42
PIVOTS = 8
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), _CHUNK):
        values = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        octets = np.array(values, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256) @ _BITS
    bits = (counts.ravel() * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every document's whole text; null and empty texts have fingerprint zero."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int, equal: int) -> list[int]:
    """Signed 64-bit masks, each of ``equal`` of ``blocks`` nearly even bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(single, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(count: int, threshold: int) -> int:
    """Blocks for which keys and chance meetings together are fewest."""

    def cost(blocks: int) -> float:
        masks = len(list(combinations(range(blocks), blocks - threshold)))
        return masks * (20.0 * count + count * count / 2.0 ** (1 + 64 * (blocks - threshold) / blocks))

    return min(range(threshold + 1, threshold + 5), key=cost)


def pivot_table(fp: Column) -> Column:
    """Hamming distances to the pivots, seven bits each, in one long."""
    distances = [F.bit_count(fp.bitwiseXOR(F.xxhash64(F.lit(f"pivot {i}")))).cast("long") for i in range(PIVOTS)]
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(d, 7 * i) for i, d in enumerate(distances)))


def _pivots_allow(a: Column, b: Column, threshold: int) -> Column:
    def at(table: Column, i: int) -> Column:
        return F.shiftright(table, 7 * i).bitwiseAND(F.lit(127))

    return reduce(lambda x, y: x & y, (F.abs(at(a, i) - at(b, i)) <= threshold for i in range(PIVOTS)))


def linked_fingerprints(classes: DataFrame, threshold: int = 4) -> DataFrame:
    """Pairs (src, dst) of class representatives whose fingerprints differ by at most ``threshold`` bits, each once.

    ``classes``: (fp, rep), one row per fingerprint.
    """
    blocks = choose_blocks(classes.count(), threshold)
    masks = block_masks(blocks, blocks - threshold)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    keyed = classes.withColumn("pivots", pivot_table(F.col("fp"))).withColumn("key", F.explode(keys))
    keyed = keyed.select("fp", "rep", "pivots", F.col("key.mask").alias("mask"), F.col("key.part").alias("part"))
    a, b = keyed.alias("a"), keyed.alias("b")
    differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    link = (
        (F.col("a.mask") == F.col("b.mask"))
        & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.fp") < F.col("b.fp"))
        & _pivots_allow(F.col("a.pivots"), F.col("b.pivots"), threshold)
        & (F.bit_count(differing) <= threshold)
        & (first == F.col("a.mask"))
    )
    return a.hint("merge").join(b, link).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))


def near_duplicates(documents: DataFrame, threshold: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the smallest id reachable over links, the document's own included. All empty and null texts share fingerprint
    zero and link like any other. Repeated rows each give a row. Rows with a null id get the component
    of their fingerprint. An empty table gives no rows; further columns are ignored.
    """
    prints = common.materialize(fingerprints(documents, words, id_col, text_col))
    classes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    components = common.connected_components(linked_fingerprints(classes.filter("rep is not null"), threshold))
    mapping = classes.join(components.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    mapping = common.materialize(mapping)  # so that the next join may split a fingerprint that many documents share
    return prints.join(mapping.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Min-hash bands and rows of a band: a pair of similarity 0.8 shares no band with a chance of 4e-8.
BANDS, BAND_ROWS = 56, 6
#: Members of a bucket that all others of it are compared with before the pairs that are still apart are.
HEADS = 3
#: Members of a bucket, about, of which all pairs that are still apart are compared in one task; larger buckets are dealt in tiles.
TILE = 2048
#: Shingle values, about, of a tile's members together.
TILE_VALUES = 1 << 20
#: 64-bit words of the SimHash fingerprint of a set of shingles.
FINGERPRINT_WORDS = 32
#: Radius of the fingerprints: of two sets of similarity 0.8 a bit differs with a chance of 0.161 at most, if the larger has SMALL shingles or more, and more
#: bits than so many with one of about 1e-7. Smaller sets are compared whatever their fingerprints.
MOST_APART = 416
SMALL = 15
_ODD, _ADD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_ODD, _WORD_ADD = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (2, FINGERPRINT_WORDS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_values(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct XXH64 values of a text's shingles, in order; a text of fewer words is one shingle, an empty one has none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(words, len(tokens))
    if not size:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64))


def sketch(values: np.ndarray) -> np.ndarray:
    """One key for each band of the min-hash sketch of a set of shingle values."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(low, (values[at : at + 512, None] * _ODD + _ADD).min(axis=0), out=low)
    low = low.reshape(BANDS, BAND_ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)  # so that equal keys are of one band
    for i in range(BAND_ROWS):
        keys = (keys ^ low[:, i]) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def set_fingerprint(values: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle values, as longs: a bit is 1 if it is set in over half of the values, each spread over all words."""
    ones = np.zeros(64 * FINGERPRINT_WORDS, np.int64)
    for at in range(0, len(values), 255):  # so many ones an octet can count
        spread = values[at : at + 255, None] * _WORD_ODD + _WORD_ADD
        spread = (spread ^ (spread >> np.uint64(29))) * _MIX
        spread ^= spread >> np.uint64(32)
        ones += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(values)).view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the rows with an id; rows of equal id and text have equal keys."""
    return documents.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, node, bands): ``node`` is equal for equal sets of shingles."""
    from hashlib import blake2b

    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_values(t, words) for t in batch.column(2).to_pylist()]
            node = np.array([int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little") for x in sets], np.uint64)
            bands = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), bands], names=["doc_id", "key", "node", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, key long, node long, bands array<long>")


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, size, marks, keys, values) of rows (node, text); marks are the fingerprint, keys the bands'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_values(t, words) for t in batch.column(1).to_pylist()]
            marks, keys, values = (pa.array(x, pa.list_(pa.int64())) for x in ([set_fingerprint(x) for x in sets], [sketch(x) for x in sets], [x.view(np.int64) for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), marks, keys, values], names=["node", "size", "marks", "keys", "values"])

    return rows.select("node", "text").mapInArrow(run, "node long, size int, marks array<long>, keys array<long>, values array<long>")


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two sets' sizes allow the similarity, and their fingerprints are within the radius."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    distance = F.expr(f"aggregate(zip_with({a}.marks, {b}.marks, (x, y) -> bit_count(x ^ y)), 0, (n, d) -> n + d)")
    return (F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b)) & ((distance <= MOST_APART) | (F.greatest(size_a, size_b) < SMALL))


def _pivot_distances(marks: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (a row of words each) to PIVOTS of them at most, a row for each pivot."""
    pivots = marks[np.unique(np.linspace(0, len(marks) - 1, PIVOTS).astype(int))]
    return np.stack([np.bitwise_count(marks ^ pivot).sum(axis=1, dtype=np.int32) for pivot in pivots])


def _apart(members: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of the members of one bucket that are of different components and may be similar, each pair once.

    ``members``: (part, n, node, component, size, marks, keys), n being the bucket's members (or more, for smaller tiles). With the sets' ``values`` pairs are verified on them
    as well, in the group, and those left out that links of the same group already hold together; so a group of m members gives at most m - 1 links, however many of its pairs
    are near. A bucket is dealt in tiles, each pair of tiles to one group.
    A pair counts in the first bucket that both are in. In a group the fingerprints' distances to some of them, the pivots, are computed once; a pair whose distances to
    a pivot differ by more than the radius is discarded, as by the triangle inequality it can't be within it, and the rest are compared by their fingerprints.
    """
    exact = "values" in members.columns
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = members.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    dealt = dealt.withColumn("meet", F.explode(meet)).select("part", "meet.i", "meet.j", "tile", "node", "component", "size", "marks", "keys", *["values"] * exact)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        tile, node, component, size = (table.column(name).to_numpy() for name in ("tile", "node", "component", "size"))
        marks, keys = (table.column(name).combine_chunks().flatten().to_numpy().reshape(len(node), -1) for name in ("marks", "keys"))
        marks = np.ascontiguousarray(marks).view(np.uint64)
        distances = _pivot_distances(marks)
        part, i, j = (table.column(name)[0].as_py() for name in ("part", "i", "j"))
        second = len(node) if i == j else int(np.searchsorted(tile, j))
        if exact:
            values = table.column("values").combine_chunks()
            distinct, places = np.unique(values.flatten().to_numpy(), return_inverse=True)
            places = np.split(places, np.cumsum(size)[:-1])
            held = np.zeros(len(distinct), bool)
            component = component.copy()

        def verify(at: int, others: np.ndarray) -> Iterator[int]:
            held[places[at]] = True
            for other in others.tolist():
                if component[other] != component[at]:
                    both = int(np.count_nonzero(held[places[other]]))
                    if both / (int(size[at]) + int(size[other]) - both) >= similarity:
                        component[component == component[other]] = component[at]
                        yield other
            held[places[at]] = False

        src, dst = [], []
        for at in range(second):
            others = np.arange(at + 1 if i == j else second, len(node))
            others = others[component[others] != component[at]]
            others = others[np.minimum(size[others], size[at]) >= similarity * np.maximum(size[others], size[at])]
            small = np.maximum(size[others], size[at]) < SMALL
            others = others[small | (np.abs(distances[:, others] - distances[:, at, None]) <= MOST_APART).all(axis=0)]
            small = np.maximum(size[others], size[at]) < SMALL
            others = others[small | (np.bitwise_count(marks[others] ^ marks[at]).sum(axis=1, dtype=np.int32) <= MOST_APART)]
            others = others[keys[at][(keys[others] == keys[at]).argmax(axis=1)] == part]
            if exact:
                others = np.fromiter(verify(at, others), np.int64)
            src.append(np.maximum(node[others], node[at]))
            dst.append(np.minimum(node[others], node[at]))
        return pa.table({"src": np.concatenate([np.zeros(0, np.int64), *src]), "dst": np.concatenate([np.zeros(0, np.int64), *dst])})

    return dealt.groupBy("part", "i", "j").applyInArrow(run, "src long, dst long").distinct()


def similar_classes(documents: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(node, doc_id, key, component): a row for each set of shingles, with the smallest id that has it, that id's smallest text key, and its component.

    Components are over the pairs whose sets have a Jaccard similarity of ``similarity`` or more. Pairs meet by equal bands of a min-hash sketch; SimHash fingerprints of the
    sets and their distances to pivots discard those that are too far apart, and the exact sets verify the rest. In a bucket all are first compared with a few of them, then those
    that are not in one component yet are paired; so the components are those of all pairs that meet.
    """
    if similarity < 0.8:
        raise ValueError("bands and fingerprints are made for a similarity of 0.8 or more")
    rows = _keyed(documents)
    first = F.min(F.struct("doc_id", "key")).alias("first")
    classes = _sketches(rows, words).groupBy("node").agg(first, F.first("bands").alias("bands"))
    classes = common.materialize(classes.select("node", "first.doc_id", "first.key", "bands"))
    placed = classes.select("node", F.explode("bands").alias("part"))
    heads = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(HEADS)])
    shared = placed.groupBy("part").agg(F.count("*").alias("n"), heads.alias("heads")).filter("n > 1")
    buckets = common.materialize(placed.join(shared.hint("merge"), "part"))
    meeting = classes.select("doc_id", "key", "node").join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = rows.join(meeting.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    sets = common.materialize(_shingle_sets(texts, words))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(end), F.col("values").alias(f"{end}_values")) for end in ("src", "dst"))
        both = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
        common_ = F.size(F.array_intersect("src_values", "dst_values"))
        union = F.size("src_values") + F.size("dst_values") - common_
        return common.materialize(both.filter(common_ / union >= similarity).select("src", "dst"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a.node", "b.node").alias("src"), F.least("a.node", "b.node").alias("dst")).distinct()

    pairs = ends(buckets.select("node", F.explode("heads").alias("head")).filter("node <> head").select(F.struct("node").alias("a"), F.struct(F.col("head").alias("node")).alias("b")))
    traits = sets.select("node", "size", "marks")
    a, b = (traits.alias(end) for end in ("a", "b"))
    near = pairs.join(a.hint("merge"), F.col("src") == F.col("a.node")).join(b.hint("merge"), F.col("dst") == F.col("b.node")).filter(_may_be_similar("a", "b", similarity))
    edges = verified(near.select("src", "dst"))
    components = common.connected_components(edges)
    # What is left are the buckets that are not of one component.
    named = components.withColumnRenamed("node", "name")
    light = buckets.filter(F.col("n") > 2).select("part", "node").join(named.hint("merge"), F.col("node") == F.col("name"), "left").select("part", "node", F.coalesce("component", "node").alias("component"))
    light = common.materialize(light.join(sets.select("node", "size").hint("merge"), "node"))
    n = F.greatest(F.count("*"), F.ceil(F.sum("size") * (TILE / TILE_VALUES))).alias("n")
    mixed = light.groupBy("part").agg(n, F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("part", "n")
    now = light.join(mixed.hint("merge"), "part").join(sets.select("node", "marks", "keys", "values").hint("merge"), "node")
    more = common.materialize(_apart(now, similarity))
    if not more.isEmpty():
        named = common.connected_components(edges.union(more)).withColumnRenamed("node", "name")
    return classes.join(named.hint("merge"), F.col("node") == F.col("name"), "left").select("node", "doc_id", "key", F.coalesce("component", "node").alias("component"))


def keep_first(documents: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """One row of each component of similar documents, with all columns.

    It is the row with the smallest id, of equal ids the one with the smallest text hash, and of repeated rows any one. Null and empty texts are alike
    and link with each other. Rows without an id stay, all of them. An empty table gives no rows.
    """
    id_, key = common.unused(documents.columns, "keep_id", "keep_key")
    found = similar_classes(documents, similarity, words).groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    keep = common.materialize(found.select(F.col("first.doc_id").alias(id_), F.col("first.key").alias(key)))
    named = documents.filter("doc_id is not null").withColumn(key, F.xxhash64("text")).withColumn(id_, F.col("doc_id"))
    named = named.join(keep.hint("merge"), [id_, key], "left_semi").dropDuplicates([id_, key]).select(documents.columns)
    return named.unionByName(documents.filter("doc_id is null"))
