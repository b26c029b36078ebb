"""Exact substring deduplication: suffixes at anchors, sorted, and the common-prefix interval tree over them.

Wanted are all bytes covered by a string of ``least`` bytes that also starts elsewhere. Suffixes are not sorted at every
byte but at anchors: of the 64-byte grams in every window of ``least`` bytes the one with the lowest hash is chosen, by the window's
bytes alone, so two equal windows have the same anchor at the same place. An anchor whose whole
surroundings (all windows that hold it) occur twice is settled by a hash of them. For the others, a window has either a
long part after the anchor's start or a long one before it, so anchors meet if they share one or the other: a
line that many documents have between different texts brings nothing together. The
suffixes that begin at anchors that meet form an enhanced suffix array: sorted, with the common prefixes of neighbours. A
stack-scan finds its interval tree. Each interval is a repeat to the right of the anchor with all its
occurrences; how far each occurrence extends to the left together with another of the same interval is read from the order of the reversed left
contexts. Where all extend alike the repeat is not yet maximal and its extension is what counts; where left and right
together reach ``least`` bytes, the occurrence is covered that far.

Where more than ``GROUP`` anchors with different surroundings meet, as around a passage that very many documents have between different texts, sorting them in one
task would not be bounded. There the windows that hold an anchor are taken in ``BANDS`` neighbouring bands; all windows of a band
share a core of nearly their length, and only where cores are equal as well the windows themselves are hashed and counted. That is linear in
the anchors, and no task holds more than a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm import common

GRAM = 64
#: Anchors that meet and are sorted in one task (their surroundings take 24 MB), and bands of windows where there are more.
GROUP, BANDS = 32_768, 8
_CHUNK_LOG = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** n modulo 2 ** 64, kept between calls."""
    known = _powers.get(name)
    if known is None or len(known) <= n:
        size = max(n + 1, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[name] = known
    return known


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by the least from the start and to the end of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def halves(least: int) -> tuple[int, int]:
    """Bytes before an anchor and from its start on: every window has as many of one or the other."""
    ahead = GRAM + (least - GRAM) // 2
    return least - ahead, ahead


def anchors(data: bytes, least: int) -> list[np.ndarray]:
    """Arrays of place, hash of the gram, of the surroundings, of what lies before, and of what lies ahead, of each anchor.

    The last two hash the halves, and are zero where the text does not reach so far.
    """
    parts: list[list[np.ndarray]] = []
    behind, forth = halves(least)
    width = least - GRAM + 1
    whole = np.frombuffer(data, np.uint8)
    step = (1 << _CHUNK_LOG) - 2 * least
    for at in range(0, max(len(whole) - least + 1, 0), step):
        # Windows that start in this chunk, with what their anchors' surroundings need.
        low, high = max(0, at - least), min(len(whole), at + step + 2 * least)
        c = whole[low:high].astype(np.uint64) + np.uint64(1)
        n = len(c)
        up, down = _power("up", _BASE, n), _power("down", _INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(c * up[:n], out=sums[1:])
        first, last = at - low, min(at + step + least - 1, len(whole)) - low  # bytes of these windows
        grams = _mix((sums[first + GRAM : last + 1] - sums[first : last + 1 - GRAM]) * down[first : last + 1 - GRAM])
        mask = np.uint64((1 << (_CHUNK_LOG + 1)) - 1)
        keyed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        chosen = np.unique(_sliding_least(keyed, width) & mask).astype(np.int64)
        place = chosen + first
        start, end = np.maximum(place - (least - GRAM), 0), np.minimum(place + least, n)
        around = _mix((sums[end] - sums[start]) * down[start])
        around = _mix(around ^ ((place - start).astype(np.uint64) << np.uint64(32)) ^ (end - place).astype(np.uint64))
        back, ahead = np.maximum(place - behind, 0), np.minimum(place + forth, n)
        before = np.where(place + low >= behind, _mix((sums[place + GRAM] - sums[back]) * down[back]), 0)
        after = np.where(place + forth <= n, _mix((sums[ahead] - sums[place]) * down[place]), 0)
        parts.append([place + low, grams[chosen], around, before, after])
    if not parts:
        return [np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 4]
    whole_arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
    _, first_seen = np.unique(whole_arrays[0], return_index=True)
    return [x[first_seen] for x in whole_arrays]


def _common(rows: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Length of the common prefix of each row and the next one in this order."""
    lengths = np.array([len(rows[i]) for i in order])
    table = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    out = np.empty(len(order) - 1, np.int64)
    for at in range(0, len(out), 4096):
        differ = table[at : at + 4096][: len(out) - at] != table[at + 1 : at + 4097]
        found = differ.argmax(axis=1)
        out[at : at + 4096] = np.where(differ.any(axis=1), found, width)
    return np.minimum(out, np.minimum(lengths[:-1], lengths[1:]))


def prefix_intervals(common_prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of each interval of the common-prefix tree, by a stack-scan; children before parents."""
    stack: list[tuple[int, int]] = [(-1, 0)]
    for i, length in enumerate([*common_prefix.tolist(), -1]):
        first = i
        while stack[-1][0] > length:
            size, first = stack.pop()
            yield first, i, size
        if length > stack[-1][0]:
            stack.append((length, first))
    # The -1 at the bottom is no interval.


def extents(lefts: list[bytes], rights: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of the anchor each occurrence is covered; zero and zero if not at all.

    ``lefts`` are reversed, so that both are read away from the anchor.
    """
    m = len(lefts)
    far_left, far_right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if m < 2:
        return far_left, far_right
    by_right = sorted(range(m), key=rights.__getitem__)
    by_left = sorted(range(m), key=lefts.__getitem__)
    right_common = _common(rights, by_right, least)
    left_common = _common(lefts, by_left, max(least - GRAM, 1))
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    by_right_array = np.array(by_right)
    neighbours = np.concatenate([[0], left_common, [0]])
    most_left = int(np.maximum(neighbours[:-1], neighbours[1:]).max())
    seen: set[tuple[int, int]] = set()
    for first, last, length in prefix_intervals(right_common):
        if length + most_left < least or (first, last) in seen:
            continue
        seen.add((first, last))
        members = by_right_array[first : last + 1]
        ranks = np.sort(rank[members])
        # Common left context of neighbours among the members; where it is the same for all, the repeat extends.
        between = np.minimum.reduceat(left_common[: ranks[-1]], ranks[:-1]) if len(ranks) > 1 else np.zeros(0, np.int64)
        best = np.zeros(len(ranks), np.int64)
        best[:-1] = between
        best[1:] = np.maximum(best[1:], between)
        reach = best + length >= least
        who = np.array(by_left)[ranks[reach]]
        far_left[who] = np.maximum(far_left[who], best[reach])
        far_right[who] = np.maximum(far_right[who], length)
    return far_left, far_right


def _bands(side: int, least: int) -> list[tuple[int, int]]:
    """Least and most bytes before the anchor, of the windows of each band of one side."""
    behind, most = halves(least)[0], least - GRAM
    low, high = (0, behind) if side == 0 else (behind + 1, most)
    edges = [low + (high + 1 - low) * i // BANDS for i in range(BANDS + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def band_cores(data: bytes, at: int, side: int, least: int) -> list[tuple[int, int]]:
    """(band, hash) of what all windows of a band have in common, for the bands that have a window; ``at``: the anchor's place.

    Bands are numbered through over both sides.
    """
    from xxhash import xxh64_intdigest

    out = []
    for i, (low, high) in enumerate(_bands(side, least)):
        if max(low, at + least - len(data)) <= min(high, at):
            core = xxh64_intdigest(data[at - low : at + least - high], side * BANDS + i)
            out.append((side * BANDS + i, core - (1 << 64) if core >> 63 else core))
    return out


def band_windows(data: bytes, at: int, band: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the anchor, hash) of each window of a band."""
    from xxhash import xxh64_intdigest

    low, high = _bands(band // BANDS, least)[band % BANDS]
    left = np.arange(max(low, at + least - len(data)), min(high, at) + 1)
    return left, np.array([xxh64_intdigest(data[at - n : at - n + least]) for n in left.tolist()], np.uint64)


def _identified(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's bytes, and 96 bits that name the row by id and text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("bytes"))
    return rows.select("doc_id", "bytes", F.xxhash64("doc_id", "bytes").alias("a"), F.hash("bytes", "doc_id").alias("b"))


def covered(documents: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, spans) of the rows with repeated bytes: spans are (start, end) in bytes, unsorted, and may overlap."""
    rows = _identified(documents, id_col, text_col)
    spark = documents.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_buffer()
                if data.size < least:
                    continue
                place, *hashes = anchors(data, least)
                size = np.minimum(least, data.size - place)
                parts.append((*(x.view(np.int64) for x in hashes), np.full(len(place), a, np.int64), np.full(len(place), b, np.int32), place.astype(np.int32), size.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(x.as_buffer(), least)[1] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    schema = "h long, around long, before long, after long, a long, b int, place int, ahead int"
    names = [x.split()[0] for x in schema.split(", ")]
    # The anchors are found twice rather than kept: those that occur once are most of them.
    repeated = rows.select("bytes").mapInArrow(grams, "h long").groupBy("h").agg(F.count("*").alias("n"))
    repeated = common.materialize(repeated.filter("n > 1").select("h"))
    found = rows.select("a", "b", "bytes").mapInArrow(find, schema)
    found = common.materialize(found.join(repeated.hint("merge"), "h", "left_semi"))

    classes = found.groupBy("h", "around").agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "place")).alias("one"), F.first("before").alias("before"), F.first("after").alias("after"))
    classes = common.materialize(classes)
    # Surroundings that occur twice: every window that holds the anchor is repeated.
    twice = classes.filter("n > 1").select("h", "around")
    settled = found.join(twice.hint("merge"), ["h", "around"]).select("a", "b", (F.greatest(F.col("place") - (least - GRAM), F.lit(0))).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))
    settled = settled.filter(F.col("end") - F.col("start") >= least)

    # Other anchors with different surroundings that share what lies ahead or before: their suffixes and left contexts.
    meeting = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("after").alias("half")), F.struct(F.lit(1).alias("side"), F.col("before").alias("half"))))
    sided = classes.select("h", "one", "n", meeting.alias("m")).select("h", "one", "n", "m.side", "m.half").filter("half <> 0")
    several = common.materialize(sided.groupBy("h", "side", "half").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = sided.join(several.hint("merge"), ["h", "side", "half"])
    # Anchors that meet are a group under one hash from here on.
    wanted = wanted.select(F.xxhash64("h", "side", "half").alias("h"), "side", (F.col("kinds") > GROUP).alias("many"), "one.a", "one.b", "one.place", F.col("n").alias("copies"))
    wanted = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("h", "side", "many", "place", "copies")).alias("at"))
    texts = rows.select("a", "b", "bytes").join(common.materialize(wanted).hint("merge"), ["a", "b"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands before and after each anchor of a group that is sorted; of the others the bands of windows around them, by their cores."""
        names = context_schema.names
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for a, b, data, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for x in at:
                    place = x["place"]
                    before, after = data[max(0, place - (least - GRAM)) : place], data[place : place + least]
                    if x["many"]:
                        found = [(x["h"], band, core) for band, core in band_cores(before + after, len(before), x["side"], least)]
                    else:
                        found = [(x["h"], None, None)]
                    for h, band, core in found:
                        for name, value in zip(names, (h, band, core, a, b, place, x["copies"], before[::-1], after), strict=True):
                            out[name].append(value)
                if len(out["h"]) >= 5000:
                    yield pa.RecordBatch.from_pydict(out, schema=context_schema)
                    out = {k: [] for k in names}
            if out["h"]:
                yield pa.RecordBatch.from_pydict(out, schema=context_schema)

    context_schema = pa.schema([("h", pa.int64()), ("band", pa.int32()), ("core", pa.int64()), ("a", pa.int64()), ("b", pa.int32()), ("place", pa.int32()), ("copies", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
    around = texts.mapInArrow(contexts, "h long, band int, core long, a long, b int, place int, copies long, before binary, after binary")
    many = not several.filter(F.col("kinds") > GROUP).isEmpty()
    around = common.materialize(around) if many else around  # else it is read once
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = around.filter("band is null").select("h", "a", "b", "place", "copies", "before", "after").repartition(parts, "h").sortWithinPartitions("h")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, band, _, a, b, place, copies, before, after = (batch.column(n).to_pylist() for n in range(9))
            for i in range(batch.num_rows):
                left, value = band_windows(before[i][::-1] + after[i], len(before[i]), band[i], least)
                n = len(left)
                values = [pa.array(np.full(n, h[i])), pa.array(left), pa.array(value.view(np.int64)), pa.array(np.full(n, a[i])), pa.array(np.full(n, b[i], np.int32)), pa.array(np.full(n, place[i], np.int32)), pa.array(np.full(n, copies[i]))]
                yield pa.RecordBatch.from_arrays(values, names=["h", "left", "value", "a", "b", "place", "copies"])

    # Of very large groups: windows whose cores are equal.
    def counted() -> DataFrame:
        cores = around.filter("band is not null")
        shared = common.materialize(cores.groupBy("h", "band", "core").agg(F.count("*").alias("m")).filter("m > 1").drop("m"))
        near = cores.join(shared.hint("merge"), ["h", "band", "core"])
        found_windows = common.materialize(near.mapInArrow(windows, "h long, left long, value long, a long, b int, place int, copies long"))
        again = found_windows.groupBy("h", "left", "value").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
        repeated_windows = found_windows.join(again.hint("merge"), ["h", "left", "value"]).filter("copies = 1")  # more than one copy: settled
        repeated_windows = repeated_windows.groupBy("a", "b", "place").agg(F.max("left").alias("far"), F.min("left").alias("near"))
        return repeated_windows.select("a", "b", (F.col("place") - F.col("far")).cast("int").alias("start"), (F.col("place") - F.col("near") + least).cast("int").alias("end"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            if len(group) > 1:
                left, right = extents([x[4] for x in group], [x[5] for x in group], least)
                for x, l, r in zip(group, left.tolist(), right.tolist(), strict=True):
                    if l + r >= least and x[3] == 1:  # more than one copy: settled
                        out.append((x[0], x[1], x[2] - l, x[2] + r))
            group.clear()

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "start", "end"])

        for batch in batches:
            for x in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if key != x[0]:
                    close()
                    key = x[0]
                group.append(x[1:])
            if len(out) >= 5000:
                yield ready()
        close()
        if out:
            yield ready()

    compared = dealt.mapInArrow(compare, "a long, b int, start int, end int")
    # Rows that repeat id and text have the same spans: a set holds each once.
    found_spans = settled.union(compared).union(counted()) if many else settled.union(compared)
    return found_spans.groupBy("a", "b").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def deduplicate(documents: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the removed runs in bytes and the bytes that remain.

    Texts are UTF-8 bytes, null is empty; matches lie within documents; texts shorter than ``least`` lose nothing. Rows with equal id and
    text are copies of each other like any others, and each gives a row. Further columns are ignored.
    """
    if least < 2 * GRAM:
        raise ValueError("least is too short for the anchors")
    spans = common.materialize(covered(documents, least, id_col, text_col))
    rows = _identified(documents, id_col, text_col).join(spans.hint("merge"), ["a", "b"], "left").select("doc_id", "bytes", "spans")
    kind = documents.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", batches_schema), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
        for batch in batches:
            out = {"n_bytes": [], "spans": [], "kept": []}
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = merge_spans([(s["start"], s["end"]) for s in found or []])
                at, kept = 0, []
                for start, end in runs:
                    kept.append(data[at:start])
                    at = end
                out["n_bytes"].append(len(data))
                out["spans"].append([{"start": s, "end": e} for s, e in runs])
                out["kept"].append(b"".join([*kept, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], schema.field(n).type) for n in ("n_bytes", "spans", "kept"))], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    batches_schema = to_arrow_type(documents.schema[id_col].dataType)
    return rows.mapInArrow(remove, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
