"""Encoders of fork payloads, each the inverse of a decoder."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np

from moraine.operators import codecs, tables


_RUNS = re.compile(rb"(.)\1{3,254}|\x90", re.DOTALL)


def _run(found: re.Match) -> bytes:
    piece = found[0]
    return (b"\x90\x00" if piece[0] == 0x90 else piece[:1]) + (bytes([0x90, len(piece)]) if len(piece) > 3 else b"")


def rle90(data: bytes) -> bytes:
    return _RUNS.sub(_run, data)


class _Bits:
    """Collects numbers, the lowest bit first or the highest."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def low(self, value: int, n: int) -> None:
        if n:
            self.parts.append(f"{value:0{n}b}"[::-1])

    def high(self, value: int, n: int) -> None:
        if n:
            self.parts.append(f"{value:0{n}b}")

    def bytes_low(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text[::-1] or "0", 2).to_bytes(len(text) // 8, "little")

    def bytes_high(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")


def lzw(data: bytes, clear_after: int = 0) -> bytes:
    """``clear_after``: codes after which a clear code is sent, each time; 0 sends none."""
    codes: list[int] = []
    parts: list[bytes] = []
    table: dict[int, int] = {}
    word, count = -1, 257
    for value in data:
        if word < 0:
            word = value
            continue
        key = word << 8 | value
        longer = table.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        if count < codecs.LZW_LIMIT:
            table[key] = count
            count += 1
        word = value
        if clear_after and len(codes) == clear_after:
            parts.append(_lzw_bits([*codes, codecs.LZW_CLEAR], True))
            codes, table, count = [], {}, 257
    if word >= 0:
        codes.append(word)
    parts.append(_lzw_bits(codes))
    return b"".join(parts)


def _lzw_bits(codes: list[int], cleared: bool = False) -> bytes:
    """Codes since the last clear code, each in its width; after one the group of eight is filled, which ends a byte."""
    widths = codecs.lzw_widths(0, len(codes))
    bits = (np.array(codes, np.int64)[:, None] >> np.arange(14)) & 1
    kept = bits.astype(np.uint8)[np.arange(14) < widths[:, None]]
    fill = int(widths[-1]) * (-len(codes) % 8) if cleared else 0
    return np.packbits(np.concatenate([kept, np.zeros(fill, np.uint8)]), bitorder="little").tobytes()


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; 1 for a lone symbol."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    lengths: Counter = Counter()
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return dict(lengths)


def huffman(data: bytes) -> bytes:
    if not data:
        return b""
    bits = _Bits()
    heap: list = [(n, i, s) for i, (s, n) in enumerate(sorted(Counter(data).items()))]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], tie, (a[2], b[2])))
        tie += 1
    codes: dict[int, str] = {}

    def spell(node, code: str) -> None:
        if isinstance(node, int):
            bits.high(1, 1)
            bits.high(node, 8)
            codes[node] = code
        else:
            bits.high(0, 1)
            spell(node[0], code + "0")
            spell(node[1], code + "1")

    spell(heap[0][2], "")
    bits.parts.append("".join([codes[x] for x in data]))
    return bits.bytes_high()


def _before(data: bytes, most: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each place: the oldest that a match may start at, the last one before with the same eight bytes, the longest match below that, and its start."""
    size = len(data)
    octets = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    eight = np.zeros(size, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | octets[i : i + size]
    oldest = np.maximum(np.arange(size) - codecs.WINDOW, 0)
    length, start = np.zeros(size, np.int64), np.zeros(size, np.int64)
    before = np.full(size, -1)
    for n in range(4, 9):
        keys = eight[: max(size - n + 1, 0)] >> np.uint64(64 - 8 * n)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        if n == 4:
            # Of the same four bytes only the last ``most`` places are looked at.
            far = keys[most:] == keys[:-most]
            at = order[most:][far]
            oldest[at] = np.maximum(oldest[at], order[:-most][far])
        same = keys[1:] == keys[:-1]
        before = np.full(size, -1)
        before[order[1:][same]] = order[:-1][same]
        if n < 8:
            good = before >= oldest
            length[good], start[good] = n, before[good]
    return oldest.tolist(), before.tolist(), length.tolist(), start.tolist()


def _matches(data: bytes, most: int = 32) -> list[tuple[int, int, int]]:
    """(literal, length, distance): literals have length 0."""
    out, at = [], 0
    size = len(data)
    oldest, before, shorter, start = _before(data, most)
    add = out.append

    def reach(before: int, at: int, n: int, longest: int) -> int:
        """How far both agree, of which ``n`` bytes are known to."""
        step = 16
        while n < longest and step:
            more = step if step < longest - n else longest - n
            if data[before + n : before + n + more] == data[at + n : at + n + more]:
                n += more
            else:
                step = more >> 1
        return n

    while at < size:
        place, last = before[at], oldest[at]
        if place >= last:
            longest = min(1000, size - at)
            best, distance = reach(place, at, 8, longest), at - place
            while best < longest:
                beyond = data[at + best]
                place = before[place]
                # Only a match longer than the best so far counts; most others differ in the next byte.
                while place >= last and (data[place + best] != beyond or data[place : place + best] != data[at : at + best]):
                    place = before[place]
                if place < last:
                    break
                best, distance = reach(place, at, best + 1, longest), at - place
            add((0, best, distance))
            at += best
        elif shorter[at]:
            add((0, shorter[at], at - start[at]))
            at += shorter[at]
        else:
            add((data[at], 0, 0))
            at += 1
    return out


def lz_huffman(data: bytes, share_table: bool = False) -> bytes:
    symbols, after_match = [], False
    for literal, length, distance in _matches(data):
        if length == 0:
            symbols.append((after_match, literal, 0, 0, None))
        else:
            symbol, extra, n = (length + 253, 0, 0) if length < 65 else (318, length - 65, 10)
            symbols.append((after_match, symbol, extra, n, distance))
        after_match = length > 0
    uses: list[Counter] = [Counter(), Counter()]
    exponents: Counter = Counter()
    for second, symbol, _, _, distance in symbols:
        uses[second and not share_table][symbol] += 1
        if distance is not None:
            exponents[_exponent(distance)] += 1
    parts = [_low(7 | (8 if share_table else 0), 8)]
    tables: list[dict[int, str]] = []
    for counts, size in ((uses[0], 321), (None if share_table else uses[1], 321), (exponents, 17)):
        if counts is None:
            tables.append(tables[0])
            continue
        found = code_lengths(counts or {0: 1})
        lengths = [found.get(i, 0) for i in range(size)]
        parts += [_META[n - 1 if n else 31] for n in lengths]
        tables.append({s: f"{code:0{n}b}" for (n, code), s in codecs.canonical(lengths).items()})
    add = parts.append
    first, second, third = tables
    for after, symbol, extra, n, distance in symbols:
        add((second if after else first)[symbol])
        if n:
            add(_low(extra, n))
        if distance is not None:
            exponent = _exponent(distance)
            add(third[exponent])
            if exponent > 1:
                add(_low(distance - 1 - (1 << exponent - 1), exponent - 1))
    return _bytes_low("".join(parts))


def _low(value: int, n: int) -> str:
    return f"{value:0{n}b}"[::-1]


_META = [_low(code, n) for code, n in zip(codecs.META_CODES, codecs.META_LENGTHS, strict=True)]


def _bytes_low(text: str) -> bytes:
    """Bits as digits to bytes, the lowest bit first."""
    return np.packbits(np.frombuffer(text.encode(), np.uint8) & 1, bitorder="little").tobytes()


_predefined: dict[int, list[str]] = {}


def _predefined_codes(number: int) -> list[str]:
    if number not in _predefined:
        codes = {symbol: f"{value:0{size}b}" for (size, value), symbol in codecs.canonical(tables.CODE_SETS[number - 1][0]).items()}
        _predefined[number] = [codes[x] for x in range(256)]
    return _predefined[number]


def predefined(data: bytes, number: int) -> bytes:
    """Method 13 with one of the five predefined sets: literals only, so the first code is always the one in use."""
    codes = _predefined_codes(number)
    return bytes([number << 4]) + _bytes_low("".join([codes[x] for x in data]))


def _exponent(distance: int) -> int:
    return distance - 1 if distance < 3 else (distance - 1).bit_length()


def deflate(data: bytes) -> bytes:
    stream = zlib.compressobj(9, zlib.DEFLATED, -15)
    return stream.compress(data) + stream.flush()


class _Arithmetic:
    """Exact low end of the range; its bits are the stream. What is added is kept in pieces, as a long number is slow to add to."""

    def __init__(self) -> None:
        self.low, self.range, self.shifts = 0, 1 << codecs.ARITHMETIC_BITS - 1, 0
        self.pieces: list[tuple[int, int]] = []

    def put(self, model: codecs.Model, symbol: int) -> None:
        self.put_all([(model, symbol)])

    def put_all(self, pairs: list[tuple[codecs.Model, int]]) -> None:
        range_, low, shifts = self.range, self.low, self.shifts
        half, bits = 1 << codecs.ARITHMETIC_BITS - 2, codecs.ARITHMETIC_BITS - 1
        piece = shifts
        for model, symbol in pairs:
            counts, total, at = model.counts, model.total, symbol - model.first
            share = counts[at]
            unit, below = range_ // total, sum(counts[:at])
            if below:
                low += unit * below
            range_ = range_ - unit * below if below + share == total else unit * share
            if range_ <= half:
                n = bits - (range_ - 1).bit_length()
                range_ <<= n
                low <<= n
                shifts += n
            counts[at] = share + model.increment
            model.total = total = total + model.increment
            if total > model.limit:
                model.counts = [n + 1 >> 1 for n in counts]
                model.total = sum(model.counts)
            if shifts - piece > 1024:
                self.pieces.append((low, shifts))
                low, piece = 0, shifts
        self.range, self.low, self.shifts = range_, low, shifts

    def put_number(self, model: codecs.Model, value: int, n: int) -> None:
        for i in range(n):
            self.put(model, value >> i & 1)

    def stream(self) -> bytes:
        low, before = 0, 0
        for part, shifts in [*self.pieces, (self.low, self.shifts)]:
            low, before = (low << shifts - before) + part, shifts
        size = codecs.ARITHMETIC_BITS + self.shifts
        return (low << -size % 8).to_bytes(-(-size // 8), "big")


def _rotations(block: bytes) -> np.ndarray:
    """Order of the rotations, by eight bytes, then by prefix doubling."""
    n = len(block)
    octets = np.frombuffer(block, np.uint8).astype(np.uint64)
    round_ = np.concatenate([octets, np.resize(octets, 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | round_[i : i + n]
    step = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if step >= n or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        key = rank * n + np.roll(rank, -step)
        step *= 2


_FOURS = re.compile(rb"(.)\1{3,258}", re.DOTALL)


def arsenic(data: bytes, block_bits: int = 14, gaps: tuple[int, ...] = ()) -> bytes:
    """``gaps`` marks all blocks as randomized with these distances."""
    coder, start = _Arithmetic(), codecs.Model(*codecs.START_MODEL)
    for value in b"As":
        coder.put_number(start, value, 8)
    coder.put_number(start, block_bits - 9, 4)
    most = (1 << block_bits) * 4 // 5 - 8  # the repeat counts lengthen a block
    for at in range(0, len(data), most):
        block = bytearray(_FOURS.sub(lambda run: run[0][:4] + bytes([len(run[0]) - 4]), data[at : at + most]))
        if gaps:
            place, k = gaps[0], 0
            while place < len(block):
                block[place] ^= 1
                k = (k + 1) % len(gaps)
                place += gaps[k]
        order = _rotations(bytes(block))
        coder.put(start, 0)
        coder.put(start, 1 if gaps else 0)
        coder.put_number(start, int(np.flatnonzero(order == 0)[0]), block_bits)
        selector, ranks = codecs.Model(*codecs.SELECTOR_MODEL), [codecs.Model(*m) for m in codecs.RANK_MODELS]
        front, zeros = bytearray(range(256)), 0
        pairs: list[tuple[codecs.Model, int]] = []
        digits = ((selector, 0), (selector, 1))
        first, place = 0, front.index
        for value in np.frombuffer(block, np.uint8)[order - 1].tolist():
            if value == first:
                zeros += 1
                continue
            while zeros:
                pairs.append(digits[1 - (zeros & 1)])
                zeros = zeros - 1 >> 1
            rank = place(value)
            del front[rank]
            front.insert(0, value)
            first = value
            if rank == 1:
                pairs.append((selector, 2))
            else:
                group = rank.bit_length() - 2
                pairs += ((selector, group + 3), (ranks[group], rank))
        while zeros:
            pairs.append(digits[1 - (zeros & 1)])
            zeros = zeros - 1 >> 1
        pairs.append((selector, codecs.END_OF_BLOCK))
        coder.put_all(pairs)
    coder.put(start, 1)
    return coder.stream()


ENCODERS = {0: bytes, 1: rle90, 2: lzw, 3: huffman, 13: lz_huffman, 14: deflate, 15: arsenic}
