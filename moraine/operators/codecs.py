"""Decoders of fork payloads. Each takes the compressed bytes and the plain size, and raises BadData or Unsupported."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np


class BadData(Exception):
    """The stream does not decode to the declared size."""


class Unsupported(Exception):
    """A known or unknown method that can't be decoded here."""


class LowBits:
    """Reads numbers from the lowest bit of each byte upwards."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.count < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                raise BadData("bits end early")
            self.held |= int.from_bytes(chunk, "little") << self.count
            self.count += 8 * len(chunk)
            self.at += len(chunk)
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.count -= n
        return value


def _exact(out: bytes | bytearray, size: int) -> bytes:
    if len(out) != size:
        raise BadData("another size than declared")
    return bytes(out)


def stored(data: bytes, size: int) -> bytes:
    """All bytes; the declared size plays no part."""
    return data


def rle90(data: bytes, size: int) -> bytes:
    """Byte 0x90 and a count repeat the byte before; count 0 is 0x90 itself, which may then be repeated."""
    out = bytearray()
    last, at = 0, 0
    while at < len(data) and len(out) < size:
        mark = data.find(b"\x90", at)
        if mark != at:
            plain = data[at : mark if mark > 0 else len(data)]
            out += plain
            last, at = plain[-1], at + len(plain)
            continue
        if at + 1 == len(data):
            raise BadData("mark without a count")
        count = data[at + 1]
        at += 2
        if count == 1:
            raise BadData("repeat count 1")
        if count == 0:
            last = 0x90
        out += bytes([last]) * max(count - 1, count == 0)
    return _exact(out[:size], size)


LZW_LIMIT = 1 << 14
LZW_CLEAR = 256


#: Codes and bits that are looked at together, which bounds what a long fork takes.
_CODES, _BITS = 1 << 15, 1 << 18
_GROWTH = np.array([512, 1024, 2048, 4096, 8192])


def lzw_widths(start: int, count: int) -> np.ndarray:
    """Widths of the codes from number ``start`` after a clear: each but the first adds an entry, up to the limit."""
    return 9 + np.searchsorted(_GROWTH, 256 + np.maximum(np.arange(start, start + count), 1), "right")


def lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 14 bits in groups of eight; a clear code drops the rest of its group."""
    octets = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    words = octets[:-3] | octets[1:-2] << 8 | octets[2:-1] << 16 | octets[3:] << 24
    total, at = 8 * len(data), 0
    out, length = [], 0
    done = False
    while not done:
        entries: list[bytes] = [bytes([i]) for i in range(256)] + [b""]
        known, before, first = 257, b"", 0
        cleared, together = False, 256
        while length < size and not cleared:
            widths = lzw_widths(first, together)
            ends = at + np.cumsum(widths)
            n = int(np.searchsorted(ends, total, "right"))
            places = ends[:n] - widths[:n]
            codes = (words[places >> 3] >> (places & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)).tolist()
            for i, code in enumerate(codes):
                if code < known:
                    if code == LZW_CLEAR:
                        at = int(ends[i]) + int(widths[i]) * (-(first + i + 1) % 8)
                        cleared = True
                        break
                    piece = entries[code]
                elif code == known and before:
                    piece = before + before[:1]
                else:
                    raise BadData("code before its entry")
                if before and known < LZW_LIMIT:
                    entries.append(before + piece[:1])
                    known += 1
                before = piece
                out.append(piece)
                length += len(piece)
                if length >= size:
                    break
            if not cleared:
                if n < together:
                    break
                at, first, together = int(ends[-1]), first + together, min(2 * together, _CODES)
        done = not cleared or at > total or length >= size
    return _exact(b"".join(out), size)


def huffman(data: bytes, size: int) -> bytes:
    """A code tree in preorder (1 and a byte: leaf, 0: two subtrees), then codes, from the highest bit down."""
    bits = int.from_bytes(data, "big")
    total, at = 8 * len(data), 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > total:
            raise BadData("bits end early")
        at += n
        return (bits >> (total - at)) & ((1 << n) - 1)

    nodes: list[list] = []
    waiting: list[tuple[list, int]] = []
    root: list = [None, None]
    waiting.append((root, 0))
    top = None
    while waiting:
        parent, side = waiting.pop()
        if len(nodes) >= 511 or len(waiting) > 512:
            raise BadData("tree too large")
        if take(1):
            node: list | int = take(8)
            nodes.append([])
        else:
            node = [None, None]
            nodes.append(node)
            waiting += [(node, 1), (node, 0)]
        parent[side] = node
        if top is None:
            top = node
    if isinstance(top, int):
        return bytes([top]) * size
    codes: list[tuple[int, int]] = []
    pending: list[tuple[list | int, int]] = [(top, 0)]
    while pending:
        node, depth = pending.pop()
        if isinstance(node, int):
            codes.append((node, depth))
        else:
            pending += [(node[1], depth + 1), (node[0], depth + 1)]
    width = max(n for _, n in codes)
    if width <= _WIDEST:
        return _prefix_codes(data, at, size, [1 << width - n for _, n in codes], *zip(*codes, strict=True))
    out = bytearray()
    # Strings of bits are quicker to walk than shifts of a long number.
    text = bin(bits | 1 << total)[3:] if total else ""
    while len(out) < size:
        node = top
        while isinstance(node, list):
            if at >= total:
                raise BadData("bits end early")
            node = node[text[at] == "1"]
            at += 1
        out.append(node)
    return bytes(out)


#: Codes up to this length are looked up whole.
_WIDEST = 18


def _windows(data: bytes, at: int, width: int) -> np.ndarray:
    """The ``width`` bits from each of the next bits on, highest first, as a table of whole bytes from that of bit ``at``; zeros follow the end."""
    part = data[at >> 3 : (at >> 3) + (_BITS >> 3) + 8].ljust((min(_BITS, max(8 * len(data) - at, 0)) >> 3) + 8, b"\0")
    octets = np.frombuffer(part, np.uint8).astype(np.uint32)
    words = octets[:-3] << 24 | octets[1:-2] << 16 | octets[2:-1] << 8 | octets[3:]
    return ((words[:, None] << np.arange(8, dtype=np.uint32)) >> np.uint32(32 - width)).ravel()


def _prefix_codes(data: bytes, at: int, size: int, shares: list[int], symbols: Sequence[int], lengths: Sequence[int]) -> bytes:
    """``size`` bytes by a complete code given in the order of its codes: every bit is looked up, then the codes are followed from one to the next."""
    width = sum(shares).bit_length() - 1
    symbol = np.repeat(np.array(symbols, np.uint8), shares)
    length = np.repeat(np.array(lengths, np.uint8), shares)
    total, out, left = 8 * len(data), [], size
    while left:
        if at >= total:
            raise BadData("bits end early")
        start = at & ~7
        seen = _windows(data, at, width)
        steps = length[seen].tobytes()
        place, stop = at - start, min(len(steps), total - start)
        places: list[int] = []
        add = places.append
        while place < stop:
            add(place)
            place += steps[place]
        places = places[:left]
        out.append(symbol[seen[places]].tobytes())
        left -= len(places)
        at = start + places[-1] + steps[places[-1]]
    if at > total:
        raise BadData("bits end early")
    return b"".join(out)


# Fixed values of method 13: the 37 codes, lowest bit first, and their lengths, that spell code lengths.
META_CODES = (
    1496, 88, 64, 192, 0, 120, 43, 20, 12, 28, 27, 11,
    16, 32, 56, 24, 216, 3032, 384, 1664, 896, 3968, 1920, 1152,
    128, 640, 984, 4056, 2008, 2520, 472, 4, 1, 2, 7, 3,
    8,
)
META_LENGTHS = (
    11, 8, 8, 8, 8, 7, 6, 5, 5, 5, 5, 6, 5, 6, 7, 7, 9, 12, 10, 11, 11, 12, 12, 11,
    11, 11, 12, 12, 12, 12, 12, 5, 2, 2, 3, 4, 5,
)
LITERALS_AND_LENGTHS = 321
WINDOW = 1 << 16


def canonical(lengths: Sequence[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol: codes rise by length, then symbol."""
    table, code, before = {}, 0, 0
    for length, symbol in sorted((n, symbol) for symbol, n in enumerate(lengths) if 0 < n < 33):
        code <<= length - before
        table[length, code] = symbol
        code, before = code + 1, length
    return table


class _Lookup:
    """A canonical code as a table of the bits that follow: ``symbols`` and ``lengths`` (0: no such code). None of ``of`` for what a table can't hold."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, width: int):
        self.symbols, self.lengths, self.width = symbols, lengths, width
        self.one_symbol, self.one_length = memoryview(symbols), lengths.tobytes()

    @staticmethod
    def of(lengths: Sequence[int]) -> _Lookup | None:
        order = sorted((n, symbol) for symbol, n in enumerate(lengths) if 0 < n < 33)
        width = order[-1][0] if order else 1
        if width > _WIDEST:
            return None
        shares = [1 << width - n for n, _ in order]
        rest = (1 << width) - sum(shares)
        if rest < 0:
            return None
        return _Lookup(np.repeat(np.array([s for _, s in order] + [0], np.uint16), shares + [rest]), np.repeat(np.array([n for n, _ in order] + [0], np.uint8), shares + [rest]), width)


def _symbol(bits: LowBits, table: dict[tuple[int, int], int]) -> int:
    code = 0
    for length in range(1, 33):
        code = code << 1 | bits.take(1)
        if (length, code) in table:
            return table[length, code]
    raise BadData("no such code")


def _meta_lookup() -> tuple[np.ndarray, np.ndarray]:
    """The spelling codes by the next twelve bits, the lowest first: values and lengths."""
    values, lengths = np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.uint8)
    for i, (code, n) in enumerate(zip(META_CODES, META_LENGTHS, strict=True)):
        values[code :: 1 << n], lengths[code :: 1 << n] = i, n
    return values, lengths


_META = _meta_lookup()
#: Bytes that the lengths of three codes of 321 symbols can take, and more.
_SPELLED = 2200


def _spelled_lengths(data: bytes, at: int, counts: Sequence[int]) -> tuple[list[list[int]], int]:
    """Code lengths of as many symbols as ``counts`` has for each code, from bit ``at`` on, and where they end."""
    octets = np.frombuffer(data[:_SPELLED] + bytes(8), np.uint8).astype(np.uint32)
    words = octets[:-2] | octets[1:-1] << 8 | octets[2:] << 16
    seen = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(4095)).ravel()
    values, sizes, total = _META[0][seen].tobytes(), _META[1][seen].tobytes(), 8 * len(data)
    bits = lambda place, n: int.from_bytes(data[place >> 3 : (place >> 3) + 2], "little") >> (place & 7) & ((1 << n) - 1)
    found = []
    for count in counts:
        lengths: list[int] = []
        length = 0
        while len(lengths) < count:
            if at >= total:
                raise BadData("bits end early")
            value, n = values[at], sizes[at]
            if not n:
                raise BadData("no such code")
            at += n
            if value < 31:
                length = value + 1
                lengths.append(length)
                continue
            more = 1
            if value == 31:
                length = -1
            elif value < 34:
                length += 1 if value == 32 else -1
            else:
                n, least = ((1, 0), (3, 2), (6, 10))[value - 34]
                more += bits(at, n) + least
                at += n
            lengths += [length] * more
        if at > total:
            raise BadData("bits end early")
        found.append(lengths[:count])
    return found, at


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Codes of sets that come again, such as the predefined ones.
_kept: dict[tuple, list] = {}


def _lookups(sets: Sequence[Sequence[int]], keep: bool = False) -> list:
    if not keep:
        return [_Lookup.of(x) for x in sets]
    key = tuple(map(tuple, sets))
    if key not in _kept:
        if len(_kept) > 16:
            _kept.clear()
        _kept[key] = [_Lookup.of(x) for x in sets]
    return _kept[key]


def lz_huffman(data: bytes, size: int, static_tables: Sequence[tuple[Sequence[int], Sequence[int], Sequence[int]]] = ()) -> bytes:
    """Matches in a window of zeros of 64 KiB, and literals, by two codes that alternate, and a code of distances.

    Streams may name one of five predefined code sets; ``static_tables`` gives their lengths (first, second, distance). Without
    them such streams are unsupported.
    """
    if size == 0:
        return b""
    if not data:
        raise BadData("bits end early")
    head, at = data[0], 8
    if head >> 4 == 0:
        found, at = _spelled_lengths(data, at, [LITERALS_AND_LENGTHS] * (1 if head & 8 else 2) + [(head & 7) + 10])
        sets = [found[0], found[0 if head & 8 else 1], found[-1]]
    elif head >> 4 < 6:
        if len(static_tables) < head >> 4:
            raise Unsupported("predefined code set")
        sets = static_tables[(head >> 4) - 1]
    else:
        raise BadData("no such code set")
    codes = _lookups(sets, head >> 4 > 0)
    out = bytearray(WINDOW)  # what lies before the start is zero
    if any(x is None for x in codes):
        bits = LowBits(data)
        bits.take(8)
        for _ in range(at - 8):
            bits.take(1)
        _by_bits(bits, [canonical(x) for x in sets], out, WINDOW + size)
    else:
        _by_lookup(data, at, codes, out, WINDOW + size)
    return _exact(out[WINDOW:], size)


def _by_lookup(data: bytes, at: int, codes: Sequence[_Lookup], out: bytearray, end: int) -> None:
    """Appends up to ``end``. The first code is looked up at every bit, since most symbols are its; the others where they are met."""
    first, second, distances = codes
    turned, total = data.translate(_TURNED), 8 * len(data)
    symbols2, lengths2, symbols3, lengths3 = second.one_symbol, second.one_length, distances.one_symbol, distances.one_length
    down2, down3 = 32 - second.width, 32 - distances.width
    # Length of a symbol's code and whether it is a literal.
    marked = first.lengths | np.where(first.symbols > 255, np.uint8(128), np.uint8(0))
    low = (first.symbols & 255).astype(np.uint8)
    add, read = out.append, int.from_bytes
    left = end - len(out)
    while left > 0:
        if at >= total:
            raise BadData("bits end early")
        base = at & ~7
        seen = _windows(turned, at, first.width)
        marks, lows = marked[seen].tobytes(), low[seen].tobytes()
        place, stop = at - base, min(len(marks), total - base)
        while left > 0 and place < stop:
            mark = marks[place]
            if mark < 128:
                if not mark:
                    raise BadData("no such code")
                add(lows[place])
                place += mark
                left -= 1
                continue
            symbol = 256 | lows[place]
            at = base + place + (mark & 127)
            while symbol > 255:
                if symbol >= 320:
                    if at > total:
                        raise BadData("bits end early")
                    return
                if symbol < 318:
                    length = symbol - 253
                else:
                    n = 10 if symbol == 318 else 15
                    length = (read(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << n) - 1)) + 65
                    at += n
                seen3 = (read(turned[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"), "big") << (at & 7) & 0xFFFFFFFF) >> down3
                if not lengths3[seen3]:
                    raise BadData("no such code")
                at += lengths3[seen3]
                exponent = symbols3[seen3]
                if exponent < 2:
                    distance = exponent + 1
                else:
                    n = exponent - 1
                    distance = (1 << n) + (read(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)) + 1
                    at += n
                if at > total:
                    raise BadData("bits end early")
                if distance > WINDOW:
                    raise BadData("distance beyond the window")
                length = min(length, left)
                start = len(out) - distance
                if length <= distance:
                    out += out[start : start + length]
                else:
                    piece = bytes(out[start:])
                    out += (piece * (length // distance + 1))[:length]
                left -= length
                if left <= 0:
                    return
                seen2 = (read(turned[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"), "big") << (at & 7) & 0xFFFFFFFF) >> down2
                if not lengths2[seen2] or at >= total:
                    raise BadData("no such code")
                symbol = symbols2[seen2]
                at += lengths2[seen2]
            add(symbol)
            left -= 1
            place = at - base
        at = base + place
    if at > total:
        raise BadData("bits end early")


def _by_bits(bits: LowBits, codes: Sequence[dict[tuple[int, int], int]], out: bytearray, end: int) -> None:
    """The same bit by bit, for codes that a table can't hold."""
    first, second, distances = codes
    table = first
    while len(out) < end:
        symbol = _symbol(bits, table)
        if symbol < 256:
            out.append(symbol)
            table = first
            continue
        if symbol >= 320:
            break
        table = second
        length = symbol - 253 if symbol < 318 else bits.take(10 if symbol == 318 else 15) + 65
        exponent = _symbol(bits, distances)
        distance = exponent + 1 if exponent < 2 else (1 << exponent - 1) + bits.take(exponent - 1) + 1
        if distance > WINDOW:
            raise BadData("distance beyond the window")
        length = min(length, end - len(out))
        start = len(out) - distance
        piece = bytes(out[start : start + length])
        while len(piece) < length:
            piece += piece[: length - len(piece)]
        out += piece


def deflate(data: bytes, size: int) -> bytes:
    """Raw deflate that ends exactly at the declared size; what follows the stream is not read."""
    stream = zlib.decompressobj(-15)
    try:
        out = stream.decompress(data, size + 1)
        if not stream.eof and len(out) <= size:
            out += stream.flush()
    except zlib.error as error:
        raise BadData(str(error)) from error
    if not stream.eof:
        raise BadData("stream goes on")
    return _exact(out, size)


class Model:
    """Adaptive frequencies of an arithmetic coder."""

    def __init__(self, first: int, symbols: int, increment: int, limit: int):
        self.first, self.symbols, self.increment, self.limit = first, symbols, increment, limit
        self.reset()

    def reset(self) -> None:
        self.counts = [self.increment] * self.symbols
        self.total = self.increment * self.symbols

    def update(self, at: int) -> None:
        self.counts[at] += self.increment
        self.total += self.increment
        if self.total > self.limit:
            self.counts = [n + 1 >> 1 for n in self.counts]
            self.total = sum(self.counts)


#: Bits of the coder's range.
ARITHMETIC_BITS = 26
#: (first symbol, symbols, increment, limit): start, selector, and the groups of move-to-front ranks.
START_MODEL = (0, 2, 1, 256)
SELECTOR_MODEL = (0, 11, 8, 1024)
RANK_MODELS = ((2, 2, 8, 1024), (4, 4, 4, 1024), (8, 8, 4, 1024), (16, 16, 4, 1024), (32, 32, 2, 1024), (64, 64, 2, 1024), (128, 128, 1, 1024))
END_OF_BLOCK = 10


_FULL, _HALF = 1 << ARITHMETIC_BITS - 1, 1 << ARITHMETIC_BITS - 2


class _Arithmetic:
    """The coder's state: its range, the code within it, and bits read ahead (``held``, ``count`` of them)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0
        self.range, self.code = _FULL, 0
        self.shift(ARITHMETIC_BITS)

    def shift(self, n: int) -> None:
        while self.count < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                raise BadData("bits end early")
            self.held = self.held << 8 * len(chunk) | int.from_bytes(chunk, "big")
            self.count += 8 * len(chunk)
            self.at += len(chunk)
        self.count -= n
        self.code = self.code << n | self.held >> self.count
        self.held &= (1 << self.count) - 1

    def symbol(self, model: Model) -> int:
        unit = self.range // model.total
        target = min(self.code // unit, model.total - 1)
        low, at = 0, 0
        while at < model.symbols - 1 and low + model.counts[at] <= target:
            low += model.counts[at]
            at += 1
        self.code -= unit * low
        self.range = self.range - unit * low if low + model.counts[at] == model.total else unit * model.counts[at]
        if self.range <= _HALF:
            n = ARITHMETIC_BITS - 1 - (self.range - 1).bit_length()
            self.range <<= n
            self.shift(n)
        model.update(at)
        return model.first + at

    def number(self, model: Model, n: int) -> int:
        return sum((self.symbol(model) != 0) << i for i in range(n))


def _block(coder: _Arithmetic, limit: int) -> bytearray:
    """One block of the transformed bytes: runs of the front byte and move-to-front ranks.

    ``_Arithmetic.symbol`` and ``Model.update`` are written out here, with the state in local names: it is most of the method's time.
    """
    front, block = bytearray(range(256)), bytearray()
    models = [[[model[2]] * model[1], model[2] * model[1], *model] for model in (SELECTOR_MODEL, *RANK_MODELS)]
    data, at, held, count, range_, code = coder.data, coder.at, coder.held, coder.count, coder.range, coder.code
    selector = model = models[0]
    run, weight = 0, 1
    while True:
        counts, total, first, _, increment, most = model
        unit = range_ // total
        target = code // unit
        if target >= total:
            target = total - 1
        low = 0
        for place, share in enumerate(counts):  # noqa: B007
            low += share
            if low > target:
                break
        if low == total:
            low -= share
            range_ -= unit * low
        else:
            low -= share
            range_ = unit * share
        code -= unit * low
        if range_ <= _HALF:
            n = ARITHMETIC_BITS - 1 - (range_ - 1).bit_length()
            range_ <<= n
            if count < n:
                chunk = data[at : at + 8]
                held = held << 8 * len(chunk) | int.from_bytes(chunk, "big")
                count += 8 * len(chunk)
                at += len(chunk)
                if count < n:
                    raise BadData("bits end early")
            count -= n
            code = code << n | held >> count
            held &= (1 << count) - 1
        counts[place] = share + increment
        total += increment
        if total > most:
            counts = model[0] = [n + 1 >> 1 for n in counts]
            total = sum(counts)
        model[1] = total
        if model is selector:
            if place < 2:  # digits 1 and 2 of a number with powers of two
                run += weight << place
                weight <<= 1
                if run > limit:
                    raise BadData("run beyond the block")
                continue
            if run:
                block += front[:1] * run
                run, weight = 0, 1
            if place == END_OF_BLOCK:
                break
            if place > 2:
                model = models[place - 2]
                continue
            rank = 1
        else:
            rank, model = first + place, selector
        value = front[rank]
        del front[rank]
        front.insert(0, value)
        block.append(value)
        if len(block) > limit:
            raise BadData("block too long")
    coder.at, coder.held, coder.count, coder.range, coder.code = at, held, count, range_, code
    if len(block) > limit:
        raise BadData("block too long")
    return block


def arsenic(data: bytes, size: int, gaps: Sequence[int] = ()) -> bytes:
    """Blocks of arithmetic-coded move-to-front ranks of a Burrows-Wheeler transform, with repeats after four equal bytes.

    Blocks may be marked as randomized; ``gaps`` has the distances of the bytes to flip. Without it such blocks are unsupported.
    """
    if size == 0:
        return b""
    coder, start = _Arithmetic(data), Model(*START_MODEL)
    if bytes(coder.number(start, 8) for _ in range(2)) != b"As":
        raise BadData("no signature")
    limit_bits = coder.number(start, 4) + 9
    out = bytearray()
    while len(out) < size:
        if coder.symbol(start):
            break
        randomized = coder.symbol(start)
        first = coder.number(start, limit_bits)
        if randomized and not gaps:
            raise Unsupported("randomized block")
        block = _block(coder, 1 << limit_bits)
        if first >= len(block):
            raise BadData("start outside of the block")
        last = np.frombuffer(block, np.uint8)
        follow = np.argsort(last, kind="stable").tolist()
        order, at = [], first
        for _ in range(len(block)):
            at = follow[at]
            order.append(at)
        plain = bytearray(last[order])
        if randomized:
            place, i = gaps[0], 0
            while place < len(plain):
                plain[place] ^= 1
                i = (i + 1) % len(gaps)
                place += gaps[i]
        _expand(plain, out, size)
    return _exact(out, size)


_FOUR = re.compile(rb"(.)\1{3}(.)", re.DOTALL)


def _expand(plain: bytearray, out: bytearray, size: int) -> None:
    """Four equal bytes are followed by how often the byte comes again."""
    out += _FOUR.sub(lambda found: found[1] * (4 + found[2][0]), plain)
    del out[size:]


def decode(method: int, data: bytes, size: int, version5: bool = False, static_tables: Sequence = (), gaps: Sequence[int] = ()) -> bytes:
    """Plain bytes by the low nibble of the method."""
    low = method & 0x0F
    if low == 13:
        return lz_huffman(data, size, static_tables)
    if low == 15:
        return arsenic(data, size, gaps)
    if low == 14 and not version5:
        raise Unsupported("installer")
    known = {0: stored, 1: rle90, 2: lzw, 3: huffman, 14: deflate}
    if low not in known:
        raise Unsupported(f"method {low}")
    return known[low](data, size)
