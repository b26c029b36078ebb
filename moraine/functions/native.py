"""Native column functions on bytes, paths, times and their renderings."""

from __future__ import annotations

import binascii

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from moraine.functions.vocab import MAC_EPOCH


def be(content: Column, offset: Column | int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes at ``offset``; null beyond the end."""
    part = F.substring(content, F.lit(offset) + 1 if isinstance(offset, int) else offset.cast("int") + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def le(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number of ``size`` bytes at ``offset``; null beyond the end."""
    total = be(content, offset, 1)
    for i in range(1, size):
        total = total + F.shiftleft(be(content, offset + i, 1), 8 * i)
    return total


def big_endian(value: Column, size: int) -> Column:
    """Bytes of an unsigned number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _crc_table(polynomial: int, reflected: bool) -> list[int]:
    table = []
    for i in range(256):
        r = i if reflected else i << 8
        for _ in range(8):
            if reflected:
                r = (r >> 1) ^ polynomial if r & 1 else r >> 1
            else:
                r = ((r << 1) ^ polynomial if r & 0x8000 else r << 1) & 0xFFFF
        table.append(r)
    return table


IBM_TABLE = _crc_table(0xA001, True)
CCITT_TABLE = _crc_table(0x1021, False)


def _octets(content: Column) -> Column:
    digits = F.hex(content)
    places = F.when(F.octet_length(content) > 0, F.sequence(F.lit(1), F.octet_length(content))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))


def crc16_ibm(content: Column) -> Column:
    """CRC-16 of the archive formats (polynomial A001, reflected, initially 0)."""
    table = F.array(*[F.lit(x) for x in IBM_TABLE])
    return F.aggregate(_octets(content), F.lit(0), lambda crc, x: F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(x).bitwiseAND(255))))


def crc16_ccitt(content: Column) -> Column:
    """CRC-16 of the wrappers (polynomial 1021, initially 0)."""
    table = F.array(*[F.lit(x) for x in CCITT_TABLE])
    return F.aggregate(_octets(content), F.lit(0), lambda crc, x: F.shiftleft(crc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(x).bitwiseAND(255))))


#: Bytes that one lookup takes in.
_SPAN = 4096
_places: list[np.ndarray] = []


def _place_values() -> np.ndarray:
    """What a byte adds to the checksum, by the number of bytes after it: the checksum is the exclusive or of all."""
    if not _places:
        table, row = np.array(IBM_TABLE, np.uint16), np.array(IBM_TABLE, np.uint16)
        rows = []
        for _ in range(_SPAN):
            rows.append(row)
            row = (row >> np.uint16(8)) ^ table[row & np.uint16(255)]
        _places.append(np.concatenate(rows))
    return _places[0]


def crc16_ibm_bytes(data: bytes) -> int:
    """The same on the executors' Python side; many bytes at once by looking up what each adds."""
    crc = 0
    if len(data) < 48:
        for x in data:
            crc = crc >> 8 ^ IBM_TABLE[(crc ^ x) & 255]
        return crc
    octets, values = np.frombuffer(data, np.uint8).astype(np.int64), _place_values()
    for at in range(0, len(octets), _SPAN):
        part = octets[at : at + _SPAN].copy()
        # What went before acts on the next two bytes.
        part[0] ^= crc & 255
        carried = 0
        if len(part) > 1:
            part[1] ^= crc >> 8
        else:
            carried = crc >> 8
        crc = int(np.bitwise_xor.reduce(values[(np.arange(len(part) - 1, -1, -1) << 8) + part])) ^ carried
    return crc


@F.arrow_udf(IntegerType())
def crc16_ibm_whole(content: pa.Array) -> pa.Array:
    """``crc16_ibm`` of values of any length, in Arrow batches."""
    return pa.array([None if x is None else crc16_ibm_bytes(x) for x in content.to_pylist()], pa.int32())


@F.arrow_udf(IntegerType())
def crc16_ccitt_whole(content: pa.Array) -> pa.Array:
    """``crc16_ccitt`` of values of any length, in Arrow batches."""
    return pa.array([None if x is None else binascii.crc_hqx(x, 0) for x in content.to_pylist()], pa.int32())


def register(spark: SparkSession) -> None:
    """Make the checksums and name functions callable from SQL."""
    spark.udf.register("crc16_ibm", crc16_ibm_whole)
    spark.udf.register("crc16_ccitt", crc16_ccitt_whole)


def crc_text(crc: Column) -> Column:
    """Four lower-case hex digits."""
    return F.lower(F.lpad(F.hex(crc.cast("long")), 4, "0"))


def mac_to_unix(seconds: Column) -> Column:
    """Seconds since 1970; 0 where a time is before that, which stands for none."""
    return F.greatest(seconds.cast("long") - MAC_EPOCH, F.lit(0).cast("long"))


def unix_to_mac(seconds: Column) -> Column:
    """Seconds since 1904 in 32 bits: clamped above, 0 for times up to 1970."""
    value = F.least(seconds.cast("long") + MAC_EPOCH, F.lit((1 << 32) - 1).cast("long"))
    return F.when(seconds > 0, value).otherwise(F.lit(0).cast("long"))


def round_up_128(size: Column) -> Column:
    return F.floor((size + 127) / 128).cast("long") * 128


def path_is_safe(path: Column) -> Column:
    """May be extracted: not empty, not absolute, without backslash, colon and two dots in a row."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("..") & ~path.contains(":"), F.lit(False))


def relative_entry(path: Column) -> Column:
    """May name a member to add or delete: no empty, ``.`` or ``..`` component."""
    parts = F.forall(F.split(path, "/", -1), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains(":") & parts, F.lit(False))


def clean_selector(selector: str) -> str:
    """Without leading and trailing slashes."""
    return selector.lstrip("/").rstrip("/")


def selected(path: Column, selectors: list[str] | None) -> Column:
    """Equals a selector or lies below it; without selectors all, while empty ones select nothing."""
    if not selectors:
        return F.lit(True)
    found = F.lit(False)
    for selector in map(clean_selector, selectors):
        if selector:
            found = found | (path == selector) | path.startswith(selector + "/")
    return found


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def sanitized_name(path: Column) -> Column:
    """A member name to write: at most 31 bytes, and each byte other than letters, digits, space and ``._-+()[]`` becomes ``_``."""
    by_bytes = F.decode(F.encode(path, "UTF-8"), "ISO-8859-1")
    return F.substring(F.regexp_replace(by_bytes, r"[^A-Za-z0-9 ._\-+()\[\]]", "_"), 1, 31)


def fourcc_text(code: Column, unprintable: str = "?") -> Column:
    """Four-character code in listings."""
    return F.regexp_replace(F.decode(code, "ISO-8859-1"), "[^\\x20-\\x7e]", unprintable)


def fourcc_json(code: Column) -> Column:
    """Four-character code inside a JSON string."""
    chars = F.transform(_octets(code), lambda x: F.when((x >= 32) & (x <= 126) & ~x.isin(34, 92), F.chr(x)).otherwise(F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")))))
    return F.array_join(chars, "")


def json_text(value: Column) -> Column:
    """Escaped for a JSON string: quotes, backslashes and control characters (127 as well)."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in [*range(1, 32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u00{code:02x}"))
    return text


def hex_bytes(content: Column, offset: Column | int, size: Column | int) -> Column:
    """Lower-case hex of a byte range; null where it does not lie within the bytes."""
    offset, size = (F.lit(x) if isinstance(x, int) else x for x in (offset, size))
    inside = (offset >= 0) & (size >= 0) & (offset + size <= F.octet_length(content))
    return F.when(inside, F.lower(F.hex(F.substring(content, (offset + 1).cast("int"), size.cast("int")))))


def hex_rows(content: Column, offset: int, size: int) -> Column:
    """Hex dump as an array of rows of 16 bytes: offset, byte pairs, printable characters."""
    starts = F.sequence(F.lit(offset), F.lit(max(offset, offset + size - 1)), F.lit(16))

    def row(start: Column) -> Column:
        part = F.substring(content, start + 1, F.least(F.lit(16), F.lit(offset + size) - start))
        pairs = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(....)", "$1 "))
        return F.concat(F.lower(F.lpad(F.hex(start.cast("long")), 8, "0")), F.lit(": "), F.rpad(pairs, 40, " "), F.lit(" "), fourcc_text(part, "."))

    return F.when(F.lit(offset + size) <= F.octet_length(content), F.transform(starts, row))
