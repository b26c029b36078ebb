"""Archive directories: the members of classic and version 5 archives, one row each."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moraine.functions import vocab
from moraine.functions.names import decode_name

# Fixed values of the formats.
CLASSIC_HEADER, CLASSIC_ENTRY = 22, 112
FOLDER_START, FOLDER_END, FOLDER_DEPTH = 32, 33, 64
CLASSIC_KEY = 16
V5_HEADER, V5_ENTRY, V5_ENTRY_MAGIC = 100, 48, 0xA5A5A5A5
#: Place of the data fork's checksum in an entry.
V5_CRC_AT = 42
V5_HASH = 5
V5_SENTINEL = 0xFFFFFFFF

FORK = T.StructType(
    [
        T.StructField("present", T.BooleanType()),
        T.StructField("offset", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("compressed_size", T.LongType()),
        T.StructField("method", T.IntegerType()),
        T.StructField("method_name", T.StringType()),
        T.StructField("crc16", T.IntegerType()),
        T.StructField("encrypted", T.BooleanType()),
        T.StructField("encryption", T.StringType()),
        T.StructField("classic_padding", T.IntegerType()),
        T.StructField("mkey", T.BinaryType()),
        T.StructField("entry_key", T.BinaryType()),
        T.StructField("archive_hash", T.BinaryType()),
    ]
)
ENTRY_FIELDS = [
    T.StructField("entry_index", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("kind", T.StringType()),
    T.StructField("header_offset", T.LongType()),
    T.StructField("file_type", T.BinaryType()),
    T.StructField("creator", T.BinaryType()),
    T.StructField("finder_flags", T.IntegerType()),
    T.StructField("create_time_mac", T.LongType()),
    T.StructField("modify_time_mac", T.LongType()),
    T.StructField("data_fork", FORK),
    T.StructField("resource_fork", FORK),
    T.StructField("parse_status", T.StringType()),
]


class Defect(Exception):
    """Ends the parse of one archive with a status."""


@dataclass
class Fork:
    present: bool = False
    offset: int = 0
    size: int = 0
    compressed_size: int = 0
    method: int = 0
    crc16: int = 0
    encrypted: bool = False
    encryption: str = "none"
    classic_padding: int = 0
    mkey: bytes | None = None
    entry_key: bytes | None = None
    archive_hash: bytes | None = None
    version5: bool = False

    def row(self) -> dict:
        found = {f.name: getattr(self, f.name, None) for f in FORK.fields}
        found["method_name"] = vocab.method_name(self.method, self.version5)
        if self.encrypted and self.encryption == "none":
            found["encryption"] = "unknown"
        return found


@dataclass
class Entry:
    path: str
    is_dir: bool
    header_offset: int
    file_type: bytes = b"\0\0\0\0"
    creator: bytes = b"\0\0\0\0"
    finder_flags: int = 0
    create_time_mac: int = 0
    modify_time_mac: int = 0
    data: Fork = field(default_factory=Fork)
    resource: Fork = field(default_factory=Fork)


def _join(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def classic_entries(content: bytes, base: int, resource: bytes, normalization: str = "nfc") -> list[Entry]:
    """Members in archive order, folders by their start markers."""
    if len(content) < base + CLASSIC_HEADER:
        raise Defect(vocab.BAD_FORMAT)
    length = int.from_bytes(content[base + 6 : base + 10], "big")
    end = base + length if CLASSIC_HEADER <= length <= len(content) - base else len(content)
    mkey = find_mkey(resource)
    out: list[Entry] = []
    folders: list[str] = []
    at = base + CLASSIC_HEADER
    while end - at >= CLASSIC_ENTRY:
        rmethod, dmethod, name_length = content[at : at + 3]
        marks = (dmethod & 0x6F, rmethod & 0x6F)
        if FOLDER_END in marks and marks[0] != FOLDER_START:
            if folders:
                folders.pop()
            at += CLASSIC_ENTRY
            continue
        name = decode_name(content[at + 3 : at + 3 + min(name_length, 31)], normalization)
        path = _join(folders[-1] if folders else "", name)
        file_type, creator, flags, created, modified, rsize, dsize, rpacked, dpacked, rcrc, dcrc, rpad, dpad = struct.unpack_from(">4s4sH6I2H2B", content, at + 66)
        entry = Entry(path, FOLDER_START in marks, at, file_type, creator, flags, created, modified)
        out.append(entry)
        if entry.is_dir:
            if len(folders) < FOLDER_DEPTH:
                folders.append(path)
            at += CLASSIC_ENTRY
            continue
        start = at + CLASSIC_ENTRY
        entry.resource = Fork(rsize != 0, start, rsize, rpacked, rmethod & 0x7F, rcrc, bool(rmethod & 0x80), classic_padding=rpad)
        entry.data = Fork(dsize != 0 or rsize == 0, start + rpacked, dsize, dpacked, dmethod & 0x7F, dcrc, bool(dmethod & 0x80), classic_padding=dpad)
        for fork in (entry.resource, entry.data):
            stop = fork.offset + fork.compressed_size
            if fork.encrypted and fork.compressed_size >= CLASSIC_KEY and mkey and stop <= len(content):
                fork.encryption, fork.mkey, fork.entry_key = "classic-des", mkey, content[stop - CLASSIC_KEY : stop]
                fork.compressed_size -= CLASSIC_KEY
        at = start + rpacked + dpacked
    return out


def find_mkey(resource: bytes) -> bytes | None:
    """The eight bytes of resource ``MKey`` 0 of a resource fork."""
    try:
        data_at, map_at, data_size, map_size = struct.unpack_from(">4I", resource, 0)
        area = resource[map_at : map_at + map_size]
        data = resource[data_at : data_at + data_size]
        if len(area) != map_size or len(data) != data_size or map_size < 30:
            return None
        (types,) = struct.unpack_from(">H", area, 24)
        (last,) = struct.unpack_from(">H", area, types)
        for i in range(last + 1):
            kind, more, refs = struct.unpack_from(">4sHH", area, types + 2 + 8 * i)
            for j in range(more + 1 if kind == b"MKey" else 0):
                ident, _, place, _ = struct.unpack_from(">hHII", area, types + refs + 12 * j)
                if ident == 0:
                    place &= 0xFFFFFF
                    (size,) = struct.unpack_from(">I", data, place)
                    value = data[place + 4 : place + 12]
                    return value if size == 8 and len(value) == 8 else None
    except struct.error:
        return None
    return None


class _Reader:
    """Big-endian fields in order; running out is bad-format."""

    def __init__(self, content: bytes, at: int):
        self.content, self.at = content, at

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def take(self, n: int) -> bytes:
        part = self.content[self.at : self.at + n]
        if len(part) != n:
            raise Defect(vocab.BAD_FORMAT)
        self.at += n
        return part

    def key(self, wanted: bool) -> bytes | None:
        """A key of five bytes where one is wanted, and none elsewhere."""
        size = self.number(1)
        value = self.take(size)
        if size != (V5_HASH if wanted else 0):
            raise Defect(vocab.UNSUPPORTED)
        return value if wanted else None


def v5_entries(content: bytes, base: int, normalization: str = "nfc") -> list[Entry]:
    """Members in archive order; a folder's members name its offset. Any defect gives up the archive."""
    if len(content) - base < V5_HEADER:
        raise Defect(vocab.BAD_FORMAT)
    flags = content[base + 83]
    waiting, first = struct.unpack_from(">HI", content, base + 92)
    reader = _Reader(content, base + V5_HEADER + (14 if flags & 0x10 else 0))
    if flags & 0x20:
        reader.take(4)
    archive_hash = None
    if flags & 0x80:
        if reader.number(1) != V5_HASH:
            raise Defect(vocab.BAD_FORMAT)
        archive_hash = reader.take(V5_HASH)
    if flags & 0x40:
        reader.take(2)
    folders: dict[int, str] = {}
    out: list[Entry] = []
    at = base + first
    while waiting > 0:
        waiting -= 1
        if at > len(content) or len(content) - at < V5_ENTRY:
            raise Defect(vocab.BAD_FORMAT)
        magic, version, _, header, _, kind = struct.unpack_from(">IBBHBB", content, at)
        created, modified, _, _, parent = struct.unpack_from(">5I", content, at + 10)
        name_length, _, dsize, dpacked, dcrc = struct.unpack_from(">2H2IH", content, at + 30)
        if magic != V5_ENTRY_MAGIC or header < V5_ENTRY or at + header > len(content):
            raise Defect(vocab.BAD_FORMAT)
        is_dir, encrypted = bool(kind & 0x40), bool(kind & 0x20)
        reader = _Reader(content, at + 46)
        data = Fork(size=dsize, compressed_size=dpacked, crc16=dcrc, encrypted=encrypted, version5=True)
        children = 0
        if is_dir:
            children = reader.number(2)
            if dsize == V5_SENTINEL:
                waiting += 1
                at += header
                continue
        else:
            data.method = reader.number(1)
            data.entry_key = reader.key(encrypted and dsize != 0)
        name = decode_name(reader.take(name_length), normalization)
        if reader.at < at + header:
            comment = reader.number(2)
            reader.take(2 + comment)
        meta = reader.number(2)
        reader.take(2)
        file_type, creator, finder = reader.take(4), reader.take(4), reader.number(2)
        reader.at += 22 if version == 1 else 18
        resource = Fork(present=bool(meta & 1), encrypted=encrypted, version5=True)
        if resource.present:
            resource.size, resource.compressed_size, resource.crc16 = reader.number(4), reader.number(4), reader.number(2)
            reader.take(2)
            resource.method = reader.number(1)
            resource.entry_key = reader.key(encrypted and resource.size != 0)
        entry = Entry(_join(folders.get(parent, ""), name), is_dir, at, file_type, creator, finder, created, modified)
        out.append(entry)
        if is_dir:
            folders.setdefault(at - base, entry.path)
            waiting += children
            at = reader.at
            continue
        resource.offset = reader.at
        data.offset = reader.at + resource.compressed_size
        data.present = dsize != 0 or not resource.present
        for fork in (data, resource):
            if encrypted and archive_hash and fork.entry_key:
                fork.encryption, fork.archive_hash = "sit5-rc4", archive_hash
        entry.data, entry.resource = data, resource
        at = data.offset + dpacked
    return out


def parse(content: bytes | None, format_: str, base: int, resource: bytes | None, normalization: str = "nfc") -> tuple[str, list[Entry]]:
    """Status and members of one archive; never raises for what its bytes hold."""
    try:
        if format_ == "sit-classic":
            return vocab.OK, classic_entries(content or b"", base, resource or b"", normalization)
        if format_ == "sit5":
            return vocab.OK, v5_entries(content or b"", base, normalization)
    except Defect as defect:
        return str(defect), []
    return vocab.UNSUPPORTED, []


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one by one, so that only one archive's bytes are copied out of it at a time."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def list_entries(opened: DataFrame, normalization: str = "nfc", selectors: list[str] | None = None) -> DataFrame:
    """One row for each member of the opened archives (see ``open_archives``); without payloads.

    An archive that can't be parsed has one row without a member and with its ``parse_status``.
    """
    vocab.check_choice("normalization", normalization, vocab.NORMALIZATIONS)
    kind = opened.schema["archive_id"].dataType
    schema = T.StructType([T.StructField("archive_id", kind), *ENTRY_FIELDS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for archive, content, status, format_, base, resource in rows_of(batch):
                found, entries = (status, []) if status != vocab.OK else parse(content, format_, base, resource, normalization)
                if found != vocab.OK:
                    out.append({"archive_id": archive, "parse_status": found})
                for i, e in enumerate(entries):
                    out.append(
                        {
                            "archive_id": archive, "entry_index": i, "path": e.path, "is_dir": e.is_dir, "kind": "directory" if e.is_dir else "file", "header_offset": e.header_offset, "file_type": e.file_type, "creator": e.creator,
                            "finder_flags": e.finder_flags, "create_time_mac": e.create_time_mac, "modify_time_mac": e.modify_time_mac, "data_fork": e.data.row(), "resource_fork": e.resource.row(), "parse_status": found,
                        }
                    )
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = opened.select("archive_id", "content", "status", "format", "payload_offset", "resource")
    found = rows.mapInArrow(run, schema)
    if selectors:
        from moraine.functions.native import selected

        found = found.filter(selected(F.col("path"), selectors))
    return found
