"""Fork payloads: slice, decrypt, decompress and check, in one pass over the archives and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moraine.functions import vocab
from moraine.functions.native import clean_selector, crc16_ibm_bytes
from moraine.operators import codecs, crypto
from moraine.operators import tables as fixed
from moraine.sources.parse import Entry, Fork, parse, rows_of

PAYLOAD_FIELDS = [
    T.StructField("entry_index", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("fork", T.StringType()),
    T.StructField("method", T.IntegerType()),
    T.StructField("method_name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("compressed_size", T.LongType()),
    T.StructField("encrypted", T.BooleanType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_size", T.LongType()),
    T.StructField("crc16_expected", T.IntegerType()),
    T.StructField("crc16_actual", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("file_type", T.BinaryType()),
    T.StructField("creator", T.BinaryType()),
    T.StructField("finder_flags", T.IntegerType()),
    T.StructField("create_time_mac", T.LongType()),
    T.StructField("modify_time_mac", T.LongType()),
]


@dataclass(frozen=True)
class Tables:
    """Fixed values of the formats, the reference's unless others are given: predefined code sets of method 13, gaps of method 15, boxes of the classic cipher."""

    code_sets: Sequence = fixed.CODE_SETS
    gaps: Sequence[int] = fixed.GAPS
    boxes: Sequence[Sequence[int]] = fixed.BOXES


def _plain(content: bytes, fork: Fork, password: str | None, tables: Tables) -> tuple[str, bytes]:
    """Status and compressed bytes after decryption."""
    end = fork.offset + fork.compressed_size
    if end > len(content):
        return vocab.BAD_FORMAT, b""
    packed = content[fork.offset : end]
    if not fork.encrypted:
        return vocab.OK, packed
    if password is None:
        return vocab.PASSWORD_REQUIRED, b""
    if fork.encryption == "sit5-rc4":
        found = crypto.v5_decrypt(password, fork.archive_hash, fork.entry_key, packed)
        return (vocab.PASSWORD_BAD, b"") if found is None else (vocab.OK, found)
    if fork.encryption == "classic-des" and tables.boxes:
        cipher = crypto.ClassicCipher(tables.boxes)
        key = cipher.file_key(password.encode(), fork.mkey, fork.entry_key)
        if key is None:
            return vocab.PASSWORD_BAD, b""
        try:
            return vocab.OK, cipher.stream(key, packed, fork.classic_padding)
        except codecs.BadData:
            return vocab.BAD_FORMAT, b""
    return vocab.UNSUPPORTED, b""


def decode_fork(content: bytes, fork: Fork, password: str | None = None, verify_crc: bool = True, tables: Tables = Tables()) -> tuple[str, bytes | None, int | None]:
    """(status, payload, CRC of the payload); no payload where it can't be had, the payload with status ``checksum`` where it is wrong."""
    status, packed = _plain(content, fork, password, tables)
    if status != vocab.OK:
        return status, None, None
    try:
        payload = codecs.decode(fork.method, packed, fork.size, fork.version5, tables.code_sets, tables.gaps)
    except codecs.Unsupported:
        return vocab.UNSUPPORTED, None, None
    except codecs.BadData:
        return vocab.BAD_FORMAT, None, None
    crc = crc16_ibm_bytes(payload)
    wrong = verify_crc and fork.method & 0x0F != 15 and crc != fork.crc16
    return vocab.CHECKSUM if wrong else vocab.OK, payload, crc


def is_selected(path: str, selectors: Sequence[str] | None) -> bool:
    if not selectors:
        return True
    return any(s and (path == s or path.startswith(s + "/")) for s in map(clean_selector, selectors))


def payloads(
    opened: DataFrame,
    password: str | None = None,
    selectors: Sequence[str] | None = None,
    forks: Sequence[str] = ("data", "resource"),
    verify_crc: bool = True,
    normalization: str = "nfc",
    tables: Tables = Tables(),
    marks: Sequence[str] = (),
) -> DataFrame:
    """One row for each present fork of the selected members, with its payload and status and the member's finder information; errors are statuses and never end the job.

    With "folder" in ``marks`` each folder has a row as well, with "file" each file one after its forks; they hold no payload and ``fork`` says which they are.
    An archive's rows stand together, in its order.

    Selectors, forks and names are applied before anything is decoded. An archive that can't be opened or parsed has one row
    with its status and no member.
    """
    for fork in forks:
        vocab.check_choice("fork", fork, ("data", "resource"))
    for mark in marks:
        vocab.check_choice("mark", mark, ("folder", "file"))
    vocab.check_choice("normalization", normalization, vocab.NORMALIZATIONS)
    schema = T.StructType([T.StructField("archive_id", opened.schema["archive_id"].dataType), *PAYLOAD_FIELDS])
    arrow = to_arrow_schema(schema)

    def of(archive: object, i: int, entry: Entry, content: bytes) -> Iterator[dict]:
        finder = {"archive_id": archive, "entry_index": i, "path": entry.path, "file_type": entry.file_type, "creator": entry.creator, "finder_flags": entry.finder_flags, "create_time_mac": entry.create_time_mac, "modify_time_mac": entry.modify_time_mac}
        for name, fork in (("data", entry.data), ("resource", entry.resource)):
            if name in forks and fork.present and not entry.is_dir:
                status, payload, crc = decode_fork(content, fork, password, verify_crc, tables)
                yield finder | {
                    "fork": name, "method": fork.method, "method_name": vocab.method_name(fork.method, fork.version5), "size": fork.size, "compressed_size": fork.compressed_size,
                    "encrypted": fork.encrypted, "payload": payload, "payload_size": None if payload is None else len(payload), "crc16_expected": fork.crc16, "crc16_actual": crc, "status": status,
                }
        mark = "folder" if entry.is_dir else "file"
        if mark in marks:
            yield finder | {"fork": mark, "status": vocab.OK}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, status, format_, base, resource in rows_of(batch):
                out, held = [], 0
                found, entries = (status, []) if status != vocab.OK else parse(content, format_, base, resource, normalization)
                if found != vocab.OK:
                    out.append({"archive_id": archive, "status": found})
                for i, entry in enumerate(entries):
                    if not is_selected(entry.path, selectors):
                        continue
                    for row in of(archive, i, entry, content):
                        out.append(row)
                        held += row.get("payload_size") or 0
                    if held > 8 << 20 or len(out) > 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = opened.select("archive_id", "content", "status", "format", "payload_offset", "resource")
    return rows.mapInArrow(run, schema)


def manifest(decoded: DataFrame) -> DataFrame:
    """(archive_id, path, size, sha256) of every file that extraction writes with resource forks as ``.rsrc``."""
    path = F.when(F.col("fork") == "resource", F.concat("path", F.lit(".rsrc"))).otherwise(F.col("path"))
    return decoded.filter("status = 'ok' and fork in ('data', 'resource')").select("archive_id", path.alias("path"), F.col("payload_size").alias("size"), F.sha2("payload", 256).alias("sha256"))
