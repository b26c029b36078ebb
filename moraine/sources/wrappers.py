"""Transport wrappers whose payload must be decoded first: BinHex 4.0."""

from __future__ import annotations

import binascii
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from moraine.functions import vocab
from moraine.functions.names import decode_name
from moraine.sources.detect import BINHEX_MARK, FIELDS, detect

#: Fixed value: the 64 characters of BinHex in order of their number.
ALPHABET = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
_BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TO_BASE64 = bytes.maketrans(ALPHABET, _BASE64)
_OTHERS = bytes(sorted(set(range(256)) - set(ALPHABET)))


@dataclass
class BinHex:
    status: str
    name: str = ""
    finder_type: bytes = b"\0\0\0\0"
    finder_creator: bytes = b"\0\0\0\0"
    finder_flags: int = 0
    data: bytes = b""
    resource: bytes = b""


def _expanded(body: bytes) -> bytes:
    """Six bits a character, then the repeats that 0x90 marks."""
    coded = body.translate(_TO_BASE64, _OTHERS)
    bits = len(coded) * 6 // 8
    packed = binascii.a2b_base64(coded + b"A" * (-len(coded) % 4))[:bits]
    out, at = bytearray(), 0
    while at < len(packed):
        mark = packed.find(b"\x90", at)
        if mark < 0:
            out += packed[at:]
            break
        out += packed[at:mark]
        if mark + 1 >= len(packed):
            break
        count = packed[mark + 1]
        if count == 0:
            out.append(0x90)
        elif out:
            out += out[-1:] * (count - 1)
        at = mark + 2
    return bytes(out)


def decode_binhex(content: bytes) -> BinHex:
    """Header and both forks; any wrong checksum is ``checksum``, any other defect ``bad-format``."""
    mark = content.find(BINHEX_MARK)
    if mark < 0:
        return BinHex(vocab.UNSUPPORTED)
    line = min((p for p in (content.find(b"\r", mark), content.find(b"\n", mark)) if p >= 0), default=len(content))
    rest = content[line:].lstrip(b"\r\n\t ")
    if not rest.startswith(b":"):
        return BinHex(vocab.UNSUPPORTED)
    body = _expanded(rest[1:].split(b":", 1)[0])
    if len(body) < 22 or not 1 <= body[0] <= 63 or len(body) < body[0] + 22:
        return BinHex(vocab.BAD_FORMAT)
    at = body[0] + 2
    number = lambda p, n: int.from_bytes(body[p : p + n], "big")
    out = BinHex(vocab.OK, decode_name(body[1 : at - 1], "none"), body[at : at + 4], body[at + 4 : at + 8], number(at + 8, 2))
    sizes = number(at + 10, 4), number(at + 14, 4)
    start = 0
    parts = []
    for size in (at + 18, *sizes):
        end = start + size
        if end + 2 > len(body):
            return BinHex(vocab.BAD_FORMAT)
        if binascii.crc_hqx(body[start:end], 0) != number(end, 2):
            return BinHex(vocab.CHECKSUM)
        parts.append(body[start:end])
        start = end + 2
    out.data, out.resource = parts[1], parts[2]
    return out


_BINHEX = T.StructType(
    [T.StructField(n, t) for n, t in (("status", T.StringType()), ("name", T.StringType()), ("finder_type", T.BinaryType()), ("finder_creator", T.BinaryType()), ("data", T.BinaryType()), ("resource", T.BinaryType()))]
)


@F.arrow_udf(_BINHEX)
def _decoded(contents: pa.Array) -> pa.Array:
    files = [None if c is None else decode_binhex(c) for c in contents.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([getattr(f, field.name, None) for f in files], to_arrow_type(field.dataType)) for field in _BINHEX.fields],
        names=_BINHEX.names,
    )


def open_archives(archives: DataFrame, decode_binhex_files: bool = True) -> DataFrame:
    """The archives with their detection and ``resource``, the bytes of the wrapper's resource fork.

    BinHex files are decoded and their data fork detected in their place, as ``content``, with wrapper, fork map and finder fields of the BinHex
    header. With ``decode_binhex_files`` off they stay unsupported. All in one pass; only BinHex files reach Python.
    """
    found = detect(archives)
    inside = F.col("resource_fork.present") & (F.col("resource_fork.offset") + F.col("resource_fork.size") <= F.octet_length("content"))
    resource = F.when(inside, F.substring("content", (F.col("resource_fork.offset") + 1).cast("int"), F.col("resource_fork.size").cast("int"))).otherwise(F.unhex(F.lit("")))
    found = found.withColumn("resource", resource)
    if not decode_binhex_files:
        return found
    coded = F.col("wrapper") == "binhex"
    outer = found.select(*archives.columns, F.struct(*FIELDS, "resource").alias("_outer"), _decoded(F.when(coded, F.col("content"))).alias("_hqx"))
    inner = detect(outer.withColumn("_inner", F.col("_hqx.data")).withColumn("_inner_name", F.lit("")), "_inner", "_inner_name")
    ok, none = F.col("_hqx.status") == vocab.OK, F.lit(0).cast("long")
    fork = lambda c: F.struct((F.octet_length(c) > 0).alias("present"), none.alias("offset"), F.octet_length(c).cast("long").alias("size"))
    status = F.when(ok, F.when(F.col("supported"), vocab.OK).otherwise(vocab.UNSUPPORTED)).otherwise(F.col("_hqx.status"))
    of_binhex = {
        "status": status,
        "exit_code": vocab.exit_code(status),
        "wrapper": F.lit("binhex"),
        "format": F.when(ok, F.col("format")).otherwise("unknown"),
        "supported": ok & F.col("supported"),
        "payload_offset": F.when(ok, F.col("payload_offset")).otherwise(none),
        "payload_size": F.when(ok, F.col("payload_size")).otherwise(none),
        "data_fork": fork(F.col("_hqx.data")),
        "resource_fork": fork(F.col("_hqx.resource")),
        "finder_type": F.col("_hqx.finder_type"),
        "finder_creator": F.col("_hqx.finder_creator"),
        "macbinary_version": F.lit(0),
        "binhex_name": F.when(ok, F.col("_hqx.name")),
        "resource": F.col("_hqx.resource"),
    }
    is_binhex = F.col("_hqx.status").isNotNull()
    content = F.when(is_binhex, F.col("_hqx.data")).otherwise(F.col("content")).alias("content")
    return inner.select(
        *[content if c == "content" else F.col(c) for c in archives.columns],
        *[F.when(is_binhex, of_binhex[f]).otherwise(F.col(f"_outer.{f}")).alias(f) for f in (*FIELDS, "resource")],
    )
