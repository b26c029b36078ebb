"""Detection of wrapper and archive format, by one cascade of native expressions; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions import native, vocab

# Fixed values of the formats.
CLASSIC_MAGIC, CLASSIC_MARK = b"SIT!", b"rLau"
V5_MAGIC = b"StuffIt (c)1997-"
SITX_MAGIC = b"StuffIt!"
BINHEX_MARK = b"(This file must be converted with BinHex"
APPLE_MAGICS = {"applesingle": (0x00051600, 0x00160500), "appledouble": (0x00051607, 0x07160500)}
APPLE_VERSIONS = (0x00020000, 0x00000200)

FORK_MAP = "struct<present:boolean,offset:long,size:long>"
FIELDS = ("status", "exit_code", "wrapper", "format", "supported", "payload_offset", "payload_size", "data_fork", "resource_fork", "finder_type", "finder_creator", "macbinary_version", "binhex_name")


def read_archives(spark, path: str, glob: str | None = None, max_length: int | None = None) -> DataFrame:
    """(archive_id, name, content) of every file below a path, which is also the id."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if max_length is not None:
        files = files.filter(F.col("length") <= max_length)
    return files.select(F.col("path").alias("archive_id"), native.basename(F.col("path")).alias("name"), "content")


def _literal(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def _starts(content: Column, offset: Column, magic: bytes) -> Column:
    return F.substring(content, (offset + 1).cast("int"), F.lit(len(magic))) == _literal(magic)


def _format_at(content: Column, offset: Column) -> Column:
    """Archive format whose signature is at the offset, else unknown."""
    length = F.octet_length(content)
    classic = _starts(content, offset, CLASSIC_MAGIC) & _starts(content, offset + 10, CLASSIC_MARK)
    return (
        F.when(classic & (length >= offset + 14), "sit-classic")
        .when(_starts(content, offset, V5_MAGIC) & (length >= offset + 100), "sit5")
        .when(_starts(content, offset, SITX_MAGIC), "sitx")
        .otherwise("unknown")
    )


def _fork(present: Column, offset: Column, size: Column) -> Column:
    return F.struct(present.alias("present"), offset.cast("long").alias("offset"), size.cast("long").alias("size"))


def detect(archives: DataFrame, content_col: str = "content", name_col: str = "name") -> DataFrame:
    """The rows with the detection's columns; null and empty content is bad-format."""
    c, name = F.col(content_col), F.coalesce(F.col(name_col), F.lit(""))
    size = F.octet_length(c).cast("long")
    zero = F.lit(0).cast("long")
    raw = _format_at(c, zero)

    # MacBinary: a header of 128 bytes, then the forks, each padded to 128.
    name_length = native.be(c, 1, 1)
    name_bytes = F.substring(c, F.lit(3), F.least(F.coalesce(name_length, F.lit(0)), F.lit(63)).cast("int"))
    data_size, resource_size = native.be(c, 83, 4), native.be(c, 87, 4)
    zeros = (native.be(c, 0, 1) == 0) & (native.be(c, 74, 1) == 0) & (native.be(c, 82, 1) == 0)
    mac = F.coalesce((size >= 128) & zeros & name_length.between(1, 63) & ~_has_nul(name_bytes) & (data_size <= size - 128), F.lit(False))
    mac_version = F.when(_starts(c, F.lit(102), b"mBIN"), 3).when(native.crc16_ccitt(F.substring(c, F.lit(1), F.lit(124))) == native.be(c, 124, 2), 2).otherwise(1)

    # AppleSingle and AppleDouble: descriptors of forks; of several with one id the last counts.
    magic, version = native.be(c, 0, 4), native.be(c, 4, 4)
    single, double = magic.isin(*APPLE_MAGICS["applesingle"]), magic.isin(*APPLE_MAGICS["appledouble"])
    apple = F.coalesce(version.isin(*APPLE_VERSIONS) & (single | double), F.lit(False))
    big = magic.isin(0x00051600, 0x00051607)

    def number(offset, n: int) -> Column:
        digits = F.hex(F.substring(c, (offset + 1).cast("int"), F.lit(n)))
        turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
        value = F.conv(F.when(big, digits).otherwise(turned), 16, 10).cast("long")
        return F.when(F.length(digits) == 2 * n, value)

    count = F.coalesce(number(F.lit(24), 2), F.lit(0).cast("long"))
    readable = F.greatest(F.least(count, F.floor((size - 26) / 12)), F.lit(0)).cast("int")
    places = F.when(apple & (readable > 0), F.sequence(F.lit(0), readable - 1)).otherwise(F.array().cast("array<int>"))
    descriptors = F.transform(places, lambda i: F.struct(number(i * 12 + 26, 4).alias("id"), number(i * 12 + 30, 4).alias("offset"), number(i * 12 + 34, 4).alias("size")))

    df = archives.withColumn("_raw", raw).withColumn("_mac", mac).withColumn("_apple", apple).withColumn("_parts", descriptors)
    df = df.withColumn("_data", F.try_element_at(F.filter("_parts", lambda p: p["id"] == 1), F.lit(-1))).withColumn("_rsrc", F.try_element_at(F.filter("_parts", lambda p: p["id"] == 2), F.lit(-1)))
    # The last data descriptor within the file that holds a known format gives the payload.
    held = F.filter(F.transform(F.filter("_parts", lambda p: (p["id"] == 1) & (p["offset"] + p["size"] <= size)), lambda p: F.struct(_format_at(c, p["offset"]).alias("format"), p["offset"].alias("offset"), p["size"].alias("size"))), lambda p: p["format"] != "unknown")
    df = df.withColumn("_held", F.try_element_at(held, F.lit(-1))).withColumn("_kind", _kind(size, name, c))

    kind = F.col("_kind")
    wrapper = F.when(kind == "apple", F.when(single, "applesingle").otherwise("appledouble")).when(kind == "empty", "unknown").otherwise(kind)
    format_ = F.when(kind == "raw", F.when(F.col("_raw").isin("sit-classic", "sit5"), F.col("_raw")).otherwise("sitx")).when(kind == "macbinary", _format_at(c, F.lit(128).cast("long"))).when(kind == "apple", F.coalesce("_held.format", F.lit("unknown"))).otherwise("unknown")
    df = df.withColumn("wrapper", wrapper).withColumn("format", format_).withColumn("supported", F.col("format").isin("sit-classic", "sit5"))
    df = df.withColumn("status", F.when(kind == "empty", vocab.BAD_FORMAT).when(F.col("supported"), vocab.OK).otherwise(vocab.UNSUPPORTED))
    resource_offset = F.lit(128) + native.round_up_128(data_size)
    df = df.select(
        *archives.columns,
        "status",
        vocab.exit_code(F.col("status")).alias("exit_code"),
        "wrapper",
        "format",
        "supported",
        F.when(kind == "macbinary", F.lit(128).cast("long")).when(kind == "apple", F.coalesce("_held.offset", zero)).otherwise(zero).alias("payload_offset"),
        F.when(kind == "macbinary", data_size).when(kind == "apple", F.coalesce("_held.size", zero)).when(kind.isin("raw", "pe-sfx"), size).otherwise(zero).alias("payload_size"),
        F.when(kind == "raw", _fork(F.lit(True), zero, zero))
        .when(kind == "macbinary", _fork(data_size > 0, F.lit(128), data_size))
        .when((kind == "apple") & F.col("_data").isNotNull(), _fork(F.lit(True), F.col("_data.offset"), F.col("_data.size")))
        .otherwise(_fork(F.lit(False), zero, zero))
        .alias("data_fork"),
        F.when(kind == "macbinary", _fork(resource_size > 0, resource_offset, resource_size))
        .when((kind == "apple") & F.col("_rsrc").isNotNull(), _fork(F.lit(True), F.col("_rsrc.offset"), F.col("_rsrc.size")))
        .otherwise(_fork(F.lit(False), zero, zero))
        .alias("resource_fork"),
        F.when(kind == "macbinary", F.substring(c, F.lit(66), F.lit(4))).otherwise(F.unhex(F.lit("00000000"))).alias("finder_type"),
        F.when(kind == "macbinary", F.substring(c, F.lit(70), F.lit(4))).otherwise(F.unhex(F.lit("00000000"))).alias("finder_creator"),
        F.when(kind == "macbinary", mac_version).otherwise(F.lit(0)).alias("macbinary_version"),
        F.lit(None).cast("string").alias("binhex_name"),
    )
    return df


def _has_nul(value: Column) -> Column:
    return F.hex(value).rlike("^(..)*00")


def _kind(size: Column, name: Column, c: Column) -> Column:
    """Which branch of the cascade a row takes."""
    binhex = (size >= 45) & (F.position(_literal(BINHEX_MARK), F.substring(c, F.lit(1), F.lit(256))) > 0)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when((F.col("_raw") != "unknown") | F.lower(name).endswith(".sitx"), "raw")
        .when(F.col("_mac"), "macbinary")
        .when(F.col("_apple"), "apple")
        .when(_starts(c, F.lit(0), b"MZ"), "pe-sfx")
        .when(binhex, "binhex")
        .otherwise("unknown")
    )
