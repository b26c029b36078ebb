"""Writing archives: create, add and delete as relational rewrites of member tables.

A member table has archive_id, path and content (null for a folder), and optionally file_type, creator, create_time and
modify_time (seconds since 1970). Only stored data forks are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from moraine.functions import native
from moraine.sources.parse import CLASSIC_ENTRY, CLASSIC_HEADER, FOLDER_END, FOLDER_START

#: What members get that name no type and creator.
DEFAULT_TYPE, DEFAULT_CREATOR = "TEXT", "KAHL"
#: Place of the content's checksum in a member's header, and the header's length without its own.
CRC_AT, HEADER = 102, 110
_M32 = (1 << 32) - 1
_FIRST, _LAST = "\x01", "\U0010ffff"


def _u32(value: Column) -> Column:
    return native.big_endian(F.least(value.cast("long"), F.lit(_M32).cast("long")), 4)


def _u16(value: Column) -> Column:
    return native.big_endian(F.least(value.cast("long"), F.lit(0xFFFF).cast("long")), 2)


def _fourcc(code: Column, default: str) -> Column:
    given = F.encode(code, "ISO-8859-1") if not isinstance(code, str) else code
    return F.when(F.octet_length(given) == 4, given).otherwise(F.encode(F.lit(default), "ISO-8859-1"))


def _header(method: Column) -> Column:
    """The first 110 bytes of a member or a folder's marker, without the content's checksum, which stands at CRC_AT."""
    name = F.encode(F.col("name"), "ISO-8859-1")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    body = F.concat(
        method, method, native.big_endian(F.octet_length(name), 1), name, F.unhex(F.repeat(F.lit("00"), F.lit(63) - F.octet_length(name))),
        F.col("type_code"), F.col("creator_code"), zeros(2), _u32(F.col("created")), _u32(F.col("modified")), _u32(F.lit(0)), _u32(F.col("size")), _u32(F.lit(0)), _u32(F.col("packed")), zeros(10),
    )
    return body


def create(members: DataFrame, default_type: str = DEFAULT_TYPE, default_creator: str = DEFAULT_CREATOR, partitions: int | None = None) -> DataFrame:
    """(archive_id, name, content): one classic archive for each archive_id, members in byte order of their names, folders first opened.

    Empty paths are left out. Folders follow from the members' paths; a row with null content makes a folder of its own. Times up to 1970 are
    written as zero. Names are cut to 31 bytes and unusual bytes replaced. An archive is one value: its members are sorted together and joined as they
    stream by, so a task holds one archive; archives are built in parallel. ``partitions`` fixes the number of tasks, and so what the next steps get at once;
    without it partitions are joined up to the session's advised size.
    """
    for code in (default_type, default_creator):
        if len(code.encode("ISO-8859-1")) != 4:
            raise ValueError("type and creator have four bytes")
    have = set(members.columns)
    optional = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    rows = members.select(
        "archive_id", F.regexp_replace("path", "/+$", "").alias("path"), "content", _fourcc(optional("file_type", "string"), default_type).alias("type_code"), _fourcc(optional("creator", "string"), default_creator).alias("creator_code"),
        native.unix_to_mac(F.coalesce(optional("create_time", "long"), F.lit(0))).alias("created"), native.unix_to_mac(F.coalesce(optional("modify_time", "long"), F.lit(0))).alias("modified"),
    ).filter("path <> ''")
    files = rows.filter("content is not null").withColumn("size", F.octet_length("content").cast("long"))
    # Every folder above a member, with the bytes that its members' records take.
    parts = F.split("path", "/")
    depth = F.when(F.col("content").isNull(), F.size(parts)).otherwise(F.size(parts) - 1)
    above = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    held = rows.select("archive_id", F.explode(above).alias("folder"), F.when(F.col("content").isNull(), 0).otherwise(CLASSIC_ENTRY + F.octet_length("content")).cast("long").alias("bytes"))
    folders = held.groupBy("archive_id", "folder").agg(F.sum("bytes").alias("bytes"))
    # A folder also holds two markers for each folder below it.
    upper = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), i), "/"))
    below = folders.select("archive_id", F.col("folder").alias("own"), F.explode(upper).alias("folder")).filter("own <> folder").groupBy("archive_id", "folder").agg((F.count("*") * 2 * CLASSIC_ENTRY).alias("markers"))
    folders = folders.join(below, ["archive_id", "folder"], "left").withColumn("bytes", F.col("bytes") + F.coalesce("markers", F.lit(0)))

    code = lambda c: F.encode(F.lit(c), "ISO-8859-1")
    zero = F.lit(0).cast("long")
    folder_rows = folders.select("archive_id", F.col("folder").alias("path"), F.explode(F.array(F.lit(FOLDER_START), F.lit(FOLDER_END))).alias("method"), "bytes")
    start = F.col("method") == FOLDER_START
    folder_rows = folder_rows.select(
        "archive_id", "path", "method", F.unhex(F.lit("")).alias("content"), code(default_type).alias("type_code"), code(default_creator).alias("creator_code"), zero.alias("created"), zero.alias("modified"),
        F.when(start, F.col("bytes")).otherwise(zero).alias("size"), F.when(start, F.col("bytes") + CLASSIC_ENTRY).otherwise(zero).alias("packed"),
        F.concat(F.replace(F.col("path"), F.lit("/"), F.lit(_FIRST)), F.when(start, F.lit(_FIRST)).otherwise(F.lit(_FIRST + _LAST))).alias("place"),
    )
    file_rows = files.select(
        "archive_id", "path", F.lit(0).alias("method"), "content", "type_code", "creator_code", "created", "modified", "size", F.col("size").alias("packed"),
        F.replace(F.col("path"), F.lit("/"), F.lit(_FIRST)).alias("place"),
    )
    everything = file_rows.unionByName(folder_rows).withColumn("name", native.sanitized_name(native.basename(F.col("path"))))
    everything = everything.select("archive_id", "place", _header(native.big_endian(F.col("method"), 1)).alias("header"), "content")
    kind = members.schema["archive_id"].dataType
    arrow = pa.schema([("archive_id", to_arrow_type(kind)), ("name", pa.string()), ("content", pa.binary())])

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        key = None

        def close() -> pa.RecordBatch:
            size = CLASSIC_HEADER + sum(map(len, records))
            head = b"SIT!" + min(len(records) // 2, 0xFFFF).to_bytes(2, "big") + min(size, _M32).to_bytes(4, "big") + b"rLau" + bytes([1]) + bytes(7)
            whole = b"".join([head, *records])
            records.clear()
            return pa.RecordBatch.from_pydict({"archive_id": [key], "name": [f"{key}.sit"], "content": [whole]}, schema=arrow)

        for batch in batches:
            for archive, header, content in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if records and archive != key:
                    yield close()
                key = archive
                header = header[:CRC_AT] + native.crc16_ibm_bytes(content).to_bytes(2, "big") + header[CRC_AT + 2 :]
                records += (header + native.crc16_ibm_bytes(header).to_bytes(2, "big"), content)
        if records:
            yield close()

    placed = everything.repartition("archive_id") if partitions is None else everything.repartition(partitions, "archive_id")
    return placed.sortWithinPartitions("archive_id", "place").mapInArrow(seal, f"archive_id {kind.simpleString()}, name string, content binary")


def members_of(decoded: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Member table of decoded archives (data forks and folders), for a rewrite.

    Folders come from ``entries``, or from the rows that ``payloads`` has for them with the mark "folder", which spares reading the archives twice.
    """
    data = decoded.filter("status = 'ok' and fork in ('data', 'folder')").select("archive_id", "path", F.col("payload").alias("content"))
    if entries is None:
        return data
    folders = entries.filter("is_dir").select("archive_id", "path", F.lit(None).cast("binary").alias("content"))
    return data.unionByName(folders)


def writable(entries: DataFrame, opened: DataFrame) -> DataFrame:
    """(archive_id, writable): raw classic archives without resource forks and encrypted members may be rewritten."""
    bad = F.coalesce(F.col("resource_fork.present") | F.col("data_fork.encrypted") | F.col("resource_fork.encrypted"), F.lit(False)) | (F.col("parse_status") != "ok")
    state = entries.groupBy("archive_id").agg(F.bool_or(bad).alias("bad"))
    found = opened.select("archive_id", ((F.col("wrapper") == "raw") & (F.col("format") == "sit-classic")).alias("raw")).join(state, "archive_id", "left")
    return found.select("archive_id", (F.col("raw") & ~F.coalesce("bad", F.lit(False))).alias("writable"))


def require_writable(entries: DataFrame, opened: DataFrame) -> None:
    """The gate before add and delete: an archive that may not be rewritten is an error."""
    refused = writable(entries, opened).filter("not writable").select("archive_id").limit(3).collect()
    if refused:
        raise ValueError(f"archives that cannot be rewritten, such as {', '.join(str(r[0]) for r in refused)}")


def add(members: DataFrame, new: DataFrame, update: bool = False) -> DataFrame:
    """The member table with the new members in place of old ones of the same path.

    With ``update`` an old member stays if its modify_time is not before the new one's. A path that is not a safe relative one is a ValueError.
    """
    if new.filter(~native.relative_entry(F.col("path"))).limit(1).count():
        raise ValueError("a path to add is not a safe relative path")
    keys = ["archive_id", "path"]
    if update:
        old_times = members.select(*keys, F.col("modify_time").alias("_old"))
        new = new.join(old_times, keys, "left").filter("_old is null or modify_time is null or _old < modify_time").drop("_old")
    return members.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(members: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """The member table without the selected paths and what lies below them; paths that are not there are no error."""
    from moraine.functions.native import selected

    for path in selectors:
        if not path or path.startswith("/") or "\\" in path or ":" in path or any(p in ("", ".", "..") for p in path.split("/")):
            raise ValueError(f"not a safe relative path: {path!r}")
    return members.filter(~selected(F.col("path"), list(selectors)))


def add_counters(members: DataFrame, new: DataFrame, update: bool = False) -> DataFrame:
    """(archive_id, added, updated, skipped) of what ``add`` would do."""
    keys = ["archive_id", "path"]
    times = members.columns
    old = members.select(*keys, (F.col("modify_time") if "modify_time" in times else F.lit(None).cast("long")).alias("_old"), F.lit(True).alias("_there"))
    both = new.join(old, keys, "left")
    kept = F.lit(update) & F.coalesce(F.col("_old") >= F.col("modify_time"), F.lit(False)) if "modify_time" in new.columns else F.lit(False)
    there = F.coalesce("_there", F.lit(False))
    return both.groupBy("archive_id").agg(F.count_if(~there).alias("added"), F.count_if(there & ~kept).alias("updated"), F.count_if(there & kept).alias("skipped"))


def delete_counters(members: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """(archive_id, deleted, kept) of what ``delete`` would do."""
    gone = native.selected(F.col("path"), list(selectors))
    return members.groupBy("archive_id").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def free_name(path: str, used: set[str], next_: dict[str, int]) -> str:
    """The path, or with the first of .1, .2 … that no name has; it is in use from then on. ``next_`` keeps where to go on for each path."""
    name, n = path, next_.get(path, 1)
    while name in used:
        name, n = f"{path}.{n}", n + 1
    next_[path] = n
    used.add(name)
    return name


def rename_collisions(paths: DataFrame, order: str = "event_idx") -> DataFrame:
    """Adds ``target``: the path, or the first of .1, .2 … behind it that no earlier row has.

    Names can only clash with those of the same path without its numbers at the end; the rows of such a family stream by in order.
    """
    family = F.regexp_replace("path", r"(\.[0-9]+)+$", "")
    rows = paths.withColumn("target", family).repartition("archive_id", "target").sortWithinPartitions("archive_id", "target", order)
    columns = rows.columns
    at = [columns.index(c) for c in ("archive_id", "target", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, next_ = None, set(), {}
        for batch in batches:
            names = []
            for *now, path in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if now != key:
                    key, used, next_ = now, set(), {}
                names.append(free_name(path, used, next_))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns) - 1)), pa.array(names, pa.string())], names=columns)

    return rows.mapInArrow(run, rows.schema)
