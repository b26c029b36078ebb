"""Extraction as a table: what would be written, in order, with its outcome; counters; sidecars; a sink."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.functions import native, vocab
from moraine.operators.decode import Tables, payloads
from moraine.operators.writer import free_name

#: Statuses that end an extraction.
FATAL = (vocab.BAD_FORMAT, vocab.CHECKSUM, vocab.PASSWORD_REQUIRED, vocab.PASSWORD_BAD, vocab.IO)


def appledouble(file_type: Column, creator: Column, flags: Column, resource: Column) -> Column:
    """Header with two descriptors, 32 bytes of finder information, resource bytes."""
    number = lambda x: native.big_endian(F.lit(x) if isinstance(x, int) else x, 4)
    head = F.concat(number(0x00051607), number(0x00020000), F.unhex(F.lit("00" * 16)), native.big_endian(F.lit(2), 2), number(9), number(50), number(32), number(2), number(82), number(F.octet_length(resource)))
    return F.concat(head, file_type, creator, native.big_endian(flags, 2), F.unhex(F.lit("00" * 22)), resource)


def finder_json(path: Column, file_type: Column, creator: Column, flags: Column, created: Column, modified: Column) -> Column:
    """Text of a finder sidecar; bytes of the path beyond ASCII are escaped one by one."""
    text = native.fourcc_json(F.encode(path, "UTF-8"))
    return F.concat(
        F.lit('{"path":"'), text, F.lit('","finder":{"type":"'), native.fourcc_json(file_type), F.lit('","creator":"'), native.fourcc_json(creator), F.lit('","flags":"'), native.crc_text(flags),
        F.lit('"},"mac_time":{"create":'), created.cast("string"), F.lit(',"modify":'), modified.cast("string"), F.lit("}}\n"),
    )


def plan(
    opened: DataFrame,
    password: str | None = None,
    selectors: Sequence[str] | None = None,
    forks: str = "skip",
    finder: str = "skip",
    collision: str = "skip",
    existing: DataFrame | None = None,
    on_error: str = "continue",
    verify_crc: bool = True,
    preserve_time: bool = True,
    normalization: str = "nfc",
    tables: Tables = Tables(),
) -> DataFrame:
    """(archive_id, event_idx, path, output, target, content, mtime, status, unsafe): one row for each file to write.

    ``output`` is data, rsrc, appledouble, native or finder. ``existing`` (archive_id, path) names files that are there before. With
    ``on_error="abort"`` what follows the first fatal status of an archive is left out, as when files are written one by one;
    "continue" decides each alone. ``native`` forks are unsupported here. Unsafe paths are bad-format. With ``collision="rename"`` a file gets the first
    free name, and its sidecars follow it.
    """
    vocab.check_choice("forks", forks, vocab.FORK_MODES)
    vocab.check_choice("finder", finder, vocab.FINDER_MODES)
    vocab.check_choice("collision", collision, vocab.COLLISIONS)
    vocab.check_choice("on_error", on_error, ("continue", "abort"))
    wanted = ("data",) if forks == "skip" else ("data", "resource")
    decoded = payloads(opened, password, selectors, wanted, verify_crc, normalization, tables, ("file",) if finder == "sidecar" else ())
    finder_columns = ["file_type", "creator", "finder_flags", "create_time_mac", "modify_time_mac"]
    columns = ["archive_id", "entry_index", "step", "path", "output", "target", "content", "mtime", "status"]
    rows = decoded

    modes = {"skip": [], "rsrc": ["rsrc"], "appledouble": ["appledouble"], "both": ["rsrc", "appledouble"], "native": ["native"]}[forks]
    resource = F.array(*[F.lit(m) for m in modes]) if modes else F.array().cast("array<string>")
    # An archive that can't be opened has one row without a member.
    output = F.when(F.col("entry_index").isNull(), F.array(F.lit("open"))).when(F.col("fork") == "data", F.array(F.lit("data"))).when(F.col("fork") == "file", F.array(F.lit("finder"))).otherwise(resource)
    written = rows.withColumn("output", F.explode(output))
    written = written.withColumn("step", F.when(F.col("output").isin("data", "open"), 0).when(F.col("output") == "rsrc", 1).when(F.col("output") == "finder", 3).otherwise(2))
    parent, base = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), native.basename(F.col("path"))
    written = written.withColumn("target", F.when(F.col("output") == "rsrc", F.concat("path", F.lit(".rsrc"))).when(F.col("output") == "appledouble", F.concat(parent, F.lit("._"), base)).when(F.col("output") == "finder", F.concat("path", F.lit(".finder.json"))).otherwise(F.col("path")))
    double = appledouble(F.col("file_type"), F.col("creator"), F.col("finder_flags"), F.coalesce("payload", F.unhex(F.lit(""))))
    written = written.withColumn("content", F.when(F.col("output") == "appledouble", double).when(F.col("output") == "native", F.lit(None)).when(F.col("output") == "finder", F.encode(finder_json(F.col("path"), *[F.col(c) for c in finder_columns]), "UTF-8")).otherwise(F.col("payload")))
    written = written.withColumn("status", F.when((F.col("output") == "native") & (F.col("status") == "ok"), vocab.UNSUPPORTED).otherwise(F.col("status")))
    mtime = F.when(F.lit(preserve_time) & (F.col("output") == "data") & (F.col("modify_time_mac") >= vocab.MAC_EPOCH), F.col("modify_time_mac") - vocab.MAC_EPOCH)
    written = written.withColumn("mtime", mtime).select(*columns)
    unsafe = F.coalesce(~native.path_is_safe(F.col("path")), F.lit(False))
    written = written.withColumn("unsafe", unsafe).withColumn("status", F.when(F.col("unsafe"), vocab.BAD_FORMAT).otherwise(F.col("status"))).withColumn("event_idx", F.coalesce(F.col("entry_index") * 4 + F.col("step"), F.lit(0)))
    if collision in ("rename", "skip"):
        written = _collide(written, collision, existing)
    out = written.select("archive_id", "event_idx", "path", "output", "target", F.when(F.col("status") == "ok", F.col("content")).alias("content"), "mtime", "status", "unsafe")
    return abort_after_fatal(out) if on_error == "abort" else out


def _collide(written: DataFrame, collision: str, existing: DataFrame | None) -> DataFrame:
    """Decides names as files are written one by one: an archive's rows stand together and in order, so a task goes through them with the names in use.

    Payloads pass by untouched, without a shuffle unless there are existing files to know of.
    """
    if existing is None:
        written = written.withColumn("known", F.lit(None).cast("array<string>"))
    else:
        known = existing.groupBy("archive_id").agg(F.collect_set("path").alias("known"))
        written = written.join(known, "archive_id", "left").repartition("archive_id").sortWithinPartitions("archive_id", "event_idx")
    names = ["archive_id", "entry_index", "path", "output", "target", "status", "known"]
    columns = written.columns
    at = [columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, next_, moved = object(), set(), {}, {}
        for batch in batches:
            targets, statuses = [], []
            for archive, entry, path, output, target, status, known in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if archive != key:
                    key, used, next_, moved = archive, set(known or ()), {}, {}
                if entry in moved and output != "data":
                    # A sidecar goes beside the name that its file has got.
                    folder, _, name = moved[entry].rpartition("/")
                    target = {"rsrc": f"{moved[entry]}.rsrc", "finder": f"{moved[entry]}.finder.json", "appledouble": f"{folder}/._{name}" if folder else f"._{name}"}.get(output, moved[entry])
                if status == vocab.OK and collision == "skip":
                    status = vocab.SKIPPED if target in used else status
                    used.add(target)
                elif status == vocab.OK:
                    target = free_name(target, used, next_)
                    if output == "data" and target != path:
                        moved = {entry: target}
                targets.append(target)
                statuses.append(status)
            changed = {"target": pa.array(targets, pa.string()), "status": pa.array(statuses, pa.string())}
            yield pa.RecordBatch.from_arrays([changed.get(c, batch.column(i)) for i, c in enumerate(columns)], names=columns)

    return written.mapInArrow(run, written.schema).drop("known")


def abort_after_fatal(events: DataFrame) -> DataFrame:
    """Without the rows after an archive's first fatal one."""
    before = Window.partitionBy("archive_id").orderBy("event_idx").rowsBetween(Window.unboundedPreceding, -1)
    fatal = F.max(F.col("status").isin(*FATAL)).over(before)
    return events.withColumn("_after", fatal).filter("_after is null or not _after").drop("_after")


def counters(events: DataFrame) -> DataFrame:
    """Counts by archive, and the extraction's final status: that of a fatal row, else unsupported if a row is, else ok. A member of an unsafe path is skipped."""
    count = lambda s: F.count_if(F.col("status") == s)
    fatal = F.min_by(F.when(F.col("status").isin(*FATAL), F.col("status")), F.when(F.col("status").isin(*FATAL), F.col("event_idx")))
    unsafe = F.count_distinct(F.when(F.col("unsafe"), F.floor(F.col("event_idx") / 4)))
    found = events.groupBy("archive_id").agg(count("ok").alias("extracted_files"), (count("skipped") + unsafe).alias("skipped_files"), count("unsupported").alias("unsupported_files"), count("checksum").alias("checksum_errors"), fatal.alias("fatal"))
    status = F.coalesce("fatal", F.when(F.col("unsupported_files") > 0, vocab.UNSUPPORTED).otherwise(vocab.OK))
    return found.withColumn("status", status).withColumn("exit_code", vocab.exit_code(status)).drop("fatal")


def archive_folder(archive_id: object) -> str:
    """Folder of an archive's files: the last part of its id, and a hash, since archives in different folders may share that."""
    name = str(archive_id)
    return f"{os.path.basename(name)}-{hashlib.sha256(name.encode()).hexdigest()[:12]}"


def write_files(events: DataFrame, folder: str) -> None:
    """Write what a plan has as ok below ``folder``/``archive_folder``, which all executors must share; tasks may be repeated."""

    def write(rows) -> None:
        for row in rows:
            if row["status"] != vocab.OK or row["content"] is None:
                continue
            path = os.path.join(folder, archive_folder(row["archive_id"]), row["target"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.part-{os.getpid()}"
            with open(part, "wb") as file:
                file.write(row["content"])
            if row["mtime"] is not None:
                os.utime(part, (row["mtime"], row["mtime"]))
            os.replace(part, path)

    events.foreachPartition(write)
