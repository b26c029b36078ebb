"""The registered queries and the SQL that gives the same rows.

Archives are packed from ``documents`` inside the queries, one for each source, so that plain SQL over the same tables can
say what listing, decoding and rewriting them must give.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import names, native
from moraine.operators import decode, extract, reports, writer
from moraine.sources.parse import V5_CRC_AT, V5_ENTRY_MAGIC, list_entries
from moraine.sources.wrappers import open_archives
from moraine.testing import archives as make
from moraine.testing import encoders


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as members: archives are the source's, each of at most 2000 documents, the folder is the language."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(_archive(), path.alias("path"), F.col("text").cast("binary").alias("content"))


def _archive() -> Column:
    """The archive of a document: a source may have a third of all, so it has an archive for every 2000 numbers."""
    return F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 2000).cast("string")).alias("archive_id")


def _source() -> Column:
    return F.regexp_extract("archive_id", "^(.*)-[0-9]+$", 1).alias("source")


#: Documents of a partition, on average: what a task and its Arrow batches hold is bounded by it, however large the table.
DOCUMENTS_A_TASK = 1000


def _partitions(docs: DataFrame) -> int:
    return max(16, -(-docs.count() // DOCUMENTS_A_TASK))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_archives(writer.create(_members(spark, sf_dir), partitions=_partitions(_table(spark, sf_dir, "documents"))))


def _doc_id(path: Column) -> Column:
    return F.regexp_extract(path, r"doc_(\d+)", 1).cast("long")


def _encoded(spark: SparkSession, sf_dir: str, build: Callable[[int, bytes], bytes]) -> DataFrame:
    """One archive for each document, by ``build`` (doc_id, text)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            files = [build(i, (t or "").encode()) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{i}.sit" for i in ids]), pa.array(files, pa.binary())], names=["archive_id", "name", "content"])

    return docs.repartition(_partitions(docs), "doc_id").mapInArrow(run, "archive_id long, name string, content binary")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and bytes by archive, after packing, detection, listing and decoding, with their checksums verified."""
    found = decode.payloads(_packed(spark, sf_dir))
    return found.filter("status = 'ok'").groupBy(_source()).agg(F.count("*").alias("members"), F.sum("payload_size").alias("bytes"))


def list_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = list_entries(_packed(spark, sf_dir)).filter("not is_dir")
    return entries.select(_source(), _doc_id(F.col("path")).alias("doc_id"), "path", F.col("data_fork.size").alias("size"))


def _round_trip(method: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if method in (0, 14):
            files = _encoded(spark, sf_dir, lambda i, t: make.v5([make.Member(f"doc_{i}.txt", t, method=method)]))
        else:
            files = _encoded(spark, sf_dir, lambda i, t: make.classic([make.Member(f"doc_{i}.txt", t, method=method)]))
        found = decode.payloads(open_archives(files))
        return found.select(_doc_id(F.col("path")).alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))

    return query


def crc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.regexp_replace("text", "[^\\x01-\\x7f]", "?"), "UTF-8")
    return _table(spark, sf_dir, "documents").select("doc_id", native.crc16_ibm_whole(text).cast("long").alias("ibm"), native.crc16_ccitt_whole(text).cast("long").alias("ccitt"))


def _wrapped(i: int, text: bytes) -> bytes:
    inner = make.classic([make.Member(f"doc_{i}.txt", text)])
    return [
        lambda: inner, lambda: make.v5([make.Member(f"doc_{i}.txt", text)]), lambda: make.macbinary(inner), lambda: make.apple(inner), lambda: make.apple(inner, double=True, little=True), lambda: make.binhex(inner), lambda: b"MZ" + text, lambda: b"StuffIt!" + text, lambda: b"\xff" + text,
    ][i % 9]()


def identify_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.identify(open_archives(_encoded(spark, sf_dir, _wrapped)))
    return found.groupBy("wrapper", "format", "status", "exit_code").agg(F.count("*").alias("n"))


def wrapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.payloads(open_archives(_encoded(spark, sf_dir, _wrapped))).filter("path is not null")
    return found.select(F.col("archive_id").alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.payloads(_packed(spark, sf_dir), selectors=["/de/", "fr", "en/doc_1"])
    return found.select(_source(), "path", "payload_size")


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "/", "../", "a..b/", "c:", "d\\", "e/")]), (F.col("doc_id") % 7 + 1).cast("int")), F.lit("f"), F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", made.alias("path"))
    return docs.select("doc_id", "path", native.path_is_safe(F.col("path")).alias("safe"), native.relative_entry(F.col("path")).alias("relative"))


def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.folder_sizes(list_entries(_packed(spark, sf_dir)))
    return found.groupBy(_source(), "folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def method_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _encoded(spark, sf_dir, lambda i, t: make.classic([make.Member("a", t, method=(0, 1, 2, 3)[i % 4]), make.Member("b", b"x", t)]))
    return reports.method_histogram(list_entries(open_archives(files))).select("method", "method_name", "archives", "forks")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.manifest(decode.payloads(_packed(spark, sf_dir))).select(_source(), "path", "size", "sha256")


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = decode.manifest(decode.payloads(_packed(spark, sf_dir)))
    docs = _table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.concat("lang", F.lit("/doc_"), F.when(F.col("doc_id") % 5 == 2, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).cast("string"), F.lit(".txt"))
    expected = docs.select(_archive(), path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return reports.compare_manifests(expected, actual).groupBy("outcome").agg(F.count("*").alias("n"))


def delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = writer.delete(writer.members_of(decode.payloads(_packed(spark, sf_dir), marks=("folder",))), ["es", "absent/path"])
    again = list_entries(open_archives(writer.create(kept, partitions=_partitions(_table(spark, sf_dir, "documents"))))).filter("not is_dir")
    return again.select(_source(), "path", F.col("data_fork.size").alias("size"))


def add_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _members(spark, sf_dir).withColumn("modify_time", _doc_id(F.col("path")))
    new = old.filter(_doc_id(F.col("path")) % 3 == 0).withColumn("content", F.lit("new").cast("binary"))
    new = new.withColumn("modify_time", F.when(_doc_id(F.col("path")) % 2 == 0, F.col("modify_time") + 1).otherwise(F.col("modify_time")))
    more = old.filter(_doc_id(F.col("path")) % 50 == 1).withColumn("path", F.concat("path", F.lit(".add")))
    found = writer.add(old, new.unionByName(more), update=True)
    entries = list_entries(open_archives(writer.create(found, partitions=_partitions(old)))).filter("not is_dir")
    return entries.select(_source(), "path", F.col("data_fork.size").alias("size"))


def _damaged(i: int, text: bytes) -> bytes:
    good = make.v5([make.Member("a.txt", text), make.Member("b.txt", text), make.Member("c.txt", text)])
    # A bit of the last member's content; of an empty one, of the checksum in its header.
    at = good.rindex(text) if text else good.rindex(V5_ENTRY_MAGIC.to_bytes(4, "big")) + V5_CRC_AT
    if i % 4 == 1:
        return good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    return good[: len(good) // 2] if i % 4 == 2 else good


def extract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = extract.plan(open_archives(_encoded(spark, sf_dir, _damaged)))
    found = extract.counters(events)
    return found.select(F.col("archive_id").alias("doc_id"), "extracted_files", "checksum_errors", "status", "exit_code")


def abort_first_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by user of the events table, cut at the first that counts as fatal."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("archive_id"), F.col("event_id").alias("event_idx"), F.when(F.col("event_id") % 17 == 3, "checksum").otherwise("ok").alias("status"))
    return extract.abort_after_fatal(events).groupBy(F.col("archive_id").alias("user_id")).agg(F.count("*").alias("n"), F.max("event_idx").alias("last_event"))


def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("archive_id"), F.col("lang").alias("path"), F.col("doc_id").alias("event_idx"))
    return writer.rename_collisions(docs).select(F.col("event_idx").alias("doc_id"), "target")


def hex_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.regexp_replace("text", "[^\\x01-\\x7f]", "?"), "UTF-8")
    return _table(spark, sf_dir, "documents").select("doc_id", native.hex_bytes(content, 4, 24).alias("hex"))


def mac_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    unix = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    mac = native.unix_to_mac(unix)
    return _table(spark, sf_dir, "orders").select("o_orderkey", mac.alias("mac"), native.mac_to_unix(mac).alias("unix"))


def mac_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("doc_id") % 128 + 128).cast("long")
    raw = F.concat(F.encode(F.lit("Caf"), "UTF-8"), native.big_endian(code, 1))
    name = names.mac_roman(raw)
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", name.alias("nfc"), F.lower(F.hex(F.encode(names.decomposed(name), "UTF-8"))).alias("nfd_hex"))


def encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = {0: None, 1: "wrong", 2: "password"}
    files = open_archives(_encoded(spark, sf_dir, lambda i, t: make.v5([make.Member("a", t or b"x", method=14)], password="password")))
    parts = [decode.payloads(files, password=p).select(F.col("archive_id").alias("doc_id"), F.lit(k).alias("attempt"), "status", F.sha2("payload", 256).alias("sha256")) for k, p in secrets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resource_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _encoded(spark, sf_dir, lambda i, t: make.v5([make.Member("a.txt", t, f"rsrc {i}".encode())]))
    events = extract.plan(open_archives(files), forks="both")
    return events.select(F.col("archive_id").alias("doc_id"), "output", "target", F.octet_length("content").cast("long").alias("size"), "status")


def v5_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _encoded(spark, sf_dir, lambda i, t: make.v5([make.Member(f"top/mid_{i}/leaf.txt", t), make.Member("top/other.txt", b"o")]))
    return list_entries(open_archives(files)).select(F.col("archive_id").alias("doc_id"), "entry_index", "path", "is_dir", F.col("data_fork.size").alias("size"))


def listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = open_archives(_encoded(spark, sf_dir, lambda i, t: make.classic([make.Member(f"doc_{i}.txt", t)])))
    found = reports.list_json(files, list_entries(files))
    return found.select(F.col("archive_id").alias("doc_id"), F.regexp_replace("json", '"crc16":"[0-9a-f]{4}"', '"crc16":"-"').alias("json"))


def exit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_histogram(reports.identify(open_archives(_encoded(spark, sf_dir, _wrapped))))


def extract_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members of one name, and one of the name that the second gets; a sidecar of each."""
    files = _encoded(spark, sf_dir, lambda i, t: make.classic([make.Member("f", t + b"!", b"r"), make.Member("f", b"2", b"r"), make.Member("f.1", b"3")]))
    events = extract.plan(open_archives(files), forks="rsrc", finder="sidecar", collision="rename")
    return events.select(F.col("archive_id").alias("doc_id"), "event_idx", "target", F.octet_length(F.when(F.col("output") != "finder", F.col("content"))).cast("long").alias("size"))


def extract_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = open_archives(_encoded(spark, sf_dir, lambda i, t: make.classic([make.Member("a", t + b"!"), make.Member("../b", t + b"!", b"r"), make.Member("c", b"!")])))
    modes = [extract.counters(extract.plan(files, forks="rsrc", on_error=m)).withColumn("on_error", F.lit(m)) for m in ("continue", "abort")]
    return modes[0].unionByName(modes[1]).select(F.col("archive_id").alias("doc_id"), "on_error", "extracted_files", "skipped_files", "status", "exit_code")


def listing_verylong(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = open_archives(_encoded(spark, sf_dir, lambda i, t: make.classic([make.Member("a", t + b"!", b"four"), make.Member("b", b"x")])))
    found = reports.list_json(files, list_entries(files), very_long=True)
    return found.select(F.col("archive_id").alias("doc_id"), F.regexp_extract_all("json", F.lit('"offsets":(\\{[^}]*\\})'), F.lit(1)).alias("offsets")).select("doc_id", F.array_join("offsets", ";").alias("offsets"))


def dump_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = open_archives(_encoded(spark, sf_dir, lambda i, t: make.classic([make.Member("a", t + b"!", b"four")])))
    found = reports.dump_json(list_entries(files))
    return found.select(F.col("archive_id").alias("doc_id"), F.regexp_replace("json", '"crc16":"[0-9a-f]{4}"', '"crc16":"-"').alias("json"))


def bridge_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = open_archives(_encoded(spark, sf_dir, _wrapped))
    return reports.bridge_json(files, list_entries(files)).select(F.col("archive_id").alias("doc_id"), "json")


def change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an update with newer, older and new members, and of a deletion."""
    old = _members(spark, sf_dir).withColumn("modify_time", _doc_id(F.col("path")))
    number = _doc_id(F.col("path"))
    new = old.filter(number % 3 < 2).withColumn("path", F.when(number % 9 == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))).withColumn("modify_time", F.col("modify_time") + F.when(number % 2 == 0, 1).otherwise(0))
    added = writer.add_counters(old, new, update=True).groupBy(_source()).agg(*[F.sum(c).alias(c) for c in ("added", "updated", "skipped")])
    gone = writer.delete_counters(old, ["de", "fr/"]).groupBy(_source()).agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept"))
    return added.join(gone, "source", "full_outer").na.fill(0)


def roundtrip_predefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method 13 with each of the five predefined sets."""
    files = _encoded(spark, sf_dir, lambda i, t: make.classic([make.Member(f"doc_{i}.txt", t, method=13, packed=encoders.predefined(t, i % 5 + 1))]))
    return decode.payloads(open_archives(files)).select(_doc_id(F.col("path")).alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))


def roundtrip_randomized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method 15 with randomized blocks."""
    gaps = decode.Tables().gaps
    files = _encoded(spark, sf_dir, lambda i, t: make.v5([make.Member(f"doc_{i}.txt", t, method=15, packed=encoders.arsenic(t, gaps=gaps))]))
    return decode.payloads(open_archives(files)).select(_doc_id(F.col("path")).alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "list_store": list_store,
    **{f"roundtrip_{name}": _round_trip(m) for m, name in ((0, "store"), (1, "rle"), (2, "compress"), (3, "huffman"), (13, "lz_huffman"), (14, "deflate"), (15, "arsenic"))},
    "crc16": crc16,
    "identify_wrappers": identify_wrappers,
    "wrapped_payloads": wrapped_payloads,
    "selectors": selectors,
    "path_safety": path_safety,
    "folder_rollup": folder_rollup,
    "method_histogram": method_histogram,
    "manifest": manifest,
    "manifest_diff": manifest_diff,
    "delete_prefix": delete_prefix,
    "add_update": add_update,
    "extract_counters": extract_counters,
    "abort_first_fatal": abort_first_fatal,
    "rename_collisions": rename_collisions,
    "hex_range": hex_range,
    "mac_times": mac_times,
    "mac_names": mac_names,
    "encrypted": encrypted,
    "resource_forks": resource_forks,
    "v5_folders": v5_folders,
    "listing_json": listing_json,
    "exit_histogram": exit_histogram,
    "extract_rename": extract_rename,
    "extract_unsafe": extract_unsafe,
    "listing_verylong": listing_verylong,
    "dump_entry": dump_entry,
    "bridge_identify": bridge_identify,
    "change_counters": change_counters,
    "roundtrip_predefined": roundtrip_predefined,
    "roundtrip_randomized": roundtrip_randomized,
}

_PATH = "lang || '/doc_' || doc_id || '.txt'"
_ROUND_TRIP = "SELECT doc_id, 'ok' AS status, sha256(text) AS sha256 FROM documents"


def _crc_sql(text: str, reflected: bool) -> str:
    table = native.IBM_TABLE if reflected else native.CCITT_TABLE
    entries = ", ".join(map(str, table))
    step = f"xor(c >> 8, ([{entries}])[(xor(c, b) & 255) + 1])" if reflected else f"xor((c << 8) & 65535, ([{entries}])[(xor(c >> 8, b) & 255) + 1])"
    octets = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"list_reduce(list_prepend(0::BIGINT, {octets}), lambda c, b: ({step})::BIGINT)"


_ASCII = "regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g')"
#: The upper half of MacRoman and its decomposed forms as hexadecimal UTF-8, by Python's codec; one sign is left whole.
_HIGH = [bytes([i]).decode("mac_roman") for i in range(128, 256)]
_APART = [(c if c == "\u2260" else unicodedata.normalize("NFD", c)).encode().hex() for c in _HIGH]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FORK = '{"present":%s,"size":%s,"compressed_size":%s,"method":0,"method_name":"none","crc16":"-","encrypted":false}'

ORACLE_SQL: dict[str, str] = {
    "flagship": "SELECT source, count(*) AS members, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source",
    "list_store": f"SELECT source, doc_id, {_PATH} AS path, strlen(text) AS size FROM documents",
    **{k: _ROUND_TRIP for k in QUERIES if k.startswith("roundtrip_")},
    "crc16": f"SELECT doc_id, {_crc_sql(_ASCII, True)} AS ibm, {_crc_sql(_ASCII, False)} AS ccitt FROM documents",
    "identify_wrappers": """
        SELECT k.wrapper, k.format, k.status, k.exit_code, count(*) AS n
        FROM documents JOIN (VALUES (0, 'raw', 'sit-classic', 'ok', 0), (1, 'raw', 'sit5', 'ok', 0), (2, 'macbinary', 'sit-classic', 'ok', 0), (3, 'applesingle', 'sit-classic', 'ok', 0),
          (4, 'appledouble', 'sit-classic', 'ok', 0), (5, 'binhex', 'sit-classic', 'ok', 0), (6, 'pe-sfx', 'unknown', 'unsupported', 2), (7, 'raw', 'sitx', 'unsupported', 2), (8, 'unknown', 'unknown', 'unsupported', 2))
          AS k(r, wrapper, format, status, exit_code) ON doc_id % 9 = k.r
        GROUP BY ALL""",
    "wrapped_payloads": "SELECT doc_id, 'ok' AS status, sha256(text) AS sha256 FROM documents WHERE doc_id % 9 < 6",
    "selectors": f"SELECT source, {_PATH} AS path, strlen(text) AS payload_size FROM documents WHERE lang IN ('de', 'fr')",
    "path_safety": """
        WITH p AS (SELECT doc_id, (['', '/', '../', 'a..b/', 'c:', 'd\\', 'e/'])[doc_id % 7 + 1] || 'f' || doc_id AS path FROM documents)
        SELECT doc_id, path, NOT starts_with(path, '/') AND NOT contains(path, '\\') AND NOT contains(path, '..') AND NOT contains(path, ':') AS safe,
               doc_id % 7 IN (0, 3, 6) AS relative FROM p""",
    "folder_rollup": """
        SELECT source, coalesce(lang, '') AS folder, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY GROUPING SETS ((source, lang), (source))""",
    "method_histogram": """
        WITH m AS (SELECT doc_id, (doc_id % 4)::INT AS method FROM documents WHERE strlen(text) > 0),
        f AS (SELECT doc_id, method FROM m UNION ALL SELECT doc_id, 0 FROM documents UNION ALL SELECT doc_id, 0 FROM documents WHERE strlen(text) > 0)
        SELECT method, (['none', 'rle', 'compress', 'huffman'])[method + 1] AS method_name, count(DISTINCT doc_id) AS archives, count(*) AS forks
        FROM f GROUP BY method""",
    "manifest": f"SELECT source, {_PATH} AS path, strlen(text) AS size, sha256(text) AS sha256 FROM documents",
    "manifest_diff": """
        SELECT outcome, count(*) AS n FROM (
          SELECT CASE WHEN doc_id % 5 = 1 THEN 'changed' WHEN doc_id % 5 = 2 THEN 'missing' ELSE 'same' END AS outcome FROM documents
          UNION ALL SELECT 'extra' FROM documents WHERE doc_id % 5 = 2) GROUP BY outcome""",
    "delete_prefix": f"SELECT source, {_PATH} AS path, strlen(text) AS size FROM documents WHERE lang <> 'es'",
    "add_update": f"""
        SELECT source, {_PATH} AS path, CASE WHEN doc_id % 6 = 0 THEN 3 ELSE strlen(text) END AS size FROM documents
        UNION ALL SELECT source, {_PATH} || '.add', strlen(text) FROM documents WHERE doc_id % 50 = 1""",
    "abort_first_fatal": """
        WITH f AS (SELECT user_id, min(event_id) AS first_fatal FROM events WHERE event_id % 17 = 3 GROUP BY user_id)
        SELECT e.user_id, count(*) AS n, max(event_id) AS last_event FROM events e LEFT JOIN f ON e.user_id = f.user_id
        WHERE first_fatal IS NULL OR event_id <= first_fatal GROUP BY e.user_id""",
    "rename_collisions": """
        SELECT doc_id, CASE WHEN n > 0 THEN lang || '.' || n ELSE lang END AS target
        FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents)""",
    "hex_range": "SELECT doc_id, CASE WHEN strlen(t) >= 28 THEN lower(hex(substr(t, 5, 24))) END AS hex FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS t FROM documents)",
    "mac_times": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT + 2082844800 AS mac, epoch(o_orderdate)::BIGINT AS unix FROM orders",
    "mac_names": f"SELECT doc_id, 'Caf' || ({_sql_list(_HIGH)})[doc_id % 128 + 1] AS nfc, '436166' || ({_sql_list(_APART)})[doc_id % 128 + 1] AS nfd_hex FROM documents",
    "encrypted": """
        SELECT doc_id, attempt, status, CASE WHEN attempt = 2 THEN sha256(CASE WHEN strlen(text) = 0 THEN 'x' ELSE text END) END AS sha256
        FROM documents, (VALUES (0, 'password-required'), (1, 'password-bad'), (2, 'ok')) AS a(attempt, status)""",
    "extract_rename": """
        SELECT doc_id, event_idx, target, CASE WHEN event_idx = 0 THEN strlen(text) + 1 ELSE size END AS size
        FROM documents, (VALUES (0, 'f', 0), (1, 'f.rsrc', 1), (3, 'f.finder.json', NULL), (4, 'f.1', 1), (5, 'f.1.rsrc', 1), (7, 'f.1.finder.json', NULL), (8, 'f.1.1', 1), (11, 'f.1.1.finder.json', NULL)) AS e(event_idx, target, size)""",
    "extract_unsafe": """
        SELECT doc_id, on_error, extracted_files, 1::BIGINT AS skipped_files, 'bad-format' AS status, 3 AS exit_code
        FROM documents, (VALUES ('continue', 2::BIGINT), ('abort', 1::BIGINT)) AS m(on_error, extracted_files)""",
    # 22 bytes of archive header, 112 of the member's, then its resource fork of four bytes, then its data fork.
    "listing_verylong": """
        SELECT doc_id, '{"header":22,"data":138,"resource":134};{"header":' || (n + 138) || ',"data":' || (n + 250) || ',"resource":' || (n + 250) || '}' AS offsets
        FROM (SELECT doc_id, strlen(text) + 1 AS n FROM documents)""",
    "dump_entry": """
        SELECT doc_id, '{"index":0,"path":"a","kind":"file","header_offset":22,"finder":{"type":"TEXT","creator":"ttxt","flags":"0000"},"mac_time":{"create":3061152000,"modify":3758308646},"data_fork":{"present":true,"offset":138,"size":' || n ||
          ',"compressed_size":' || n || ',"method":0,"method_name":"none","crc16":"-","encrypted":false,"encryption":"none"},"resource_fork":{"present":true,"offset":134,"size":4,"compressed_size":4,"method":0,"method_name":"none","crc16":"-","encrypted":false,"encryption":"none"}}' AS json
        FROM (SELECT doc_id, strlen(text) + 1 AS n FROM documents)""",
    "bridge_identify": """
        SELECT doc_id, '{"status":"' || status || '","wrapper":"' || wrapper || '","format":"' || format || '","supported":' || (n = 1) || ',"entry_count":' || n || '}' AS json
        FROM documents JOIN (VALUES (0, 'raw', 'sit-classic', 'ok', 1), (1, 'raw', 'sit5', 'ok', 1), (2, 'macbinary', 'sit-classic', 'ok', 1), (3, 'applesingle', 'sit-classic', 'ok', 1), (4, 'appledouble', 'sit-classic', 'ok', 1),
          (5, 'binhex', 'sit-classic', 'ok', 1), (6, 'pe-sfx', 'unknown', 'unsupported', 0), (7, 'raw', 'sitx', 'unsupported', 0), (8, 'unknown', 'unknown', 'unsupported', 0)) AS k(r, wrapper, format, status, n) ON doc_id % 9 = r""",
    "change_counters": """
        SELECT source, count(*) FILTER (doc_id % 9 = 1) AS added, count(*) FILTER (doc_id % 3 < 2 AND doc_id % 9 <> 1 AND doc_id % 2 = 0) AS updated,
          count(*) FILTER (doc_id % 3 < 2 AND doc_id % 9 <> 1 AND doc_id % 2 = 1) AS skipped, count(*) FILTER (lang IN ('de', 'fr')) AS deleted, count(*) FILTER (lang NOT IN ('de', 'fr')) AS kept
        FROM documents GROUP BY source""",
    "resource_forks": """
        SELECT doc_id, output, target, CASE output WHEN 'data' THEN strlen(text) WHEN 'rsrc' THEN strlen('rsrc ' || doc_id) ELSE 82 + strlen('rsrc ' || doc_id) END AS size, 'ok' AS status
        FROM documents, (VALUES ('data', 'a.txt'), ('rsrc', 'a.txt.rsrc'), ('appledouble', '._a.txt')) AS o(output, target) WHERE output <> 'data' OR strlen(text) > 0""",
    "v5_folders": """
        SELECT doc_id, i AS entry_index, replace(path, '#', doc_id::VARCHAR) AS path, i IN (0, 1) AS is_dir, CASE i WHEN 2 THEN strlen(text) WHEN 3 THEN 1 ELSE 0 END AS size
        FROM documents, (VALUES (0, 'top'), (1, 'top/mid_#'), (2, 'top/mid_#/leaf.txt'), (3, 'top/other.txt')) AS e(i, path)""",
    "listing_json": f"""
        SELECT doc_id, '{{"format":"sit-classic","wrapper":"raw","entries":[{{"index":0,"path":"doc_' || doc_id || '.txt","kind":"file","data_fork":' ||
          format('{_FORK.replace("{", "{{").replace("}", "}}").replace("%s", "{}")}', 'true', strlen(text), strlen(text)) || ',"resource_fork":{_FORK % ("false", 0, 0)},"finder":{{"type":"TEXT","creator":"ttxt","flags":"0000"}}}}]}}' AS json
        FROM documents""",
    "exit_histogram": """
        SELECT count(*) AS total, count(*) FILTER (doc_id % 9 < 6) AS ok, count(*) FILTER (doc_id % 9 >= 6) AS unsupported, 0::BIGINT AS bad, 0::BIGINT AS password, 0::BIGINT AS failed FROM documents""",
    "extract_counters": """
        SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END::BIGINT AS extracted_files, CASE doc_id % 4 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS checksum_errors,
          CASE doc_id % 4 WHEN 1 THEN 'checksum' WHEN 2 THEN 'bad-format' ELSE 'ok' END AS status, CASE WHEN doc_id % 4 IN (1, 2) THEN 3 ELSE 0 END AS exit_code FROM documents""",
}
