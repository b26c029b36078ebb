import hashlib
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from moraine.operators import reports
from moraine.plans import catalog


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def oracle(tmp_path, query):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return sorted(con.execute(catalog.ORACLE_SQL[query]).fetchall())


def plain_crc(data, reflected):
    crc = 0
    for byte in data:
        crc ^= byte if reflected else byte << 8
        for _ in range(8):
            crc = (crc >> 1) ^ (0xA001 if crc & 1 else 0) if reflected else ((crc << 1) ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def test_crc16_of_whole_texts(spark, tmp_path):
    texts = ["", "short", "a" * 41, "a" * 40 + "b", "some words, " * 90 + "caf\u00e9", "x" * 39 + "\u00e9\u00e9 tail"]
    got = {r["doc_id"]: r for r in catalog.crc16(spark, documents(spark, tmp_path, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        data = re.sub("[^\x01-\x7f]", "?", text).encode()
        assert (got[i]["ibm"], got[i]["ccitt"]) == (plain_crc(data, True), plain_crc(data, False))


def test_method_histogram_packs_whole_texts(spark, tmp_path, monkeypatch):
    seen = []
    histogram = reports.method_histogram

    def spy(entries):
        sizes = entries.select(F.sum(F.col("data_fork.size")).alias("data"), F.sum(F.col("resource_fork.size")).alias("resource")).first()
        seen.append((sizes["data"], sizes["resource"]))
        return histogram(entries)

    monkeypatch.setattr(reports, "method_histogram", spy)
    texts = ["many words " * n for n in (1, 60, 100, 300)]
    rows = catalog.method_histogram(spark, documents(spark, tmp_path, list(enumerate(texts)))).collect()
    whole = sum(map(len, texts))
    assert seen == [(whole + 4, whole)]
    assert {r["method"]: r["forks"] for r in rows} == {0: 9, 1: 1, 2: 1, 3: 1}


def test_mac_names_of_every_high_byte(spark, tmp_path):
    got = {r["doc_id"]: r for r in catalog.mac_names(spark, documents(spark, tmp_path, [(i, "x") for i in range(256)])).collect()}
    assert sorted(got) == list(range(256))
    for i in range(256):
        name = "Caf" + bytes([i % 128 + 128]).decode("mac_roman")
        # The reference does not take U+2260 apart.
        apart = name if name[-1] == "\u2260" else unicodedata.normalize("NFD", name)
        assert (got[i]["nfc"], bytes.fromhex(got[i]["nfd_hex"]).decode()) == (name, apart), hex(i % 128 + 128)


def test_encrypted_runs_over_all_documents_and_whole_texts(spark, tmp_path):
    texts = ["", "short", "long text " * 500, "a" * 2001]
    got = {(r["doc_id"], r["attempt"]): (r["status"], r["sha256"]) for r in catalog.encrypted(spark, documents(spark, tmp_path, list(enumerate(texts)))).collect()}
    want = {}
    for i, text in enumerate(texts):
        want[i, 0], want[i, 1] = ("password-required", None), ("password-bad", None)
        want[i, 2] = ("ok", hashlib.sha256((text or "x").encode()).hexdigest())
    assert got == want


def test_extract_counters_of_empty_texts_equal_the_sql(spark, tmp_path):
    rows = [(i, "" if i < 8 else "some words") for i in range(16)]
    got = sorted(map(tuple, catalog.extract_counters(spark, documents(spark, tmp_path, rows)).collect()))
    assert got == oracle(tmp_path, "extract_counters")


def test_method_histogram_of_empty_texts_equals_the_sql(spark, tmp_path):
    rows = [(i, "" if i < 6 else "some words") for i in range(16)]
    got = sorted(map(tuple, catalog.method_histogram(spark, documents(spark, tmp_path, rows)).collect()))
    assert got == oracle(tmp_path, "method_histogram")


def test_tasks_follow_the_number_of_documents(spark, tmp_path):
    folder = documents(spark, tmp_path, [(i, "x") for i in range(40_000)])
    files = catalog._encoded(spark, folder, lambda i, t: t)
    assert files.rdd.getNumPartitions() == 40
    assert max(files.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1300
