import random

import pytest
from pyspark.sql import functions as F

from moraine.functions import names, native
from moraine.operators import crypto, decode, extract, reports, writer
from moraine.sources.parse import find_mkey, list_entries
from moraine.sources.wrappers import decode_binhex, open_archives
from moraine.testing import archives as make

TEXT = b"alpha beta gamma delta, " * 20


def opened(spark, files, **options):
    rows = [(k, n, bytearray(c) if c is not None else None) for k, (n, c) in enumerate(files)]
    return open_archives(spark.createDataFrame(rows, "archive_id int, name string, content binary"), **options)


def test_detection_cascade(spark):
    inner = make.classic([make.Member("a.txt", TEXT)])
    files = [
        ("a.sit", inner), ("b.sit", make.v5([make.Member("a.txt", TEXT)])), ("c.sitx", b"anything"), ("d", b"StuffIt!" + bytes(200)), ("e.bin", make.macbinary(inner)), ("f.bin", make.macbinary(inner, version=3)), ("g.bin", make.macbinary(inner, version=1)),
        ("h.as", make.apple(inner)), ("i.as", make.apple(inner, little=True, double=True, resource=b"rsrc")), ("j.exe", b"MZ" + bytes(100)), ("k.hqx", make.binhex(inner)), ("l", b"nothing known" * 9), ("m", b""), ("n", None), ("o.hqx", make.binhex(inner)[:-60] + b"aaaa" + make.binhex(inner)[-56:]),
    ]
    found = {r["archive_id"]: r for r in opened(spark, files).collect()}
    got = [(found[i]["status"], found[i]["wrapper"], found[i]["format"]) for i in range(len(files))]
    assert got == [
        ("ok", "raw", "sit-classic"), ("ok", "raw", "sit5"), ("unsupported", "raw", "sitx"), ("unsupported", "raw", "sitx"), ("ok", "macbinary", "sit-classic"), ("ok", "macbinary", "sit-classic"), ("ok", "macbinary", "sit-classic"), ("ok", "applesingle", "sit-classic"),
        ("ok", "appledouble", "sit-classic"), ("unsupported", "pe-sfx", "unknown"), ("ok", "binhex", "sit-classic"), ("unsupported", "unknown", "unknown"), ("bad-format", "unknown", "unknown"), ("bad-format", "unknown", "unknown"), ("checksum", "binhex", "unknown"),
    ]
    assert [found[i]["macbinary_version"] for i in (4, 5, 6)] == [2, 3, 1]
    assert found[4]["payload_offset"] == 128 and found[4]["payload_size"] == len(inner)
    assert found[10]["binhex_name"] == "archive.sit"
    assert {r["wrapper"] for r in opened(spark, files[10:11], decode_binhex_files=False).collect()} == {"binhex"}
    paths = {r["archive_id"] for r in list_entries(opened(spark, files)).filter("path = 'a.txt'").collect()}
    assert paths == {0, 1, 4, 5, 6, 7, 8, 10}


@pytest.mark.parametrize("method", [0, 1, 2, 3, 13, 14, 15])
def test_payloads_of_both_versions(spark, method):
    member = make.Member("x", TEXT, b"resource " * 9, method)
    files = [("b", make.v5([member, make.Member("folder/deep/y", TEXT, method=method)]))]
    if method != 14:
        files.append(("a", make.classic([member])))
    rows = decode.payloads(opened(spark, files)).collect()
    assert {r["status"] for r in rows} == {"ok"}
    assert {(r["path"], r["fork"], bytes(r["payload"])) for r in rows} == {("x", "data", TEXT), ("x", "resource", b"resource " * 9), ("folder/deep/y", "data", TEXT)}


def test_statuses(spark):
    good = make.v5([make.Member("a", TEXT)])
    flipped = good[:-3] + b"xyz"
    secret = make.v5([make.Member("a", TEXT, b"r", 14)], password="password")
    files = [("a", good), ("b", flipped), ("c", secret), ("d", good[:130])]
    status = lambda **o: {(r["archive_id"], r["fork"]): r["status"] for r in decode.payloads(opened(spark, files), **o).collect()}
    assert status() == {(0, "data"): "ok", (1, "data"): "checksum", (2, "data"): "password-required", (2, "resource"): "password-required", (3, None): "bad-format"}
    assert status(password="wrong")[2, "data"] == "password-bad"
    assert status(password="password")[2, "resource"] == "ok"
    assert status(verify_crc=False)[1, "data"] == "ok"
    assert status(selectors=["/b/"]) == {(3, None): "bad-format"}


def test_write_list_and_extract(spark):
    rows = [("s", "b/two.txt", b"two"), ("s", "b/c/three.txt", b"three"), ("s", "a.txt", b"one"), ("s", "empty", None), ("t", "zé.txt", b"")]
    members = spark.createDataFrame(rows, "archive_id string, path string, content binary")
    files = open_archives(writer.create(members)).cache()
    entries = list_entries(files)
    listed = {(r["archive_id"], r["path"], r["is_dir"], r["data_fork"]["size"]) for r in entries.collect()}
    assert listed == {("s", "a.txt", False, 3), ("s", "b", True, 0), ("s", "b/c", True, 0), ("s", "b/c/three.txt", False, 5), ("s", "b/two.txt", False, 3), ("s", "empty", True, 0), ("t", "z__.txt", False, 0)}
    order = [r["path"] for r in entries.filter("archive_id = 's'").orderBy("entry_index").collect()]
    assert order == ["a.txt", "b", "b/c", "b/c/three.txt", "b/two.txt", "empty"]
    events = extract.plan(files, finder="sidecar")
    assert {r["extracted_files"] for r in extract.counters(events).collect()} == {6, 2}
    kept = writer.delete(writer.members_of(decode.payloads(files), entries), ["b/c", "absent"])
    assert {r["path"] for r in kept.filter("archive_id = 's'").collect()} == {"a.txt", "b", "b/two.txt", "empty"}
    new = spark.createDataFrame([("s", "a.txt", b"ONE!")], "archive_id string, path string, content binary")
    again = decode.payloads(open_archives(writer.create(writer.add(kept, new))))
    assert {(r["path"], bytes(r["payload"])) for r in again.filter("archive_id = 's'").collect()} == {("a.txt", b"ONE!"), ("b/two.txt", b"two")}
    with pytest.raises(ValueError):
        writer.delete(kept, ["../x"])
    assert all(r["writable"] for r in writer.writable(entries, files).collect())
    sizes = {(r["folder"], r["files"], r["bytes"]) for r in reports.folder_sizes(entries.filter("archive_id = 's'")).collect()}
    assert sizes == {("", 3, 11), ("b", 2, 8), ("b/c", 1, 5)}
    assert reports.list_json(files, entries).filter("archive_id = 't'").first()["json"].startswith('{"format":"sit-classic","wrapper":"raw","entries":[{"index":0,"path":"z__.txt","kind":"file","data_fork":{"present":true,"size":0')


def test_abort_and_unsafe_names(spark):
    bad = make.classic([make.Member("ok.txt", TEXT), make.Member("../escape.txt", TEXT), make.Member("late.txt", TEXT)])
    files = opened(spark, [("a", bad)])
    assert {r["path"]: r["status"] for r in extract.plan(files).collect()} == {"ok.txt": "ok", "../escape.txt": "bad-format", "late.txt": "ok"}
    assert [r["path"] for r in extract.plan(files, on_error="abort").orderBy("event_idx").collect()] == ["ok.txt", "../escape.txt"]
    row = extract.counters(extract.plan(files, on_error="abort")).first()
    assert (row["extracted_files"], row["status"], row["exit_code"]) == (1, "bad-format", 3)


def test_sidecars_and_collisions(spark):
    files = opened(spark, [("a", make.classic([make.Member("f", b"d", b"rs"), make.Member("f", b"e")]))])
    out = {r["target"]: bytes(r["content"]) for r in extract.plan(files, forks="both", collision="rename").collect()}
    assert out["f"] == b"d" and out["f.1"] == b"e" and out["f.rsrc"] == b"rs"
    assert out["._f"].startswith(bytes.fromhex("0005160700020000")) and out["._f"].endswith(b"rs") and len(out["._f"]) == 84
    assert sorted(r["status"] for r in extract.plan(files).collect()) == ["ok", "skipped"]


def test_first_free_names(spark):
    files = opened(spark, [("a", make.classic([make.Member("f", b"1", b"r"), make.Member("f", b"2", b"s"), make.Member("f.1", b"3"), make.Member("d/f", b"4", b"t")])), ("b", make.classic([make.Member("f", b"5")]))])
    existing = spark.createDataFrame([(0, "d/f"), (0, "d/f.1")], "archive_id long, path string")
    events = extract.plan(files, forks="appledouble", finder="sidecar", collision="rename", existing=existing)
    got = [r["target"] for r in events.filter("archive_id = 0").orderBy("event_idx").collect()]
    assert got == ["f", "._f", "f.finder.json", "f.1", "._f.1", "f.1.finder.json", "f.1.1", "f.1.1.finder.json", "d/f.2", "d/._f.2", "d/f.2.finder.json"]
    assert events.filter("archive_id = 1 and target = 'f'").count() == 1
    paths = spark.createDataFrame([("a", i, p) for i, p in enumerate(["f.1", "f", "f", "f.1", "f", "g"])], "archive_id string, event_idx int, path string")
    assert [r["target"] for r in writer.rename_collisions(paths).orderBy("event_idx").collect()] == ["f.1", "f", "f.2", "f.1.1", "f.3", "g"]


def test_files_of_archives_with_one_name(spark, tmp_path):
    """From files to files: scan, list, extract and write; archives of one name in two folders keep their files apart."""
    from moraine.sources.detect import read_archives

    for folder, text in (("x", b"one"), ("y", b"two")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.sit").write_bytes(make.classic([make.Member("m", text)]))
    events = extract.plan(open_archives(read_archives(spark, str(tmp_path / "in"), glob="*.sit")))
    extract.write_files(events, str(tmp_path / "out"))
    assert sorted(p.read_bytes() for p in (tmp_path / "out").glob("*/m")) == [b"one", b"two"]


def test_the_gate_before_writing(spark):
    files = opened(spark, [("a", make.classic([make.Member("f", b"1", b"r")])), ("b", make.classic([make.Member("f", b"1")]))])
    with pytest.raises(ValueError, match="such as 0"):
        writer.require_writable(list_entries(files), files)
    only = files.filter("archive_id = 1")
    writer.require_writable(list_entries(only), only)


def test_reports_of_members(spark):
    files = opened(spark, [("a", make.v5([make.Member("top/x.txt", b"1"), make.Member("top/sub/y.JPG", b"2"), make.Member("z.txt", b"3")]))])
    entries = list_entries(files)
    assert reports.entry_counts(entries).first()["entry_count"] == 5
    assert [(r["folder"], r["files"]) for r in reports.top_folders(entries).collect()] == [("top", 2)]
    assert {r["path"] for r in reports.without_extensions(entries, [".jpg"]).collect()} == {"top", "top/sub", "top/x.txt", "z.txt"}
    stripped = reports.without_top_folder(decode.manifest(decode.payloads(files)))
    assert {r["path"] for r in stripped.collect()} == {"x.txt", "sub/y.JPG", "z.txt"}


def test_checksums_of_any_length():
    import random

    rng = random.Random(2)
    for n in (*range(70), 4095, 4096, 4097, 8192, 8193, 20_000):
        data, crc = rng.randbytes(n), 0
        for x in data:
            crc = crc >> 8 ^ native.IBM_TABLE[(crc ^ x) & 255]
        assert native.crc16_ibm_bytes(data) == crc, n


def test_native_functions(spark):
    row = spark.range(1).select(
        native.crc16_ibm(F.lit("123456789").cast("binary")).alias("ibm"), native.crc16_ccitt(F.lit("123456789").cast("binary")).alias("ccitt"), names.mac_roman(F.unhex(F.lit("4361668E20DB"))).alias("name"), native.le(F.unhex(F.lit("12345678")), 0, 4).alias("le"), native.be(F.unhex(F.lit("12345678")), 1, 4).alias("beyond"),
        native.mac_to_unix(F.lit(3758308646)).alias("unix"), native.fourcc_json(F.unhex(F.lit("41220a42"))).alias("code"), names.decomposed(F.lit("Café ≠")).alias("nfd"), native.hex_rows(F.lit("SIT!").cast("binary"), 0, 4).alias("dump"),
    ).first()
    assert (row["ibm"], row["ccitt"], row["name"], row["le"], row["beyond"], row["unix"]) == (0xBB3D, 0x31C3, "Café €", 0x78563412, None, 1675463846)
    assert row["code"] == "A\\u0022\\u000aB" and row["nfd"] == "Café ≠" and row["dump"][0].startswith("00000000: 5349 5421")
    assert native.crc16_ibm_bytes(b"123456789") == 0xBB3D
    assert names.decode_name(bytes.fromhex("4361668e"), "nfd").encode().hex() == "43616665cc81"


def test_classic_cipher_is_invertible_for_any_boxes():
    rng = random.Random(1)
    cipher = crypto.ClassicCipher([[rng.randrange(16) for _ in range(64)] for _ in range(8)])
    key, block = rng.randbytes(8), rng.randbytes(8)
    assert cipher.block(key, cipher.block(key, block, True), False) == block
    # A key record that the password fits: verify bytes follow from its first half.
    archive_key = cipher.archive_key(b"password")
    start = b"abcd" + cipher.block(archive_key, b"abcd\0\0\0\4", True)[4:]
    mkey = cipher.block(archive_key, start, True)
    entry_key = rng.randbytes(16)
    own = cipher.file_key(b"password", mkey, entry_key)
    assert own and cipher.file_key(b"wrong", mkey, entry_key) is None
    plain = b"sixteen bytes ok"
    left = cipher.stream(own, plain, 0)
    assert left != plain and len(cipher.stream(own, plain, 3)) == 13


def test_mkey_and_binhex_defects():
    assert find_mkey(b"") is None
    good = make.binhex(b"payload", resource=b"resource")
    found = decode_binhex(good)
    assert (found.status, found.data, found.resource, found.name) == ("ok", b"payload", b"resource", "archive.sit")
    assert decode_binhex(b"nothing").status == "unsupported"
    assert decode_binhex(good[:80] + b":").status == "bad-format"
