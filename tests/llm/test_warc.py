"""WARC archives: exact round trips, the same bytes for the same rows, damage, commits."""

import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest

from quillon.llm import warc

PAGES = "page_id long, url string, html string, record_type string, digest int, role string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 5}.example/{i}?a=%41é\n\x7f", "".join(rng.choices("abcdefgh é\r\n", k=rng.choice((0, 50, 99, 100, 3000)))), "x", 1, "y") for i in range(200)]
    big = "<p>" + "copy " * 100
    rows += [(500 - i, f"http://c/{i}", big, None, None, None) for i in range(60)]
    rows += [(700, "http://a", big, None, None, None), (700, "http://a", big, None, None, None), (441, "http://c/59", big, None, None, None)]
    rows += [(None, None, big, None, None, None), (None, None, None, None, None, None), (800, None, "only " * 50, None, None, None), (800, None, "only " * 50, None, None, None)]
    rows += [(801, "", "ab" * 49, None, None, None), (802, "", "ab" * 49, None, None, None), (803, None, None, None, None, None), (804, "x", "z" * 3_000_000, None, None, None)]
    rows += [(None, "http://n", "null " * 40, None, None, None), (None, "http://m", "null " * 40, None, None, None)]
    return rows


def _expected(rows):
    groups: dict = {}
    for page_id, url, html, *_ in rows:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append((page_id is None, page_id or 0, url is None, url or "", page_id))
    out = []
    for payload, own in groups.items():
        own.sort()
        for i, x in enumerate(own):
            revisit = len(payload) >= 100 and i > 0
            out.append((x[4], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", own[0][4] if revisit else None))
    return sorted(out, key=repr)


def _files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".gz")}


def test_round_trip_and_same_bytes(spark, pages, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    frame = spark.createDataFrame(pages, PAGES)
    warc.write_warc(frame.coalesce(1), a, ranges=7, file_bytes=8_000)
    warc.write_warc(frame.repartition(9, "html"), b, ranges=7, file_bytes=8_000)
    assert sorted([tuple(r) for r in warc.read_pages(spark, a).collect()], key=repr) == _expected(pages)
    files = _files(tmp_path / "a")
    assert files == _files(tmp_path / "b")
    assert not [f for f in os.listdir(tmp_path / "a") if not f.endswith(".gz") and f != "manifest"]
    # Files are rolled by their compressed size, but a record is never cut.
    assert len(files) > 7 and sum(len(x) > 8_000 for x in files.values()) <= 1
    listed = {r.file: r for r in warc.manifest(spark, a).collect()}
    assert set(listed) == set(files)
    for f, data in files.items():
        assert listed[f].bytes == len(data) and listed[f].sha256 == hashlib.sha256(data).hexdigest()
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == listed[f].records
    ids = [r.page_id for r in warc.read_warc(spark, a).collect() if r.page_id is not None]
    in_order = [int(x.split(b"\r\n")[0]) for f in sorted(files) for x in gzip.decompress(files[f]).split(b"X-Page-ID: ")[1:]]
    assert in_order == sorted(ids)


def test_records_as_written(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame([(1, "http://a/%\r\nX: y", "é" * 60, None, None, None), (2, None, "é" * 60, None, None, None)], PAGES), path)
    text = gzip.decompress(b"".join(_files(tmp_path / "a").values())).decode()
    first, second = text.split("WARC/1.1\r\n")[1:]
    assert "WARC-Target-URI: http://a/%25%0D%0AX: y\r\n" in first and first.endswith("é" * 60 + "\r\n\r\n")
    assert f"WARC-Payload-Digest: sha256:{hashlib.sha256(('é' * 60).encode()).hexdigest()}\r\n" in second
    name = first.split("WARC-Record-ID: ")[1].split("\r\n")[0]
    assert f"WARC-Refers-To: {name}\r\n" in second and "é" not in second and "Target" not in second
    records = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert records[1].url == "http://a/%\r\nX: y" and bytes(records[1].payload).decode() == "é" * 60 and records[2].payload is None


def test_damage_is_an_error(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(pages[:5], PAGES), path, ranges=1)
    (file, data), = _files(tmp_path / "a").items()
    plain = gzip.decompress(data)
    changed = plain[:-8] + bytes([plain[-8] ^ 1]) + plain[-7:]
    for bad, said in ((gzip.compress(changed), "damaged"), (data[:-20], "cut off"), (gzip.compress(plain.rpartition(b"WARC/1.1")[0]), "damaged|records")):
        (tmp_path / "a" / file).write_bytes(bad)
        with pytest.raises(Exception, match=said):
            warc.read_warc(spark, path).collect()


def test_commit_twice_and_lost_files(tmp_path):
    folder = tmp_path / "_temporary"
    folder.mkdir()
    (folder / "attempt-x").write_bytes(b"abc")
    row = pa.RecordBatch.from_pylist([{"file": "x", "attempt": "attempt-x", "bytes": 3}])
    for _ in range(2):
        list(warc._commit(str(tmp_path), str(folder))([row]))
        assert (tmp_path / "x").read_bytes() == b"abc"
    (tmp_path / "x").unlink()
    with pytest.raises(OSError):
        list(warc._commit(str(tmp_path), str(folder))([row]))


def test_empty_table_and_taken_folder(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    none = spark.createDataFrame([], PAGES)
    assert warc.write_warc(none, path).collect() == [] and warc.read_pages(spark, path).collect() == []
    with pytest.raises(FileExistsError):
        warc.write_warc(none, path)
