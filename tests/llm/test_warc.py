"""Packages against the standard library's ZIP module, and pages through archives and back."""

import gzip
import hashlib
import io
import random
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import warc

SCHEMA = "page_id long, url string, html string"


def package(entries, comment=b"", prefix=b"", wide=False, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, data in entries:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
    return prefix + out.getvalue()


def to_wide(data):
    """The same package with its directory's end told by ZIP64 records alone, and every field of its entries full."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos, begin = z.infolist(), z.start_dir
    body = data[:begin]
    entries = b""
    for i in infos:
        extra = struct.pack("<HHQQQ", 1, 24, i.file_size, i.compress_size, i.header_offset)
        name = i.filename.encode()
        entries += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, i.compress_type, 0, 33, i.CRC, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(infos), len(infos), len(entries), begin)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, begin + len(entries), 1)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return body + entries + end64 + locator + end


def listed(data):
    f = pa.BufferReader(data)
    return {m.name: (m.method, data[m.begin : m.begin + m.size]) for m in warc.members(f)}


def test_directories():
    entries = [("a.txt", b"alpha"), ("dir/bü.bin", b"\0" * 1000), ("empty", b"")]
    expect = {n: (0, d) for n, d in entries}
    assert listed(package(entries)) == expect
    assert listed(package(entries, comment=b"a comment with PK\5\6 inside" + b"x" * 30)) == expect
    assert listed(package(entries, prefix=b"#!/bin/sh\n" * 9)) == expect
    assert listed(package(entries, wide=True)) == expect
    assert listed(to_wide(package(entries))) == expect
    assert listed(b"some bytes before" + to_wide(package(entries))) == expect
    assert listed(package([])) == {}
    for broken in (b"", b"no package", package(entries)[:-30], to_wide(package(entries))[:40]):
        with pytest.raises(ValueError):
            listed(broken)


def test_records_round_trip():
    for payload in (b"", b"x", b"\r\n\r\n" * 5, "Żółć".encode() * 100):
        head, block = warc.parse_record(warc.record("response", 7, "http://a.b/é?q=1\r\nX: y", payload, "d"))
        assert head["warc-type"] == "response" and "\r" not in head["warc-target-uri"] and warc._row("p", head, block)["payload"] == payload
    head, block = warc.parse_record(warc.record("revisit", 8, None, b"abc", "d", 7))
    assert head["warc-refers-to"] == "<urn:page:7>" and warc._row("p", head, block)["payload"] is None and b"Content-Length: 3" in block


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 100 and same and page_id != min(same)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def rows_of(rng, n):
    texts = ["<p>" + "é" * k for k in (0, 46, 48, 49, 60, 500)] + ["x" * 99, "x" * 100, "\r\n" * 80]
    return [(rng.randrange(10**6), f"http://host{rng.randrange(9)}.example/p?{i}", rng.choice(texts) if rng.random() < 0.7 else f"<b>{i}</b>" * rng.randrange(40)) for i in range(n)]


def test_pages_survive(spark, monkeypatch):
    rng = random.Random(1)
    rows = rows_of(rng, 400) + [(5, None, None), (6, "", ""), (7, "not a url [", "y" * 200), (None, "u", "y" * 200), (None, "u", "z" * 200), (None, "u", "z" * 200), (9, "u", "w" * 150), (9, "v", "w" * 150), (10, "v", "w" * 150), (9, "v", "v" * 150), (11, "v", "v" * 150)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("x")).withColumn("record_type", F.lit(1)).repartition(5)
    assert result(warc.archived_pages(pages)) == brute(rows)
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_long_payload_and_many_packages(spark, monkeypatch):
    long = "".join(random.Random(2).choices("abcdefgh <>\n", k=6_000_000))
    rows = [(1, "u", long), (2, "u", long), (3, "u", "short")]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert result(warc.archived_pages(pages)) == brute(rows)


def test_packages_are_plain_zips_and_ranges_cover_them(spark, tmp_path):
    rows = rows_of(random.Random(3), 120)
    made = warc.write_packages(warc.marked_copies(spark.createDataFrame(rows, SCHEMA)).coalesce(2), str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in made) == len(rows)
    n = 0
    for r in made:
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX} and all(i.compress_type == 0 for i in z.infolist())
            n += gzip.decompress(z.read(warc.ARCHIVE)).count(b"WARC/1.1\r\n")
        spans = sorted((x["begin"], x["begin"] + x["size"]) for x in warc._ranges_of(r["path"]))
        assert sum(b - a for a, b in spans) == r["bytes"]
    assert n == len(rows)


def test_foreign_packages(spark, tmp_path):
    """Archives without an index, uncompressed ones, deflated indexes; what can't be read is told and harms nothing."""
    records = [warc.record("response", i, f"http://h/{i}", f"page {i}".encode() * 50, "d") for i in range(30)]
    (tmp_path / "plain.zip").write_bytes(package([("archive/x.warc", b"".join(records[:10]))]))
    (tmp_path / "walk.zip").write_bytes(to_wide(package([("archive/y.warc.gz", b"".join(map(gzip.compress, records[10:20])))])))
    at, lines = 0, []
    for r in records[20:]:
        lines.append('key 2024 {"filename": "z.warc", "offset": "%d", "length": "%d"}' % (at, len(r)))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/z.warc", b"".join(records[20:]))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
        z.writestr("archive/packed.warc", records[0] * 50, zipfile.ZIP_DEFLATED)
        z.writestr("notes.txt", "no archive")
    (tmp_path / "index.zip").write_bytes(out.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    packages = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    ranges = warc.record_ranges(packages)
    errors = [r["error"] for r in ranges.collect() if r["error"]]
    assert len(errors) == 2 and any("compressed" in e for e in errors)
    rows = warc.read_ranges(ranges).collect()
    assert sorted(r["payload"] for r in rows) == sorted(f"page {i}".encode() * 50 for i in range(30))


def repacked(path, lines):
    """The package again, with these lines of its index alone."""
    with zipfile.ZipFile(path) as z:
        archive, index = z.read(warc.ARCHIVE), z.read(warc.INDEX).split(b"\n")[:-1]
    return package([(warc.ARCHIVE, archive), (warc.INDEX, b"".join(line + b"\n" for line in index[lines]))])


@pytest.mark.parametrize("damage", ["cut", "empty", "zeros", "short index"])
def test_pages_fail_if_packages_break(spark, monkeypatch, damage):
    """Of several packages one is damaged after it was written: that is an error, not a table with fewer rows."""
    write = warc.write_packages

    def broken(marked, folder):
        made = write(marked.repartition(3), folder)
        path = min(r["path"] for r in made.collect())
        with open(path, "rb") as f:
            data = f.read()
        if damage == "short index":
            data = repacked(path, slice(0, -1))
        else:
            data = {"cut": data[:-40], "empty": b"", "zeros": b"\0" * len(data)}[damage]
        with open(path, "wb") as f:
            f.write(data)
        return made

    monkeypatch.setattr(warc, "write_packages", broken)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 30) for i in range(60)], SCHEMA)
    with pytest.raises(ValueError, match="can't be read|records were written"):
        warc.archived_pages(pages).collect()


def test_pages_fail_if_the_storage_fails(spark, tmp_path, monkeypatch):
    packages = spark.createDataFrame([(str(tmp_path / "gone.zip"),)], "path string")
    with pytest.raises(Exception, match="FileNotFoundError"):
        warc.record_ranges(packages)

    def refused(path):
        raise OSError("try again later")

    monkeypatch.setattr(warc, "_ranges_of", refused)
    with pytest.raises(Exception, match="try again later"):
        warc.archived_pages(spark.createDataFrame([(1, "u", "x" * 200)], SCHEMA)).collect()


def test_pages_fail_if_records_get_lost(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 200) for i in range(5)], SCHEMA)
    read = warc.read_ranges
    with monkeypatch.context() as m:
        m.setattr(warc, "read_ranges", lambda ranges: read(ranges).where("record_id <> 'urn:page:3'"))
        with pytest.raises(ValueError, match="5 records were written, 4 read"):
            warc.archived_pages(pages)
    other = F.when(F.col("record_type") == "response", F.lit("urn:page:77")).otherwise(F.col("record_id"))
    with monkeypatch.context() as m:
        m.setattr(warc, "read_ranges", lambda ranges: read(ranges).withColumn("record_id", other))
        with pytest.raises(Exception, match="revisits a payload of page 0 that wasn't read"):
            warc.archived_pages(pages).collect()


def test_packages_that_cannot_be_read_fail(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(package([("archive/x.warc", warc.record("response", 1, "u", b"page", "d"))]))
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    packages = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    with pytest.raises(ValueError, match="broken.zip: ValueError: not a ZIP package"):
        warc.read_packages(packages)
    assert [r["payload"] for r in warc.read_packages(packages.where("path like '%good.zip'")).collect()] == [b"page"]
    (tmp_path / "named.zip").write_bytes(package([("archive/x.warc", b""), ("indexes/index.cdxj", b'k 1 {"filename": "y.warc", "offset": 0, "length": 9}')]))
    with pytest.raises(ValueError, match="y.warc is in an index, but not in the package"):
        warc.read_packages(spark.createDataFrame([(str(tmp_path / "named.zip"),)], "path string"))


@pytest.mark.parametrize("gz", [False, True])
def test_walks_tell_what_breaks_off(gz):
    records = [warc.record("response", i, f"http://h/{i}", random.Random(i).randbytes(50_000 * (i % 3)), "d") for i in range(12)]
    walked = lambda data: [head["warc-record-id"] for head, _ in warc.walk(io.BufferedReader(io.BytesIO(data)), gz)]
    parts = [gzip.compress(r) for r in records] if gz else records
    whole, ids = b"".join(parts), [f"<urn:page:{i}>" for i in range(12)]
    assert walked(whole) == ids and walked(b"") == []
    assert walked(b"\r\n".join(parts) + b"\r\n") == ids
    last = len(whole) - len(parts[-1])
    for cut in (last + 5, last + 100, len(whole) - 6, len(whole) - 30_000):
        with pytest.raises(ValueError):
            walked(whole[:cut])
    if gz:  # several records in a member
        assert walked(gzip.compress(b"".join(records[:7])) + b"".join(parts[7:])) == ids


def test_indexes_of_several_members(tmp_path):
    """An index of gzip members names the records of all of them; one that breaks off is an error; archives of the same name are all read."""
    record = warc.record("response", 1, "u", b"page", "d")
    lines = [b'k %d {"filename": "x.warc", "offset": %d, "length": %d}\n' % (i, i * len(record), len(record)) for i in range(9)]
    index = b"".join(gzip.compress(b"".join(lines[i : i + 3])) for i in (0, 3, 6))
    (tmp_path / "whole.zip").write_bytes(package([("archive/x.warc", record * 9), ("indexes/index.cdx.gz", index)]))
    (found,) = warc._ranges_of(str(tmp_path / "whole.zip"))
    assert found["starts"] == [i * len(record) for i in range(9)] and found["size"] == 9 * len(record)
    (tmp_path / "cut.zip").write_bytes(package([("archive/x.warc", record * 9), ("indexes/index.cdx.gz", index[:-12])]))
    with pytest.raises(ValueError, match="end too early"):
        list(warc._ranges_of(str(tmp_path / "cut.zip")))
    (tmp_path / "twice.zip").write_bytes(package([("a/x.warc", record * 2), ("b/x.warc", record * 3), ("indexes/index.cdxj", b"".join(lines[:2]))]))
    assert sorted((r["starts"], r["size"]) for r in warc._ranges_of(str(tmp_path / "twice.zip"))) == [(None, 2 * len(record)), (None, 3 * len(record))]
