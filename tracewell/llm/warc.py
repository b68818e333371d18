"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member for each record) and ``indexes/index.cdxj`` (a line for each record with
its offset and length).  The reader parses a package's central directory, ZIP64
fields included, finds its archives and indexes, and reads records by ranges of
the package file; archives that no index covers are walked from their start.

Driver and tasks reach packages through pyarrow's file systems, by the URI of the
folder they lie in (a local or mounted path, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, shared_dir, stored
from .tokens import slices

#: Payloads of fewer bytes never become revisits.
LEAST_PAYLOAD = 100
#: A package ends with so many bytes of records; neighbouring records are read in one range of so many bytes; a task reads so many.
PACKAGE_BYTES, RANGE_BYTES, TASK_BYTES = 64 << 20, 4 << 20, 128 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- packages ---------------------------------------------------------------


def file_at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


class Member(NamedTuple):
    """A file inside a package: where its bytes begin, how many are stored, how it is compressed (0: not)."""

    name: str
    method: int
    begin: int
    size: int


def _within(f: pa.NativeFile, at: int, n: int) -> None:
    if at < 0 or n < 0 or at + n > f.size():
        raise ValueError("the package ends too early")


def _read(f: pa.NativeFile, at: int, n: int) -> bytes:
    _within(f, at, n)
    data = f.read_at(n, at)
    if len(data) < n:
        raise ValueError("the package ends too early")
    return data


def directory_range(f: pa.NativeFile) -> tuple[int, int, int, int]:
    """(begin, bytes, entries, shift) of the central directory; shift: bytes that stand before the package proper."""
    size = f.size()
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("not a ZIP package")
    entries, length, begin = struct.unpack_from("<HII", tail, end + 10)
    behind = tail_at + end
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        # the wide record ends right before its locator, unless it was moved by bytes before the package
        told = struct.unpack_from("<Q", tail, end - 12)[0]
        for at in (told, behind - 20 - 56):
            head = f.read_at(56, at) if 0 <= at < size else b""
            if head[:4] == b"PK\6\6":
                entries, length, begin = struct.unpack_from("<QQQ", head, 32)
                behind = at
                break
        else:
            raise ValueError("the ZIP64 directory is missing")
    shift = behind - length - begin
    if shift < 0:
        raise ValueError("the central directory is broken")
    return begin + shift, length, entries, shift


def members(f: pa.NativeFile) -> list[Member]:
    """All files of a package, by its central directory."""
    begin, length, entries, shift = directory_range(f)
    data, at, out = _read(f, begin, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != b"PK\1\2" or len(data) < at + 46:
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored_size, raw_size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        local = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # wide values, in this order, of those fields alone that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                raw_size, stored_size, local = (next(wide, -1) if v == 0xFFFFFFFF else v for v in (raw_size, stored_size, local))
                if min(raw_size, stored_size, local) < 0:
                    raise ValueError("the central directory is broken")
            extra = extra[4 + n :]
        if flags & 1:
            raise ValueError("the package is encrypted")
        head = _read(f, local + shift, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("a member's header is broken")
        out.append(Member(name, method, local + shift + 30 + sum(struct.unpack_from("<HH", head, 26)), stored_size))
        at += 46 + n_name + n_extra + n_comment
    return out


class _Range(io.RawIOBase):
    """A range of a package as a stream."""

    def __init__(self, f: pa.NativeFile, begin: int, size: int):
        _within(f, begin, size)
        self.f, self.at, self.end = f, begin, begin + size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.f.read_at(min(len(into), self.end - self.at), self.at) if self.at < self.end else b""
        if not data and self.at < self.end:
            raise ValueError("the package ends too early")
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def _pieces(stream: io.BufferedIOBase, n: int) -> Iterator[bytes]:
    while data := stream.read(n):
        yield data


def _inflated(pieces: Iterator[bytes], bits: int) -> Iterator[bytes]:
    """The bytes of all compressed streams that follow each other (gzip members may have line ends between)."""
    inflate = None
    for data in pieces:
        while data:
            if inflate is None:
                data = data.lstrip(b"\r\n") if bits > 0 else data
                inflate = zlib.decompressobj(bits) if data else None
                continue
            yield inflate.decompress(data)
            data = inflate.unused_data
            inflate = None if inflate.eof else inflate
    if inflate is not None:
        raise ValueError("compressed bytes end too early")


def _member_lines(f: pa.NativeFile, m: Member) -> Iterator[bytes]:
    """Lines of an index, which may be deflated, gzipped (in several members, too) or both."""
    pieces = _pieces(io.BufferedReader(_Range(f, m.begin, m.size), 1 << 20), 1 << 20)
    pieces = _inflated(pieces, -15) if m.method == 8 else pieces
    rest = b""
    for data in _inflated(pieces, 47) if m.name.endswith(".gz") else pieces:
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        yield from lines
    yield rest


# -- records ----------------------------------------------------------------


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A WARC record of a page; a revisit has the page's HTTP header, which tells the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")] if kind == "revisit" else []),
        ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """(fields by lower-case name, bytes of the header) of a record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one whole record."""
    head, at = parse_head(data)
    n = int(head["content-length"])
    if len(data) < at + n:
        raise ValueError("the record ends too early")
    return head, data[at : at + n]


def walk(stream: io.BufferedIOBase, gz: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive from its start; holds one record at a time.  One that breaks off is an error."""
    pieces = _pieces(stream, 1 << 16)
    rest, need = bytearray(), None
    for data in _inflated(pieces, 31) if gz else pieces:
        rest += data
        while True:
            if need is None:
                while rest[:1] in (b"\r", b"\n"):
                    del rest[:1]
                if not b"WARC/".startswith(rest[:5]):
                    raise ValueError("not a WARC record")
                end = rest.find(b"\r\n\r\n")
                if end < 0:
                    break
                head, at = parse_head(bytes(rest[: end + 4]))
                need = at + int(head["content-length"])
            if len(rest) < need:
                break
            yield parse_record(bytes(rest[:need]))
            del rest[:need]
            need = None
    if rest.strip(b"\r\n"):
        raise ValueError("the archive ends too early")


def sort_key(url: str) -> str:
    """The index's key: the host's parts turned round, then the path."""
    try:
        parts = urlsplit(url)
        return ",".join(reversed((parts.hostname or "").split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return url


class _Package:
    """A package that is being written; the archive streams to the file, index lines wait for its end."""

    def __init__(self, path: str):
        files, at = file_at(path)
        self.path, self.file = path, files.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes, url: str, digest: str, kind: str) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.archive.write(packed)
        about = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "digest": f"sha256:{digest}", "length": len(packed), "offset": self.size, "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{quote(sort_key(url), safe=',)/?=&%')} {re.sub('[^0-9]', '', _DATE)} {json.dumps(about)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(sorted(self.lines)).encode())
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines), self.size


def marked_copies(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): revisits of the smallest page_id that has the same payload.

    Payloads below ``LEAST_PAYLOAD`` bytes are always responses; so are all rows
    that bear the smallest id, should it repeat.  A null id is never the smallest
    unless all are null; then all are responses.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = base.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = base.join(groups.where("copies > 1").select("digest", "first"), "digest", "left")
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(copy, "revisit").otherwise("response").alias("record_type"), F.when(copy, F.col("first")).alias("refers_to"))


def write_packages(marked: DataFrame, folder: str) -> DataFrame:
    """Write the marked pages as packages into the folder; (path, records, bytes) of every package, stored.

    Files are named by the attempt that writes them, and only those of attempts
    that Spark commits are listed, so what a lost executor leaves is never read.
    """
    files, at = file_at(folder)
    files.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, package = TaskContext.get(), 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("path", "records", "bytes"), package.close())}, schema)

        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for part in slices(batches, "payload"):
            for page_id, url, payload, digest, kind, refers_to in zip(*[(c.cast(pa.binary()) if i == 2 else c).to_pylist() for i, c in enumerate(part.columns)]):
                package = package or _Package(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.zip")
                package.add(record(kind, page_id, url, payload, digest, refers_to), url or "", digest, kind)
                if package.size >= PACKAGE_BYTES:
                    yield closed()
                    made, package = made + 1, None
        if package:
            yield closed()

    columns = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
    return stored(bounded_batches(marked).select(*columns).mapInArrow(run, "path string, records long, bytes long"), "packages")


# -- reading ----------------------------------------------------------------

_RANGE = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("starts", pa.list_(pa.int64())), ("gz", pa.bool_()), ("error", pa.string())])


def _ranges_of(path: str) -> Iterator[dict]:
    """Ranges of a package: records that stand close together by its indexes; whole archives that no index names."""
    files, at = file_at(path)
    with files.open_input_file(at) as f:
        every = members(f)
        archives = [m for m in every if re.search(r"\.warc(\.gz)?$", m.name)]
        for m in archives:
            if m.method:
                yield {"path": path, "error": f"{m.name} is compressed"}
        # indexes name archives without their folder; of equal names none is meant for sure, so those are walked
        short = [m.name.rpartition("/")[2] for m in archives]
        archives = [(name, m) for name, m in zip(short, archives) if not m.method]
        named = {name for name, _ in archives if short.count(name) == 1}
        places: dict[str, list[tuple[int, int]]] = {}
        missing: set[str] = set()
        for m in every:
            if re.search(r"\.cdxj?(\.gz)?$", m.name):
                for line in _member_lines(f, m):
                    about = json.loads(line[line.index(b"{") :]) if b"{" in line else {}
                    name = (about.get("filename") or "").rpartition("/")[2]
                    if name in named:
                        places.setdefault(name, []).append((int(about["offset"]), int(about["length"])))
                    elif name and name not in short:
                        missing.add(name)
    for name in sorted(missing):
        yield {"path": path, "error": f"{name} is in an index, but not in the package"}
    for name, m in archives:
        gz = name.endswith(".gz")
        if name not in places:
            yield {"path": path, "begin": m.begin, "size": m.size, "starts": None, "gz": gz}
            continue
        starts, end = [], 0
        for begin, length in [*sorted(set(places[name])), (-1, 0)]:
            if starts and (begin != end or end - starts[0] >= RANGE_BYTES):
                yield {"path": path, "begin": m.begin + starts[0], "size": end - starts[0], "starts": [s - starts[0] for s in starts], "gz": gz}
                starts = []
            starts.append(begin)
            end = begin + length


def record_ranges(packages: DataFrame) -> DataFrame:
    """(path, begin, size, starts, gz, error) of all ranges to read in the packages (path), stored.

    ``starts`` are the records' places in the range, null for an archive without
    an index; of others, the records are those that the index names.  A package or
    archive that is broken gives one row that says why; ``read_ranges`` leaves those
    rows to the caller.  What the storage refuses, a missing package too, is no
    property of the package: it fails the task, so that Spark tries again and then
    fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = list(_ranges_of(path))
                except (ValueError, KeyError, TypeError, AttributeError, struct.error, zlib.error) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, _RANGE)

    return stored(packages.select("path").mapInArrow(run, "path string, begin long, size long, starts array<long>, gz boolean, error string"), "ranges")


_RECORD = pa.schema([(c, pa.string()) for c in ("path", "record_type", "record_id", "url", "refers_to", "digest")] + [("payload", pa.binary())])


def _row(path: str, head: dict[str, str], block: bytes) -> dict:
    kind = head.get("warc-type")
    payload = None
    if kind == "response" and head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind != "revisit":
        payload = block
    plain = {c: head.get(f) for c, f in (("record_id", "warc-record-id"), ("url", "warc-target-uri"), ("refers_to", "warc-refers-to"), ("digest", "warc-payload-digest"))}
    return {"path": path, "record_type": kind, "payload": payload, **{k: v and v.strip("<>") for k, v in plain.items()}}


def read_ranges(ranges: DataFrame) -> DataFrame:
    """(path, record_type, record_id, url, refers_to, digest, payload) of the ranges' records; a revisit's payload is null.

    Rows with an error have no range and are passed over (``read_packages`` fails on them); a record that is broken fails the job.
    """
    total = ranges.agg(F.sum("size").alias("n")).first()["n"] or 0
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                files, at = file_at(r["path"])
                rows, size = [], 0
                with files.open_input_file(at) as f:
                    if r["starts"] is None:
                        found = walk(io.BufferedReader(_Range(f, r["begin"], r["size"]), 1 << 20), r["gz"])
                    else:
                        data, cuts = _read(f, r["begin"], r["size"]), [*r["starts"], r["size"]]
                        parts = (data[a:b] for a, b in zip(cuts, cuts[1:]))
                        found = (parse_record(zlib.decompress(p, 31) if r["gz"] else p) for p in parts)
                    for head, block in found:
                        rows.append(_row(r["path"], head, block))
                        size += len(block)
                        if size >= RANGE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    good = bounded_batches(ranges).where("error is null").repartition(int(tasks))
    return good.mapInArrow(run, "path string, record_type string, record_id string, url string, refers_to string, digest string, payload binary")


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages (path), read by ranges; fails if a package or an archive in it can't be read.

    To read what is left beside broken packages, look at the errors of ``record_ranges`` and call ``read_ranges``.
    """
    ranges = record_ranges(packages)
    broken = ranges.where("error is not null").select("path", "error").limit(10).collect()
    if broken:
        raise ValueError("packages that can't be read: " + "; ".join(f"{r['path']}: {r['error']}" for r in broken))
    return read_ranges(ranges)


def page_records(records: DataFrame, written: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records as read; a revisit's payload is that of the response it names.

    The payload's bytes and digest are worked out from the payload itself; they are
    null for a revisit of a response that isn't there.  With the number of records
    ``written``, fails if not as many were read, or if such a revisit is found.
    """
    number = lambda c: F.regexp_extract(c, f"^{_ID}(-?[0-9]+)$", 1)
    narrow = records.select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"),
        F.regexp_extract("digest", "^sha256:([0-9a-f]+)$", 1).alias("told"),
    )
    narrow = stored(narrow, "records")
    if written is not None and (n := narrow.where("record_type in ('response', 'revisit')").count()) != written:
        raise ValueError(f"{written} records were written, {n} read")
    whole = narrow.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    named = whole.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("told"), "payload_digest").distinct()
    revisits = narrow.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told").join(named, ["refers_to", "told"], "left")
    if written is not None:
        lost = F.raise_error(F.format_string("page %s revisits a payload of page %s that wasn't read", F.col("page_id"), F.col("refers_to")))
        revisits = revisits.withColumns({c: F.coalesce(c, lost) for c in ("payload_bytes", "payload_digest")})
    return whole.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages written as WARC packages in the shared folder and read back.

    Returns one row per input row: page_id, payload_bytes and payload_digest (of
    the full payload, for revisits too), record_type, refers_to.  A null payload
    is an empty one; null ids stay null; repeated rows are recorded each (see
    ``marked_copies`` on ties); other columns are ignored; empty input gives no rows.
    Fails if a package can't be read back or not all its records come back.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    packages = write_packages(marked_copies(pages, id_col, url_col, payload_col), folder)
    return page_records(read_packages(packages), packages.agg(F.sum("records").alias("n")).first()["n"] or 0)
