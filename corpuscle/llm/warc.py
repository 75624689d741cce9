"""WARC records in ZIP-packaged archives: written, indexed, and read by ranges without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip
member a record) and ``indexes/index.cdxj`` (a line for each record with its
offset and length). The reader parses the end records and the central directory,
ZIP64 forms included, finds where the stored members lie, and reads records by
offset; it takes any number of data members and indexes, whatever their names. A
table of archives has a row for each archive, so it can be written by Spark to any
store; archives that are files are read in place by ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm._spark import Tables

#: Reads (offset, size) of an archive.
ReadAt = Callable[[int, int], bytes]
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 writes the 64-bit forms even where they aren't needed."""
    out, central, at = [], [], 0
    for name, body in members:
        title, crc, size = name.encode("utf-8"), zlib.crc32(body), len(body)
        wide = zip64 or size >= _FULL32 or at >= _FULL32
        short = _FULL32 if wide else size
        version = 45 if wide else 20
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0x800, 0, 0, 33, crc, short, short, len(title), len(extra)) + title + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0x800, 0, 0, 33, crc, short, short, len(title), len(extra), 0, 0, 0, 0, _FULL32 if wide else at) + title + extra)
        out += [local, body]
        at += len(local) + size
    directory = b"".join(central)
    end, n = at + len(directory), len(members)
    if zip64 or end >= _FULL32 or n >= _FULL16:
        out64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        tail = out64 + struct.pack("<4sHHHHIIH", b"PK\5\6", _FULL16, _FULL16, _FULL16, _FULL16, _FULL32, _FULL32, 0)
    else:
        tail = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, len(directory), at, 0)
    return b"".join([*out, directory, tail])


class Member(NamedTuple):
    """Where the bytes of a member lie in its archive, and if they are stored as they are (method 0)."""

    offset: int
    size: int
    method: int


def zip_directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset, size) of the stored members of a ZIP file, from its central directory."""
    return {name: (m.offset, m.size) for name, m in zip_members(read_at, size).items() if m.method == 0}


def zip_members(read_at: ReadAt, size: int) -> dict[str, Member]:
    """All members of a ZIP file by name, from its central directory; ZIP64 forms are read where they are used."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    while k >= 0 and k + 22 + int.from_bytes(tail[k + 20 : k + 22], "little") != len(tail):
        k = tail.rfind(b"PK\5\6", 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, at, _ = struct.unpack("<4sHHHHIIH", tail[k : k + 22])
    locator = read_at(tail_at + k - 20, 20) if tail_at + k >= 20 else b""
    if locator[:4] == b"PK\6\7" and (n == _FULL16 or _FULL32 in (length, at)):
        place = struct.unpack("<4sIQI", locator)[2]
        wide = struct.unpack("<4sQHHIIQQQQ", read_at(place, 56))
        if wide[0] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory where its locator says")
        n, length, at = wide[7], wide[8], wide[9]
    directory, out, p = read_at(at, length), {}, 0
    for _ in range(n):
        f = struct.unpack("<4sHHHHHHIIIHHHHHII", directory[p : p + 46])
        if f[0] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_comment, local = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                full = next(values) if full == _FULL32 else full
                packed = next(values) if packed == _FULL32 else packed
                local = next(values) if local == _FULL32 else local
            extra = extra[4 + width :]
        head = read_at(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no local header where the directory says")
        out[name] = Member(local + 30 + sum(struct.unpack("<HH", head[26:30])), packed, method)
        p += 46 + n_name + n_extra + n_comment
    return out


def payload_digest(sha1_hex: str) -> str:
    """Upper-case base32 of a SHA-1."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode("ascii")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record, a gzip member or plain; the payload of an HTTP body is what follows its header."""
    raw = zlib.decompressobj(31).decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else body


def index_lines(read_at: ReadAt, members: dict[str, Member]) -> Iterator[dict]:
    """The entries of every CDXJ index of an archive (plain, gzip or deflated members below indexes/), offsets as numbers."""
    for name in sorted(n for n in members if n.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", n)):
        at, size, method = members[name]
        raw = read_at(at, size)
        if method == 8:
            raw = zlib.decompressobj(-15).decompress(raw)
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        for line in raw.decode("utf-8").splitlines():
            start = line.find("{")
            if start >= 0 and not line.startswith("!"):
                entry = json.loads(line[start:])
                if "offset" in entry and "length" in entry:
                    yield entry | {"offset": int(entry["offset"]), "length": int(entry["length"])}


def record_ranges(read_at: ReadAt, size: int) -> Iterator[tuple[dict, int, int]]:
    """(index entry, offset, length) of every indexed record of an archive, offsets being those in the archive file.

    An entry's filename names its data member, with or without its folder; it may
    be left out where there is but one. Data members must be stored: a packed one
    has no ranges, and records that lie in it raise an error.
    """
    members = zip_members(read_at, size)
    data = {n: m for n, m in members.items() if re.search(r"\.warc(\.gz)?$", n)}
    short = {n.rsplit("/", 1)[-1]: m for n, m in data.items()}
    for entry in index_lines(read_at, members):
        name = entry.get("filename")
        member = data.get(name) or short.get((name or "").rsplit("/", 1)[-1]) or (next(iter(data.values())) if name is None and len(data) == 1 else None)
        if member is None or member.method != 0:
            raise ValueError(f"no stored data member {name!r}")
        if entry["offset"] + entry["length"] > member.size:
            raise ValueError(f"a record of {name!r} ends beyond it")
        yield entry, member.offset + entry["offset"], entry["length"]


def read_archive(read_at: ReadAt, size: int) -> Iterator[tuple[dict, dict[str, str], bytes]]:
    """(index entry, headers, payload) of every record of an archive, each read by its range."""
    for entry, at, length in record_ranges(read_at, size):
        yield entry, *parse_record(read_at(at, length))


def archives(tables: Tables, pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 4 << 20, zip64: bool = True) -> DataFrame:
    """(name, n_records, content): archives with a record for each row of (page_id, url, html).

    Of equal payloads of at least least_bytes, that with the smallest page_id is a
    response and the others revisit it; rows that repeat that page_id are
    responses too. A null html is an empty payload; a null page_id is never
    referred to while its group has another.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload"))
    groups = pages.where(F.length("payload") >= least_bytes).groupBy(F.col("sha1").alias("g")).agg(F.count("*").alias("n"), F.min("page_id").alias("keeper"))
    shared = tables.write(groups.where("n > 1").select("g", "keeper"), "shared")  # its size then decides how it is joined
    joined = pages.join(shared, (F.col("sha1") == F.col("g")) & (F.length("payload") >= least_bytes), "left")
    joined = joined.select("page_id", "url", "payload", "sha1", "keeper", (F.col("g").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, index, at = TaskContext.get().partitionId(), 0, [], [], 0

        def packed() -> pa.RecordBatch:
            body = zip_stored([(DATA, b"".join(held)), (INDEX, "".join(index).encode("utf-8"))], zip64)
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{seq:06d}.wacz"]), pa.array([len(held)], pa.int64()), pa.array([body], pa.binary())], names=["name", "n_records", "content"])

        for batch in batches:
            for page, url, payload, sha1, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _record(page, url, payload, payload_digest(sha1), keeper, revisit)
                index.append(f"{(url or '-').replace(' ', '%20').replace(chr(10), '%0A').replace(chr(13), '%0D')} 20240101000000 " + json.dumps({"offset": at, "length": len(record), "filename": "data.warc.gz", "page": page}) + "\n")
                held.append(record)
                at += len(record)
                if at >= archive_bytes:
                    yield packed()
                    seq, held, index, at = seq + 1, [], [], 0
        if held:
            yield packed()

    return joined.mapInArrow(run, "name string, n_records long, content binary")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_id string, refers_to_id string, url string, digest_ok boolean, payload binary"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]


def _page(record_id: str | None) -> int | None:
    """The page of a record that archives() wrote."""
    inner = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if re.fullmatch(r"-?\d+", inner) else None


def _row(name: str, head: dict[str, str], payload: bytes, strict: bool, payloads: bool) -> tuple:
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest")
    own = payload_digest(hashlib.sha1(payload).hexdigest()) if kind != "revisit" else None
    stated = digest.removeprefix("sha1:") if digest and digest.startswith("sha1:") else None
    good = None if own is None or stated is None else own == stated
    if strict and good is False:
        raise ValueError(f"a payload of {name} does not have its digest")
    size = len(payload) if own is not None else head.get("warc-payload-length")
    record, refers = head.get("warc-record-id"), head.get("warc-refers-to")
    return (
        _page(record), None if size is None else int(size), stated or digest or own, kind, _page(refers) if kind == "revisit" else None, name,
        record, refers, head.get("warc-target-uri"), good, payload if payloads else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns, _KINDS)), names=[f.split()[0] for f in RECORDS.split(", ")])


def read_records(archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record of archives held as rows (name, content), payloads only if asked for.

    Digests of payloads are verified; a wrong one raises an error if strict, else
    digest_ok is false. page_id and refers_to are those of archives that this
    module wrote and null elsewhere; record_id and refers_to_id are those of any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                records = read_archive(lambda at, n, view=view: bytes(view[at : at + n]), len(view))
                yield _batch([_row(name.as_py(), head, payload, strict, payloads) for _, head, payload in records])

    found = archives.select("name", "content").mapInArrow(run, RECORDS)
    return found if payloads else found.drop("payload")


#: Opens a path for reading by ranges: a context manager that gives ReadAt.
Opener = Callable[[str], AbstractContextManager[ReadAt]]


@contextmanager
def open_ranges(path: str) -> Iterator[ReadAt]:
    """Reads ranges of a file in any store that pyarrow.fs knows by its URI, or of a local path."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as file:
        yield lambda at, n: file.read_at(n, at)


def read_archive_files(spark: SparkSession, path: str, payloads: bool = False, strict: bool = False, opener: Opener = open_ranges, run_bytes: int = 64 << 20) -> DataFrame:
    """read_records of archive files (.wacz, .zip) below a path, of any size, read by ranges alone.

    Names and sizes come from Spark's listing, which does not open the files. One
    task an archive reads its directory and index; the records are then dealt out
    in runs of about run_bytes, so a large archive is read by many tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.lower("path").rlike(r"\.(wacz|zip)$"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opener(name) as read_at:
                    found = [(name, at, n) for _, at, n in record_ranges(read_at, size)]
                columns = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "at", "n"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for name, run in groupby(places, key=lambda x: x[0]):
                with opener(name) as read_at:
                    for _, at, n in run:
                        yield _batch([_row(name, *parse_record(read_at(at, n)), strict, payloads)])

    places = files.repartition("path").mapInArrow(ranges, "path string, at long, n long")
    places = places.repartition("path", F.floor(F.col("at") / run_bytes)).sortWithinPartitions("path", "at")
    found = places.mapInArrow(records, RECORDS)
    return found if payloads else found.drop("payload")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives to the shared folder and reads the records back."""
    tables = Tables(pages.sparkSession, "warc")
    options = {"compression": "uncompressed", "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}
    return read_records(tables.write(archives(tables, pages, least_bytes), "archives", **options))
