"""WARC records in ZIP packages: a writer, and a reader that never unpacks an archive.

Every task writes packages that hold stored (uncompressed) members: a WARC archive and its index of JSON lines.  The reader
finds the end of the central directory, follows the ZIP64 locator where there is one, lists the members, and then
reads single records by range: from the index, each record's place in the archive member.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.runtime import new_path, stage

#: Payload bytes after which a task closes a package and begins another.
PACKAGE_BYTES = 8 << 20
ARCHIVE, INDEX = "archive/records.warc", "indexes/records.cdxj"

#: Fixed values of the ZIP format: signatures, and the marks that refer to ZIP64 fields.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF
STORED, ZIP64_EXTRA = 0, 1


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where the local header begins


class ZipDirectory:
    """Members of a ZIP package, found by range reads of a seekable file."""

    def __init__(self, file, size: int):
        self._file = file
        tail_at = max(0, size - (22 + MARK16))
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0:
            # the comment must reach exactly to the end, or these bytes are part of a comment
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end_at = tail_at + at
        if end_at >= 20 and (MARK16 == count or MARK32 in (length, start)):
            locator = self._read(end_at - 20, 20)
            if locator[:4] == LOCATOR64:
                end64 = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64:
                    raise ValueError("broken ZIP64 directory")
                count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members = {m.name: m for m in self._parse(self._read(start, length), count)}

    def _read(self, at: int, length: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(length)
        if len(data) != length:
            raise ValueError("package is cut short")
        return data

    @staticmethod
    def _parse(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_comment, header = struct.unpack_from("<H8xIIHHH8xI", data, at + 10)
            name = data[at + 46 : at + 46 + n_name].decode()
            extra, place = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while place + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, place)
                if kind == ZIP64_EXTRA:
                    # only the fields marked in the entry are there, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                    size = next(wide) if size == MARK32 else size
                    packed = next(wide) if packed == MARK32 else packed
                    header = next(wide) if header == MARK32 else header
                place += 4 + n
            yield Member(name, method, size, header)
            at += 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        member = self.members[name]
        if member.method != STORED:
            raise ValueError(f"{name} is compressed")
        local = self._read(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n_name + n_extra, member.size

    def read(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        start, size = self.place(name)
        return self._read(start + at, size - at if length is None else length)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value) -> str:
    return " ".join(str(value).split())


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with the payload, or a revisit that has the HTTP header only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields of one record, its HTTP fields and its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _open_fs(path: str):
    return fs.FileSystem.from_uri(path)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``digest`` (SHA-1, hexadecimal) and ``refers_to``.

    Of the rows with equal payloads of at least ``min_bytes`` bytes the one with the largest ``page_id`` is the
    response; the others get its id.  Rows that repeat the largest id are responses too, and rows without an id
    refer to the largest id there is.  Only payloads that occur more than once are joined back, by their digest.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    long_enough = pages.filter(F.length(payload) >= min_bytes).select("page_id", F.sha1(payload).alias("digest"))
    repeated = (
        long_enough.groupBy("digest")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1 AND _last IS NOT NULL")
        .select("digest", "_last")
    )
    joined = rows.join(stage(repeated, "repeated"), "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))).drop("_last")


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, digest, refers_to`` rows as packages in ``folder``, a URI that all executors reach.

    Returns the staged list of packages ``(package, records)``.  A task names its packages anew each time it runs,
    and only those of the attempt that succeeded are listed, so a repeated task leaves no double records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_fs(folder)
        system.create_dir(root, recursive=True)
        records: list[bytes] = []
        index: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal records, index, size
            name = f"part-{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                    for record in records:
                        member.write(record)
                package.writestr(zipfile.ZipInfo(INDEX), b"".join(index))
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], names=["package", "records"])
            records, index, size = [], [], 0
            return done

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    record = warc_record(row["page_id"], row["url"], payload, digest, row["refers_to"])
                    index.append(json.dumps({"page_id": row["page_id"], "offset": size, "length": len(record)}).encode() + b"\n")
                    records.append(record)
                    size += len(record)
                    if size >= package_bytes:
                        yield close()
        if records:
            yield close()

    return stage(pages.mapInArrow(run, "package string, records bigint"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the listed packages, read by range.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; with ``with_payload`` also ``url`` and
    ``payload`` (null for revisits).  A response's payload must have the digest and length in its header.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += ", url string, payload binary" if with_payload else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        wide = 7 if with_payload else 5
        for batch in batches:
            for package in batch.column(0).to_pylist():
                system, path = _open_fs(package)
                with system.open_input_file(path) as file:
                    directory = ZipDirectory(file, file.size())
                    start, size = directory.place(ARCHIVE)
                    rows = []
                    for line in directory.read(INDEX).splitlines():
                        entry = json.loads(line)
                        if entry["offset"] + entry["length"] > size:
                            raise ValueError("an index entry points beyond its archive")
                        file.seek(start + entry["offset"])
                        record = parse_record(file.read(entry["length"]))
                        fields, kind = record["fields"], record["fields"]["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(record["http"]["Content-Length"])
                        if kind == "response" and (len(record["payload"]) != n or base32_digest(record["payload"]) != digest):
                            raise ValueError(f"damaged record in {package}")
                        page = fields["WARC-Record-ID"][10:-1]
                        refers = fields.get("WARC-Refers-To")
                        rows.append(
                            (int(page) if page else None, n, digest, kind, int(refers[10:-1]) if refers else None, fields["WARC-Target-URI"], record["payload"] if kind == "response" else None)
                        )
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(wide)], names=names[:wide])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(wide)], names=names[:wide])

    return packages.select("package").repartition(max(1, packages.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record and read the archives back.

    A null ``html`` is an empty payload; a repeated row is a record of its own; other columns are ignored.
    """
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith(("file:", "/")) else f"/{folder}"
    return read_packages(write_packages(with_references(pages, min_bytes), folder))
