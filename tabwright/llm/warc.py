"""WARC archives packaged in ZIP files: a writer, and a reader that takes byte ranges.

An archive is a ZIP whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip member per
record) and ``indexes/index.cdxj`` (offset and length of each record). The reader parses the end of central directory
record, its ZIP64 forms, the central directory and the local headers, so that a member's place is known without extraction;
records are then read as byte ranges, near ranges in one request. Archives live below the shared folder and are
opened through ``pyarrow.fs``; every attempt of a task writes a name of its own, and only archives in the manifest count.

Defined cases: NULL html is an empty payload; a NULL url is written as ``urn:none``; a NULL page_id never precedes another and
stays NULL; rows that share the largest page_id of a payload are all responses; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import attach, new_path, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins its next archive.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than this are read in one request; no request exceeds READ bytes unless a record does.
NEAR, READ = 1 << 16, 8 << 20
MANIFEST = "archive string, records long, bytes long"
RECORDS = ("page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "target_uri string, payload binary")


def _open(uri: str, write: bool = False):
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


# ---- records

def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own; its header keeps the length of the full one."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
             "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {(url or 'urn:none').splitlines()[0] if url else 'urn:none'}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names, under ``headers``) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    body = rest[:int(headers["content-length"])]
    return {"headers": headers, "payload": body.partition(b"\r\n\r\n")[2]}


# ---- writing

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Archive:
    """A ZIP being streamed out: records go through, their index is kept until the end."""

    def __init__(self, uri: str):
        self.uri, self.sink = uri, _open(uri, write=True)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, compresslevel=1, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> pd.DataFrame:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return pd.DataFrame({"archive": [self.uri], "records": [len(self.lines)], "bytes": [self.at]})


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for rows in batches:
            ids = rows[["page_id", "refers_to"]].astype("object")
            for page, refers, url, html, revisit in zip(ids["page_id"], ids["refers_to"], rows["url"], rows["html"],
                                                        rows["revisit"], strict=True):
                page, refers = (None if x is None or x != x else int(x) for x in (page, refers))
                if out is None:
                    task = TaskContext.get()
                    out = _Archive(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.zip")
                payload = html.encode()
                out.add(page, record(page, url, payload, base32_sha1(payload), refers, bool(revisit)))
                if out.at >= archive_bytes:
                    yield out.close()
                    out = None
        if out is not None:
            yield out.close()
    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)``; the manifest of complete archives.

    Of rows with equal payloads of at least ``min_bytes`` bytes the largest page_id is the response, others revisit it.
    Payloads are compared by SHA-1; digests shared by many rows meet the rows by broadcast of those digests only.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
                        F.unhex(F.sha1(html)).alias("digest"))
    seen = stage(rows.select("page_id", "digest"), "payloads")
    best = seen.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    known = attach(rows, stage(best, "best"), ["digest"], "n", max(1, seen.count()))
    revisit = ~F.col("page_id").eqNullSafe(F.col("best")) & (F.octet_length("html") >= min_bytes)
    dealt = known.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("best")).alias("refers_to"))
    return stage(dealt.mapInPandas(_writer(folder, archive_bytes), MANIFEST), "manifest")


# ---- reading

def _u(fmt: str, data: bytes, at: int) -> tuple:
    return struct.unpack_from("<" + fmt, data, at)


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members of a ZIP, from its central directory.

    Sizes and offsets of 2^32 - 1 (counts of 2^16 - 1) are taken from the ZIP64 records and extra fields.
    """
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = _u("HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator:locator + 4] == b"PK\x06\x07":
        where = _u("Q", tail, locator + 8)[0]
        file.seek(where)
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 record")
        n, length, start = _u("QQQ", wide, 32)
    file.seek(start)
    directory, at, out = file.read(length), 0, {}
    for _ in range(n):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = _u("H", directory, at + 10)[0]
        packed, plain = _u("II", directory, at + 20)
        names, extras, comment = _u("HHH", directory, at + 28)
        local = _u("I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + names].decode()
        extra = directory[at + 46 + names:at + 46 + names + extras]
        packed, local = _wide(extra, plain, packed, local)
        at += 46 + names + extras + comment
        if method == 0:
            file.seek(local)
            head = file.read(30)
            skip = sum(_u("HH", head, 26))
            out[name] = (local + 30 + skip, packed)
    return out


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
    """Packed size and local offset, from the ZIP64 extra field where the short forms are full."""
    full, at = 0xFFFFFFFF, 0
    while at + 4 <= len(extra):
        kind, size = _u("HH", extra, at)
        if kind == 1:
            place = at + 4
            if plain == full:
                place += 8
            if packed == full:
                packed, place = _u("Q", extra, place)[0], place + 8
            if local == full:
                local = _u("Q", extra, place)[0]
        at += 4 + size
    return packed, local


def ranges(index: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """(offset, length) entries in ascending order, grouped into reads."""
    group: list[tuple[int, int]] = []
    for offset, length in sorted(index):
        if group and (offset - sum(group[-1]) > NEAR or offset + length - group[0][0] > READ):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def read_archive(uri: str) -> Iterator[dict]:
    """The records of an archive by range reads."""
    with _open(uri) as file:
        found = members(file, file.size())
        (data, _), (index, length) = found[DATA], found[INDEX]
        file.seek(index)
        lines = [json.loads(x) for x in file.read(length).decode().split("\n") if x]
        for group in ranges([(x["offset"], x["length"]) for x in lines]):
            first, last = group[0][0], sum(group[-1])
            file.seek(data + first)
            block = file.read(last - first)
            for offset, size in group:
                yield parse_record(zlib.decompress(block[offset - first:offset - first + size], 31))


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for uri in rows["archive"]:
                out, held = [], 0
                for found in read_archive(uri):
                    h, payload = found["headers"], found["payload"]
                    revisit = h["warc-type"] == "revisit"
                    number = lambda k, h=h: int(h[k]) if k in h else None              # noqa: E731
                    out.append((number("x-page-id"), h["warc-type"], number("x-refers-to-page"),
                                int(h["x-payload-length"]) if revisit else len(payload),
                                h["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
                                h["warc-target-uri"], payload if with_payload and not revisit else None))
                    held += len(payload) if with_payload else 100
                    if held > READ:
                        yield _records(out)
                        out, held = [], 0
                yield _records(out)
    return read


def _records(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")]) \
        .astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest``; archives are dealt out over the tasks."""
    spark = manifest.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    return manifest.select("archive").repartition(tasks, "archive").mapInPandas(_reader(with_payload), RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), with_payload=False)
