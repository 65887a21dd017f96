"""WARC records inside ZIP packages, written and range-read by tasks.

A package is a ZIP64 file with two stored members: the archive (one gzip member per record) and
an index of record offsets. The reader parses the end record, the ZIP64 records and the central
directory, finds the stored archive and its index, and reads byte ranges of records from the
package itself; no member is extracted. Files are reached through ``pyarrow.fs``, so the folder
may lie in any shared store; a manifest names the packages of tasks that succeeded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from geotransfer.llm.common import mapped
from geotransfer.session import materialize

PACKAGE_BYTES = 32 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP64 file with stored members."""
    out, central = io.BytesIO(), []
    for name, data in members:
        raw, at, crc, n = name.encode(), out.tell(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, n, n)
        out.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra)))
        out.write(raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at)
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32,
                                   len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
    start, directory = out.tell(), b"".join(central)
    end64 = start + len(directory)
    out.write(directory)
    out.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(central), len(central), len(directory), start))
    out.write(struct.pack("<4sIQI", LOCATOR, 0, end64, 1))
    out.write(struct.pack("<4sHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
    return out.getvalue()


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    offset: int  # of the data in the package
    size: int


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def directory(f, size: int) -> list[Member]:
    """Members of a ZIP package, from its central directory (ZIP64 or not)."""
    tail_at = max(0, size - 22 - FULL16 - 20)
    tail = _read(f, tail_at, size - tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + 3)  # that signature was part of a comment
    if at < 0:
        raise ValueError("not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (count == FULL16 or length == FULL32 or start == FULL32) and at >= 20 and tail[at - 20:at - 16] == LOCATOR:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = _read(f, where, 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end record not found")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = _read(f, start, length), 0, []
    for _ in range(count):
        if raw[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        offset, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + n:]
        local = _read(f, offset, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        skip = 30 + sum(struct.unpack_from("<HH", local, 26))
        out.append(Member(name, method == 0, offset + skip, packed))
        at += 46 + n_name + n_extra + n_comment
    return out


def _header_value(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page: str, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {_header_value(url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http; msgtype=response"]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", 1, mtime=0)


def _write_task(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        body, index, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal body, index
            name = f"{uuid.uuid4().hex}.zip"
            raw = package([(ARCHIVE, body.getvalue()), (INDEX, "".join(index).encode())])
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            out = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [len(raw)]},
                                             pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            body, index = io.BytesIO(), []
            return out

        for batch in batches:
            cols = [batch.column(c) for c in ("page", "url", "digest", "size", "payload", "refers_to")]
            for k in range(batch.num_rows):
                page, url, digest, size, payload, refers = (c[k].as_py() for c in cols)
                raw = record(page, url, digest, size, payload if refers is None else None, refers)
                at = body.tell()
                if at and at + len(raw) > PACKAGE_BYTES:
                    yield close()
                    at = 0
                index.append(f"{at} {len(raw)}\n")
                body.write(raw)
        if index:
            yield close()

    return task


def write_packages(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   least: int = 100) -> DataFrame:
    """Write all rows to packages under ``folder``; returns the stored manifest (path, records, bytes).

    Of equal payloads of ``least`` bytes or more the row with the smallest id is a response and
    the others revisit it. Rows that share this smallest id are all responses. Null ids never
    come first: they revisit, unless every id of the payload is null. A null body is an empty
    payload, a null url an empty one. An empty table writes no package.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit(""))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), body.alias("body"),
                      F.octet_length(body).alias("size"), F.sha2(body, 256).alias("digest"))
    same = (pages.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
            .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    rows = pages.join(same, "digest", "left").select(
        name("id").alias("page"), "url", "digest", F.col("size").cast("bigint").alias("size"),
        F.col("body").cast("binary").alias("payload"),
        F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), name("first")).alias("refers_to"))
    return materialize(mapped(rows, _write_task(folder), "path string, records bigint, bytes bigint"))


def _locate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, offset, length) of every record, from the packages' directories and indexes."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                members = {m.name: m for m in directory(f, f.size())}
                archive, index = members[ARCHIVE], members[INDEX]
                if not (archive.stored and index.stored):
                    raise ValueError(f"{path}: members are not stored")
                pairs = [tuple(map(int, x.split())) for x in _read(f, index.offset, index.size).splitlines()]
            yield pa.RecordBatch.from_pydict(
                {"path": [path] * len(pairs), "offset": [archive.offset + a for a, _ in pairs],
                 "length": [n for _, n in pairs]},
                pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def parse_record(raw: bytes) -> dict:
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    ident = lambda v: None if v is None or v == "<urn:page:none>" else v[len("<urn:page:"):-1]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its record")
    return {"page": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": ident(fields.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


RECORD = pa.schema([("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _range_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range-read records; neighbours in one package share a read of up to 4 MB."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
        k, out, held = 0, [], 0
        while k < len(rows):
            path, start, n = rows[k]
            end, j = start + n, k + 1
            while j < len(rows) and rows[j][0] == path and rows[j][1] == end and end + rows[j][2] - start <= 4 << 20:
                end, j = end + rows[j][2], j + 1
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                raw = _read(f, start, end - start)
            out += [parse_record(raw[a - start:a - start + m]) for _, a, m in rows[k:j]]
            k, held = j, held + end - start
            if held >= 4 << 20:
                yield pa.RecordBatch.from_pylist(out, RECORD)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, RECORD)


READ_BYTES = 8 << 20  # archive bytes of a reading task, about


def read_packages(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``, ``payload`` per record.

    The payload of a revisit is null; its size and digest are those of the full payload. Null ids
    come back as null, empty payloads as empty; an empty manifest gives no rows.
    """
    located = mapped(manifest.select("path").repartition("path"), _locate_task, "path string, offset bigint, length bigint")
    # The manifest knows the bytes; left alone, Spark would size the readers by the few bytes of the offsets.
    parts = 1 + (manifest.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES
    spread = located.repartition(parts, "path", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("path", "offset")
    rows = mapped(spread, _range_task, "page string, url string, record_type string, payload_bytes bigint, "
                                       "payload_digest string, refers_to string, payload binary")
    return rows.select(F.col("page").cast(id_type).alias("page_id"), "url", "record_type", "payload_bytes", "payload_digest",
                       F.col("refers_to").cast(id_type).alias("refers_to"), "payload")
