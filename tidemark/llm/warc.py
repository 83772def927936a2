"""WARC archives: one gzip member per record, written and read back by tasks that own byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.session import new_path
from tidemark.sources.tables import stored

MAGIC = b"\x1f\x8b\x08"
HEAD = 1 << 16  # a record's header must begin within its first decoded bytes and end within so many
CHUNK = 1 << 20
STEP = 64 << 10  # bytes given to the decoder at once
READERS = 100_000  # tasks, at most


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, first): first is the response's page_id of pages with equal payloads.

    Only digests are shuffled to find it, combined before the shuffle; a digest is a SHA-1 with the length.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))
    keyed = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    first = keyed.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    first = stored(first, "first-pages")
    return keyed.join(first, ["sha1", "bytes"], "left").select("page_id", "url", "payload", "sha1", "first")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """The bytes of one record: a response, or a revisit that names the response and leaves its payload out."""
    revisit = first is not None and page_id != first
    clean = lambda s: "".join(c if c >= " " else f"%{ord(c):02X}" for c in s)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def member(body: bytes, key: bytes, offset: int) -> bytes:
    """A gzip member whose header carries the archive's key and the member's offset in an extra field.

    A payload may itself hold gzip members with WARC records; they name another archive or place, and are told apart.
    """
    extra = b"TM" + (24).to_bytes(2, "little") + key + offset.to_bytes(8, "little")
    head = MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + len(extra).to_bytes(2, "little") + extra
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(body) + packer.flush()
    return head + packed + (zlib.crc32(body) & 0xFFFFFFFF).to_bytes(4, "little") + (len(body) & 0xFFFFFFFF).to_bytes(4, "little")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write ``roles`` rows into archives under ``folder``; the manifest (path, bytes, records, uri), stored.

    A task writes files of its own name, so a repeated attempt never touches another one's; only files that the manifest
    of the finished tasks names belong to the result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, size, count, done, key = None, "", 0, 0, [], b""
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for r in whole.slice(at, 64).to_pylist():
                    if out is None:
                        name, key = uuid.uuid4().hex, uuid.uuid4().bytes
                        path, size, count = f"{root}/{name}.warc.gz", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    packed = member(record(r["page_id"], r["url"], r["payload"], r["first"]), key, size)
                    out.write(packed)
                    size, count = size + len(packed), count + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, size, count))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        yield pa.RecordBatch.from_pydict({
            "path": [d[0] for d in done], "bytes": pa.array([d[1] for d in done], pa.int64()),
            "records": pa.array([d[2] for d in done], pa.int64())}, pa.schema([("path", "string"), ("bytes", "int64"), ("records", "int64")]))

    return stored(rows.mapInArrow(work, "path string, bytes long, records long"), "warc-manifest").withColumn("uri", F.lit(folder))


class _Window:
    """Bytes of a file from offset ``at`` on, read a chunk at a time. What lies behind is let go when the next chunk comes."""

    def __init__(self, handle: pa.NativeFile, size: int, at: int) -> None:
        self.handle, self.size, self.at, self.data, self.low = handle, size, at, bytearray(), 0

    def left(self) -> int:
        return len(self.data) - self.low

    def grow(self) -> bool:
        have = self.at + self.left()
        if have >= self.size:
            return False
        del self.data[:self.low]
        self.low = 0
        self.handle.seek(have)
        self.data += self.handle.read(min(CHUNK, self.size - have))
        return True

    def drop(self, n: int) -> None:
        self.low, self.at = self.low + n, self.at + n

    def part(self, start: int, stop: int) -> bytes:
        return bytes(self.data[self.low + start:self.low + stop])


def _extra(data: bytes) -> tuple[bytes, int] | None:
    """Key and offset from the extra field of a member's first bytes."""
    if len(data) < 40 or data[:3] != MAGIC or not data[3] & 4 or data[12:16] != b"TM\x18\0":
        return None
    return data[16:32], int.from_bytes(data[32:40], "little")


def _decode(window: _Window) -> tuple[bytes, int] | None:
    """(record, packed length) of the member at the start of the window; None if it is not a whole WARC member."""
    unpacker, body, used, size = zlib.decompressobj(31), [], 0, 0
    while True:
        if used == window.left() and not window.grow():
            return None
        piece = window.part(used, used + STEP)
        try:
            body.append(unpacker.decompress(piece))
        except zlib.error:
            return None
        used, before, size = used + len(piece), size, size + len(body[-1])
        if before < 5 <= size and not b"".join(body).startswith(b"WARC/"):
            return None
        if unpacker.eof:
            return (b"".join(body), used - len(unpacker.unused_data)) if size >= 5 else None


def read_range(path_handle: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Records whose members begin in [start, stop), whole, wherever they end.

    From ``start`` on every gzip magic is a candidate; it counts if its member decodes to a WARC header and, where its extra
    field carries an offset, that is its own. After a member the next one is expected right behind it.
    """
    window = _Window(path_handle, size, start)
    while window.at < stop:
        while window.left() < 64 and window.grow():
            pass
        at = window.data.find(MAGIC, window.low) - window.low
        if at < 0:
            window.drop(max(0, window.left() - 2))
            if not window.grow():
                return
            continue
        window.drop(at)
        if window.at >= stop:
            return
        while window.left() < 64 and window.grow():
            pass
        named = _extra(window.part(0, 64))
        found = _decode(window) if named is None or named[1] == window.at else None
        if found is None:
            window.drop(1)
            continue
        yield found[0]
        window.drop(found[1])


def parse(body: bytes) -> dict:
    """Header fields of a record with the page's columns; the payload's digest and length are checked for responses."""
    end = body.find(b"\r\n\r\n", 0, HEAD + CHUNK)
    if end < 0:
        raise ValueError("a WARC record without an end of its header")
    fields = dict(x.split(": ", 1) for x in body[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    length = int(fields["Content-Length"])
    payload = body[end + 4:end + 4 + length]
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest(payload) != named or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": named,
            "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
ARROW = pa.schema([("page_id", "int64"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "int64"),
                   ("payload_digest", "string"), ("refers_to", "int64"), ("payload", "binary")])


def read_archives(manifest: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """All records of the manifest's archives, read by tasks of ``split_bytes``; payload is empty for revisits."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", "uri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    # As many tasks as ranges: rows that name a range are too small for their own size to tell what a task will read.
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    dealt = ranges.repartition(max(1, min(int(count), READERS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = None
        for batch in batches:
            for r in batch.to_pylist():
                if system is None:
                    system = fs.FileSystem.from_uri(r["uri"])[0]
                with system.open_input_file(r["path"]) as handle:
                    rows, held = [], 0
                    for body in read_range(handle, r["bytes"], r["start"], r["start"] + split_bytes):
                        row = parse(body)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)

    return dealt.mapInArrow(work, SCHEMA)


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 256 << 20, split_bytes: int = 16 << 20,
                  with_payload: bool = True) -> DataFrame:
    """Write every page into archives in the shared folder and return all records read back from there.

    Null html is an empty payload; equal payloads of ``min_bytes`` and more are one response, that of the smallest
    page_id, and revisits. Rows that repeat that page_id with that payload are responses too. A row without page_id is
    never referred to: it revisits if a page with an id has its payload, else it is a response.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = write_archives(roles(pages, min_bytes), uri, archive_bytes)
    return read_archives(manifest, split_bytes, with_payload)
