"""WARC: archives written record by record, and a reader that salvages what lies beyond damage."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import scratch_path, stored

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Bytes that are read at first to find the end of a header block; more if it isn't among them.
FIRST_LOOK = 1 << 16
#: An archive is closed once it has so many compressed bytes.
ROLL = 32 << 20
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
GAP = "gap_start long, gap_end long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, kind: str, refers_to=None, payload_digest: str | None = None, when: str | None = None) -> bytes:
    """One WARC record, not compressed. A revisit carries the digest and length of its payload, and no block."""
    block = b"" if kind == "revisit" else payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{kind}')}>"),
        ("WARC-Date", when or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", "sha1:" + (payload_digest or digest(payload))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to)))
    else:
        head.append(("WARC-Block-Digest", "sha1:" + (payload_digest or digest(block))))
    head.append(("Content-Type", "text/html; charset=utf-8"))
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record, or with headers None a quarantined gap; start and end are byte offsets in the archive."""

    start: int
    end: int
    headers: dict[str, str] | None
    payload: bytes = field(default=b"", repr=False)


class Damage(Exception):
    pass


class _Window:
    """The bytes of a seekable stream from an offset on, read in chunks; only what is asked for stays in memory."""

    def __init__(self, stream):
        self.stream, self.buf, self.at = stream, bytearray(), 0
        self.size = stream.seek(0, 2)

    def need(self, n: int) -> int:
        """Tries to hold n bytes; how many there are."""
        n = min(n, self.size - self.at)
        if len(self.buf) < n:
            self.stream.seek(self.at + len(self.buf))
            while len(self.buf) < n:
                self.buf += self.stream.read(max(min(CHUNK, self.size - self.at - len(self.buf)), n - len(self.buf)))
        return len(self.buf)

    def peek(self, place: int, n: int) -> bytes:
        """n bytes at a place behind the offset, which aren't kept."""
        if place + n <= len(self.buf):
            return bytes(self.buf[place : place + n])
        self.stream.seek(self.at + place)
        return self.stream.read(n)

    def drop(self, n: int) -> None:
        del self.buf[:n]
        self.at += n

    def seek_mark(self, marks: tuple[bytes, ...], start: int) -> int | None:
        """Drops bytes up to the next of marks at or after start; None if there is none."""
        keep = max(map(len, marks)) - 1
        while True:
            self.need(start + CHUNK)
            places = [p for p in (self.buf.find(m, start) for m in marks) if p >= 0]
            if places:
                self.drop(min(places))
                return self.at
            if self.at + len(self.buf) >= self.size:
                self.drop(len(self.buf))
                return None
            self.drop(max(0, len(self.buf) - keep))
            start = 0


#: Headers that hold a number or nothing.
NUMBERS = ("x-page-id", "x-refers-to-page-id", "x-payload-length", "content-length")


def _number(value: str) -> int | None:
    """A 64-bit number, or None for no text."""
    if not value:
        return None
    if len(value) > 20 or not value.isascii() or not value.removeprefix("-").isdigit() or not -(1 << 63) <= int(value) < 1 << 63:
        raise Damage("not a number")
    return int(value)


def _headers(data: bytes | bytearray, whole: bool) -> tuple[dict[str, str], int, int] | None:
    """(headers, where the block starts, its length) of the record at the start of data; None if more data is needed, unless
    that is whole, all there is of it."""
    if not bytes(data[:7]).startswith(b"WARC/1."):
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        lines = bytes(data[: max(0, data.rfind(b"\r\n"))]).split(b"\r\n")[1:]
        if whole or any(b":" not in line for line in lines):  # such as the next record's version line
            raise Damage("no end of headers")
        return None
    headers = {}
    for line in bytes(data[:stop]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header without a colon")
        name = name.decode("utf-8", "replace").strip().lower()
        if name in headers and name != "warc-concurrent-to":  # what is left of one record's headers runs into the next record
            raise Damage("header twice")
        headers[name] = value.decode("utf-8", "replace").strip()
    numbers = {name: _number(headers.get(name, "")) for name in NUMBERS}
    if numbers["content-length"] is None or numbers["content-length"] < 0:
        raise Damage("no length")
    return headers, stop + 4, numbers["content-length"]


def _check(headers: dict[str, str], told: str, tail: bytes) -> None:
    if tail != b"\r\n\r\n":
        raise Damage("wrong length")
    block = headers.get("warc-block-digest", "")
    if block.startswith("sha1:") and block[5:] != told:
        raise Damage("wrong digest")


def _plain(window: _Window) -> tuple[dict[str, str], bytes, int]:
    """The record at the start of the window: what its length claims is checked before it is held, first by the bytes behind the
    block, then by the block's digest chunk by chunk."""
    want = FIRST_LOOK
    while True:
        there = window.need(want)
        found = _headers(window.buf, there < want)
        if found:
            break
        want = 2 * there
    headers, start, length = found
    end = start + length
    if window.at + end + 4 > window.size:
        raise Damage("cut off")
    tail = window.peek(end, 4)
    _check(headers | {"warc-block-digest": ""}, "", tail)
    sums = hashlib.sha1()
    for at in range(start, end, CHUNK):
        sums.update(window.peek(at, min(CHUNK, end - at)))
    _check(headers, base64.b32encode(sums.digest()).decode(), tail)
    window.need(end)
    return headers, bytes(window.buf[start:end]), end + 4


def _member(window: _Window) -> tuple[dict[str, str], bytes, int]:
    """The record in the gzip member at the start of the window; its CRC is checked. Inflating ends once there is more than the
    headers say, so a member holds at most that, or its headers."""
    engine, out, used, found, want = zlib.decompressobj(31), bytearray(), 0, None, FIRST_LOOK
    while not engine.eof:
        piece = engine.unconsumed_tail or window.peek(used, min(CHUNK, window.size - window.at - used))
        if not piece:
            raise Damage("member cut off")
        if not engine.unconsumed_tail:
            used += len(piece)
        try:
            out += engine.decompress(piece, CHUNK)
        except zlib.error as bad:
            raise Damage(str(bad)) from bad
        if found is None and (len(out) >= want or engine.eof):
            found, want = _headers(out, engine.eof), 2 * len(out)
        if found and len(out) > found[1] + found[2] + 4:
            raise Damage("more than a record in a member")
    headers, start, length = found or _headers(out, True)
    if len(out) != start + length + 4:
        raise Damage("cut off" if len(out) < start + length + 4 else "more than a record in a member")
    block = bytes(out[start : start + length])
    _check(headers, digest(block), bytes(out[start + length :]))
    return headers, block, used - len(engine.unused_data)


def salvage(stream) -> Iterator[Found]:
    """The records of a seekable WARC stream, gzipped by record or plain, in order. Where a check fails (version line, numbers,
    lengths, block digest, gzip CRC) the bytes up to the next member or version line that starts a valid record are quarantined
    and reported as one gap, and reading goes on there. An empty stream yields nothing; a stream without any record
    yields one gap. Memory: one record and a few chunks, whatever lengths damaged records claim."""
    window, gap = _Window(stream), None
    while window.need(16):
        try:
            headers, block, used = _member(window) if bytes(window.buf[:3]) == GZIP else _plain(window)
        except Damage:
            gap = window.at if gap is None else gap
            if window.seek_mark((GZIP, b"WARC/1."), 1) is None:
                break
            continue
        if gap is not None:
            yield Found(gap, window.at, None)
            gap = None
        yield Found(window.at, window.at + used, headers, block)
        window.drop(used)
    if gap is not None:
        yield Found(gap, window.at, None)


def write_archives(pages: DataFrame, root: str, least: int = 0, roll: int = ROLL, level: int = 4) -> DataFrame:
    """Writes pages(page_id, url, html) as gzipped WARC archives under root, a folder that all executors reach;
    (path, records, bytes) of each archive, as a stored table.

    Of equal payloads of at least `least` bytes the one with the largest page_id (nulls last) is a response, the others
    are revisits of it; smaller payloads are all responses. Null html is an empty payload. Rows that repeat the largest
    page_id of their payload are responses too. Only keepers of payloads that repeat are joined, so a payload of a third of
    all rows is one row of that side. A task names its archives afresh at each attempt and only the manifest of the
    attempts that Spark committed counts, so a lost executor leaves stray files at most."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    sums = pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("n")).where(F.col("n") >= least)
    again = sums.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    again = stored(again.select(F.col("sha1").alias("_again"), "keeper"), "revisits")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.join(again, (F.col("sha1") == F.col("_again")) & (F.length("payload") >= least), "left")
    revisit = F.col("_again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", "sha1", "keeper", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        out, done, path, n = None, [], "", 0
        when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for page_id, url, body, sha1, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(path, compression=None)
                told = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = record_bytes(page_id, url, body, "revisit" if revisit else "response", keeper, told, when)
                engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(engine.compress(raw) + engine.flush())
                n += 1
                if out.tell() >= roll:
                    done.append((path, n, out.tell()))
                    out = out.close()
        if out is not None:
            done.append((path, n, out.tell()))
            out.close()
        yield pa.RecordBatch.from_pydict(
            {"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The records and gaps of the archives in manifest(path): path, offset, the fields of RECORD and GAP, and the
    payload if asked for. A gap has null fields of RECORD; a record has null fields of GAP. The digest and length of
    a response are those of the payload that was read; those of a revisit stand in its headers."""
    schema = f"path string, offset long, {RECORD}, {GAP}" + ", payload binary" * payloads
    kinds = {"path": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
    names = [x.split()[0] for x in schema.split(", ")]
    target = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
    number = lambda x: _number(x or "")

    def rows(path: str, stream) -> Iterator[tuple]:
        for x in salvage(stream):
            if x.headers is None:
                yield (path, x.start, *[None] * 6, x.start, x.end, *[None] * payloads)
                continue
            h, kind = x.headers, x.headers.get("warc-type")
            size = number(h.get("x-payload-length")) if kind == "revisit" else len(x.payload)
            told = h.get("warc-payload-digest", "sha1:")[5:] if kind == "revisit" else digest(x.payload)
            yield (path, x.start, number(h.get("x-page-id")), h.get("warc-target-uri"), kind, number(h.get("x-refers-to-page-id")), size, told, None, None, *[x.payload] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as stream:
                    held, size = [], 0
                    for row in rows(path, stream):
                        held.append(row)
                        size += 200 + len(row[-1] or b"") * payloads
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), target, strict=True)], schema=target)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), target, strict=True)], schema=target)

    paths = manifest.select("path").where("path IS NOT NULL")
    tasks = max(1, min(paths.count(), 4096))
    return paths.repartition(tasks).mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages(page_id, url, html) as archives in the shared folder and reads every record back: page_id,
    payload_bytes, payload_digest, record_type, refers_to. See write_archives for nulls, ties and repeated rows; an
    empty table gives no rows; other columns are ignored. A record that can't be read back is an error."""
    root = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages.select("page_id", "url", "html"), root, least)
    lost = F.raise_error(F.concat(F.lit("no record at byte "), F.col("offset"), F.lit(" of "), F.col("path"))).cast("boolean")
    records = read_archives(manifest, root).where(F.when(F.col("record_type").isNotNull(), True).otherwise(lost))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def salvage_bytes(data: bytes) -> list[Found]:
    return list(salvage(io.BytesIO(data)))
