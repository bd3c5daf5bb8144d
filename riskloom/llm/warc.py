"""WARC archives: a writer of revisit-deduplicated records and a splittable reader.

Every record is a gzip member of its own. The reader plans byte ranges of the archives; a task scans its
range for the gzip magic, takes a candidate as a member only if it inflates to a WARC header, owns the
records whose first byte lies in its range and reads on past the end to finish the last of them.

Archives lie in the shared folder of the session; ``file:`` paths are opened as files, other schemes
through pyarrow's file systems. A task writes under a name of its attempt and renames when it is done, so a
task that runs again leaves one archive.

Null html: an empty payload. Null url: no target URI. Null page_id: no id in the record, null in the
result; such rows can't be referred to. Rows that repeat a page_id are records of their own; equal payloads
under one page_id are all response, a revisit needs a smaller page_id. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, filesystem, map_arrow, texts_of

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive after which the next begins, of a split, and of a read.
ARCHIVE, SPLIT, BLOCK = 64 << 20, 4 << 20, 1 << 20
#: Bytes inflated at a time.
FEED = 1 << 13
#: Most tasks of a read.
TASKS = 100_000
#: Repeated digests that a broadcast may hold (about 100 bytes each), and the tasks that share one digest beyond that.
BROADCAST_ROWS, SALTS = 1 << 16, 64
_RULES = re.compile(r"[\r\n]+")


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit that has the HTTP head only (its length is the full payload's)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + _RULES.sub(" ", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write(pages: DataFrame, least: int = 0, archive: int = ARCHIVE) -> tuple[str, DataFrame]:
    """(folder, table of path and bytes of each archive). Equal payloads of ``least`` bytes or more are stored once."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.cut(firsts.where("n > 1").select("sha", "first"), "firsts")
    # Few repeated digests go to the pages. Beyond the bound both sides are salted, so that pages of one digest (empty ones, say)
    # are dealt out over SALTS tasks.
    if firsts.count() <= BROADCAST_ROWS:
        linked = rows.join(F.broadcast(firsts), "sha", "left")
    else:
        salts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        linked = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salts, ["sha", "salt"], "left")
    linked = linked.select("page_id", "url", "html", F.expr("case when first < page_id then first end").alias("refers_to"))
    folder = scratch.path("archives")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple[str, int]] = []
        out, size, name = None, 0, ""

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{top}/part-{part:06d}-{len(done):05d}.warc.gz"
            system.move(name, final)
            done.append((final, size))
            out = None

        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page_id, url, html, refer in zip(ids, urls, texts_of(batch.column(2)), refers, strict=True):
                if out is None:
                    name, size = f"{top}/.attempt-{attempt}-{len(done)}", 0
                    out = system.open_output_stream(name)
                data = html.encode()
                member = record("response" if refer is None else "revisit", page_id, url, sha1(data), len(data), data, refer)
                out.write(member)
                size += len(member)
                if size >= archive:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "bytes": pa.array([d[1] for d in done], pa.int64())})

    return folder, scratch.cut(linked.mapInArrow(store, "path string, bytes long"), "list")


def members(data_at, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the gzip members with a WARC header that start in [start, end).

    ``data_at(offset, n)`` reads bytes; only this range and the rest of its last member are read.
    """
    at, buffer, base = start, b"", start

    def more() -> bool:
        nonlocal buffer
        got = data_at(base + len(buffer), BLOCK) if base + len(buffer) < size else b""
        buffer += got
        return bool(got)

    while at < end:
        if at - base >= BLOCK:
            buffer, base = buffer[at - base :], at
        found = buffer.find(MAGIC, at - base)
        while found < 0 and base + len(buffer) < end + 2 and more():
            found = buffer.find(MAGIC, at - base)
        if found < 0 or base + found >= end:
            return
        at = base + found
        inflate, out, fed, ok = zlib.decompressobj(31), [], found, True
        while ok and not inflate.eof:
            if fed >= len(buffer) and not more():
                ok = False
                break
            part = buffer[fed : fed + FEED]
            fed += len(part)
            try:
                out.append(inflate.decompress(part))
            except zlib.error:
                ok = False
            if ok and len(out) < 3:
                head = b"".join(out)[:5]
                ok = head == b"WARC/"[: len(head)]
        data = b"".join(out)
        if ok and data.startswith(b"WARC/"):
            yield at, data
            at = base + fed - len(inflate.unused_data)
        else:
            at += 1


def fields(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return named, rest[: int(named.get("content-length", len(rest)))]


def _page(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def splits(spark: SparkSession, archives: DataFrame, size: int = SPLIT) -> DataFrame:
    """(path, bytes, start, end): byte ranges that tasks take, blind to where records begin; dealt out evenly."""
    cuts = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size).cast("int"))).alias("k"))
    return cuts.select("path", "bytes", (F.col("k").cast("long") * size).alias("start"), F.least("bytes", (F.col("k").cast("long") + 1) * size).alias("end"))


RECORD = "path string, start long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, folder: str, archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of the archives. A response's digest and size are of the payload as read; a revisit's are in its heads."""

    def make():
        system, _ = filesystem(folder)

        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with system.open_input_file(path) as f:
                    for at, data in members(lambda o, n: f.read_at(min(n, size - o), o), size, start, end):  # noqa: B023
                        named, block = fields(data)
                        kind = named.get("warc-type")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "revisit":
                            said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                            n, digest, payload = int(said[1]) if said else None, named.get("warc-payload-digest", "").removeprefix("sha1:"), None
                        else:
                            n, digest = len(payload), sha1(payload)
                        rows.append((path, at, kind, _page(named.get("warc-record-id")), named.get("warc-target-uri"), _page(named.get("warc-refers-to")), n, digest, payload if payloads else None))
            names = ("path", "start", "record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload")
            return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

        return step

    ranges = Scratch(spark, "splits").cut(splits(spark, archives, split), "splits")
    # A task for each split, up to a bound beyond which tasks take several in a row.
    return map_arrow(ranges.repartitionByRange(max(1, min(ranges.count(), TASKS)), "path", "start"), make, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page as its archive gives it back."""
    folder, archives = write(pages, least)
    got = read(pages.sparkSession, folder, archives, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
