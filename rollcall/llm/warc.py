"""WARC archives: writing, normalising monolithic gzip, indexing and reading back.

``write`` makes archives of one gzip stream each. ``normalise`` inflates such a stream once, rewrites every
record as a gzip member of its own and puts a sidecar index beside the archive: one line per record with
offset, length, type and id. ``read`` fetches records by that index alone. Archives are streamed in chunks,
so a task holds one record at a time. Files are written under a temporary name and renamed, and depend on
their rows only: a task that is run again leaves the same file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, sliced

CHUNK, INFLATED = 1 << 18, 1 << 20  # bytes read, and made of them, at once
LEVEL = 1
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
DATE = "2020-01-01T00:00:00Z"  # a fixed time stamp keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LISTING = "path string, records long, bytes long"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def created(path: str):
    """A binary stream to ``path``, which appears complete or not at all."""
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    attempt = f"{inner}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with system.open_output_stream(attempt) as out:
        yield out
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        system.delete_file(inner)  # of an attempt before; some stores do not move onto a file
    system.move(attempt, inner)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def one_line(text: str) -> str:
    """A header value: percent-escapes control characters and blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = "null" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url or "about:blank")), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record([*fields, ("Content-Type", "application/http; msgtype=response")], http + payload)
    return record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], http)


def parsed(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is checked."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, at most INFLATED at a time.

    Zero bytes between and behind members are padding. A stream that is cut short is an error.
    """
    engine, inside = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while True:
            if not inside and not (data := data.lstrip(b"\0")):
                break
            inside = True
            part = engine.decompress(data, INFLATED)
            yield part
            if engine.eof:
                data, engine, inside = engine.unused_data, zlib.decompressobj(31), False
            else:
                data = engine.unconsumed_tail
                if not data and len(part) < INFLATED:
                    break
    if inside:
        raise ValueError("a gzip stream ends before its end mark")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head, block) of each record in a stream of bytes."""
    held = bytearray()

    def filled(until: Callable[[], bool]) -> bool:
        while not until():
            if (chunk := next(chunks, None)) is None:
                return False
            held.extend(chunk)
        return True

    while True:
        if not filled(lambda: b"\r\n\r\n" in held):
            if held.strip():
                raise ValueError("an archive ends inside a record's header")
            return
        end = held.index(b"\r\n\r\n") + 4
        head = bytes(held[:end])
        fields = parsed(head.rstrip(b"\r\n"))
        size = end + int(fields["content-length"])
        if not filled(lambda size=size: len(held) >= size + 4):
            raise ValueError("an archive ends inside a record")
        yield fields, head, bytes(held[end:size])
        del held[: size + 4]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, payload, digest, refers_to) as archives of one gzip stream; returns LISTING rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, size, stream = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0, None
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        with created(path) as out:
            stream = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in _and_rest(first, batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part = stream.compress(page_record(*row))
                    size += len(part)
                    n += 1
                    out.write(part)
            part = stream.flush()
            size += len(part)
            out.write(part)
        yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    return materialise(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, LISTING))


def _and_rest(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from sliced([first], 64)
    yield from sliced(rest, 64)


def _spread(listing: DataFrame) -> DataFrame:
    """One archive a task, dealt out in turn."""
    return listing.repartition(max(1, listing.count()))


def normalise(listing: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic archives record by record with an index beside each; returns LISTING rows of the new archives.

    Archives that already have a member per record come out the same way.
    """

    def one(path: str) -> dict:
        system, inner = located(path)
        target, offset, lines = f"{folder}/{inner.rsplit('/', 1)[1]}", 0, []
        with system.open_input_stream(inner, compression=None) as stream, created(target) as out:
            for fields, head, block in records(inflated(stream)):
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = engine.compress(head + block + b"\r\n\r\n") + engine.flush()
                out.write(member)
                lines.append(f"{offset}\t{len(member)}\t{fields.get('warc-type', '')}\t{fields.get('warc-record-id', '')}\n")
                offset += len(member)
        with created(target + ".idx") as out:
            out.write("".join(lines).encode())
        return {"path": target, "records": len(lines), "bytes": offset}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([one(path)])

    return materialise(_spread(listing).select("path").mapInArrow(run, LISTING))


def indexed(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a normalised archive, fetched by its index."""
    system, inner = located(path)
    with system.open_input_stream(inner + ".idx", compression=None) as f:
        index = [line.split("\t")[:2] for line in f.read().decode().splitlines()]
    with system.open_input_file(inner) as f:
        for offset, length in index:
            f.seek(int(offset))
            engine = zlib.decompressobj(31)
            data = engine.decompress(f.read(int(length)))
            if not engine.eof or engine.unused_data:
                raise ValueError(f"{path}: the member at {offset} is not {length} bytes long")
            end = data.index(b"\r\n\r\n") + 4
            fields = parsed(data[: end - 4])
            yield fields, data[end : end + int(fields["content-length"])]


def read(listing: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of normalised archives.

    Digest and size of a response are taken from the payload read; those of a revisit from its fields, the
    digest from WARC-Payload-Digest and the size from the HTTP header it carries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x or "")) else None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                for fields, block in indexed(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    whole = fields["warc-type"] == "response"
                    size = len(payload) if whole else int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                    digest = hashlib.sha256(payload).hexdigest() if whole else fields["warc-payload-digest"].removeprefix("sha256:")
                    out.append((number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                    if len(out) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _spread(listing).select("path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None) -> DataFrame:
    """Write ``pages`` as archives below ``folder``, normalise them and return the listing of the result.

    ``payload``: by default the html column in UTF-8; null counts as empty. Of rows with equal payloads of
    at least REVISIT_BYTES, those with the smallest id are responses and the others revisits of it; a null
    id is never referred to. Repeated rows get a record each. Blanks in a url are percent-escaped and a null
    url is about:blank. Other columns are not read. An empty table makes no archive.
    """
    payload = F.col("html").cast("binary") if payload is None else payload
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # rows that can have no partner are spread by a key of their own
    own = F.when(F.length("payload") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    rows = rows.withColumn("shared", own)
    known = rows.join(repeated.withColumnRenamed("digest", "shared"), "shared", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")))
    return normalise(write(known, f"{folder}/raw"), f"{folder}/records")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and return a row per record; see ``archive``."""
    spark: SparkSession = pages.sparkSession
    return read(archive(pages, shared_dir(spark)))
