"""WARC archives: writing, normalising and reading back.

``write`` puts pages into archives of one gzip stream each, as some crawlers
leave them.  ``normalise`` inflates each such stream once, rewrites every record
as a gzip member of its own and writes a sidecar index (offset, length, record
id, type) beside the new archive, so any record can be read alone.  ``read``
follows the sidecars and checks each payload against its digest.

Files are written by the tasks through Arrow's file systems, below the shared
folder, with the task attempt in the name; a manifest, written by Spark when a
stage has ended, names the files that count, so retried and speculative tasks
leave nothing that is read.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one of
largest page_id is a response, others are revisits of it.

Defined cases: a null html is an empty payload; a null url leaves out the target;
line breaks in a url are percent-encoded; a null page_id is below any other; rows
that share the largest page_id of equal payloads are all responses; an empty
table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep, scratch

MIN_REVISIT = 1000
#: Payload bytes after which a task begins another archive.
ROLL_BYTES = 256 << 20
#: Equal-payload groups that are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 200_000
DATE = "1970-01-01T00:00:00Z"
_LEVEL = 1
_CHUNK = 1 << 20


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    name = name.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-cased name."""
    out = {}
    for line in data.decode().split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.lower()] = value.strip()
    return out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and bytes of each record of an inflated stream, one at a time."""
    buffer, start = bytearray(), 0
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal start
        for chunk in chunks:
            if start:
                del buffer[:start]
                start = 0
            buffer.extend(chunk)
            return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n", start)) < 0:
            if not more():
                if len(buffer) > start:
                    raise ValueError("the stream ends inside a record's header")
                return
        fields = headers(bytes(buffer[start:end]))
        size = end - start + 8 + int(fields["content-length"])
        while len(buffer) - start < size:
            if not more():
                raise ValueError("the stream ends inside a record")
        yield fields, bytes(buffer[start : start + size])
        start += size


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip file's content, whether of one member or many."""
    state = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out = state.decompress(chunk, 4 * _CHUNK)
            if out:
                yield out
            if state.eof:
                chunk, state = state.unused_data, zlib.decompressobj(31)
            else:
                chunk = state.unconsumed_tail
    rest = state.flush()
    if rest:
        yield rest


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read_chunks(path: str) -> Iterator[bytes]:
    store, at = _open(path)
    with store.open_input_stream(at, compression=None) as source:
        while chunk := source.read(_CHUNK):
            yield chunk


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of each page."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    groups = keep(groups, "payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write archives of one gzip stream each below ``folder``; returns their manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            sink.write(state.flush())
            sink.close()
            done.append((path, count))

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                if state is None:
                    path, count, size = f"{folder}/{_attempt()}-{len(done)}.warc.gz", 0, 0
                    store, at = _open(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    sink, state = store.open_output_stream(at, compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                data = record(*(c[k].as_py() for c in cols))
                sink.write(state.compress(data))
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    close()
                    state = None
        if state is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return keep(plan(pages, min_bytes).mapInArrow(run, "path string, records bigint"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) with a member a record and a sidecar index; returns the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str, int]] = []
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{folder}/{_attempt()}-{len(done)}.warc.gz"
                store, at = _open(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                offset = count = 0
                with store.open_output_stream(at, compression=None) as sink, store.open_output_stream(at + ".idx", compression=None) as index:
                    for fields, data in records(inflate(_read_chunks(source))):
                        state = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        member = state.compress(data) + state.flush()
                        sink.write(member)
                        index.write(f"{offset}\t{len(member)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
                        offset, count = offset + len(member), count + 1
                done.append((path, path + ".idx", count))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "index", "records"])

    n = max(1, archives.count())
    return keep(archives.select("path").repartition(min(n, 100_000)).mapInArrow(run, "path string, index string, records bigint"), "members")


def read(archives: DataFrame) -> DataFrame:
    """Each record of normalised archives (path, index), found by its sidecar entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                entries = [line.split("\t") for line in b"".join(_read_chunks(index)).decode().splitlines()]
                store, at = _open(path)
                out: list[tuple] = []
                with store.open_input_file(at) as source:
                    for offset, length, name, _ in entries:
                        source.seek(int(offset))
                        data = zlib.decompress(source.read(int(length)), 31)
                        end = data.index(b"\r\n\r\n")
                        fields = headers(data[:end])
                        if fields["warc-record-id"] != name:
                            raise ValueError(f"{index} does not fit {path} at {offset}")
                        block = data[end + 4 : -4]
                        http = block.index(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                        size = int(headers(block[:http])["content-length"])
                        kind = fields["warc-type"]
                        if kind == "response" and (len(block) - http - 4 != size or hashlib.sha1(block[http + 4 :]).digest() != digest):
                            raise ValueError(f"the payload of {name} in {path} does not fit its digest")
                        refers = fields.get("warc-refers-to")
                        out.append((_page(name), fields.get("warc-target-uri"), size, digest.hex(), kind, None if refers is None else _page(refers), path, int(offset), int(length)))
                        if len(out) == 10_000:
                            yield batch_of(out)
                            out = []
                yield batch_of(out)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    n = max(1, archives.count())
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, path string, offset bigint, length bigint"
    return archives.select("path", "index").repartition(min(n, 100_000)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write, normalise and read back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder + "/streams", min_bytes), folder + "/members"))
