"""WARC archives as chunked record tables.

A page's payload is cut into chunk rows, and the writer streams them into gzip members of ``.warc.gz`` files, one file per
task, so no record is held whole in Python. The index lists file, offset and length of every record; it is a written table,
so only files of tasks that succeeded count, and a lost task writes another file. The reader streams a record back as rows
of (record, chunk number) that carry the running length and digest.

Payloads of at least ``MIN_BYTES`` that occur more than once are stored once, with the smallest id; the other records
revisit it. Defined results: a null payload is empty; rows that repeat an id and a payload are all responses; a row without
an id is never referred to, and revisits only a row that has one; an empty table gives an empty archive; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.shared import new_path, written

CHUNK, MIN_BYTES, READ = 32 << 10, 100, 64 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
NO_ID = "none"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_rows(pages: DataFrame, id_column: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Pages with payload, its length and digest, and the id they refer to."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.length("payload"), "digest": F.sha2("payload", 256)})
    shared = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = shared.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _header(page_id, url, size, digest, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    name = NO_ID if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    length = len(HTTP) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + HTTP


def write(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write the archive files; returns their index (``page_id``, ``file``, ``offset``, ``length``)."""
    folder = new_path(pages.sparkSession, "warc")
    rows = record_rows(pages, id_column, url, html, min_bytes)
    stored = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0)
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(stored / chunk).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("payload"), i * chunk + 1, chunk))
    cuts = F.when(F.col("refers_to").isNull(), cuts).otherwise(F.array(F.lit(b"").cast("binary")))
    chunks = rows.select("page_id", "url", "size", "digest", "refers_to", F.size(cuts).alias("n_chunks"), F.posexplode(cuts).alias("chunk_no", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _open(folder)
        store.create_dir(place, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at, begun, member, done = None, 0, 0, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{place}/{name}", compression=None)
                if r["chunk_no"] == 0:
                    begun, member = at, zlib.compressobj(1, zlib.DEFLATED, 31)
                    at += out.write(member.compress(_header(r["page_id"], r["url"], r["size"], r["digest"], r["refers_to"])))
                at += out.write(member.compress(r["chunk"]))
                if r["chunk_no"] == r["n_chunks"] - 1:
                    at += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    done.append((r["page_id"], f"{folder}/{name}", begun, at - begun))
        if out is not None:
            out.close()
        for lo in range(0, len(done), 10_000):
            part = done[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], k) for j, k in enumerate([pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["page_id", "file", "offset", "length"])

    return written(chunks.mapInArrow(run, "page_id long, file string, offset long, length long"), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Records as chunk rows: ``page_id``, ``record_type``, ``refers_to``, ``header_digest``, ``chunk_no``, ``data``, and
    ``bytes`` and ``digest`` of the payload so far; ``last`` marks a record's final row."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = index.select("file", "offset", "length").repartition(parts).sortWithinPartitions("file", "offset")
    kinds = {
        "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "header_digest": pa.string(), "chunk_no": pa.int32(),
        "data": pa.binary(), "bytes": pa.int64(), "digest": pa.string(), "last": pa.bool_(),
    }

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, rows, held = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    name = r["file"]
                    store, place = _open(name)
                    source = store.open_input_file(place)
                for row in read_record(source, r["offset"], r["length"]):
                    rows.append(row)
                    held += len(row[5]) + 200
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
        yield pack(rows)

    return spread.mapInArrow(run, "page_id long, record_type string, refers_to long, header_digest string, chunk_no int, data binary, bytes long, digest string, last boolean")


def read_record(source, offset: int, length: int) -> Iterator[tuple]:
    """Rows of one record, inflated and hashed piece by piece."""
    member, fields, buffer, left, at = zlib.decompressobj(31), None, b"", length, offset
    total = n = 0
    digest = hashlib.sha256()
    want = None
    while True:
        raw = source.read_at(min(READ, left), at) if left else b""
        at, left = at + len(raw), left - len(raw)
        buffer += member.decompress(raw) if raw else member.flush()
        if fields is None and (end := buffer.find(b"\r\n\r\n")) >= 0 and (body := buffer.find(b"\r\n\r\n", end + 4)) >= 0:
            lines = [x.split(": ", 1) for x in buffer[:end].decode().split("\r\n")[1:]]
            fields = {k: v for k, v in (x if len(x) == 2 else (x[0].rstrip(":"), "") for x in lines)}
            want = int(fields["Content-Length"]) - (body + 4 - end - 4)
            buffer = buffer[body + 4 :]
            named = lambda k: None if (v := fields.get(k, "").removeprefix("<urn:page:").rstrip(">")) in ("", NO_ID) else int(v)
            head = (named("WARC-Record-ID"), fields["WARC-Type"], named("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha256:"))
        while fields is not None and (len(buffer) >= CHUNK or total + len(buffer) >= want):
            part = buffer[: min(CHUNK, want - total)]
            buffer = buffer[len(part) :]
            digest.update(part)
            total += len(part)
            yield (*head, n, part, total, digest.hexdigest(), total == want)
            n += 1
            if total == want:
                return
        if not raw:
            raise ValueError("a record ends before its length")


def records(index: DataFrame) -> DataFrame:
    """One row per record with length and digest of the full payload; a revisit takes them from the record it refers to."""
    ends = written(read(index).filter("last").drop("data", "chunk_no", "last"), "warc-records")
    own = ends.filter(F.col("record_type") == "response").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("bytes").alias("_bytes"))
    wanted = ends.filter(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("_id"), F.col("header_digest").alias("_digest")).distinct()
    targets = own.join(wanted, ["_id", "_digest"])
    joined = ends.join(targets, (ends["refers_to"] == targets["_id"]) & (ends["header_digest"] == targets["_digest"]), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(revisit, F.col("_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )
