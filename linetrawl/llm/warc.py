"""WARC archives that are indexed as they are written and read back by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F

from linetrawl.llm.common import stored
from linetrawl.workspace import shared_dir

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: An archive is closed when it holds this many bytes.
ARCHIVE_BYTES = 128 << 20
#: Ranges are read together up to this many bytes between them and this many in all.
GAP_BYTES, RUN_BYTES = 64 << 10, 8 << 20
#: Bytes of archives that a reading task takes, about.
TASK_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def write_archives(pages: DataFrame, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one gzip member per row of ``page_id, url, html`` and return the index of the records.

    The payload is the html in UTF-8, empty if null. Of the records with equal payloads of at least
    ``min_payload`` bytes the smallest page_id is a response and the others are revisits of it; rows
    that repeat that smallest id, and all if no id is known, are responses as well. A null url is
    empty; line ends in a url are percent-encoded. An empty table gives an empty index. Other columns are ignored.

    Archives lie in the shared folder, each under a name of its own, so a task that is run again
    leaves an unlisted file behind and never touches a listed one.
    """
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), digest.alias("sha1"))
    copies = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_payload).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first")
    rows = rows.join(copies, "sha1", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("first"))
    folder = shared_dir(pages.sparkSession, "warc")
    return stored(rows.mapInArrow(lambda batches: _write(batches, folder, date), INDEX), "warc-index")


def _write(batches, folder, date):
    files, base = arrow_fs.FileSystem.from_uri(_uri(folder))
    files.create_dir(base, recursive=True)
    out, index = None, []
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                kind = "response" if row["first"] is None else "revisit"
                member = gzip.compress(_record(row["page_id"], row["first"], url, digest, kind, payload, date), 6, mtime=0)
                index.append((f"{folder}/{name}", out.tell(), len(member), url, digest, row["page_id"], kind, row["first"], len(payload)))
                out.write(member)
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield _batch(index, INDEX)
            index = []
    finally:
        if out is not None:
            out.close()


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _record(page_id, first, url, digest, kind, payload, date):
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of an index select, read back from their archives.

    Ranges of one archive are sorted by offset and neighbours are read in one go. A record whose
    payload does not match its digest fails the job. A revisit has an empty payload; its
    ``payload_bytes`` are those that its HTTP head announces.
    """
    wanted = index.select("file", "offset", "length")
    # An index row of some bytes stands for a whole record, so the number of tasks comes from the bytes of the archives.
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, (wanted.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1)
    wanted = wanted.repartition(tasks, "file").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_read, RECORD)


def _read(batches):
    run: list[tuple[int, int]] = []
    at = end = 0
    file = None
    for batch in batches:
        for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if run and (name != file or offset - end > GAP_BYTES or end - at > RUN_BYTES):
                yield from _fetch(file, run)
                run = []
            if not run:
                file, at = name, offset
            run.append((offset, length))
            end = offset + length
    if run:
        yield from _fetch(file, run)


def _fetch(file, run):
    files, path = arrow_fs.FileSystem.from_uri(_uri(file))
    start, end = run[0][0], max(o + n for o, n in run)
    with files.open_input_file(path) as source:
        source.seek(start)
        data = memoryview(source.read(end - start))
    rows, held = [], 0
    for offset, length in run:
        rows.append(_parse(gzip.decompress(data[offset - start:offset - start + length])))
        held += len(rows[-1][6])
        if held > _BATCH_BYTES:
            yield _batch(rows, RECORD)
            rows, held = [], 0
    if rows:
        yield _batch(rows, RECORD)


def _parse(record: bytes):
    source = io.BytesIO(record)
    if source.readline() != b"WARC/1.1\r\n":
        raise ValueError("not a WARC record")
    head = _fields(source)
    block = io.BytesIO(source.read(int(head["Content-Length"])))
    block.readline()
    announced = int(_fields(block)["Content-Length"])
    payload = block.read()
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, _page(head.get("WARC-Refers-To", "")), announced, digest, payload


def _fields(source) -> dict[str, str]:
    fields = {}
    while (line := source.readline()) != b"\r\n":
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name] = value
    return fields


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])
