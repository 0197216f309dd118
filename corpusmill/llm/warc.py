"""WARC: monolithic gzip archives, and a normaliser that makes every record a member of its own.

Writing puts many records into one gzip stream. The normaliser inflates such a stream once, from
front to back, cuts it into records by their Content-Length, writes each as its own gzip member and
beside them an index of offsets, by which the reader seeks every record. Files live in the shared
folder under names of their own for each task attempt; only attempts that a written table names are
read, so retries and lost executors leave nothing half done.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the
response and the others revisit it; smaller ones are all responses.

Edge cases: a null html is an empty payload; a null url leaves out the target line; rows that repeat
a page_id and its payload are each a record, and all of them responses where that id is the largest;
a null page_id revisits the largest that is known; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, shared_dir

LEAST = 1000
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def mark(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response) for every row."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    meta = rows.where(F.length("payload") >= least).select("page_id", "digest", F.length("payload").alias("n"))
    groups = meta.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    revisits = (
        meta.join(groups.select("digest", "n", "refers_to"), ["digest", "n"])
        .where("not (page_id <=> refers_to)")
        .select("page_id", F.col("digest").alias("d"), "refers_to")
        .distinct()
        .withColumnRenamed("page_id", "p")
    )
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", "url", "payload", "digest", "refers_to"
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit holds the HTTP head only, and the payload's length in a header of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        target = urllib.parse.quote(url, safe=":/?#[]@!$&%=~+,;()*'")
        lines.append(f"WARC-Target-URI: {target}")
        if target != url:  # it has characters that no URI may have
            lines.append(f"X-Url: {urllib.parse.quote(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = head if refers_to is not None else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_record(stream) -> tuple[dict[str, str], bytes, bytes] | None:
    """(headers, block, raw bytes) of the next record; None at the end."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    raw, headers = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        raw.append(line)
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    block = stream.read(n := int(headers["content-length"]))
    if len(block) != n or (tail := stream.read(4)) != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, block, b"".join([*raw, line, block, tail])


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Out:
    """A file that has its name only once it is whole."""

    def __init__(self, folder: str, suffix: str):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}{suffix}"
        self.sink = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> str:
        self.sink.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path.rpartition("/")[2]


def write_monolithic(marked: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """One gzip stream, or one for every `roll` bytes, for each partition; returns (archive, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = press = None
        done, n, size = [], 0, 0

        def finish():
            nonlocal out, press, n, size
            if out is not None:
                out.write(press.flush())
                done.append((out.close(), n))
            out, press, n, size = None, None, 0, 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    out, press = _Out(folder, ".warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(*row)
                out.write(press.compress(data))
                n, size = n + 1, size + len(data)
                if size >= roll:
                    finish()
        finish()
        yield pa.RecordBatch.from_pydict({"archive": [a for a, _ in done], "records": pa.array([k for _, k in done], pa.int64())}, schema=schema)

    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])
    return materialise(marked.mapInArrow(write, "archive string, records long"), "warc-list")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Each monolithic archive as one of a member for each record, and its index; returns (archive, index, records)."""
    names = archives.select("archive").repartition(max(1, archives.count()))
    schema = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name in batch.column(0).to_pylist():
                fs, base = _open(source)
                out, index, n = _Out(target, ".warc.gz"), _Out(target, ".idx.jsonl"), 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    while (got := read_record(stream)) is not None:
                        member = gzip.compress(got[2], 6, mtime=0)
                        line = {"offset": out.at, "length": len(member), "type": got[0]["warc-type"], "id": got[0]["warc-record-id"]}
                        out.write(member)
                        index.write(json.dumps(line).encode() + b"\n")
                        n += 1
                done.append((out.close(), index.close(), n))
            yield pa.RecordBatch.from_pydict(
                {"archive": [x[0] for x in done], "index": [x[1] for x in done], "records": pa.array([x[2] for x in done], pa.int64())}, schema=schema
            )

    return materialise(names.mapInArrow(run, "archive string, index string, records long"), "warc-normal")


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, sought by the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    names = archives.select("archive", "index").repartition(max(1, archives.count()))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def whole(text: str | None) -> int | None:
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = _open(folder)
                rows = []
                with fs.open_input_stream(f"{base}/{index}", compression=None) as at, fs.open_input_file(f"{base}/{name}") as data:
                    for line in io.TextIOWrapper(io.BufferedReader(at, 1 << 20)):
                        x = json.loads(line)
                        data.seek(x["offset"])
                        h, block, _ = read_record(io.BytesIO(gzip.decompress(data.read(x["length"]))))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if h["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload of {name} does not match its digest")
                        size = len(payload) if h["warc-type"] == "response" else int(head.rpartition(b"Content-Length: ")[2])
                        url = urllib.parse.unquote(h["x-url"]) if "x-url" in h else h.get("warc-target-uri")
                        rows.append((whole(h["x-page-id"]), url, size, digest, h["warc-type"], whole(h.get("x-refers-to-page"))))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return names.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def remove(folder: str) -> None:
    fs, base = _open(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, normalise, read back; the archives go once what was read is written."""
    base = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    raw, own = f"{base}/monolithic", f"{base}/members"
    written = write_monolithic(mark(pages, least), raw)
    normal = normalise(written, raw, own)
    remove(raw)
    out = materialise(read_back(normal, own), "warc-read")
    remove(base)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.top IS NOT NULL AND g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND g.html = p.html
"""
