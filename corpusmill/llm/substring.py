"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words. Its minimiser is the smallest hash among its m-word pieces, so
neighbouring windows mostly share one, and so do equal windows anywhere. Consecutive windows that
share a minimiser travel as one packed string of words to the bucket of that minimiser; there the
windows are sorted by hash, compared byte for byte, and all but the earliest of equal ones are
marked. Before that every task settles repeats among the documents that it has just read, so a
passage that a third of all rows hold reaches its bucket once for each chunk of input, not once for
each row. A first pass over all texts counts the bytes that each bucket would get; buckets over a
bound are split by a second minimiser, of longer pieces.

Order: smaller doc_id first (null before all), then the hash of the text where rows with one doc_id
differ, then the start. Rows equal in doc_id and text are one document and do not remove each other's words.

Edge cases: null and empty texts have no words; a document under k words keeps all; an empty table
gives no rows; other columns are carried along by `remove_repeats` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import free, shuffle_partitions, spread, text_bytes, turn_to

WINDOW = 20
PIECE, LONG_PIECE = 3, 10
#: Text bytes that a task works on at once, that a bucket gets on average, and times that at which it is split.
CHUNK, BUCKET, HEAVY = 8 << 20, 4 << 20, 4
#: Bytes hashed at once, and those of a word over which it is hashed by itself.
BLOCK, LONG_WORD = 1 << 18, 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32, _S33 = np.uint64(29), np.uint64(32), np.uint64(33)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, the powers of an odd base, and those of its inverse."""
    byte = _mix(np.arange(1, 257, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64))
    byte[_SPACE] = 0
    n = 2 * BLOCK
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return byte, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def squeeze(text: bytes) -> np.ndarray:
    """The words, each followed by one space."""
    buf = np.frombuffer(text + b" ", np.uint8)
    space = _SPACE[buf]
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = buf[keep]
    out[space[keep]] = 32
    return out


def word_starts(buf: np.ndarray) -> np.ndarray:
    """Where the words of squeezed bytes begin, and their length as the last entry."""
    return np.concatenate([[0], np.flatnonzero(buf == 32) + 1])


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of squeezed bytes: a polynomial of its bytes, mixed."""
    byte, power, inverse = _tables()
    out = np.empty(len(starts) - 1, np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)) - 1)
        a, b = starts[at], starts[to]
        if b - a <= 2 * BLOCK:  # else it is one very long word
            value = byte[buf[a:b]]
            value *= power[: b - a]
            out[at:to] = np.add.reduceat(value, starts[at:to] - a) * inverse[starts[at:to] - a]
        at = to
    sizes = np.diff(starts)
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i + 1] - 1].tobytes())
    return _mix(out, sizes.astype(np.uint64))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, by doubling; entry i covers i to i + k - 1."""
    have, width, out, done = h, 1, None, 0
    while True:
        if k & width:
            out = have if out is None else _mix(out[: len(h) - done - width + 1], have[done : done + len(h) - done - width + 1])
            done += width
        if done == k:
            return out
        have = _mix(have[: len(have) - width], have[width:])
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive entries."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    if rest := w - width:
        x = np.minimum(x[: len(x) - rest], x[rest:])
    return x


def repeats(text: bytes, starts: np.ndarray, h: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows that start at word `at` (in order of precedence) equal one of another owner or place before them."""
    if not len(at):
        return np.zeros(0, bool)
    key = h[at]
    order = np.argsort(key, kind="stable")
    new = np.empty(len(order), bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.empty(len(at), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    del order, new
    i = np.flatnonzero(first != np.arange(len(at)))
    dup = np.zeros(len(at), bool)
    if not len(i):
        return dup
    f = first[i]
    x, y = at[i], at[f]
    span = lambda u, v: text[starts[u] : starts[v + k]]
    same = np.ones(len(i), bool)
    for a, b in zip(*_runs((np.diff(x) != 1) | (np.diff(y) != 1)), strict=True):
        if span(x[a], x[b]) != span(y[a], y[b]):
            same[a : b + 1] = [span(x[j], x[j]) == span(y[j], y[j]) for j in range(a, b + 1)]
    dup[i] = same & ((owner[i] != owner[f]) | (place[i] != place[f]))
    for g in np.unique(key[i[~same]]):  # different windows under one hash: settle them by their words
        seen: dict[bytes, int] = {}
        for w in np.flatnonzero(key == g):
            f0 = seen.setdefault(span(at[w], at[w]), int(w))
            dup[w] = owner[w] != owner[f0] or place[w] != place[f0]
    return dup


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs; change: True where a run begins, for all but position 0."""
    begin = np.flatnonzero(np.concatenate([[True], change]))
    return begin, np.append(begin[1:], len(change) + 1) - 1


SCHEMA = "bucket int, kind int, blob binary"
_OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_SPANS = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
LOWEST = -(1 << 63)


def _pack(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, n: np.ndarray, text: bytes) -> bytes:
    head = np.array([len(doc)], np.int64)
    return zstandard.ZstdCompressor(level=5).compress(b"".join([head.tobytes(), doc.tobytes(), th.tobytes(), lo.tobytes(), n.tobytes(), text]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    cols = [np.frombuffer(data, np.int64, n, 8 + 8 * n * i) for i in range(4)]
    return (*cols, data[8 + 32 * n :])


class Chunk:
    """Documents that a task has read together: their words, the windows, and the minimisers of those."""

    def __init__(self, docs: list[tuple[int, int, bytes]], k: int, m: int):
        docs.sort(key=lambda d: d[:2])
        parts = [squeeze(text) for _, _, text in docs]
        counts = np.array([int((p == 32).sum()) if len(p) > 1 else 0 for p in parts], np.int64)
        buf = np.concatenate([p for p, n in zip(parts, counts, strict=True) if n] or [np.zeros(0, np.uint8)])
        del parts
        self.text = buf.tobytes()
        self.starts = word_starts(buf)
        self.h = word_hashes(buf, self.starts)
        end = np.cumsum(counts)
        self.begin = end - counts
        self.number = np.repeat(np.arange(len(docs)), counts)
        self.at = np.flatnonzero(np.arange(len(self.h)) + k <= end[self.number]) if len(self.h) else np.zeros(0, np.int64)
        self.low = sliding_min(rolling(self.h, m), k - m + 1) if len(self.at) else None
        self.doc = np.array([d[0] for d in docs], np.int64)
        self.hash = np.array([d[1] for d in docs], np.int64)

    def bucket(self, at: np.ndarray, buckets: int) -> np.ndarray:
        return ((self.low[at] * _C >> _S33) % np.uint64(buckets)).astype(np.int64)


def _bucket_of(c: Chunk, at: np.ndarray, buckets: int, split: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value by which windows stay together) of the windows that start at `at`; split: heavy buckets, their parts, their first part's number."""
    goes, value = c.bucket(at, buckets), c.low[at]
    heavy, parts, base = split
    if len(heavy):
        i = np.minimum(np.searchsorted(heavy, goes), len(heavy) - 1)
        hot = heavy[i] == goes
        if hot.any():
            second = sliding_min(rolling(_mix(c.h, np.full(len(c.h), _A)), LONG_PIECE), k - LONG_PIECE + 1)[at[hot]]
            goes[hot] = base[i[hot]] + ((second * _C >> _S33) % parts[i[hot]].astype(np.uint64)).astype(np.int64)
            value = value.copy()
            value[hot] = _mix(value[hot], second)
    return goes, value


def _chunk(docs: list[tuple[int, int, bytes]], buckets: int, k: int, m: int, split: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob): kind 1 has packed runs of windows for that bucket, kind 0 spans that are settled here."""
    c = Chunk(docs, k, m)
    at, number, begin = c.at, c.number, c.begin
    if not len(at):
        return
    # rows equal in doc_id and text are one document
    one = np.concatenate([[0], np.cumsum((c.doc[1:] != c.doc[:-1]) | (c.hash[1:] != c.hash[:-1]))])
    dup = repeats(c.text, c.starts, rolling(c.h, k), at, one[number[at]], at - begin[number[at]], k)
    if dup.any():
        d = at[dup]
        a, b = _runs((np.diff(d) != 1) | (np.diff(number[d]) != 0))
        owner = number[d[a]]
        lo = d[a] - begin[owner]
        yield int(xxhash.xxh32_intdigest(lo.tobytes()) % buckets), 0, _pack(c.doc[owner], c.hash[owner], lo, d[b] - d[a] + k, b"")
        at = at[~dup]
    if not len(at):
        return
    bucket, value = _bucket_of(c, at, buckets, split, k)
    a, b = _runs((np.diff(at) != 1) | (np.diff(number[at]) != 0) | (value[1:] != value[:-1]))
    first, last, goes = at[a], at[b], bucket[a]
    del at, bucket, value
    order = np.argsort(goes, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], goes[order[1:]] != goes[order[:-1]], [True]]))
    from_, to = c.starts[first], c.starts[last + k]
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        mine = order[x:y]
        owner = number[first[mine]]
        text = b"".join([c.text[i:j] for i, j in zip(from_[mine].tolist(), to[mine].tolist(), strict=True)])
        yield int(goes[mine[0]]), 1, _pack(c.doc[owner], c.hash[owner], first[mine] - begin[owner], last[mine] - first[mine] + 1, text)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[list[tuple[int, int, bytes]]]:
    turn_to("substring")
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, th, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((LOWEST if doc is None else doc, th, text))
                size += len(text)
                if size >= chunk:
                    yield held
                    held, size = [], 0
    yield held


def _scatter(buckets: int, k: int, m: int, chunk: int, split: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _chunks(batches, chunk):
            rows, total = [], 0
            for row in _chunk(docs, buckets, k, m, split):
                rows.append(row)
                total += len(row[2])
                if total > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)
                    rows, total = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    return run


def _weigh(buckets: int, k: int, m: int, chunk: int):
    """(bucket, bytes): what the super-k-mers of a chunk would bring to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _chunks(batches, chunk):
            c = Chunk(docs, k, m)
            if not len(c.at):
                continue
            a, b = _runs((np.diff(c.at) != 1) | (np.diff(c.number[c.at]) != 0) | (np.diff(c.low[c.at]) != 0))
            goes = c.bucket(c.at[a], buckets)
            order = np.argsort(goes, kind="stable")
            cut = _runs(np.diff(goes[order]) != 0)[0]
            load = np.add.reduceat((c.starts[c.at[b] + k] - c.starts[c.at[a]])[order], cut)
            yield pa.RecordBatch.from_arrays([pa.array(goes[order[cut]], pa.int32()), pa.array(load, pa.int64())], names=["bucket", "bytes"])

    return run


def _gather(k: int):
    def run(rows: pa.Table) -> pa.Table:
        docs, hashes, lows, highs = [], [], [], []
        runs, parts = [], []
        for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob"), strict=True):
            doc, th, lo, n, text = _unpack(blob.as_buffer())
            if kind == 0:
                docs.append(doc), hashes.append(th), lows.append(lo), highs.append(lo + n)
            else:
                runs.append((doc, th, lo, n))
                parts.append(text)
        if runs:
            doc, th, lo, n = (np.concatenate(x) for x in zip(*runs, strict=True))
            text = b"".join(parts)
            del runs, parts
            buf = np.frombuffer(text, np.uint8)
            starts = word_starts(buf)
            h = rolling(word_hashes(buf, starts), k)
            base = np.cumsum(n + k - 1) - (n + k - 1)  # where each run's words begin
            order = np.lexsort((lo, th, doc))
            doc, th, lo, n, base = (x[order] for x in (doc, th, lo, n, base))
            each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at, run_of = np.repeat(base, n) + each, np.repeat(np.arange(len(n), dtype=np.int32), n)
            owner = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))])[run_of]
            place = np.repeat(lo, n) + each
            dup = np.flatnonzero(repeats(text, starts, h, at, owner, place, k))
            if len(dup):
                a, b = _runs((np.diff(dup) != 1) | (np.diff(run_of[dup]) != 0))
                r = run_of[dup[a]]
                docs.append(doc[r]), hashes.append(th[r]), lows.append(place[dup[a]]), highs.append(place[dup[b]] + k)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, hashes, lows, highs)]
        return pa.Table.from_arrays([pa.array(c) for c in cols], schema=_SPANS)

    return run


def _same_id(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: the hash of the text, or nothing where no doc_id repeats."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.lit(0).cast("long")
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _key(docs: DataFrame, mark: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        mark.alias("hash"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )


def _heavy(rows: DataFrame, buckets: int, bucket: int, k: int, m: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that would get over HEAVY times their share, into how many parts each is split, and the number of its first part.

    At most one bucket in HEAVY can be so heavy; three numbers of each go to the driver and on to the tasks.
    """
    load = rows.mapInArrow(_weigh(buckets, k, m, chunk), "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    # a window travels in about three times its own bytes
    got = sorted(load.where(F.col("bytes") > 3 * HEAVY * bucket).toLocalIterator(), key=lambda r: r.bucket)
    parts = np.array([-(-r.bytes // (3 * bucket)) for r in got], np.int64)
    return np.array([r.bucket for r in got], np.int64), parts, buckets + np.cumsum(parts) - parts


def spans(docs: DataFrame, mark: Column, k: int = WINDOW, m: int = PIECE, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc, hash, spans array<struct<lo,hi>>): word spans to remove, for documents that have any; hash is the mark of `_same_id`."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = spread(text_bytes(docs, "text"), bucket, 2 * parts)
    rows = _key(docs, mark)
    split = _heavy(rows, buckets, bucket, k, m, chunk) if k > LONG_PIECE else (np.zeros(0, np.int64),) * 3
    packed = rows.mapInArrow(_scatter(buckets, k, m, chunk, split), SCHEMA)
    found = packed.groupBy("bucket").applyInArrow(_gather(k), "doc long, hash long, lo long, hi long")
    return found.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def _cut(text: bytes, cuts: list[dict] | None) -> tuple[int, int, bytes]:
    """Words, removed words, kept words joined by one space."""
    words = text.split()
    if not cuts:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for c in cuts:
        if c["lo"] > at:
            kept += words[at : c["lo"]]
        at = max(at, c["hi"])
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _joined(docs: DataFrame, **how) -> tuple[DataFrame, str]:
    """The documents with one more column, of the spans to cut, and its name."""
    mark = _same_id(docs)
    doc, th, cuts = free(docs, "doc", "hash", "cuts")
    found = spans(docs, mark, **how).select(F.col("doc").alias(doc), F.col("hash").alias(th), F.col("spans").alias(cuts))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    return docs.join(found, (key == F.col(doc)) & (mark == F.col(th)), "left").drop(doc, th), cuts


def dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_cut(t or b"", c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined, cuts = _joined(docs.select("doc_id", "text"), **how)
    rows = joined.select("doc_id", F.col("text").cast("binary").alias("text"), cuts)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """The documents with the columns they came with; where spans go, the text is the kept words joined by one space."""
    joined, cuts = _joined(docs, **how)
    names = joined.columns
    text, spans_at = names.index("text"), names.index(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if not c or t is None else _cut(t.encode(), c)[2].decode() for t, c in zip(b.column(text).to_pylist(), b.column(spans_at).to_pylist(), strict=True)]
            cols = [pa.array(new, pa.string()) if i == text else c for i, c in enumerate(b.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(cols, names=[n for i, n in enumerate(names) if i != spans_at])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20) x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM k) x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS j FROM later) x),
p AS (SELECT doc_id, j, w[j] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS j FROM d WHERE len(w) > 0) y),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p.j) AS t FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.j = p.j WHERE g.j IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
