"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Only DataFrame and SQL functions run here. A document's words are cut once; the hash of every window is
looked up in the broadcast set of benchmark window hashes. Only documents with hits carry their text on:
the exact words of the places that hit are compared with the benchmark's windows by an equality join, so
a hash collision costs a candidate and never a result. A set of more than `most` hashes is dealt into
blocks of at most about that many, each broadcast by itself against all documents: the set's memory is
bounded at every size, and no window of a document is ever shuffled.

Edge cases: null text or text without words has no words and no hits; a benchmark item without
words has no window; an item shorter than `n` is one window of its own length; rows equal in doc_id and
text each get the same verdict; repeated items count once for each item_id; a null item_id marks
words but is not counted; an empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import free, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and letters.
SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Hashes that are broadcast together (of 12 bytes; about 40 in the executors' table).
MOST = 2_000_000
#: Up to so many hashes stand in the plan too, so that places which cannot hit are left out before they become rows.
FEW = 20_000


def _words(text: str) -> str:
    return f"filter(split({text}, '{SEPARATORS}'), w -> w <> '')"


def _exact(text: str) -> str:
    """Words with A-Z lowered, nothing else."""
    return _words(f"translate({text}, '{UPPER}', '{LOWER}')")


def benchmark_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id string, len, key, h): the distinct windows of each item; h is over the words of key."""
    return (
        items.select(
            F.col("item_id").cast("string").alias("item_id"),
            F.expr(_exact("coalesce(text, '')")).alias("w"),
        )
        .where("size(w) > 0")
        .selectExpr("item_id", "w", "size(w) as n")
        .selectExpr(
            "item_id",
            f"explode(if(n >= {n}, transform(sequence(1, greatest(1, n - {n - 1})), i -> slice(w, i, {n})), array(w))) as win",
        )
        .selectExpr(
            "item_id", "size(win) as len", "array_join(win, ' ') as key", "xxhash64(win) as h"
        )
        .distinct()
    )


def _mark(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, mark, spans array<struct<pos,len>> of hit windows, items array<string>, of documents that have any; mark: hash of the text."""
    windows = benchmark_windows(items, n)
    hashes = windows.select(F.col("len").alias("k"), F.col("h").alias("key_hash")).distinct()
    counts = hashes.groupBy("k").count().collect()  # one row for each length up to n
    lengths = sorted(r["k"] for r in counts)
    total = sum(r["count"] for r in counts)
    blocks = max(1, -(-total // most))
    words = _exact("coalesce(text, '')")
    places_of = {k: f"if(size(w) >= {k}, sequence(1, greatest(1, size(w) - {k - 1})), cast(array() as array<int>))" for k in lengths}
    if total <= FEW:
        for k in lengths:
            own = ", ".join(f"{r.key_hash}L" for r in hashes.where(F.col("k") == k).select("key_hash").collect())
            places_of[k] = f"filter({places_of[k]}, i -> xxhash64(slice(w, i, {k})) in ({own}, 0L))"
    tries = ", ".join(f"transform({places_of[k]}, i -> named_struct('pos', i, 'len', {k}, 'h', xxhash64(slice(w, i, {k}))))" for k in lengths)
    tries = tries or "cast(array() as array<struct<pos:int,len:int,h:bigint>>)"
    cut = docs.select("doc_id", "text", _mark().alias("mark")).selectExpr("doc_id", "text", "mark", f"transform(array({words}), w -> concat({tries}))[0] as c")
    places = cut.selectExpr("doc_id", "text", "mark", "explode(c) as x").selectExpr("doc_id", "text", "mark", "x.pos as pos", "x.len as len", "x.h as h")

    def hits(i: int) -> DataFrame:
        own = hashes.where(F.expr(f"pmod(key_hash, {blocks}L) = {i}"))
        return places.join(F.broadcast(own), (F.col("len") == F.col("k")) & (F.col("h") == F.col("key_hash"))).select("doc_id", "text", "mark", "pos", "len")

    found = reduce(DataFrame.union, map(hits, range(blocks))).groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.collect_set(F.struct("pos", "len")).alias("at"))
    exact = found.selectExpr(
        "doc_id", "mark",
        f"explode(transform(array({words}), w -> transform(at, p -> named_struct('pos', p.pos, 'len', p.len, 'key', array_join(slice(w, p.pos, p.len), ' '))))[0]) as c",
    )
    sure = exact.join(windows.select("key", "item_id"), F.col("c.key") == F.col("key"))
    return sure.groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct(F.col("c.pos").alias("pos"), F.col("c.len").alias("len"))).alias("spans"), F.collect_set("item_id").alias("items")
    )


#: Words in the union of sorted spans.
COVERED = (
    "aggregate(array_sort(spans), named_struct('end', 0, 'sum', 0), (a, s) -> named_struct("
    "'end', greatest(a.end, s.pos + s.len), 'sum', a.sum + greatest(0, s.pos + s.len - greatest(a.end, s.pos))), a -> a.sum)"
)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row."""
    found = find_hits(docs, items, n, most).select(F.col("doc_id").alias("doc"), F.col("mark").alias("hash"), "spans", "items")
    words = _exact("coalesce(text, '')")
    every = docs.select("doc_id", _mark().alias("mark"), F.expr(f"size({words})").alias("n_words"))
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("mark") == F.col("hash")), "left").selectExpr(
        "doc_id",
        "cast(n_words as long) as n_words",
        f"coalesce(cast({COVERED} as long), 0L) as n_hit",
        "coalesce(cast(size(items) as long), 0L) as n_items",
        "sha2(coalesce(array_join(array_sort(items), ','), ''), 256) as items_sha256",
        "spans is not null as contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, most: int = MOST) -> DataFrame:
    """The documents, with the columns they came with, that hold no benchmark window."""
    doc, th = free(docs, "doc", "hash")
    found = materialise(find_hits(docs, items, n, most).select(F.col("doc_id").alias(doc), F.col("mark").alias(th)), "leaks")
    if found.count() <= most:  # else the documents go to their marks
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (_mark() == F.col(th)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) t WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(generate_series(1, greatest(1, n - 9))) AS i FROM b) t),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
hit AS (
  SELECT p.doc_id, p.i, p.k, win.item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM pos) p JOIN win ON win.k = p.k AND win.key = p.key),
cov AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit) u) t GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
