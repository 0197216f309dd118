"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its ends) and of itself, hashed into one
table of vectors; a window of words is the average of its words, and a linear softmax turns that into
the probability of being toxic. The softmax and the vectors are trained together. A document is as
toxic as its worst window, so a slur in a text of twenty thousand words counts as much as in one of
twenty; training goes through the same maximum after a warm start on whole-document averages. An
unseen misspelling shares most of its n-grams with the word it stands for, and so its vector.

Labels are read only from rows whose crc32(doc_id) mod 4 is not 2, at most `TRAIN_ROWS` of each class
(those of the smallest hash of doc_id, so the choice repeats); classes are weighted back to their
share of all such rows. Every document is scored over its whole text.

Edge cases: null, empty and wordless texts get the score of an empty bag; a doc_id with several
labels is toxic if any says so; null labels are left out; without labels of both classes every score
is the share of toxic ones (0 without labels); repeated rows get equal scores; an empty table gives
no rows. Other columns are carried along by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import free, turn_to

TRAIN_ROWS = 1500
THRESHOLD = 0.3
WINDOW = 8
#: Characters of text taken at once, and words whose value a Python worker keeps.
CHUNK, KEPT = 2 << 20, 500_000
BUCKETS, DIM, NGRAMS = 1 << 18, 8, (3, 4, 5)
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’¡¿…–—"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def plain(word: str) -> str:
    return word.lower().strip(EDGE)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of the word) of all n-grams of the words with their ends marked, and of the whole words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    h = (code + np.uint64(1)) * _A
    h ^= h >> _S
    buckets, owners = [], []
    roll = h
    for n in range(2, max(NGRAMS) + 1):
        if len(h) < n:
            break
        roll = roll[:-1] * _B + h[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(of[: len(roll)] == of[n - 1 :])
            x = roll[at] * _A
            buckets.append((x >> np.uint64(40)) % np.uint64(BUCKETS))
            owners.append(of[at])
    whole = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - (ends - np.diff(ends, prepend=0))[of].astype(np.uint64) + np.uint64(7)) * _B, ends - np.diff(ends, prepend=0))
    buckets.append(((whole * _A) >> np.uint64(40)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(words)))
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


class Model:
    """Only what scoring needs: a number for each bucket (its vector along the softmax's direction), and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state, known={})

    def words(self, words: list[str]) -> np.ndarray:
        """Mean over the subwords of each word."""
        b, o = subwords(words)
        return np.bincount(o, self.weight[b], len(words)) / np.maximum(1, np.bincount(o, minlength=len(words)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, which are taken a few at a time so that words and n-grams never pile up."""
        parts, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > CHUNK:
                parts.append(self._some(held))
                held, size = [], 0
        return np.concatenate([*parts, self._some(held)])

    def _some(self, texts: list[str]) -> np.ndarray:
        cut = [t.split() for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            self.known.update(zip(some, self.words([plain(w) for w in some]).tolist(), strict=True))
        out = np.empty(len(texts))
        for i, c in enumerate(cut):
            out[i] = worst(runs_once(np.fromiter(map(self.known.__getitem__, c), np.float64, len(c))))[1]
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def runs_once(values: np.ndarray) -> np.ndarray:
    """Without entries equal to the one before: a run of one word counts once."""
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def worst(values: np.ndarray, window: int = WINDOW) -> tuple[int, float]:
    """Start and mean of the window of the largest mean; short texts are one window, and empty ones 0."""
    if len(values) <= window:
        return 0, float(values.mean()) if len(values) else 0.0
    total = np.concatenate([[0.0], np.cumsum(values)])
    mean = (total[window:] - total[:-window]) / window
    i = int(mean.argmax())
    return i, float(mean[i])


def train(texts: list[str], toxic: list[int], weights: tuple[float, float], steps: int = 120, warm: int = 15, rate: float = 0.08, seed: int = 7) -> Model:
    """Adam over all texts at once; the gradient reaches the vectors of the words in each text's window. Empties the list of texts."""
    y = np.array(toxic, np.float64)
    w = np.where(y == 1, weights[1], weights[0])
    w = w / w.sum()
    names: dict[str, int] = {}
    docs = []
    while texts:  # each text goes once its words are numbered
        docs.append(runs_once(np.array([names.setdefault(plain(x), len(names)) for x in texts.pop(0).split()], np.int32)))
    words = list(names)
    parts = [subwords(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    sub = np.concatenate([p[0].astype(np.int32) for p in parts] or [np.zeros(0, np.int32)])
    owner = np.concatenate([(p[1] + 10_000 * i).astype(np.int32) for i, p in enumerate(parts)] or [np.zeros(0, np.int32)])
    n_words = len(words)
    del names, words, parts
    size = np.maximum(1, np.bincount(owner, minlength=n_words)).astype(np.float64)
    used = np.flatnonzero(np.bincount(sub, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    sub = place[sub]
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (len(used), DIM))
    direction, bias = rng.normal(0, 1, (2, DIM)), np.zeros(2)
    direction[0] = -direction[1]
    params = [vec, direction, bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    first = np.searchsorted(owner, np.arange(n_words + 1))
    length = np.array([max(1, len(d)) for d in docs], np.float64)
    flat = np.concatenate([*docs, np.zeros(0, np.int32)])
    doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    for step in range(steps):
        u = direction[1] - direction[0]
        along_u = vec @ u
        value = np.concatenate([np.add.reduceat(along_u[sub[first[i] : first[min(i + 50_000, n_words)]]], first[i : min(i + 50_000, n_words)] - first[i]) for i in range(0, n_words, 50_000)] or [np.zeros(0)]) / size
        if step < warm:
            who, doc, share = flat, doc_of, 1 / length[doc_of]
            mean = np.bincount(doc_of, value[flat], len(docs)) / length
        else:
            starts = [worst(value[d]) for d in docs]
            parts = [d[s : s + WINDOW] for d, (s, _) in zip(docs, starts, strict=True)]
            who = np.concatenate([*parts, np.zeros(0, np.int32)])
            doc = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
            share = 1 / np.maximum(1, np.array([len(p) for p in parts]))[doc]
            mean = np.array([s[1] for s in starts])
        p = 1 / (1 + np.exp(-np.clip(mean + bias[1] - bias[0], -60, 60)))
        wrong = w * (p - y)
        word = np.bincount(who, wrong[doc] * share, n_words) / size  # what reaches each subword of a word
        got = np.flatnonzero(word)
        along = np.zeros(len(used))
        for i in range(0, len(got), 50_000):
            some = got[i : i + 50_000]
            lengths = first[some + 1] - first[some]
            at = np.repeat(first[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            along += np.bincount(sub[at], np.repeat(word[some], lengths), len(used))
        grad_u = along @ vec
        grads = [along[:, None] * u[None, :], np.stack([-grad_u, grad_u]), np.array([-wrong.sum(), wrong.sum()])]
        for i, (q, g) in enumerate(zip(params, grads, strict=True)):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            q -= rate * (m1[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2[i] / (1 - 0.99 ** (step + 1))) + 1e-9)
        vec *= 1 - 1e-4
    weight = np.zeros(BUCKETS)
    weight[used] = vec @ (direction[1] - direction[0])
    return Model(weight, float(bias[1] - bias[0]))


def _labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows that may be learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    return known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = 120) -> Model:
    """A model from at most train_rows texts of each class; class shares come from all labels."""
    known = _labels(docs, labels)
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        share = shares.get(1, 0) / total if total else 0.0
        return Model(np.zeros(BUCKETS), 60.0 if share else -60.0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [known.where(F.col("toxic") == k).orderBy(*order).limit(train_rows) for k in (0, 1)]
    # at most 2 * train_rows ids
    ids = F.broadcast(chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "__id"))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: str(r["doc_id"]))
    got = [max(1, sum(r["toxic"] == k for r in rows)) for k in (0, 1)]
    toxic, texts = [r["toxic"] for r in rows], [r["text"] or "" for r in rows]
    del rows
    return train(texts, toxic, (shares[0] / got[0], shares[1] / got[1]), steps)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; a column of that name gives way."""
    docs = docs.drop(column)
    names = docs.columns
    at = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        turn_to("toxicity", own.known.clear)
        for b in batches:
            s = own.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, **how)).select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The documents, with the columns they came with, whose score is below the threshold."""
    (name,) = free(docs, "score")
    return score(docs, fit(docs, labels, **how), name).where(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
