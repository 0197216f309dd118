"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling inside Spark tasks.

Each word v is a context with a restaurant of its own: the customers of dish w are the bigrams "v w" of
the training texts, and each of its tables sends one customer to the parent, the restaurant of
single words, which all contexts share. The parent's tables draw from the base: a share `UNSEEN` for the
one outcome "a word that training does not have", the rest even over the V words that it has.

    P(w | v) = (c_vw - d t_vw) / (s + C_v) + (s + d T_v) / (s + C_v) P(w),   P(w) likewise over the base

A seating is kept as t_vw, its number of tables for each dish; the sizes of tables are summed out. Given
all others, t tables for c customers have the probability  prod_{i<t} (s + d (T' + i)) * H^t * S_d(c, t),
with T' the restaurant's other tables, H the parent's probability of the dish and S_d the generalized Stirling
numbers. Gibbs sweeps draw each dish from it: from a table of S_d up to `EXACT` customers, and by
Metropolis steps, with S_d from an integral or a saddle point, beyond that. Predictions are averaged over samples.

How it is spread: a chunk of texts sends each bigram occurrence (packed, with the number of its document) to the
bucket of its context; restaurants with a large share of all tokens are dealt over many buckets by dish, and their
totals are exchanged. Buckets are written once, as a bucketed table, and read again without a shuffle. Buckets
ask the keepers of single words, packed, twice: for the training count of each word, and, after the burn-in, for
its customers and tables in the parent. All that moves grows with the text; nothing of the model is on the driver but totals.

The chain is drawn from the bucket's own seed, so a lost task repeats it. `docs` is read once more if tasks are
lost: its rows have to come in the same order then, as they do from files.

Edge cases: a null or empty text has one token, its end; a null doc_id is not held out; repeated rows are
scored, and learnt from, each; without training texts the model is the base over one outcome, with score 0; an
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from corpusmill.llm.common import discard, materialise, shared_dir, shuffle_partitions, spread, text_bytes, turn_to
from corpusmill.llm.substring import _mix, squeeze, word_hashes, word_starts

#: Text bytes of a chunk and, on average, of a bucket; a context with over 1 / SPLIT of a bucket's tokens is dealt out by dish.
CHUNK, BUCKET, SPLIT = 10 << 20, 16 << 20, 8
#: Strength of each restaurant, and the base's share of unseen words.
STRENGTH, UNSEEN = 1.0, 0.5
#: Sweeps before the parent is seated, then samples that are averaged.
BURN, SAMPLES = 3, 4
#: Customers of a dish up to which its tables are drawn from the whole table of Stirling numbers; Metropolis steps beyond.
EXACT, STEPS = 64, 24
#: Bytes of text, and share of the text, from which frequent contexts are estimated: it decides where rows go, never what comes out.
SAMPLE_BYTES, SAMPLE_SHARE = 16 << 20, 1 / 4096
MAX_TABLE_BUCKETS = 100_000
START, END = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b"\x00start", b"\x00end"))
_SALT = np.uint64(0x6A09E667F3BCC909)


# Packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, or of doubles, in planes of as few bytes as they need."""
    head, body = [len(arrays)], []
    for a in arrays:
        x = a.view(np.uint64) if a.dtype == np.float64 else a.astype(np.uint64)
        width = 8 if a.dtype == np.float64 else max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        head += [len(x), width, int(a.dtype == np.float64)]
        body.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 3 * count, 8).reshape(count, 3)
    at, out = 8 + 24 * count, []
    for n, width, real in head.tolist():
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out.append(whole.reshape(-1).view(np.float64 if real else np.uint64))
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _keeper(keys: np.ndarray, n: int) -> np.ndarray:
    """Number of the keeper of each key; ascending keys have ascending keepers."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# Seating


@lru_cache(4)
def stirling_table(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c and t up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 0)), -np.inf) + out[c]
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Nodes of y c along the cut, evenly in its logarithm.
_CUT = np.arange(-16, 4.6, 0.4)


class Stirling:
    """log S_d(c, t) = log of c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t, for many customers c, which are given once, and any t.

    With few tables, up to 3 c^d, the coefficient is integrated along the cut z = 1 + y; with more of them the saddle point is near enough.
    """

    def __init__(self, c: np.ndarray, d: float):
        self.c, self.d = c.astype(np.float64), d
        y = np.exp(_CUT) / self.c[:, None]
        base = np.log1p(-(y**d) * np.exp(-1j * math.pi * d))
        self.real, self.angle = base.real, base.imag
        self.weight = np.log(y * (_CUT[1] - _CUT[0]) / math.pi) - (self.c[:, None] + 1) * np.log1p(y)
        self.few = np.minimum(3 * self.c**d, 0.8 * self.c)
        self.log_c = log_gamma(self.c + 1)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        t = t.astype(np.float64)
        value, few = np.empty(len(t)), t <= self.few
        n = t[few, None]
        total = (np.exp(n * self.real[few] + self.weight[few]) * np.sin(n * self.angle[few])).sum(1)
        value[few] = np.log(np.maximum(total, 1e-300))
        few[few] = total > 0
        value[~few] = _saddle(self.c[~few], t[~few], self.d)
        return np.where(t >= self.c, 0.0, value + self.log_c - log_gamma(t + 1) - t * math.log(self.d))


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(c.shape, -60.0), np.full(c.shape, -1e-12)  # of log(1 - z)
    for _ in range(50):
        mid = (low + high) / 2
        # few customers for so many tables: z is too large
        over = t * d * -np.expm1(mid) * np.exp((d - 1) * mid) > c * -np.expm1(d * mid)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    log_q = (low + high) / 2
    z = -np.expm1(log_q)
    curve = np.maximum(c * (1 + (1 - d) * z * np.exp(-log_q) - c / t), 1 / (2 * math.pi))
    return t * np.log(-np.expm1(d * log_q)) - c * np.log(z) - 0.5 * np.log(2 * math.pi * curve)


class Restaurants:
    """Seating of dishes (customers c, restaurant k) in restaurants, by tables; scale: all tables of a restaurant over those that are here."""

    def __init__(self, c: np.ndarray, k: np.ndarray, n: int, d: float, s: float, rng: np.random.Generator, scale: np.ndarray | None = None):
        self.c, self.k, self.n, self.d, self.s, self.rng = c, k, n, d, s, rng
        self.scale = np.ones(n) if scale is None else scale
        self.t = np.ones(len(c), np.int64)
        many = np.flatnonzero(c > 1)
        self.some = [many[c[many] == x] for x in np.unique(c[many]) if x <= EXACT]
        large = many[c[many] > EXACT]
        self.large = [(at, Stirling(c[at], d)) for at in (large[0::2], large[1::2])]
        self.begun = False

    def tables(self) -> np.ndarray:
        return np.bincount(self.k, self.t, self.n) * self.scale

    def sweep(self, h: np.ndarray) -> None:
        """Each dish of more than one customer is drawn anew, half of them at a time given the other half. h: the parent's probability of each dish."""
        if not self.begun:
            for at, stirling in self.large:
                self._begin(at, stirling, h)
        self.begun = True
        for half in (0, 1):
            total = self.tables()
            for at in self.some:
                self._draw(at[half::2], total, h)
            self._walk(*self.large[half], total, h)

    def _others(self, at: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self.s + self.d * np.maximum(total[self.k[at]] - self.t[at], 0)

    def _draw(self, at: np.ndarray, total: np.ndarray, h: np.ndarray) -> None:
        if not len(at):
            return
        c = int(self.c[at[0]])
        x = self._others(at, total)[:, None] + self.d * np.arange(c)
        weight = np.cumsum(np.log(x), 1) + np.log(h[at])[:, None] * np.arange(1, c + 1) + stirling_table(self.d)[c, 1 : c + 1]
        p = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        self.t[at] = 1 + (p < (self.rng.random(len(at)) * p[:, -1])[:, None]).sum(1)

    def _log_weight(self, stirling: Stirling, t: np.ndarray, x: np.ndarray, log_h: np.ndarray) -> np.ndarray:
        return log_gamma(x / self.d + t) - log_gamma(x / self.d) + t * (math.log(self.d) + log_h) + stirling(t)

    def _begin(self, at: np.ndarray, stirling: Stirling, h: np.ndarray) -> None:
        """Large dishes begin at the likeliest of some numbers between 1 and their customers."""
        x, best, value = self._others(at, self.tables()), np.ones(len(at), np.int64), np.full(len(at), -np.inf)
        for share in np.linspace(0, 1, 25):
            t = np.maximum(1, np.round(np.exp(share * np.log(self.c[at])))).astype(np.int64)
            v = self._log_weight(stirling, t, x, np.log(h[at]))
            best, value = np.where(v > value, t, best), np.maximum(v, value)
        self.t[at] = best

    def _walk(self, at: np.ndarray, stirling: Stirling, total: np.ndarray, h: np.ndarray) -> None:
        if not len(at):
            return
        x, wide, log_h = self._others(at, total), np.maximum(1.0, self.c[at] ** (self.d / 2)), np.log(h[at])
        now = self._log_weight(stirling, self.t[at], x, log_h)
        for i in range(STEPS):
            t = self.t[at] + np.round(self.rng.normal(0, wide / 4 ** (i % 3))).astype(np.int64)
            inside = (t >= 1) & (t <= self.c[at])
            then = self._log_weight(stirling, np.clip(t, 1, self.c[at]), x, log_h)
            take = inside & (np.log(self.rng.random(len(at))) < then - now)
            self.t[at], now = np.where(take, t, self.t[at]), np.where(take, then, now)


def discount(once: int, twice: int) -> float:
    """From the dishes of one and of two customers."""
    return min(0.98, max(0.1, once / (once + 2 * twice))) if once else 0.5


# Chunks, buckets, keepers


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, number of the text) of each token, the end of a text one of them; A-Z are lowered."""
    parts, counts, at = [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
            size += len(texts[to])
            to += 1
        words = [squeeze(t.lower()) for t in texts[at:to]]
        own = [int((w == 32).sum()) if len(w) > 1 else 0 for w in words]
        buf = np.concatenate([w for w, c in zip(words, own, strict=True) if c] or [np.zeros(0, np.uint8)])
        parts.append(word_hashes(buf, word_starts(buf)) if len(buf) else np.zeros(0, np.uint64))
        counts += own
        at = to
    n = np.array(counts, np.int64)
    ends = np.cumsum(n + 1) - 1
    w = np.full(int((n + 1).sum()), END, np.uint64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner] = np.concatenate([*parts, np.zeros(0, np.uint64)])
    v = np.concatenate([[START], w[:-1]]).astype(np.uint64)
    v[ends[:-1] + 1] = START
    return v, w, np.repeat(np.arange(len(n)), n + 1)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _scatter(buckets: int, hot: np.ndarray, chunk: int):
    """A blob of bigram occurrences for each bucket (kind 0), and one that names the chunk's documents (kind 1)."""

    def flush(number: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        v, w, doc = _tokens([t or b"" for t in held.column(1).to_pylist()])
        out_ = held.column(2).to_numpy(zero_copy_only=False).astype(bool)
        sink = pa.BufferOutputStream()
        ids = pa.table({"doc_id": held.column(0), "held_out": held.column(2), "n_tokens": pa.array(np.bincount(doc, minlength=len(held)))})
        with pa.ipc.new_stream(sink, ids.schema) as f:
            f.write_table(ids)
        row = lambda b, kind, blob: pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], schema=_SENT)
        yield row(number % buckets, 1, zstandard.compress(sink.getvalue().to_pybytes()))
        split = np.isin(v, hot)
        goes = (np.where(split, _mix(v, w), _mix(v, np.full(len(v), _SALT))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((w, v, goes))
        goes, v, w, doc = goes[order], v[order], w[order], 2 * doc[order] + out_[doc[order]]
        for part in np.split(np.arange(len(goes)), np.flatnonzero(np.diff(goes)) + 1):
            if len(part):
                contexts, of = np.unique(v[part], return_counts=True)
                words, which = np.unique(w[part], return_inverse=True)
                yield row(int(goes[part[0]]), 0, pack(steps(contexts), of, steps(words), which, doc[part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pitman_yor")
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            lengths = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 8
                if size >= chunk:
                    held.append(b.slice(begin, i + 1 - begin))
                    yield from flush(number, held)
                    number, held, size, begin = number + 1, [], 0, i + 1
            if begin < b.num_rows:
                held.append(b.slice(begin))
        if held:
            yield from flush(number, held)

    return run


_ROOM = "bucket int, chunk long, kind int, blob binary, once long, twice long, tokens long"


def _gather(rows: pa.Table) -> pa.Table:
    """Of a bucket: its dishes with their training customers, and their occurrences (kind 0, one row); names of chunks go on as they are."""
    kinds = rows.column("kind").to_numpy()
    bucket = rows.column("bucket")[0].as_py()
    own, blobs, chunks = np.flatnonzero(kinds == 0), rows.column("blob"), rows.column("chunk").to_numpy()
    out = [(bucket, int(chunks[i]), 1, blobs[int(i)].as_py(), 0, 0, 0) for i in np.flatnonzero(kinds == 1)]
    if len(own):
        parts = [unpack(blobs[int(i)].as_py()) for i in own]
        parts = [(np.cumsum(a, dtype=np.uint64), n.astype(np.int64), np.cumsum(b, dtype=np.uint64), which.astype(np.int64), doc) for a, n, b, which, doc in parts]
        contexts, words = (np.unique(np.concatenate([p[i] for p in parts])) for i in (0, 2))
        key = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]), p[1]) * len(words) + np.searchsorted(words, p[2])[p[3]] for p in parts])
        doc = np.concatenate([p[4] for p in parts])
        names, chunk = np.unique(chunks[own], return_inverse=True)
        chunk = np.repeat(chunk, [len(p[4]) for p in parts])
        del parts
        order = np.argsort(key, kind="stable")
        key, doc, chunk = key[order], doc[order], chunk[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        dish = np.cumsum(first) - 1
        learnt = np.bincount(dish, (doc & np.uint64(1)) == 0).astype(np.int64)
        dishes = key[first]
        blob = pack(steps(contexts), steps(words), steps(dishes // len(words)), dishes % len(words), learnt, np.bincount(dish), names, chunk, doc)
        out.append((bucket, -1, 0, blob, int((learnt == 1).sum()), int((learnt == 2).sum()), int(learnt.sum())))
    kinds_ = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds_, strict=True)], names=[x.split(" ")[0] for x in _ROOM.split(", ")])


class Room:
    """A bucket: contexts and words as hashes, dishes (context, word, customers), occurrences."""

    def __init__(self, bucket: int, blob: bytes, hot: np.ndarray):
        a, b, k, w, c, uses, self.names, self.chunk, self.doc = unpack(blob)
        self.bucket = bucket
        self.contexts, self.words = np.cumsum(a, dtype=np.uint64), np.cumsum(b, dtype=np.uint64)
        self.k, self.w, self.c, self.uses = np.cumsum(k, dtype=np.uint64).astype(np.int64), w.astype(np.int64), c.astype(np.int64), uses.astype(np.int64)
        self.customers = np.bincount(self.k, self.c, len(self.contexts))
        self.learnt = np.flatnonzero(self.c)
        split = np.flatnonzero(np.isin(self.contexts, hot))
        keys = _mix(self.contexts[split], np.full(len(split), _SALT))
        self.split, self.split_keys = split[np.argsort(keys)], np.sort(keys)
        self.kinds = np.bincount(self.k[self.learnt], minlength=len(self.contexts))

    def asks(self, keepers: int, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(keeper, blob): a number for each word, and two for each context that other buckets share."""
        w_at = np.searchsorted(_keeper(self.words, keepers), np.arange(keepers + 1))
        s_at = np.searchsorted(_keeper(self.split_keys, keepers), np.arange(keepers + 1))
        for i in range(keepers):
            x, y = slice(w_at[i], w_at[i + 1]), slice(s_at[i], s_at[i + 1])
            if w_at[i] < w_at[i + 1] or s_at[i] < s_at[i + 1]:
                yield i, pack(steps(self.words[x]), counts[x], steps(self.split_keys[y]), a[y], b[y])

    def seated(self, told: Told, totals: Totals) -> Restaurants:
        """After the burn-in, with the parent estimated from counts of words; always the same."""
        scale = np.ones(len(self.contexts))
        scale[self.split] = told.split_b / np.maximum(1, self.kinds[self.split])
        rng = np.random.default_rng([11, self.bucket])
        r = Restaurants(self.c[self.learnt], self.k[self.learnt], len(self.contexts), totals.d, STRENGTH, rng, scale)
        h = np.maximum(told.counts, 1)[self.w[self.learnt]] / (totals.tokens + totals.words)
        for _ in range(BURN):
            r.sweep(h)
        return r


class Told:
    """What keepers answered: of words and of shared contexts, in the room's order."""

    def __init__(self, answers: list[tuple[int, bytes]]):
        parts = [unpack(blob) for _, blob in sorted(answers)]
        real = lambda i: np.concatenate([p[i].astype(np.float64) for p in parts])
        self.counts, self.tables, self.split_a, self.split_b = (real(i) for i in range(4))


class Totals:
    """Of all training texts: tokens, distinct words, and the discounts; of the parent: customers and tables."""

    def __init__(self, tokens: int, words: int, d: float, parent_d: float = 0.5, customers: float = 0.0, tables: float = 0.0):
        self.tokens, self.words, self.d, self.parent_d, self.customers, self.tables = tokens, words, d, parent_d, customers, tables

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w) of words with so many customers and tables in the parent; without any it is that of all unseen words together."""
        if not self.words:
            return np.ones(len(customers))
        base = np.where(customers > 0, (1 - UNSEEN) / self.words, UNSEEN)
        return (customers - self.parent_d * tables + (STRENGTH + self.parent_d * self.tables) * base) / (STRENGTH + self.customers)


_ASKED = pa.schema([("keeper", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_ANSWER = "round int, bucket int, keeper int, blob binary, words long, once long, twice long, customers double, tables double"


def _asked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ASKED)], schema=_ASKED)


def _keep(round_: int, words_all: int, parent_d: float):
    """Of a keeper: sums over what buckets sent, told to each bucket in the order it asked; in round 2 the parent's tables are seated."""

    def run(rows: pa.Table) -> pa.Table:
        keeper, buckets, blobs = rows.column("keeper")[0].as_py(), rows.column("bucket").to_pylist(), rows.column("blob").to_pylist()
        parts = [unpack(b) for b in blobs]
        names = [(np.cumsum(p[0], dtype=np.uint64), np.cumsum(p[2], dtype=np.uint64)) for p in parts]
        words, word_of = np.unique(np.concatenate([n[0] for n in names]), return_inverse=True)
        shared, shared_of = np.unique(np.concatenate([n[1] for n in names]), return_inverse=True)
        total = np.bincount(word_of, np.concatenate([p[1] for p in parts]).astype(np.float64), len(words))
        a, b = (np.bincount(shared_of, np.concatenate([p[i] for p in parts]).astype(np.float64), len(shared)) for i in (3, 4))
        tables = np.zeros(len(words))
        some = np.flatnonzero(total > 0)
        if round_ == 2 and len(some):
            r = Restaurants(total[some].astype(np.int64), np.zeros(len(some), np.int64), 1, parent_d, STRENGTH, np.random.default_rng([12, keeper]), np.array([words_all / len(some)]))
            h = np.full(len(some), (1 - UNSEEN) / words_all)
            for i in range(BURN + SAMPLES):
                r.sweep(h)
                if i >= BURN:
                    tables[some] += r.t / SAMPLES
        out, at, sat = [], 0, 0
        stats = (len(some), int((total == 1).sum()), int((total == 2).sum()), float(total.sum()), float(tables.sum()))
        for i, (x, y) in enumerate(names):
            own, his = word_of[at : at + len(x)], shared_of[sat : sat + len(y)]
            at, sat = at + len(x), sat + len(y)
            whole = total[own].astype(np.int64)
            out.append((round_, buckets[i], keeper, pack(whole, tables[own] if round_ == 2 else np.zeros(len(own), np.int64), a[his].astype(np.int64), b[his].astype(np.int64)), *(stats if i == 0 else (0, 0, 0, 0.0, 0.0))))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in _ANSWER.split(", ")])

    return run


def _first_ask(hot: np.ndarray, keepers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pitman_yor")
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                room = Room(bucket, blob.as_py(), hot)
                counts = np.bincount(room.w, room.c, len(room.words)).astype(np.int64)
                yield _asked([(i, bucket, x) for i, x in room.asks(keepers, counts, room.customers[room.split].astype(np.int64), room.kinds[room.split])])

    return run


def _told(answers: list[dict], round_: int) -> Told:
    return Told([(a["keeper"], a["blob"]) for a in answers if a["round"] == round_])


def _second_ask(hot: np.ndarray, keepers: int, totals: Totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pitman_yor")
        for b in batches:
            for bucket, blob, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                room = Room(bucket, blob.as_py(), hot)
                r = room.seated(_told(answers.as_py(), 1), totals)
                counts = np.bincount(room.w[room.learnt], r.t, len(room.words)).astype(np.int64)
                here = np.bincount(r.k, r.t, r.n).astype(np.int64)[room.split]
                yield _asked([(i, bucket, x) for i, x in room.asks(keepers, counts, here, np.zeros(len(here), np.int64))])

    return run


def predictive(room: Room, first: Told, second: Told, totals: Totals, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own part of each dish, parent's share of each context, P(w) of each word), averaged over samples."""
    r = room.seated(first, totals)
    here = np.bincount(r.k, r.t, r.n)[room.split]
    r.scale[room.split] = second.split_a / np.maximum(1, here)
    customers = room.customers.astype(np.float64)
    customers[room.split] = first.split_a
    p = totals.parent(second.counts, second.tables)
    h = np.maximum(p, 1e-300)[room.w[room.learnt]]
    own, share = np.zeros(len(room.c)), np.zeros(len(room.contexts))
    for _ in range(samples):
        r.sweep(h)
        own[room.learnt] += (room.c[room.learnt] - r.d * r.t) / (STRENGTH + customers[r.k]) / samples
        share += (STRENGTH + r.d * r.tables()) / (STRENGTH + customers) / samples
    return own, share, p


def _score(hot: np.ndarray, totals: Totals):
    """(chunk, blob): for each document of a chunk with tokens here, those that are known, and two sums of logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pitman_yor")
        for b in batches:
            for bucket, blob, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                room, answers = Room(bucket, blob.as_py(), hot), answers.as_py()
                first = _told(answers, 1)
                own, share, p = predictive(room, first, _told(answers, 2), totals)
                score = np.log10(own + share[room.k] * p[room.w])
                base = np.log10((first.counts + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))[room.w]
                known = (first.counts > 0)[room.w]
                dish = np.repeat(np.arange(len(room.c)), room.uses)
                key, of = np.unique(room.chunk.astype(np.int64) << 32 | (room.doc >> np.uint64(1)).astype(np.int64), return_inverse=True)
                sums = [np.bincount(of, x[dish], len(key)) for x in (known, base, score)]
                cut = np.searchsorted(key >> 32, np.arange(len(room.names) + 1))
                for i, name in enumerate(room.names.astype(np.int64).tolist()):
                    x = slice(cut[i], cut[i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack(steps(key[x] & 0xFFFFFFFF), sums[0][x].astype(np.int64), sums[1][x], sums[2][x])], pa.binary())], names=["chunk", "blob"])

    return run


def _merge(rows: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over all buckets."""
    kinds, blobs = rows.column("kind").to_pylist(), rows.column("blob")
    names = pa.ipc.open_stream(zstandard.decompress(blobs[kinds.index(1)].as_py())).read_all()
    sums = np.zeros((3, len(names)))
    for i, kind in enumerate(kinds):
        if kind == 0:
            doc, *values = unpack(blobs[i].as_py())
            sums[:, np.cumsum(doc).astype(np.int64)] += np.array([v.astype(np.float64) for v in values])
    return names.append_column("n_known", pa.array(sums[0].astype(np.int64))).append_column("base_score", pa.array(sums[1])).append_column("score", pa.array(sums[2]))


# Plan


def frequent(docs: DataFrame, n_bytes: int, buckets: int) -> np.ndarray:
    """Hashes of the contexts that are dealt over buckets: at most SPLIT for each bucket, estimated from a share of the texts."""
    share = min(1.0, max(SAMPLE_BYTES / max(1, n_bytes), SAMPLE_SHARE))
    some = docs if share == 1.0 else docs.sample(share, seed=5)
    words = some.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").groupBy("w").count()
    total = words.agg(F.sum("count")).first()[0] or 0
    hot = [r.w.encode() for r in words.where(F.col("count") >= max(8, total / (SPLIT * buckets))).select("w").collect()]
    return np.unique(np.concatenate([_tokens([w])[1][:1] for w in hot] + [np.array([START], np.uint64)]))


def _table(df: DataFrame, buckets: int) -> tuple[DataFrame, str, str]:
    """df as a table bucketed by `bucket` in the shared folder: (its rows, its name, its path)."""
    spark = df.sparkSession
    name = f"rooms_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(min(buckets, MAX_TABLE_BUCKETS), "bucket").saveAsTable(name)
    out = spark.table(name)
    out._written = path
    return out, name, path


def model_scores(docs: DataFrame, held_out: str = "false", chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; held_out: SQL, true for rows not to be learnt from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType
    n_bytes = text_bytes(docs, "text")
    buckets = spread(n_bytes, bucket, shuffle_partitions(spark))
    hot = frequent(docs.select("text"), n_bytes, buckets)
    sent = rows.mapInArrow(_scatter(buckets, hot, chunk), "bucket int, chunk long, kind int, blob binary")
    rooms, name, _ = _table(sent.groupBy("bucket").applyInArrow(_gather, _ROOM), buckets)
    own = rooms.where("kind = 0").select("bucket", "blob")
    tokens, once, twice = (x or 0 for x in rooms.agg(F.sum("tokens"), F.sum("once"), F.sum("twice")).first())
    asked = own.mapInArrow(_first_ask(hot, buckets), "keeper int, bucket int, blob binary")
    first = materialise(asked.groupBy("keeper").applyInArrow(_keep(1, 0, 0.5), _ANSWER), "answers")
    words, rare, double = (x or 0 for x in first.agg(F.sum("words"), F.sum("once"), F.sum("twice")).first())
    totals = Totals(tokens, words, discount(once, twice))
    told = lambda answers: own.join(answers.groupBy("bucket").agg(F.collect_list(F.struct("round", "keeper", "blob")).alias("told")), "bucket").select("bucket", "blob", "told")
    asked = materialise(told(first).mapInArrow(_second_ask(hot, buckets, totals), "keeper int, bucket int, blob binary"), "asked")
    parent_d = discount(rare, double)
    second = materialise(asked.groupBy("keeper").applyInArrow(_keep(2, words, parent_d), _ANSWER), "answers")
    customers, tables = (x or 0.0 for x in second.agg(F.sum("customers"), F.sum("tables")).first())
    totals = Totals(tokens, words, totals.d, parent_d, customers, tables)
    scored = told(first.union(second)).mapInArrow(_score(hot, totals), "chunk long, blob binary")
    both = scored.select("chunk", F.lit(0).alias("kind"), "blob").union(rooms.where("kind = 1").select("chunk", "kind", "blob"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    out = materialise(both.groupBy("chunk").applyInArrow(_merge, schema), "scores")
    discard(asked, first, second)
    spark.sql(f"drop table {name}")
    discard(rooms)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
