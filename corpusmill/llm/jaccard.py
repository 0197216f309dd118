"""N-gram Jaccard self-join by a partition of the token universe and the pigeonhole principle.

Sets of shingles are put into size bands so wide that a partner is in the same band or in the next
one. For each band, shingles are hashed into segments. Sets a and b that link differ in at most
H = (|a| + |b|)(1 - s)/(1 + s) shingles, so few segments differ, and one of two plans finds them:

* exact segments: with m > H segments, at least m - H are equal. Segments are ordered by how many
  shingles they hold (weak ones, which many sets share, last), and the first H + 1 are indexed: two
  sets that share m - H segments share one of those.
* one-deletion neighbourhoods: with 2 m > H, some segment differs by one shingle at most; each
  segment is indexed whole and once without each of its shingles.

The plan and m are those of least cost for the band: signatures written, and a price for each that is
expected to stand on one shingle or none. Sets with equal shingles are one (hot groups of copies
cost one set for each chunk of input). Sets that share a signature are candidates: all pairs of small
groups, a star for larger ones. Parity bits of bins of the universe rule out pairs that differ in too
many of them (two sets differ in no more bins than shingles); the rest is verified on the texts. Members of
a larger group that are still in different components after that are tested with each other by the
same bits, in blocks, so no link between components is lost, no group is paired within a component,
and no large group is in one task.

Edge cases: fewer words than a shingle make one shingle of the whole sequence; null and empty texts
have no shingles and link with nothing; copies share a component; a null doc_id never names a
component with others in it; an empty table gives no rows. Other columns are carried along by
`keep_one`, which also drops all but one of rows equal in doc_id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import components, discard, free, materialise, of_stars, shuffle_partitions, spread, stars, text_bytes, turn_to
from corpusmill.llm.substring import _mix, rolling, squeeze, word_hashes, word_starts

SHINGLE, PERCENT = 5, 80
BITS = 1024
CHUNK, BUCKET = 12 << 20, 12 << 20
#: Up to this many sets that share a signature are paired at once; so many members of a larger group are tested together.
SMALL, BLOCK = 8, 1024
#: Smallest groups of a set that go with it, so that two sets which share several groups are a pair in the first of them only.
LOWEST = 16
#: Rows of names (of 24 bytes) that are sent to every task; beyond it the texts go to the names.
SENT = 1_000_000
#: Bits of a signature that are kept.
KEPT = 56
_ONE = np.uint64(0x2545F4914F6CDD1D)


class Bands:
    """Size bands, and for each band the plan of the pairs whose smaller set is in it."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]
        self.plans: list[tuple[bool, int]] = []

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
            self.plans.append(self._plan(self.lows[-2], self.lows[-1] - 1))

    def difference(self, total: int) -> int:
        """Largest difference of two linked sets with so many shingles together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def _plan(self, low: int, high: int) -> tuple[bool, int]:
        """(exact, segments) of least cost for sets from low to high."""
        h = self.difference(high + 100 * high // self.percent)
        tries = [(True, m) for m in sorted({h + 1, *(h + 1 + h * x // 10 for x in range(1, 11))})] + [(False, -(-(h + 1) // 2))]
        return min(tries, key=lambda t: max(self._cost(n, self.difference(n + 100 * n // self.percent), *t) for n in (low, high)))

    @staticmethod
    def _cost(n: int, h: int, exact: bool, m: int) -> float:
        """Signatures of a set of n shingles, and a price for those that are expected to stand on few shingles."""
        of = lambda k: m * math.comb(n, k) * (1 / m) ** k * (1 - 1 / m) ** (n - k) if m > 1 else float(n == k)
        none, one = of(0), of(1) if n > 1 else 0.0
        if exact:  # the weakest m - h - 1 segments aren't indexed
            left = m - h - 1
            return h + 1 + 200 * max(0.0, none + 2 * math.sqrt(none) - left) + 4 * max(0.0, none + one - left)
        return n + m + 200 * (none + one) + 4 * (of(2) if n > 2 else 0.0)

    def of(self, size: int) -> list[tuple[int, bool, int, int]]:
        """(band, exact, segments, differences) of each band in whose pairs a set of this size takes part."""
        self._grow(size)
        i = next(k for k in range(len(self.lows) - 1) if self.lows[k] <= size < self.lows[k + 1])
        out = [(i, *self.plans[i], self.difference(size + 100 * size // self.percent))]
        if i:
            smaller = self.lows[i] - 1
            if 100 * smaller >= self.percent * size:
                out.append((i - 1, *self.plans[i - 1], self.difference(size + smaller)))
        return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    out: list[np.ndarray] = []
    for part in _groups_of(texts, 1 << 20):
        words = [squeeze(t.lower()) for t in part]
        counts = [int((w == 32).sum()) if len(w) > 1 else 0 for w in words]
        buf = np.concatenate([w for w, c in zip(words, counts, strict=True) if c] or [np.zeros(0, np.uint8)])
        h = word_hashes(buf, word_starts(buf))
        rolled, at = rolling(h, n) if len(h) >= n else h[:0], 0
        for c in counts:
            if c >= n:
                out.append(np.unique(rolled[at : at + c - n + 1]))
            elif c:
                out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + c].tobytes(), seed=n)], np.uint64))
            else:
                out.append(h[:0])
            at += c
    return out


def parity_bits(hashes: np.ndarray) -> list[int]:
    """For each of BITS bins of the universe whether it holds an odd number of the set's shingles, in 64-bit words.

    Bins in which two sets differ are at most as many as the shingles in which they differ.
    """
    odd = (np.bincount((hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def set_id(hashes: np.ndarray, renamed: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(name, check): 64 bits each of one 128-bit hash of the set. A renamed name stands for several sets, which are told apart by the check."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    name, check = both & (1 << 64) - 1, both >> 64
    signed, check = (x - (1 << 64) * (x >> 63) for x in (name, check))
    return _renamed(signed, check) if signed in renamed else signed, check


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, position of the set) of all sets, by their plans."""
    jobs = [(i, *job) for i, s in enumerate(sets) for job in bands.of(len(s))]
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sigs, owners = [], []
    for kind in (True, False):
        own = [j for j in jobs if j[2] is kind]
        for at in range(0, len(own), 2000):
            part = own[at : at + 2000]
            which = np.array([j[0] for j in part])
            band, m, h = (np.array([j[k] for j in part], np.int64) for k in (1, 3, 4))
            n = np.array([len(sets[i]) for i in which])
            tokens = np.concatenate([sets[i] for i in which])
            job_of = np.repeat(np.arange(len(part)), n)
            base = np.cumsum(m) - m
            salted = _mix(tokens, (band[job_of] + 1).astype(np.uint64))
            seg = base[job_of] + (salted % m[job_of].astype(np.uint64)).astype(np.int64)
            value = _mix(salted, np.full(len(salted), _ONE))
            total, count = np.zeros(int(m.sum()), np.uint64), np.bincount(seg, minlength=int(m.sum()))
            np.add.at(total, seg, value)
            seg_job = np.repeat(np.arange(len(part)), m)
            name = _mix((np.arange(len(total)) - base[seg_job]).astype(np.uint64), (band[seg_job] + 1).astype(np.uint64))
            sig = _mix(total, name)
            if kind:
                key = (seg_job.astype(np.uint64) << np.uint64(48)) | ((255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(40)) | (sig >> np.uint64(24))
                order = np.argsort(key, kind="stable")
                rank = np.arange(len(order)) - base[seg_job]
                chosen = order[rank <= h[seg_job]]
                sigs.append(sig[chosen])
                owners.append(which[seg_job[chosen]])
            else:
                sigs += [sig, _mix(total[seg] - value, name[seg])]
                owners += [which[seg_job], which[job_of]]
    return np.concatenate(sigs), np.concatenate(owners)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, all first bytes first."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def _whole(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view(np.uint64).reshape(n)


def _pack(sid: np.ndarray, n: np.ndarray, sig: np.ndarray, owner: np.ndarray) -> bytes:
    """Sets and their signatures: sorted, as differences, in planes of bytes."""
    order = np.argsort(sig)
    used, index = np.unique(owner[order], return_inverse=True)
    kept = sig[order] >> np.uint64(64 - KEPT)
    wide = 2 if len(used) < 1 << 16 else 4
    head = np.array([len(used), len(sig), wide], np.int64)
    parts = [head.tobytes(), sid[used].tobytes(), _planes(n[used].astype(np.uint64), 4), _planes(np.diff(kept, prepend=np.uint64(0)), KEPT // 8), _planes(index.astype(np.uint64), wide)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    d, s, wide = (int(x) for x in np.frombuffer(data, np.int64, 3))
    sid = np.frombuffer(data, np.int64, d, 24)
    at = 24 + 8 * d
    n = _whole(data, d, 4, at).astype(np.int64)
    sig = np.cumsum(_whole(data, s, KEPT // 8, at + 4 * d), dtype=np.uint64)
    index = _whole(data, s, wide, at + 4 * d + KEPT // 8 * s).astype(np.int64)
    return sig, sid[index], n[index]


def _groups_of(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        for b in batches:
            names, sizes, bits = [], [], []
            for texts in _groups_of(b.column(2).to_pylist(), 4 << 20):
                for s in shingle_sets(texts, n):
                    sizes.append(len(s))
                    names.append(set_id(s) if len(s) else (None, None))
                    bits.append(parity_bits(s) if len(s) else None)
            sids, checks = (pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), sids, checks, pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "hash", "n", "sid", "check", "bits"])

    return run


def _scatter(n: int, renamed: frozenset[int], percent: int, buckets: int, chunk: int):
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        bands = Bands(percent)
        held: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, owner = signatures(held, bands)
            sid, sizes = np.array(names, np.int64), np.array([len(s) for s in held])
            goes = (sig >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(goes, kind="stable")
            cut = np.flatnonzero(np.diff(goes[order])) + 1
            for mine in np.split(order, cut):
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array([int(goes[mine[0]])], pa.int32()), pa.array([_pack(sid, sizes, sig[mine], owner[mine])])], schema=schema)

        for b in batches:
            for texts in _groups_of(b.column(0).to_pylist(), 4 << 20):
                for s in shingle_sets(texts, n):
                    if not len(s) or (name := set_id(s, renamed)[0]) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    held.append(s)
                    names.append(name)
                    size += 6 * len(s)
                    if size >= chunk:
                        yield from flush()
                        held.clear(), names.clear()
                        size = 0
        if held:
            yield from flush()

    return run


_FOUND = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _gather(percent: int, small: int):
    def run(rows: pa.Table) -> pa.Table:
        sig, sid, n = (np.concatenate(x) for x in zip(*(_unpack(b) for b in rows.column("blob").to_pylist()), strict=True))
        order = np.lexsort((sid, sig))
        sig, sid, n = sig[order], sid[order], n[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid, n = sig[keep], sid[keep], n[keep]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(begin, len(sig)))
        pairs = []
        for s in range(2, small + 1):
            at = begin[size == s]
            pairs += [(at + i, at + j) for i in range(s) for j in range(i + 1, s)]
        large = np.flatnonzero(size > small)
        member = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in large]) if len(large) else np.zeros(0, np.int64)
        hub = np.repeat(begin[large], size[large])
        pairs.append((hub[hub != member], member[hub != member]))
        x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
        fits = percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])
        two = np.unique(np.stack([sid[x[fits]], sid[y[fits]]], 1), axis=0)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(two), np.int64), sig[member].astype(np.int64)]), mask=np.arange(len(two) + len(member)) < len(two)),
                pa.array(np.concatenate([two[:, 0], sid[member]])),
                pa.array(np.concatenate([two[:, 1], np.zeros(len(member), np.int64)]), mask=np.arange(len(two) + len(member)) >= len(two)),
            ],
            schema=_FOUND,
        )

    return run


def word_shingles(text: bytes, n: int) -> frozenset:
    """The set of shingles, as tuples of words."""
    w = text.lower().split()
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose texts link: shingle sets are built from the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(word_shingles)
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = known(x, n), known(y, n)
                both = len(p & q)
                if 100 * both >= percent * (len(p) + len(q) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    left = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("x")), "a")
    return left.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def may_link(percent: int, x: str, y: str, nx: str, ny: str) -> str:
    """SQL: two sets, by their sizes and parity bits, may link; it never rules out a pair that does."""
    apart = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITS // 64))
    return f"{percent} * greatest({nx}, {ny}) <= 100 * least({nx}, {ny}) and ({apart}) * {100 + percent} <= ({nx} + {ny}) * {100 - percent}"


def _described(docs: DataFrame, n: int) -> tuple[DataFrame, frozenset[int]]:
    """((doc_id, hash, n, sid, bits) of every row; renamed names): sid names the set of shingles, null if there is none; bits: see parity_bits.

    Names of 64 bits that stand for two sets (about n^2 / 2^65 of n sets) are found by their checks and renamed.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = materialise(rows.mapInArrow(_describe(n), f"doc_id {kind}, hash long, n long, sid long, check long, bits array<long>"), "sets")
    twice = out.where("sid is not null").groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
    renamed = frozenset(r.sid for r in twice.select("sid").toLocalIterator())
    return _rename(out, renamed).drop("check"), renamed


def _rename(sets: DataFrame, renamed: frozenset[int]) -> DataFrame:
    if not renamed:
        return sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("sid")
            new = [s if s not in renamed else _renamed(s, c) for s, c in zip(b.column("sid").to_pylist(), b.column("check").to_pylist(), strict=True)]
            yield b.set_column(i, "sid", pa.array(new, pa.int64()))

    return materialise(sets.mapInArrow(run, sets.schema), "sets")


def _renamed(name: int, check: int) -> int:
    out = xxhash.xxh3_64_intdigest((check & (1 << 64) - 1).to_bytes(8, "little"), seed=name & (1 << 64) - 1)
    return out - (1 << 64) * (out >> 63)


def _apart(percent: int, p: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of different components that may link: between left and right, or within left."""
    step = max(1, (1 << 17) // max(1, len(left) if right is None else len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        j = left[at:] if right is None else right
        x, y = i[:, None], j[None, :]
        ok = (p[x] != p[y]) & (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y]))
        if right is None:
            ok &= np.arange(len(j))[None, :] > np.arange(len(i))[:, None]
        u, v = np.nonzero(ok)
        u, v = i[u], j[v]
        odd = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
        fits = odd * (100 + percent) <= (n[u] + n[v]) * (100 - percent)
        yield u[fits], v[fits]


def _met_before(u: np.ndarray, v: np.ndarray, low: np.ndarray, g: int) -> np.ndarray:
    """Whether two sets share a group below g, as far as their lowest groups tell; never so in the lowest group that they share."""
    out = np.zeros(len(u), bool)
    for at in range(0, len(u), 1 << 15):
        x, y = low[u[at : at + (1 << 15)]], low[v[at : at + (1 << 15)]]
        out[at : at + (1 << 15)] = ((x[:, :, None] == y[:, None, :]) & (x < g)[:, :, None]).any((1, 2))
    return out


def _close(percent: int):
    """(a, b): pairs of a group's members, in different components, that parity bits do not rule out and that no lower group has."""

    def run(rows: pa.Table) -> pa.Table:
        col = lambda c: rows.column(c).to_numpy()
        order = np.lexsort((col("sid"), col("y"), col("x"), col("g")))
        g, x, y, own, sid, p, n = (col(c)[order] for c in ("g", "x", "y", "own", "sid", "p", "n"))
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(order), -1)[order]
        lists = rows.column("low").combine_chunks()
        low = np.full((len(order), LOWEST), np.iinfo(np.int64).max)
        sizes = np.diff(lists.offsets.to_numpy())
        low[np.repeat(np.arange(len(order)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        low = low[order]
        begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        found = []
        for a, b in zip(begin, np.append(begin[1:], len(g)), strict=True):
            at = np.arange(a, b)
            if x[a] == y[a]:
                got = _apart(percent, p, n, bits, at, None)
            else:
                got = _apart(percent, p, n, bits, at[own[a:b] == x[a]], at[own[a:b] == y[a]])
            for u, v in got:
                new = ~_met_before(u, v, low, g[a])
                found.append(np.stack([np.minimum(sid[u[new]], sid[v[new]]), np.maximum(sid[u[new]], sid[v[new]])], 1))
        two = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(two[:, 0]), "b": pa.array(two[:, 1])})

    return run


def _between(part: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): what members of groups (g, sid, p, n, bits) may link with members of other components p; large groups in pairs of blocks.

    Sets of one cluster share many groups; a pair leaves the lowest of those only (and seldom another), whatever their number.
    """
    lowest = part.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list("g")), 1, LOWEST).alias("low"))
    part = part.join(lowest, "sid")
    sizes = part.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    buckets = spread(192 * part.count(), 4 << 20, shuffle_partitions(part.sparkSession))
    cut = part.join(sizes, "g").withColumn("own", F.expr("cast(pmod(xxhash64(sid), k) as int)"))
    cut = cut.selectExpr("*", "explode(sequence(0, k - 1)) as other").selectExpr("g", "least(own, other) as x", "greatest(own, other) as y", "own", "sid", "p", "n", "bits", "low")
    cut = cut.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(g, x, y), {buckets}) as int)"))
    return cut.groupBy("bucket").applyInArrow(_close(percent), "a long, b long").distinct()


def _texts(docs: DataFrame, known: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(sid, text) of one row for each wanted sid; known: (sid, d, h) names a row of each set."""
    rows = materialise(known.select("sid", "d", "h").join(wanted, "sid", "left_semi"), "representatives")
    one = F.broadcast(rows) if rows.count() <= SENT else rows
    key = docs.select("doc_id", "text").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = key.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("sid", F.col("text").cast("binary").alias("text"))
    texts = materialise(texts.dropDuplicates(["sid"]) if repeated else texts, "texts")
    discard(rows)
    return texts


def linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, chunk: int = CHUNK, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): (doc_id, hash, n, sid) of every row, and edges (a, b) between sids that connect all that verified links connect, and no more."""
    spark = docs.sparkSession
    sets, renamed = _described(docs, n)
    buckets = spread(text_bytes(docs, "text"), bucket, shuffle_partitions(spark))
    packed = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_scatter(n, renamed, percent, buckets, chunk), "bucket int, blob binary")
    found = materialise(packed.groupBy("bucket").applyInArrow(_gather(percent, small), "g long, a long, b long"), "candidates")
    pairs = found.where("g is null").select("a", "b").distinct()
    known = sets.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "hash")).alias("s"))
    known = materialise(known.selectExpr("sid", "n", "bits", "s.doc_id as d", "s.hash as h"), "names")
    side = lambda k: known.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))
    first = materialise(pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(percent, "xa", "xb", "na", "nb")).select("a", "b"), "pairs")
    wide = found.where("g is not null").select("g", F.col("a").alias("sid")).distinct()
    wanted = first.select(F.col("a").alias("sid")).union(first.select(F.col("b").alias("sid"))).union(wide.select("sid"))
    texts = _texts(docs, known, wanted, _repeated(sets))
    edges = materialise(verify(first, texts, n, percent), "links")
    if not wide.isEmpty():
        links, edges = edges, stars(edges)
        discard(links)
        part = wide.join(of_stars(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("p", F.coalesce("component", "sid")).select("g", "sid", "p")
        part = materialise(part, "groups")
        mixed = part.groupBy("g").agg(F.min("p").alias("x"), F.max("p").alias("y")).where("x <> y").select("g")
        left = materialise(part.join(mixed, "g", "left_semi").join(known.select("sid", "n", "bits"), "sid"), "mixed")
        more = materialise(_between(left, percent, block).join(first, ["a", "b"], "left_anti"), "pairs")
        discard(part, left)
        edges = edges.union(materialise(verify(more, texts, n, percent), "links"))
        discard(more)
    discard(found, known, first, texts)
    return sets.drop("bits"), edges


def _repeated(sets: DataFrame) -> bool:
    return not sets.groupBy("doc_id", "hash").count().where("count > 1").isEmpty()


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, hash, n_shingles, component_id for every document row."""
    sets, edges = linked(docs, **how)
    of = components(edges).withColumnRenamed("node", "sid")
    lowest = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low")).join(of, "sid", "left")
    lowest = lowest.withColumn("component", F.coalesce("component", "sid"))
    least = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    named = lowest.join(least, "component").select("sid", "component_id")
    return sets.join(named, "sid", "left").select(
        "doc_id", "hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents, with the columns they came with, of the smallest doc_id of each component; all without shingles stay."""
    found = materialise(join(docs, **how), "components")
    doc, th, key = free(docs, "doc", "hash", "key")
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias(doc), F.col("hash").alias(th)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    if _repeated(found):
        keyed = keyed.dropDuplicates(["doc_id", key])
    return keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left_semi").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.i >= 80 * (x.n + y.n - o.i)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
