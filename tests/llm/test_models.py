"""Operators 11 to 13 against brute force: the language model, whitening, the divergence audit."""

import collections
import fractions
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import divergence, pitman_yor, whitening

DOCS = "doc_id long, text string, lang string, source string, n int, term string, bucket int, chunk string, score string"


def corpus(seed=3, n=160):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["", "a", "É", "ß-x", "1"])
    texts = [None, "", " \n\t ", "solo", "The THE the"] + [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    texts += ["the end of"] * 30 + [" ".join(["again and"] * 400)]
    out = [(i, t, rnd.choice(["x", "x", "y", None]), rnd.choice(["s1", "s2", "s3", None, "s1"]), 1, "t", 2, "c", "s") for i, t in enumerate(texts)]
    return [*out, (None, "a b", "x", "s1", 1, "t", 2, "c", "s"), out[9], out[9], (9000, "zzz", "only", "one", 1, "t", 2, "c", "s")]


# Language model


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute_base(data):
    counts = collections.Counter(w for r in data if not held(r[0]) for w in words_of(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in data:
        w = words_of(r[1])
        out.append((r[0], held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


HELD = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"


@pytest.mark.parametrize(("chunk", "bucket"), [(pitman_yor.CHUNK, pitman_yor.BUCKET), (700, 300)])
def test_language_model_counts_and_base(spark, chunk, bucket):
    """Many chunks and buckets, with contexts dealt over them, give the same counts as one."""
    data = corpus()
    docs = spark.createDataFrame(data, DOCS).repartition(3)
    docs = pitman_yor.materialise(docs, "docs")  # a repeatable order
    got = sorted(map(tuple, pitman_yor.model_scores(docs, HELD, chunk, bucket).collect()), key=str)
    want = sorted(brute_base(data), key=str)
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)
    assert sum(r[6] for r in got) > sum(r[5] for r in got)
    twice = [r for r in got if r[0] == 9]
    assert len(twice) == 3 and len({round(r[6], 9) for r in twice}) == 1


def test_language_model_splits_agree_nearly(spark):
    """Where rows go changes the draws, not the model: totals are close."""
    docs = pitman_yor.materialise(spark.createDataFrame(corpus(n=400), DOCS).repartition(2), "docs")
    total = [sum(r.score for r in pitman_yor.model_scores(docs, HELD, *how).collect()) for how in ((pitman_yor.CHUNK, pitman_yor.BUCKET), (900, 2000))]
    assert abs(total[0] - total[1]) < 0.01 * abs(total[0])


def test_language_model_is_a_distribution():
    """The probabilities of all words and of "unseen" after a context add up to 1, in a context with and one without customers."""
    rnd = random.Random(4)
    v = np.array([1, 1, 1, 1, 2, 2, 7], np.uint64)
    w = np.array([10, 11, 12, 13, 10, 12, 14], np.uint64)
    learnt = [90, 1, 2, 5, 3, 1, 0]
    occurrences = np.ones(7, np.int64)
    contexts, words = np.unique(v), np.unique(w)
    key = np.searchsorted(contexts, v) * len(words) + np.searchsorted(words, w)
    s, p = pitman_yor.steps, pitman_yor.pack
    blob = p(s(contexts), s(words), s(key // len(words)), key % len(words), np.array(learnt), occurrences, np.zeros(1, np.int64), np.zeros(7, np.int64), np.zeros(7, np.int64))
    room = pitman_yor.Room(0, blob, np.array([2], np.uint64))
    counts = np.bincount(room.w, room.c, len(words)).astype(np.int64)
    n, some = int(sum(learnt)), counts[counts > 0]
    told = lambda a, t, x, y: pitman_yor.Told([(0, p(a, t, x, y))])
    first = told(counts, np.zeros(5, np.int64), np.array([4]), np.array([2]))
    totals = pitman_yor.Totals(n, len(some), 0.6)
    r = room.seated(first, totals)
    customers = np.bincount(room.w[room.learnt], r.t, len(words)).astype(np.int64)
    tables = (customers > 0).astype(np.int64) * rnd.choice([1])
    totals = pitman_yor.Totals(n, len(some), 0.6, 0.5, float(customers.sum()), float(tables.sum()))
    here = int(np.bincount(r.k, r.t, r.n)[1])
    own, share, parent = pitman_yor.predictive(room, first, told(customers, tables, np.array([here]), np.array([0])), totals)
    unseen = parent[customers == 0][0]
    assert abs(parent[customers > 0].sum() + unseen - 1) < 1e-12
    for k in range(len(contexts)):
        assert abs(own[room.k == k].sum() + share[k] * (parent[customers > 0].sum() + unseen) - 1) < 1e-12


def test_table_counts_follow_their_exact_law():
    """Draws of one dish's tables, by the Stirling table and by Metropolis steps, against enumerated probabilities."""
    d, s, h, others = 0.7, 1.0, 0.05, 5
    for c, near in ((6, 0.02), (90, 0.06)):
        logs = pitman_yor.stirling_table(d, 128)[c, 1 : c + 1]
        t = np.arange(1, c + 1)
        weight = np.cumsum(np.log(s + d * (others + t - 1))) + t * math.log(h) + logs
        p = np.exp(weight - weight.max())
        p /= p.sum()
        n = 4000
        r = pitman_yor.Restaurants(np.array([c, *[1] * others] * n), np.repeat(np.arange(n), others + 1), n, d, s, np.random.default_rng(1))
        for _ in range(4):
            r.sweep(np.full(len(r.c), h))
        drawn = r.t[:: others + 1]
        assert abs(drawn.mean() - (p * t).sum()) < near * (p * t).sum() and abs(np.bincount(drawn, minlength=c + 1)[1:] / n - p).max() < 0.04


def test_stirling_numbers_near_the_saddle():
    for d in (0.1, 0.5, 0.8, 0.95):
        table = pitman_yor.stirling_table(d, 256)
        t = np.array([1, 2, 3, 5, 20, 60, 120, 200, 250, 256])
        near = pitman_yor.Stirling(np.full(len(t), 256), d)(t)
        assert np.abs(near - table[256, t]).max() < 0.25
    table = pitman_yor.stirling_table(0.8)
    assert abs(math.exp(table[3, 2]) - 3 * (1 - 0.8)) < 1e-12
    assert np.allclose(pitman_yor.log_gamma(np.array([0.5, 1.0, 7.5, 1e6])), [math.lgamma(x) for x in (0.5, 1.0, 7.5, 1e6)])


def test_language_model_without_rows_or_training(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pitman_yor.model_scores(empty, HELD).collect() == []
    alone = [next(i for i in range(50) if held(i))]
    docs = pitman_yor.materialise(spark.createDataFrame([(alone[0], "a b", "x", "s", 1, "t", 2, "c", "s")], DOCS), "docs")
    (row,) = pitman_yor.model_scores(docs, HELD).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and abs(row.base_score) < 1e-12 and abs(row.score) < 1e-12


# Whitening

VECTORS = "vec_id long, embedding array<float>, label int, i int, component string, n string"


def vectors(seed=1, n=90, d=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d))
    out = [(i, [float(np.float32(c)) for c in r], 1, 2, "c", "n") for i, r in enumerate(x)]
    bad = [None, [], [1.0] * (d + 1), [None] + [1.0] * (d - 1), [math.nan] * d, [math.inf] + [0.0] * (d - 1), [3e38] + [0.0] * (d - 1)]
    return [*out, out[3], (None, out[4][1], 1, 2, "c", "n"), *((1000 + i, b, 1, 2, "c", "n") for i, b in enumerate(bad))], n + 2


def test_whitening(spark):
    data, n = vectors()
    got = whitening.whiten(spark.createDataFrame(data, VECTORS).repartition(4), 5).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in data[:n]]
    s = [sum(c) for c in zip(*x, strict=True)]
    deviation = collections.Counter(((r[0]), sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True))) for r, v in zip(data[:n], x, strict=True))
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == deviation
    exact = np.array([[float(fractions.Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in x), n**3)) for j in range(7)] for i in range(7)])
    e, w = np.linalg.eigh(exact)
    z = (np.array(x) - np.array(s) / n) @ w[:, ::-1][:, :5] / np.sqrt(e[::-1][:5])
    assert len(got) == 5 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    for k in range(5):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        theirs = {r[0]: z[i, k] for i, r in enumerate(data[:n])}
        sign = 1 if mine[0] * theirs[0] > 0 else -1
        assert all(abs(mine[i] - sign * theirs[i]) < 1e-8 for i in theirs)
        assert all(abs(r.explained - e[::-1][k] / e.sum()) < 1e-12 for r in got if r.component == k + 1)


def test_whitening_of_huge_entries_and_of_few(spark):
    """Entries near 2^62 go through integers of any size; equal vectors and empty tables give no rows."""
    rows = [(i, [float(np.float32(1.4e17 * (i % 3 - 1))), float(i)], 1, 2, "c", "n") for i in range(6)]
    n, s, m = whitening.scatter(whitening.usable(spark.createDataFrame(rows, VECTORS)))
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    assert n == 6 and s == [sum(c) for c in zip(*x, strict=True)]
    assert m.tolist() == [[n * sum(a[i] * a[j] for a in x) - s[i] * s[j] for j in range(2)] for i in range(2)]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 2, "c", "n")] * 3, VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


# Divergence


def brute_audit(data, min_docs, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    groups, held_by, count = set(), collections.Counter(), collections.defaultdict(collections.Counter)
    for _, t, lang, source, *_ in data:
        g = (lang or "", source or "")
        groups.add(g)
        words = term(t)
        held_by.update((g[0], w) for w in set(words))
        count[g].update(words)
    out = set()
    for lang, source in groups:
        kept = [w for (k, w), c in held_by.items() if k == lang and c >= min_docs]

        def p(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        every = sum((count[g] for g in groups if g[0] == lang), collections.Counter())
        own, q = p(count[lang, source]), p(every)
        pairs = [(sum(abs(own[w] - x[w]) for w in kept), o) for g, o in groups if g == lang and o != source for x in [p(count[lang, o])]]
        terms = [(own[w] - q[w], w) for w in kept if count[lang, source][w] and own[w] > q[w]]
        for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for i, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]):
                out.add((lang, source, part, item, value, i + 1))
    return out


def test_divergence(spark):
    data = corpus(n=300)
    docs = spark.createDataFrame(data, DOCS).repartition(4)
    for min_docs, top in itertools.product((4, 1000), (3, 50)):
        got = [tuple(r) for r in divergence.audit(docs, min_docs, top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_audit(data, min_docs, top)
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_with_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SENT", -1)
    data = corpus(n=120)
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(data, DOCS), 3).collect()}
    assert got == brute_audit(data, 3, 50)
