"""Operators over documents against brute force: repeats, near copies, leaks, tokens, shards, toxicity."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, jaccard, shard, substring, toxicity
from corpusmill.llm.common import components

SCHEMA = "doc_id long, text string, bucket int, hash string, n string, lo string, spans string, n_chars long"


def rows(seed=1):
    """Copies, near copies, shared passages, short, empty, null, very long and repeated rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    out = [None, "", " \t\n", "a", "b c", "B C", text(4), text(5)]
    for n in (8, 12, 15, 20, 30, 60, 100, 150):
        base = text(n).split()
        out.append(" ".join(base))
        for edits in (0, 1, 2, n // 10, n // 5):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(n)] = word()
            out.append(" ".join(w))
        out.append(" ".join(base[:-1]) + " " + base[-1])
    out += [text(30) + " " + passage + "\n" + text(20) for _ in range(6)]
    out += [" ".join(["same"] * 50), text(4000), text(40) + " " + text(4000)]
    out += [text(25)] * 12
    return [(i, t, 1, "h", "n", "l", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows()
    random.Random(5).shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def brute_repeats(data, k):
    seen, out = set(), {}
    for i, t in sorted(data.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone[a : a + k] = [True] * k
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"chunk": 300, "bucket": 500}, {"chunk": 5000, "bucket": 100}])
def test_repeats(docs, how):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, **how).collect()}
    assert got == brute_repeats(texts(docs), 20)


def test_repeats_edges(spark, docs, empty):
    assert substring.dedup(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    twice = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.dedup(twice).collect())
    assert got == [("1", 30), ("1", 30), ("2", 30), ("None", 0)]
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = brute_repeats(texts(docs), 20)
    for r in out.collect():
        n, gone, sha = want[r.doc_id]
        if gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)
        else:
            assert r.text == texts(docs)[r.doc_id]


def test_heavy_buckets_are_split(spark, monkeypatch):
    """Three frequent words in every window: their bucket would hold nearly all, and is dealt out by longer pieces."""
    rnd = random.Random(4)
    texts_ = [" ".join(w for _ in range(rnd.randint(8, 60)) for w in ("the", "of", "and", *(f"w{rnd.randrange(40)}" for _ in range(4)))) for _ in range(60)]
    texts_ += [texts_[3] + " tail", "head " + texts_[7]]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    mark = substring._same_id(docs)
    split = substring._heavy(substring._key(docs, mark), 16, 500, 20, 3, 4000)
    assert len(split[0]) and (split[1] > 1).all()
    monkeypatch.setattr(substring, "HEAVY", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, chunk=4000, bucket=300).collect()}
    assert got == brute_repeats(dict(enumerate(texts_)), 20)


CLASHING = ("__doc", "__hash", "__spans", "__key", "__hit", "__row", "__score", "doc", "mark", "key", "cuts", "score", "Hash")


def test_columns_of_any_name_stay(spark, docs):
    own = docs.where("doc_id < 30 or doc_id > 80").select("doc_id", "text", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in CLASHING))
    items = spark.createDataFrame([(1, "same same same same same same same same same same")], ITEM)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for out in (substring.remove_repeats(own), jaccard.keep_one(own), decontaminate.drop_contaminated(own, items), toxicity.drop_toxic(own, labels, steps=2)):
        assert out.columns == own.columns
        assert all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in CLASHING)


def test_names_of_sets_that_collide_are_renamed(spark, docs):
    """By its check, and to the same name where rows are described and where signatures are made."""
    a, b = jaccard.shingle_sets([b"a b c d e f", b"u v w x y z"], 5)
    (name, check), (_, other) = jaccard.set_id(a), jaccard.set_id(b)
    assert jaccard.set_id(a, frozenset([name])) == (jaccard._renamed(name, check), check)
    assert jaccard._renamed(name, check) not in (name, jaccard._renamed(name, other))
    sets, renamed = jaccard._described(docs, 5)
    assert not renamed and "check" not in sets.columns
    rows = spark.createDataFrame([(name, check), (name, other), (3, 4), (None, None)], "sid long, check long")
    got = [r.sid for r in jaccard._rename(rows, frozenset([name])).orderBy("check").collect()]
    assert sorted(got, key=str) == sorted([jaccard._renamed(name, check), jaccard._renamed(name, other), 3, None], key=str)


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies_in_one_large_group(spark, block):
    """Hundreds of near copies, not all of which link with each other."""
    rnd = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    data = {}
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        data[i] = " ".join(w)
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, small=3, block=block).collect()}
    assert got == brute_components(data, 80)


def test_windows_under_one_hash_are_told_apart():
    import numpy as np

    text = b"1 2 3 1 2 4 1 2 3 "
    starts = substring.word_starts(np.frombuffer(text, np.uint8))
    got = substring.repeats(text, starts, np.zeros(7, np.uint64), np.array([0, 3, 6]), np.array([0, 1, 2]), np.zeros(3, np.int64), 3)
    assert got.tolist() == [False, False, True]


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(data, percent):
    ids = sorted(data)
    sets = {i: shingles(data[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("percent", "how"), [(80, {}), (80, {"small": 2, "chunk": 400, "bucket": 2000}), (60, {"small": 2})])
def test_near_copies(docs, percent, how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, percent=percent, **how).collect()}
    assert got == brute_components(texts(docs), percent)


def test_near_copies_edges(spark, docs, empty):
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute_components(texts(docs), 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    twice = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "x y"), (7, "A b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(twice).collect()) == ["3", "None"]


def test_plans_cover_every_linked_pair():
    """For random linked pairs of every size some signature is shared: the pigeonhole holds."""
    import numpy as np

    rnd = np.random.default_rng(3)
    bands = jaccard.Bands(80)
    for n in list(range(1, 60)) + [75, 100, 181, 300, 577, 1200]:
        for _ in range(4):
            a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rnd.integers(0, max(1, n // 9 + 1)))
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**63, int(rnd.integers(0, n // 9 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            sig, owner = jaccard.signatures([a, b], bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (n, drop)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, i) for i in range(201, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != 5 or True if x in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


ITEM = "item_id long, text string"


def brute_leaks(data, items, n):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[a : a + n])].add(i)
    out = {}
    for d, t in data.items():
        w, hit, found = cut(t), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if (key := tuple(w[a : a + size])) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[key]
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("bound", [2_000_000, 5])
def test_leaks(spark, docs, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW", 0 if bound == 5 else 20_000)
    data = texts(docs)
    long = [t for t in data.values() if t and len(t.split()) > 40]
    items = [(1, " ".join(long[0].split()[3:18])), (2, "B-C"), (10, long[1].upper()), (3, None), (4, "?!"), (5, long[2].replace(" ", ", ")), (5, "É ßa"), (6, " ".join(long[3].split()[:9]))]
    got = {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, ITEM), most=bound).collect()
    }
    assert got == brute_leaks(data, items, 10)


@pytest.mark.parametrize("bound", [2_000_000, 5])
def test_leaks_with_capital_sigma(spark, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW", 0 if bound == 5 else 20_000)
    """lower() of a whole text and of its words alone differ in a final sigma, which must not hide a passage."""
    passage = "Η ΕΤΑΙΡΕΙΑ Δ.Σ. της ΟΔΟΣ: των Σ' και ΛΟΓΟΣ. Kelvin \u212a İ ẞ end"
    data = {1: f"before {passage} after", 2: passage.lower(), 3: passage.replace("Kelvin", "kELVIN"), 4: "nothing", 5: None}
    items = [(1, passage), (2, "Δ.Σ. της")]
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, ITEM), most=bound).collect()
    }
    assert got == brute_leaks(data, items, 10) and got[1][2] == 2


def test_leaks_edges(spark, docs, empty):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.decontaminate(empty, none).count() == 0
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    items = spark.createDataFrame([(1, "same same same same same same same same same same")], ITEM)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    out = bpe.decode(bpe.encode(docs))
    assert bpe.encode(empty).count() == 0
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path())
    rnd = random.Random(1)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCXYZ'’.,!<|>_-0123 \n\t\x1c\xa0éÉßİıΣσςäöüñøÿ中文字🙂👍🏽é​ﬁ٣ⅷ×÷", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "ing", "ation"]
    sample = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "=" * 500]
    for t, (_, data, decoded) in zip(sample, own.encode_texts(sample), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)] == ids
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(data)


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                n, load = n + 1, 0
            load += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 4000])
def test_shards(spark, hot):
    from pyspark.sql import functions as F

    rnd = random.Random(hot)
    data = [(i, "t%d" % rnd.randrange(500) * rnd.randint(1, 40)) for i in range(1500)] + [(5000 + i, "hot" * 20) for i in range(hot)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = shard.assign(docs).collect()
    known = {d: t or "" for d, t in data}
    assert len(out) == len(data) and {r.law for r in out} == {"bytes"}
    assert all(r["size"] == len(known[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(known[r.doc_id].encode()) and r.grown_shard is None for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert len({(r.shard, known[r.doc_id]) for r in out}) == len(set(known.values()))
    groups = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).groupBy("h").agg(F.sum("s").alias("s")).orderBy("h").collect()
    best = brute_capacity([g.s for g in groups], 16)
    loads = [sum(r["size"] for r in v) for v in by.values()]
    assert max(loads) == best if not hot else max(loads) <= best
    rest = sorted(loads)[:-1] if hot else loads
    assert len(loads) == 16 and min(rest) * 2 >= sum(rest) / len(rest)


def test_shards_of_nothing(empty):
    assert shard.assign(empty).count() == 0


def test_toxicity(spark):
    rnd = random.Random(4)
    plain = ["the", "of", "and", "with", "river", "stone", "window", "paper", "garden", "music"]
    bad = ["moronical", "idiotish", "worthlessly", "scumbagger"]
    data, labels = [], []
    for i in range(1200):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", "s", "x"])
        data.append((i, " ".join(w), 1.0))
        labels.append((i, int(toxic)))
    data += [(5000, None, 1.0), (5001, "", 1.0), (5002, "a nice garden, moronicaly " * 3, 1.0)]
    docs, known = spark.createDataFrame(data, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (0, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.predict(docs, known, steps=60).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == len(data)
    assert got[5002].predicted == 1 and got[5000].score == got[5001].score
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert toxicity.drop_toxic(docs, known.where("false")).columns == docs.columns
    assert toxicity.predict(docs.where("false"), known.where("false")).count() == 0


def test_nulls_repeats_and_very_long_texts(spark):
    """A null doc_id, rows that stand twice and a text of half a million characters: one defined row each."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    data = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (None, None), (3, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    shards = shard.assign(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in shards) == sorted((str(i), len((t or "").encode()) + 1) for i, t in data)
    scores = toxicity.predict(docs, labels, steps=3).collect()
    assert sorted(str(r.doc_id) for r in scores) == sorted(str(i) for i, _ in data) and all(not r.held_out for r in scores if r.doc_id is None)
    items = spark.createDataFrame([(1, " ".join(long.split()[20_000:20_012])), (None, "a b")], ITEM)
    leaks = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect())
    assert leaks == sorted([("None", 2, 2, 0, True), ("1", 2, 2, 0, True), ("1", 2, 2, 0, True), ("2", 0, 0, 0, False), ("None", 0, 0, 0, False), ("3", 60_000, 12 * 12, 1, True)])
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()}[3] == 55_000
    assert {r.doc_id: r.n_shingles for r in jaccard.join(docs).collect()}[3] == 5000
