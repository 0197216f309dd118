"""Leakage between candidates and protected rows on five levels, and an exact token-set similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.shared import materialise


def levels(candidates: DataFrame, protected: DataFrame, keys: dict[int, str], id_: str = "id", group: str = "theorem_group_id") -> DataFrame:
    """J-06, J-09: of each candidate the levels at which a protected row has its key, and whether its group goes."""
    out = candidates
    for level, key in keys.items():
        known = protected.select(F.col(key).alias(f"__k{level}")).distinct()
        out = out.join(known, F.col(key).eqNullSafe(F.col(f"__k{level}")), "left").withColumn(f"__hit{level}", F.col(f"__k{level}").isNotNull()).drop(f"__k{level}")
    found = F.array_compact(F.array(*(F.when(F.col(f"__hit{k}"), F.lit(k)) for k in keys)))
    out = out.withColumn("levels", found).drop(*(f"__hit{k}" for k in keys))
    gone = out.where(F.size("levels") > 0).select(F.col(group).alias("__group")).distinct()  # joined, so a large group is not in one task
    return out.join(gone, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("removed", F.col("__group").isNotNull()).drop("__group")


#: Classes of a block; two blocks' sets and their pairs are compared in one group.
BLOCK = 500


def _part_keys(threshold: float):
    """Arrow batches of (class, n, hashes of a set's n members) into (key, class, own): two sets that are similar enough share a key.

    Sizes are cut into levels of the ratio 1 / threshold, so similar sets are of one level or of two
    next to each other; a set gives keys for its own level and for the next. On a level, similar sets
    differ in at most d members. Dealt by their hashes into d + 1 parts, at least one part is equal in
    both; a key is the number and the content of a part.
    """
    import numpy as np
    import pyarrow as pa

    base = -np.log(threshold * (1 - 1e-6))

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        for batch in batches:
            n, cls, lists = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(2)
            h, size = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            level = np.floor(np.log(np.maximum(n, 1)) / base).astype(np.int64)
            for up in (0, 1):
                parts = np.floor(2 * np.exp((level + up + 1) * base) * (1 - threshold) / (1 + threshold) + 1e-6).astype(np.int64) + 1
                parts = np.where((parts > 1) & (n > 0), parts, 0)  # with one part only equal sets are similar
                start = np.concatenate(([0], np.cumsum(parts)))
                of = np.repeat(np.arange(len(n)), size)
                used = parts[of] > 0
                slot = start[of[used]] + (mix(h[used]) % parts[of[used]].astype(np.uint64)).astype(np.int64)
                total = np.zeros(start[-1], np.uint64)
                np.add.at(total, slot, mix(h[used] + np.uint64(0x9E3779B97F4A7C15)))
                doc = np.repeat(np.arange(len(n)), parts)
                place = (np.arange(start[-1]) - start[doc]).astype(np.uint64)
                key = mix(total + mix(place * np.uint64(0x9E3779B97F4A7C15) + (level[doc] + up).astype(np.uint64)))
                for at in range(0, len(key), 100_000):
                    to = slice(at, at + 100_000)
                    yield pa.record_batch([pa.array(key[to].view(np.int64)), pa.array(cls[doc[to]]), pa.array(np.full(len(key[to]), up == 0))], ["key", "c", "own"])

    return run


def _compared(threshold: float):
    """Cogrouped pairs (x, y) of classes, and sets (c, k, t) of one pair of blocks, into the pairs of k that are similar enough."""
    import numpy as np
    import pyarrow as pa

    def run(pairs, sets):
        t = sets.column("t").combine_chunks()
        codes, at = t.flatten().dictionary_encode().indices.to_numpy(), np.diff(t.offsets.to_numpy())
        ends = np.cumsum(at)
        c, k = sets.column("c").to_numpy(), sets.column("k").to_pylist()
        places = {}
        for place, number in enumerate(c.tolist()):
            places.setdefault(number, []).append(place)
        mark, left, out = np.zeros(len(codes) + 1, bool), {}, []
        for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist(), strict=True):
            left.setdefault(x, []).append(y)
        for x, others in left.items():
            for one in places.get(x, ()):
                own = codes[ends[one] - at[one] : ends[one]]
                mark[own] = True
                for two in (p for y in others for p in places.get(y, ())):
                    if k[one] != k[two]:
                        both = int(np.count_nonzero(mark[codes[ends[two] - at[two] : ends[two]]]))
                        score = both / (int(at[one]) + int(at[two]) - both)
                        if score >= threshold:
                            out.append((k[one], k[two], score))
                mark[own] = False
        kx, ky, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"kx": pa.array(kx, pa.binary()), "ky": pa.array(ky, pa.binary()), "score": pa.array(score, pa.float64())})

    return run


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = 0.9) -> DataFrame:
    """J-08, R-07: pairs of (id, tokens) whose token sets have a Jaccard similarity of at least the threshold, exactly.

    Equal sets are one class, named by their hash. Classes that share a key of `_part_keys` are compared
    by their tokens; a key is of about 1 / (1 - threshold) tokens, so common words alone bring no pairs
    together. Only the sets of such classes are shuffled, each once for a pair of blocks of classes that it
    has a pair in, so a large group of near copies doesn't send a set along with each pair. Pairs of two empty sets score 1.
    """
    assert 0 < threshold <= 1
    one = left is right
    rows = left.select("id", F.sort_array(F.array_distinct("tokens")).alias("t"), F.lit(0).alias("side"))
    if not one:
        rows = rows.unionByName(right.select("id", F.sort_array(F.array_distinct("tokens")).alias("t"), F.lit(1).alias("side")))
    rows = rows.withColumn("k", F.unhex(F.sha2(F.to_json("t"), 256))).withColumn("c", F.xxhash64("k"))
    members = materialise(rows.select("id", "side", "k", "c"), "members")
    keys = rows.select("c", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n"), F.transform("t", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(_part_keys(threshold), "key long, c long, own boolean")
    met = keys.groupBy("key").agg(F.collect_set(F.when(F.col("own"), F.col("c"))).alias("own"), F.collect_set(F.when(~F.col("own"), F.col("c"))).alias("low")).where("size(own) + size(low) > 1 and size(own) > 0")
    met = met.select("own", "low", F.explode("own").alias("x")).select("x", F.explode(F.expr("concat(filter(own, y -> y > x), low)")).alias("y"))
    pairs = met.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    twins = members.select("c", "k").distinct().groupBy("c").count().where("count > 1").select(F.col("c").alias("x"), F.col("c").alias("y"))  # two sets under one number
    pairs = materialise(pairs.unionByName(twins), "pairs")
    need = materialise(pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct(), "classes")
    first = materialise(members.join(need, "c", "left_semi").groupBy("k").agg(F.min(F.struct("side", "id")).alias("f")).select("f.*"), "first")
    sets = rows.join(first, ["side", "id"], "left_semi").select("c", "k", "t")  # before the texts are cut into tokens
    cut = max(1, need.count() // BLOCK)
    block = lambda c: F.pmod(F.col(c), F.lit(cut))
    dealt = pairs.withColumns({"i": block("x"), "j": block("y")})
    to = dealt.select(F.col("i").alias("p"), F.col("j").alias("q"), F.explode(F.array("x", "y")).alias("c")).distinct()
    scored = dealt.groupBy("i", "j").cogroup(to.join(sets, "c").select("p", "q", "c", "k", "t").groupBy("p", "q")).applyInArrow(_compared(threshold), "kx binary, ky binary, score double")
    scored = materialise(scored, "scored")
    scored = scored.unionByName(scored.select(F.col("ky").alias("kx"), F.col("kx").alias("ky"), "score")).distinct()
    ones, twos = members if one else members.where("side = 0"), members if one else members.where("side = 1")
    ones, twos = ones.select(F.col("id").alias("a"), F.col("k").alias("kx")), twos.select(F.col("id").alias("b"), F.col("k").alias("ky"))
    equal = ones.join(twos, F.col("kx") == F.col("ky")).select("a", "b", F.lit(1.0).alias("score"))
    return scored.join(ones, "kx").join(twos, "ky").select("a", "b", "score").unionByName(equal)
