"""Sharding by bytes: a minimax contiguous partition of ordered groups of equal texts.

Groups of equal texts (by a 64-bit hash of the text; texts that share a hash share a group) are
atomic and stand in the order of that hash. The smallest capacity for which a greedy pass needs no
more than the wanted shards is found by binary search, and the cuts are made there. No list of all
groups reaches the driver: it holds byte totals of hash ranges, and only ranges in which a cut may
fall are split further, down to single groups where that is needed, so the answer is exact.

Edge cases: a null text counts as empty (size 1, crc32 of no bytes) and groups with empty ones; a
group larger than an even share gets a shard to itself or shares it with its neighbours; the other
shards then stay near equal; an empty table gives no rows; repeated rows each get a slot; ties in
doc_id are put in some order. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, shared_dir, shuffle_partitions

SHARDS = 16
#: Bits of the hash dropped at each level of the ranges; at 0 a range is a single group.
SHIFTS = (50, 38, 26, 14, 0)


class Ranges:
    """Byte totals of hash ranges in order, split on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.level, self.key, self.bytes, self.count = self._read(groups, 0)

    def _read(self, rows: DataFrame, level: int):
        got = (
            rows.groupBy(F.shiftright("h", SHIFTS[level]).alias("k"))
            .agg(F.sum("bytes").alias("bytes"), F.sum(F.lit(1)).alias("n"))
            .collect()
        )
        got.sort(key=lambda r: r["k"])
        col = lambda name: np.array([r[name] for r in got], dtype=np.int64)
        return np.full(len(got), level), col("k"), col("bytes"), col("n")

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.bytes)

    def last_hash(self, i: int) -> int:
        """The largest hash that range i may hold."""
        s = SHIFTS[self.level[i]]
        return (int(self.key[i]) << s) + (1 << s) - 1

    def split(self, which: set[int]) -> None:
        """Split the ranges of these positions by the next bits; one job for each level among them."""
        keep = np.ones(len(self.key), bool)
        parts = []
        for level in sorted({int(self.level[i]) for i in which}):
            mine = [i for i in which if self.level[i] == level]
            keep[mine] = False
            keys = ",".join(f"{int(self.key[i])}L" for i in mine)
            parts.append(self._read(self.groups.where(f"shiftright(h, {SHIFTS[level]}) in ({keys})"), level + 1))
        cols = [np.concatenate([c[keep], *(p[j] for p in parts)]) for j, c in enumerate((self.level, self.key, self.bytes, self.count))]
        first = np.array([int(k) << SHIFTS[lv] for lv, k in zip(cols[0], cols[1], strict=True)], dtype=np.int64)
        order = np.argsort(first, kind="stable")
        self.level, self.key, self.bytes, self.count = (c[order] for c in cols)


def _cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy: positions after which a shard ends, with whole ranges only; None where it takes more shards."""
    at, out, start = 0, [], 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, at + capacity, side="right"))
        if stop == start or len(out) == shards:
            return None
        out.append(stop)
        at, start = int(ends[stop - 1]), stop
    return out


def _optimistic(r: Ranges, ends: np.ndarray, capacity: int, shards: int) -> tuple[bool, set[int]]:
    """Whether the capacity would do if ranges of several groups could be cut anywhere; the ranges it would cut."""
    at, total, touched = 0, int(ends[-1]), set()
    for _ in range(shards):
        if total - at <= capacity:
            return True, touched
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        if r.count[i] == 1:
            begin = int(ends[i] - r.bytes[i])
            if begin <= at:
                return False, touched
            at = begin
        else:
            touched.add(i)
            at += capacity
    return False, touched


def capacity_and_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the last hash of each shard but the last (fewer where shards stay empty)."""
    r = Ranges(groups)
    if not len(r.key):
        return 0, []
    while True:
        ends = r.ends
        total = int(ends[-1])
        low, high = -(-total // shards) - 1, total  # low is infeasible, high feasible
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if _cuts(ends, mid, shards) is not None else (mid, high)
        sure = high
        low, high = -(-total // shards) - 1, sure
        while high - low > 1:  # the smallest that may be feasible
            mid = (low + high) // 2
            low, high = (low, mid) if _optimistic(r, ends, mid, shards)[0] else (mid, high)
        if high == sure:
            break
        # a cut of any capacity between the two falls between the j-th cuts of both
        touched = set()
        a, b = _walk(r, ends, high, shards, False), _walk(r, ends, sure, shards, True)
        for x, y in zip(a, b, strict=False):
            i, j = np.searchsorted(ends, [x, y], side="right")
            touched |= {k for k in range(int(i), min(int(j), len(ends) - 1) + 1) if r.count[k] > 1}
        if not touched:
            break
        r.split(touched)
    return sure, [r.last_hash(c - 1) for c in _even(r, sure, shards)]


def _walk(r: Ranges, ends: np.ndarray, capacity: int, shards: int, ahead: bool) -> list[int]:
    """Bounds of the cuts at this capacity: the lowest places (whole ranges) or, ahead, the highest (cut anywhere)."""
    at, out = 0, []
    for _ in range(shards - 1):
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        if i >= len(ends):
            out.append(int(ends[-1]))
            break
        at = at + capacity if ahead else max(at, int(ends[i] - r.bytes[i]))
        out.append(at)
    return out


def _even(r: Ranges, capacity: int, shards: int) -> list[int]:
    """Cuts of at most `capacity`: greedy; where that leaves a shard under half of the mean, even shares under the same cap."""
    ends = r.ends
    greedy = _cuts(ends, capacity, shards)
    loads = np.diff([0, *(int(ends[c - 1]) for c in greedy)])
    if len(greedy) == shards and loads.min() * 2 >= int(ends[-1]) / shards:
        return greedy[:-1]
    out: list[int] = []
    while True:
        ends = r.ends
        total, at, start, out = int(ends[-1]), 0, 0, []
        large = r.bytes * shards > total  # a group of more than an even share stands alone; the others share the rest
        need = {int(i) for i in np.flatnonzero(large & (r.count > 1))}
        alone = np.flatnonzero(large)
        for left in range(shards, 1, -1):
            if start >= len(ends):
                break
            ahead = alone[alone >= start]
            if len(ahead) and ahead[0] == start:
                stop = start + 1
            else:
                rest = total - at - int(r.bytes[ahead].sum())
                aim = at + min(capacity, max(-(-rest // max(1, left - len(ahead))), int(r.bytes[start])))
                stop = int(np.searchsorted(ends, aim, side="right"))
                if stop < len(ends) and r.count[stop] > 1:
                    need.add(stop)
                stop = max(min([stop, *ahead[:1].tolist()]), start + 1)
            most = max(stop, int(np.searchsorted(ends, at + capacity, side="right")))
            while stop < most and stop < len(ends) and _cuts(ends[stop:] - int(ends[stop - 1]), capacity, left - 1) is None:
                stop += 1
            out.append(stop)
            at, start = int(ends[stop - 1]), stop
        if not need:
            return [c for c in out if c < len(ends)]
        r.split(need)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document row."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, last = capacity_and_cuts(groups, shards)
    shard = sum((F.when(F.col("h") > F.lit(x), 1).otherwise(0) for x in last), F.lit(0))
    # checkpointed: partitions keep their order and content, so a row's place is its number
    placed = (
        rows.withColumn("shard", shard.cast("int"))
        .repartitionByRange(shuffle_partitions(spark), "h", "doc_id")
        .sortWithinPartitions("h", "doc_id")
        .checkpoint()
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
        .withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()
    done: dict[int, int] = {}
    offsets = []
    for x in sorted(counts, key=lambda x: (x["part"], x["shard"])):  # at most partitions + shards
        offsets.append((x["part"], x["shard"], done.get(x["shard"], 0) - x["low"]))
        done[x["shard"]] = done.get(x["shard"], 0) + x["n"]
    known = spark.createDataFrame(offsets or [(0, 0, 0)], "part long, shard int, off long")
    return placed.join(F.broadcast(known), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("off")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
