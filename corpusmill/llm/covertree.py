"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label (and one length) are laid into blocks around centres; blocks whose covering
radii keep them further apart than the threshold allows never meet. Each pair of blocks that may
meet goes to a task, which builds a cover tree over each: nested levels, each with half the radius of the
one before it and with all of its centres. Both trees are walked level by level: a pair of nodes is
dropped when the distance of its centres less both covering radii exceeds the threshold, counted whole
when that distance plus both radii is below it, and passed to the next level otherwise; what is left
at the finest level is compared vector by vector in double precision. Tasks return the number of links
of each vector and a spanning forest of the links, so a cluster of thousands of near-identical vectors
makes thousands of rows and not millions.

Centres of blocks are chosen from a sample of at most about `sample` vectors of the whole table; they only
decide which vectors stand together, every vector is compared with all that it may link with. A
block holds about `block` vectors; larger ones (a label with a third of all rows) are split by hash.

Edge cases: a null label, or a vector that is null, empty, zero or has a null or non-finite entry,
links with nothing and is its own component; so do vectors of different lengths; repeated rows are
vectors of their own and link; a null vec_id names no component with others in it; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import components, discard, materialise

THRESHOLD = 0.93
BLOCK, SAMPLE, CENTRES = 2000, 8000, 512
#: The least radius of a level.
FINEST = 1 / 32
#: Slack for rounding of distances; leaves are decided by the cosine itself.
EPS = 1e-7


def distance(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def _far(x: np.ndarray, near: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray]:
    """New centres by farthest point until all are within radius of one, or there are `most`; and whose each point is: 0 the old centre's, at distance near."""
    chosen: list[int] = []
    own = np.zeros(len(x), np.int64)
    while len(chosen) < most and near[far := int(near.argmax())] > radius:
        d = apart(x, x[far : far + 1])[:, 0]
        d[far] = 0.0
        chosen.append(far)
        own[d < near] = len(chosen)
        near = np.minimum(near, d)
    return chosen, own


class Level(NamedTuple):
    bound: float
    """No node's covering radius is over it."""
    centre: np.ndarray
    radius: np.ndarray
    own: np.ndarray
    """The node of each point."""
    up: np.ndarray
    """The node of the level before that each node is part of."""

    def size(self) -> np.ndarray:
        return np.bincount(self.own, minlength=len(self.centre))


class CoverTree:
    """Levels of halving bounds; the centres of each are among those of the next. Bounds that bring no new centre have no level."""

    def __init__(self, x: np.ndarray, finest: float = FINEST):
        self.x = x
        own, centre = np.zeros(len(x), np.int64), [0]
        away = apart(x, x[:1])[:, 0]
        bound = 2.0
        self.levels = [Level(bound, np.array(centre), np.array([away.max()]), own, np.zeros(1, np.int64))]
        while bound / 2 >= finest and away.max() > 0:
            bound /= 2
            if away.max() <= bound:
                continue
            last = self.levels[-1]
            own, up = last.own.copy(), list(range(len(centre)))
            order = np.argsort(last.own, kind="stable")
            for k, points in enumerate(np.split(order, np.cumsum(last.size())[:-1])):
                if last.radius[k] > bound:
                    new, whose = _far(x[points], away[points], bound, len(points))
                    own[points[whose > 0]] = len(centre) - 1 + whose[whose > 0]
                    centre += points[new].tolist()
                    up += [k] * len(new)
            at = np.array(centre)
            away = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, x[at[own]])))
            away[at] = 0.0
            radius = np.zeros(len(at))
            np.maximum.at(radius, own, away)
            self.levels.append(Level(bound, at, radius, own, np.array(up)))


def dual(a: CoverTree, b: CoverTree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Links of each point of a with points of b (not itself where both are the same tree), those of b, and edges (i, j)."""
    reach = distance(cosine)
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    edges: list[np.ndarray] = []
    open_ = np.ones((1, 1), bool)
    for depth in range(max(len(a.levels), len(b.levels))):
        s, t = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        if depth:
            open_ = open_[s.up] if depth < len(a.levels) else open_
            open_ = open_[:, t.up] if depth < len(b.levels) else open_
        if same:
            open_ = np.triu(open_ | open_.T)
        if not open_.any():
            break
        gap = apart(a.x[s.centre], b.x[t.centre])
        if same:
            np.fill_diagonal(gap, 0.0)
        reaches = s.radius[:, None] + t.radius[None, :]
        open_ = open_ & (gap - reaches <= reach + EPS)
        whole = open_ & (gap + reaches < reach - EPS)
        if whole.any():
            _count_whole(whole, s, t, same, na, nb, edges)
            open_ &= ~whole
    _compare(a, b, s, t, open_, same, cosine, na, nb, edges)
    if same:
        na, nb = na + nb, np.zeros(0, np.int64)
    return na, nb, edges


def _count_whole(whole: np.ndarray, s: Level, t: Level, same: bool, na: np.ndarray, nb: np.ndarray, edges: list[np.ndarray]) -> None:
    """Pairs of nodes all of whose points link."""
    na += (whole @ t.size())[s.own]
    nb += (whole.T @ s.size())[t.own]
    if same:  # a node with itself: each of its points was counted on both sides, with itself
        one = np.diagonal(whole)
        na -= (one * s.size())[s.own]
        nb -= one[s.own]
    i, j = np.nonzero(whole)
    edges.append(np.stack([s.centre[i], t.centre[j]], 1))
    left, right = whole.any(1), whole.any(0)
    p, q = np.flatnonzero(left[s.own]), np.flatnonzero(right[t.own])
    edges.append(np.stack([p, t.centre[whole.argmax(1)[s.own[p]]]], 1))
    edges.append(np.stack([s.centre[whole.argmax(0)[t.own[q]]], q], 1))


def _compare(a: CoverTree, b: CoverTree, s: Level, t: Level, open_: np.ndarray, same: bool, cosine: float, na: np.ndarray, nb: np.ndarray, edges: list[np.ndarray]) -> None:
    """Pairs of nodes that no bound settles: vector by vector."""
    points = [np.split(np.argsort(x.own, kind="stable"), np.cumsum(x.size())[:-1]) for x in (s, t)]
    for i in np.flatnonzero(open_.any(1)):
        p, js = points[0][i], np.flatnonzero(open_[i])
        q = np.concatenate([points[1][j] for j in js])
        hit = a.x[p] @ b.x[q].T >= cosine
        if same:  # within a node: each pair once
            mine = np.isin(q, p)
            hit[:, mine] &= p[:, None] < q[mine][None, :]
        na[p] += hit.sum(1)
        np.add.at(nb, q, hit.sum(0))
        x, y = np.nonzero(hit)
        if len(x):
            edges.append(np.stack([p[x], q[y]], 1))


def forest(n: int, edges: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) for the nodes that aren't the smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        for k in (0, 1):
            np.minimum.at(new, edges[:, k], low)
            np.minimum.at(new, label[edges[:, k]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return np.stack([node, label[node]], 1)


_FOUND = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])


def _meet(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("uid")  # one order whichever task ran first
        uid, side = rows.column("uid").to_numpy(), rows.column("block").to_numpy()
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(uid), -1)
        low = side == side.min()
        same = bool(low.all())
        ua, ub = (uid, uid) if same else (uid[low], uid[~low])
        a = CoverTree(np.ascontiguousarray(x[low]))
        na, nb, edges = dual(a, a if same else CoverTree(np.ascontiguousarray(x[~low])), same, cosine)
        who, count = (ua, na) if same else (np.concatenate([ua, ub]), np.concatenate([na, nb]))
        some = count > 0
        all_edges = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        tree = forest(len(who), all_edges + np.array([0, 0 if same else len(ua)]))
        v = np.concatenate([who[some], who[tree[:, 0]]])
        w = np.concatenate([np.zeros(int(some.sum()), np.int64), who[tree[:, 1]]])
        n = np.concatenate([count[some], np.zeros(len(tree), np.int64)])
        return pa.Table.from_arrays([pa.array(v), pa.array(w, mask=np.arange(len(w)) < some.sum()), pa.array(n)], schema=_FOUND)

    return run


#: A vector that can link: not null, not empty, all entries finite, one of them not zero.
USABLE = (
    "label is not null and embedding is not null and size(embedding) > 0 and "
    "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
)


def _units(column) -> list[bytes]:
    """Each vector at length one, as bytes of doubles."""
    out = []
    for v in column.to_pylist():
        x = np.array(v, np.float64)
        x /= np.abs(x).max()
        out.append((x / np.sqrt(x @ x)).tobytes())
    return out


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(_units(b.column(3)), pa.binary())], names=["uid", "label", "dim", "vector"])


def _place(centres: dict[tuple[str, int], np.ndarray]):
    """The nearest centre of a vector's label, and the distance to it; 0 and null for a label without centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, away = [], []
            for label, dim, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                c = centres.get((label, dim))
                if c is None:
                    near.append(0), away.append(None)
                    continue
                cos = c @ np.frombuffer(v, np.float64)
                k = int(cos.argmax())
                near.append(k), away.append(float(np.sqrt(max(0.0, 2 - 2 * cos[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(away, pa.float64())], names=["uid", "label", "dim", "vector", "near", "away"])

    return run


def linked(vectors: DataFrame, cosine: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): (uid, vec_id) of every row, and (v, w, n): n links of v in one task, or, where w isn't null, an edge."""
    rows = materialise(vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    fit = rows.where(USABLE).selectExpr("uid", "label", "size(embedding) as dim", "embedding")
    units = materialise(fit.mapInArrow(_unit_rows, "uid long, label string, dim int, vector binary"), "units")
    count = units.count()
    few = units.where(F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-count // sample)))) == 0).limit(2 * sample).collect()
    known: dict[tuple[str, int], list[bytes]] = {}
    for r in few:
        known.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    centres = {}
    for key, own in known.items():
        x = np.frombuffer(b"".join(own), np.float64).reshape(len(own), -1)
        share = -(-count * len(own) // max(1, len(few)) // block)
        new = _far(x, np.full(len(x), 3.0), 0.0, min(CENTRES, max(1, share)))[0]
        centres[key] = np.ascontiguousarray(x[new])
    placed = units.mapInArrow(_place(centres), "uid long, label string, dim int, vector binary, near int, away double")
    placed = materialise(placed, "placed")
    discard(units)
    # a centre with more than a block's share is split by hash
    sizes = placed.groupBy("label", "dim", "near").agg(F.count("*").alias("c"), F.max("away").alias("r"))
    sizes = materialise(sizes.withColumn("parts", F.ceil(F.col("c") / block).cast("int")), "centres")
    near = sizes.selectExpr("label", "dim", "near as near1", "near as near2").union(_neighbours(sizes, centres, distance(cosine) + EPS))
    one, two = (sizes.selectExpr("label", "dim", f"near as near{k}", f"parts as parts{k}") for k in (1, 2))
    meet = near.join(one, ["label", "dim", "near1"]).join(two, ["label", "dim", "near2"])
    meet = meet.selectExpr("*", "explode(sequence(0, parts1 - 1)) as part1").selectExpr("*", "explode(sequence(if(near1 = near2, part1, 0), parts2 - 1)) as part2")
    meet = meet.selectExpr("xxhash64(label, dim, near1, part1) as block1", "xxhash64(label, dim, near2, part2) as block2")
    sides = materialise(meet.select("*", F.col("block1").alias("block")).union(meet.select("*", F.col("block2").alias("block"))).distinct(), "meets")
    own = placed.join(sizes.select("label", "dim", "near", "parts"), ["label", "dim", "near"]).withColumn("part", F.pmod(F.hash("uid"), F.col("parts")))
    own = own.select("uid", "vector", F.xxhash64("label", "dim", "near", "part").alias("block"))
    sent = own.join(sides, "block").select("block1", "block2", "block", "uid", "vector")
    found = sent.groupBy("block1", "block2").applyInArrow(_meet(cosine), "v long, w long, n long")
    found = materialise(found, "links")
    discard(placed, sizes, sides)
    return rows.select("uid", "vec_id"), found


def _neighbours(sizes: DataFrame, centres: dict[tuple[str, int], np.ndarray], reach: float) -> DataFrame:
    """(label, dim, near1, near2), near1 < near2: centres whose vectors may link. Their number is bounded by the sample's."""
    radius = {key: np.full(len(c), -np.inf) for key, c in centres.items()}
    for r in sizes.where("r is not null").select("label", "dim", "near", "r").toLocalIterator():
        radius[r.label, r.dim][r.near] = r.r
    cols: list[list] = [[], [], [], []]
    for (label, dim), c in centres.items():
        r = radius[label, dim]
        i, j = np.nonzero(np.triu(apart(c, c) - r[:, None] - r[None, :] <= reach, 1))
        for col, new in zip(cols, ([label] * len(i), [dim] * len(i), i.tolist(), j.tolist()), strict=True):
            col += new
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("near1", pa.int32()), ("near2", pa.int32())])
    return sizes.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema))


def near_duplicates(vectors: DataFrame, cosine: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows, found = linked(vectors, cosine, block, sample)
    links = found.where("w is null").groupBy(F.col("v").alias("uid")).agg(F.sum("n").alias("n_links"))
    of = components(found.where("w is not null").select(F.col("v").alias("a"), F.col("w").alias("b"))).withColumnRenamed("node", "uid")
    named = rows.join(of, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    low = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return (
        named.join(low, "component")
        .join(links, "uid", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))




SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.vec_id = m.vec_id LEFT JOIN n ON n.vec_id = m.vec_id
"""
