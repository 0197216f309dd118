"""Places, sums and picks over whole tables, against plain Python; expected mixtures follow the stated greedy rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import attempts, places, traces
from corpusmill.operators import selection as S


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.randrange(10**6), float(rnd.randrange(1, 50))) for i in range(500)]
    return data, spark.createDataFrame(data, "id long, g int, n long, w double").repartition(7)


def test_numbered_within_groups(rows):
    data, df = rows
    got = {r.id: r.place for r in places.numbered(df, "g", "n", "place").collect()}
    want, seen = {}, {}
    for i, g, n, _ in sorted(data, key=lambda r: r[2]):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    by_n = {}
    for i, g, n, _ in data:
        by_n.setdefault((g, n), []).append(i)
    assert all(got[i] == want[i] for ids in by_n.values() if len(ids) == 1 for i in ids) and sorted(got) == sorted(want)
    assert places.numbered(df.where("false"), "g", "n", "place").count() == 0


def test_placed_over_a_table(rows):
    data, df = rows
    got = {r.id: r.place for r in places.placed(df, F.desc("n"), "id").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])), 1)}
    assert places.placed(df.where("false"), "id").count() == 0


def test_running_sum_over_a_table(rows):
    data, df = rows
    total, want = 0.0, {}
    for i, _, _, w in sorted(data):
        want[i] = total = total + w
    assert {r.id: r.running for r in places.running_sum(df, "w", "id").collect()} == want


def greedy(data, targets):
    picks, seen = [], set()
    for source, target in sorted(targets.items()):
        pool, running = [r for r in data if r[0] == source], 0
        while pool and running < target:
            left = [r for r in pool if r[2] not in seen]
            if not left:
                break
            row = min(left, key=lambda r: (abs(target - (running + r[3])), str(r[1])))
            pool.remove(row)
            if running and abs(target - running) <= abs(target - (running + row[3])):
                break
            picks.append(row[:2])
            seen.add(row[2])
            running += row[3]
    return sorted(picks)


@pytest.mark.parametrize("seed", range(6))
def test_greedy_mixture(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "_SLICE", 5)
    rnd = random.Random(seed)
    data = [(rnd.randrange(2), i, f"g{rnd.randrange(40)}", rnd.choice([1, 3, 7, 10, 25, 80])) for i in range(90)]
    df = spark.createDataFrame(data, "source_rank int, id long, theorem_group_id string, tokens long")
    targets = {0: rnd.randrange(20, 200), 1: rnd.randrange(20, 200)}
    assert sorted((r.source_rank, r.id) for r in S.greedy_budget(df, targets).collect()) == greedy(data, targets)


@pytest.mark.parametrize("bad", [0.0, -1.0, math.nan, math.inf, None])
def test_weights_must_be_finite_and_positive(spark, bad):
    df = spark.createDataFrame([(1, 1.0), (2, bad)], "id long, w double")
    with pytest.raises(ValueError, match="1 weights"):
        S.weighted_draws(df, "w", 1, 10)


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 8.0), (3, 1.0)], "id long, w double")
    got = [r.id for r in S.weighted_draws(df, "w", 5, 2000).collect()]
    assert len(got) == 2000 and 0.75 < got.count(2) / 2000 < 0.85 and {1, 2, 3} == set(got)


def test_lagged_scale_is_a_fold(spark, monkeypatch):
    monkeypatch.setattr(traces, "BLOCK", 3)
    rnd = random.Random(9)
    ids = [g + 10**9 * (g % 5) for g in range(16 * 11 + 5) if g % 37]  # far apart: a window is so many groups, not so many ids
    data = [(g, rnd.uniform(-1, 1)) for g in ids for _ in range(1 + g % 3)]
    got = {r.window_id: r.scale for r in traces.lagged_scale(spark.createDataFrame(data, "g long, v double"), "g", "v").collect()}
    scale, want = 0.5, {}
    ids.sort()
    for w in range(math.ceil(len(ids) / 16)):
        members = set(ids[16 * w : 16 * w + 16])
        own = [v for g, v in data if g in members]
        want[w] = scale
        if len(members) == 16:
            scale = 0.9 * scale + 0.1 * max(1e-4, math.sqrt(sum(v * v for v in own) / len(own)))
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-12) for w in want)


def test_stages_and_what_breaks_them(spark):
    stages = (("pass8", 0, 2), ("pass16", 2, 2), ("pass32", 4, 3))
    rows = lambda *xs: spark.createDataFrame([(p, i, True) for p, i in xs], "problem_id long, attempt_index int, success boolean")
    given = {"pass8": rows((1, 0), (1, 1), (2, 0), (2, 0)), "pass16": rows((1, 0), (1, 1), (2, 0), (2, 2)), "pass32": rows((1, 0), (1, 1), (1, 2), (2, 0))}
    merged = attempts.staged(given, stages)
    assert sorted((r.problem_id, r.attempt_index) for r in merged.collect() if r.problem_id == 1) == [(1, i) for i in range(7)]
    got = {(r.problem_id, r.attempt_index, r.stage, r.reason) for r in attempts.stage_violations(merged, stages).collect()}
    assert got == {
        (2, 4, "pass16", "invalid local attempt"), (2, 0, "pass8", "duplicate merged attempt"), (2, 4, "pass16", "duplicate merged attempt"), (2, None, "pass32", "incomplete per-problem attempt set"),
    }
