"""Queries over whole texts and all rows, against brute force on small tables."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables of rows as parquet; gives a function that runs a query over them."""
    from corpusmill.plans import catalog

    def run(name, **rows):
        for table, (schema, data) in rows.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return catalog.queries()[name](spark, str(tmp_path)).collect()

    return run


OPENING = " ".join(f"opening{i}" for i in range(40))


def test_similarity_is_over_whole_texts_and_all_documents(tables):
    words = [f"w{i}" for i in range(200)]
    data = [
        (1, f"{OPENING} " + " ".join(words)),
        (2, f"{OPENING} " + " ".join(f"x{i}" for i in range(200))),  # shares only the opening of 1
        (3, "Other start " + " ".join([OPENING, *words])),  # differs from 1 only early
        (7, "a b"), (9, "B A"), (10, ""), (11, None),
    ]
    got = {(r.a, r.b): r.score for r in tables("j08_token_similarity", documents=("doc_id long, text string", data))}
    sets = {i: set(t.lower().split()) for i, t in data if t is not None}
    score = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(i, j): round(score(a, b), 9) for i, a in sets.items() for j, b in sets.items() if score(a, b) >= 0.9}
    assert got == want and (1, 3) in got and (1, 2) not in got


def test_field_gate_has_all_documents(tables):
    documents = ("doc_id long, n_chars long", [(4, 1), (5, 1), (10, 2), (15, 1)])
    labels = ("doc_id long, quality int", [(4, 1), (5, 1), (10, 1), (99, 0)])
    got = {(r.doc_id, r.reason) for r in tables("j12_key_and_field_gate", documents=documents, labels=labels)}
    assert got == {(10, "flag"), (15, "left_only"), (99, "right_only")}


def test_leakage_is_over_whole_texts(tables):
    documents = [
        (1, f"{OPENING} one"), (2, f"{OPENING} two"),  # one opening, unrelated
        (3, "a  passage \r\nof the benchmark"), (4, "a passage\nof the benchmark"), (5, "Held"), (6, "Held  "), (7, "Held"),
    ]
    benchmark = ("item_id long, text string", [(1, f"{OPENING} benchmark"), (2, "a passage\nof the benchmark")])
    got = tables("j06_leakage_levels", documents=("doc_id long, text string", documents), benchmark=benchmark, labels=("doc_id long", [(5,)]))
    assert {r.id: (r.levels, r.removed) for r in got} == {1: ("", False), 2: ("", False), 3: ("2", True), 4: ("1,2", True), 5: ("0,1,2", True), 6: ("2", True), 7: ("1,2", True)}


def test_dedup_is_over_whole_texts(tables):
    body = [f"{OPENING} {end}" for end in ("one", "two", "one")]
    rows = ("doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en", f"s{i}", i) for i, t in enumerate(body)])
    kept = {r.doc_id: r.kept_pair for r in tables("a03_role_dedup", documents=rows)}
    assert kept == {0: True, 1: True, 2: False}
    assert {(r.level, r.record_ids) for r in tables("a05_duplicate_groups", documents=rows)} == {(3, "0,2"), (4, "0,2")}
    assert {r.doc_id: r.pair for r in tables("j05_cross_source_overlap", documents=rows)} == {0: False, 2: False}
    assert {(r.side, r.variants, r.rows) for r in tables("a07_variants", documents=rows)} == {("statement", 2, 3)}
    assert tables("a08_same_proof_statements", documents=rows) == []
    united = tables("u02_union_then_dedup", documents=rows, benchmark=("item_id long, text string", [(1, body[1]), (2, f"{OPENING} three")]))
    assert {(r.file, r.id) for r in united if r.kept} == {(0, 0), (0, 1), (1, 2)}
    assert sorted(r.again for r in tables("o22_diverse_selection", documents=rows)) == [False, False, True]
    many = ("doc_id long, text string, lang string", [(i, f"{OPENING} {i}", "en") for i in range(9)])
    assert len(tables("o23_balanced_selection", documents=many)) == 9
    middle = ("doc_id long, text string", [(1, "x " * 80 + "a b " * 40 + "y " * 80 + "a b " * 40), (2, ""), (3, None)])
    assert {r.doc_id: r.score for r in tables("h13_token_jaccard", documents=middle)} == {1: 0.5, 2: 1.0, 3: None}


def test_bootstrap_gives_the_paired_interval(tables, spark):
    import hashlib

    from corpusmill.operators.attempts import paired_interval

    x, y = [1, 0, 0, 1, 0, 1, 0], [0, 1, 1, 1, 0, 1, 1]
    side = lambda v: spark.createDataFrame([(i, bool(s)) for i, s in enumerate(v)], "problem_id int, solved boolean")
    worth, n, draws = [-1, 1, 1, 1, 0, 0, 0], 7, 400
    means = sorted(sum(worth[int(hashlib.sha256(f"3:{d}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)) / n for d in range(draws))
    got = paired_interval(side(x), side(y), 3, draws).first()
    assert (got.problems, got.delta) == (7, 2 / 7)
    assert (got.low, got.high) == pytest.approx((means[int(0.025 * 399)], means[int(0.975 * 399)]))
    assert paired_interval(side([]), side([]), 3, draws).first().low is None
    events = [(i, u, "purchase" if i % 32 >= 28 - u else "view", 1.0, None) for u in range(3) for i in range(32 * u, 32 * u + 32)]
    rows = tables("a33_paired_bootstrap", events=("event_id long, user_id long, event_type string, value double, ts timestamp", events))
    assert {(r.k, r.problems, r.delta, r.low, r.high) for r in rows} == {(1, 3, 1.0, 1.0, 1.0), (4, 3, 1.0, 1.0, 1.0)}


def test_bootstrap_draws_once_for_all_comparisons(spark, monkeypatch):
    from corpusmill.operators import attempts as A

    monkeypatch.setattr(A, "BLOCK", 4)
    both = spark.createDataFrame([(i, i % 3 == 0, i % 2 == 0, i % 5 > 0) for i in range(11)], "problem_id int, x boolean, y boolean, z boolean")
    got = A.paired_intervals(both, {1: (F.col("x"), F.col("y")), 4: (F.col("x"), F.col("z"))}, 3, 300)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    side = lambda c: both.select("problem_id", F.col(c).alias("solved"))
    alone = {k: A.paired_interval(side("x"), side(c), 3, 300).first() for k, c in ((1, "y"), (4, "z"))}
    assert {r.k: r[1:] for r in got.collect()} == {k: tuple(r) for k, r in alone.items()}
    assert [tuple(r) for r in A.paired_intervals(both.where("false"), {1: (F.col("x"), F.col("y"))}, 3).collect()] == [(1, 0, None, None, None)]


def test_attempts_of_a_hot_problem_are_all_there(tables):
    events = [(i, 1 if i < 100 else i, "purchase" if i == 90 else "view", float(i), None) for i in range(140)]
    rows = ("event_id long, user_id long, event_type string, value double, ts timestamp", events)
    got = tables("a36_receipt_counters", events=rows)[0]
    assert (got.receipts, got.successes, got.least_seconds, got.most_seconds) == (140, 1, 0.0, 139.0)
    own = {r.problem_id: r.attempts for r in tables("a19_problem_summary", events=rows) if r.problem_id % 10**9 == 1}
    assert own == {1: 32, 10**9 + 1: 32, 2 * 10**9 + 1: 32, 3 * 10**9 + 1: 4}
    assert len(tables("t02_once_for_each_key", events=rows)) == 140
    assert sum(r.n for r in tables("k06_problem_shards", events=rows) if int(r.problem) % 10**9 == 1) == 100
    many = [(i, i if i < 17 else 0, "purchase" if 20 < i <= 40 else "view", 1.0, None) for i in range(100)]  # 17 users and 19 problems; one scale for 16 of them
    scales = tables("t07_lagged_scale_stream", events=(rows[0], many))
    last = max(scales, key=lambda r: r.group_id)[2]
    assert last == pytest.approx(0.9 * 0.5 + 0.1 * ((20 * 0.64 + 27 * 0.04) / 47) ** 0.5)


def _same_as_sql(tables, name, events):
    duckdb = pytest.importorskip("duckdb")
    from corpusmill.plans import catalog

    kinds = "event_id long, user_id long, event_type string, value double"
    got = [tuple(r) for r in tables(name, events=(kinds + ", ts timestamp", [(*e, None) for e in events]))]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, user_id bigint, event_type varchar, value double, ts timestamp)")
    con.executemany("insert into events values (?, ?, ?, ?, null)", events)
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    return got


def test_weights_of_problems_with_eight_attempts_are_those_of_the_sql(tables):
    events = [(10 * u + i, u, "purchase" if i < u else "view", 1.0) for u in range(1, 5) for i in range(8)]
    assert {r[2] for r in _same_as_sql(tables, "f35_problem_weights", events)} == {1.0}


def test_budget_orders_sums_of_doubles_as_the_sql_does(tables):
    pair = lambda u, *values: [(100 * u + i, u, "purchase" if i == 0 else "view", v) for i, v in enumerate(values)]
    events = [e for u in range(40) for e in (pair(u, 0.1, 0.2) if u % 2 else pair(u, 0.3))]  # 0.30000000000000004 and 0.3
    first = {r[0] for r in _same_as_sql(tables, "o07_budget_with_cooldown", events) if r[1] <= 20}
    assert first == set(range(1, 40, 2))


def test_budget_sums_all_events_whatever_their_ids(tables):
    ids = lambda u, i: None if u % 3 == 1 else 7 if u % 3 == 2 else 10 * u + i
    events = [(ids(u, i), u, "purchase" if i == 0 else "view", float(u if i == 3 else 100)) for u in range(12) for i in range(6)]
    assert [r[0] for r in sorted(_same_as_sql(tables, "o07_budget_with_cooldown", events), key=lambda r: r[1])] == list(range(11, -1, -1))


def test_problems_share_folders_and_none_is_in_two(spark, tmp_path):
    import glob
    import json
    import zlib

    from corpusmill.sources import sinks

    path = f"{tmp_path}/shards"
    sinks.shard_by_problem(spark.range(6000).selectExpr("id div 2 as problem_id", "cast(id % 2 as int) as attempt_index"), path)
    files = glob.glob(f"{path}/shard=*/*.json")
    assert len(files) <= sinks.FOLDERS < 3000
    held = {}
    for f in files:
        for line in open(f):
            row = json.loads(line)
            held.setdefault(row["problem"], []).append((int(f.split("shard=")[1].split("/")[0]), row["attempt_index"]))
    assert {p: sorted(v) for p, v in held.items()} == {str(p): [(zlib.crc32(str(p).encode()) % sinks.FOLDERS, i) for i in (0, 1)] for p in range(3000)}


def test_text_operators_read_the_texts(tables):
    long = "word " * 20_000
    data = [(0, "theorem a : b := by simp"), (1, long + "\nsorry"), (2, long + '"sorry" -- admit'), (4, "theorem a : b := by ring"), (8, ""), (12, None)]
    run = lambda name: {r[0]: r[1:] for r in tables(f"{name}", documents=("doc_id long, text string", data))}
    assert {i for i, (bad,) in run("v03_forbidden_tokens").items() if bad} == {1}
    got = run("f01_split_declaration")
    assert got[0] == ("theorem a : b", "by simp") and got[4] == ("theorem a : b", "by ring")
    assert {i for i, (yes,) in run("v01_declaration_prefix").items() if yes} == {0, 4}
    assert run("f06_proof_bodies")[1] == (data[1][1],)
    assert run("f08_proof_format")[4] == ("full_declaration",)
    assert len(run("f25_extracted_proofs")) == len(run("f32_tactic_signatures")) == 6
    groups = run("h07_theorem_group")
    assert groups[0] != groups[4] and groups[1] != groups[2]
    prints = run("h11_structural_fingerprints")
    assert prints[0] != prints[4] and prints[1] != prints[2]


def test_groups_go_whole_and_structures_match(tables):
    documents = ("doc_id long, text string", [(1, "theorem a : x = 1 := by simp"), (2, "theorem b : x = 1 := by simp"), (3, "theorem c : y := z"), (4, None), (5, "theorem q : x =  1 :="), (50, "lemma e : x = 1 := ring")])
    rest = {"benchmark": ("item_id long, text string", [(7, "theorem a : x = 1 := by simp"), (9, "theorem zz : y := z")]), "labels": ("doc_id long, quality int", [(3, 1)])}
    matches = {r.doc_id for r in tables("j07_structural_matches", documents=documents, **rest)}
    assert matches == {1, 2, 3}
    gone = {r.theorem_group_id: r.removed for r in tables("j09_group_removal")}
    assert sum(gone.values()) == 3 and sorted(gone.values()) == [1, 2]


def test_similar_sets_send_no_set_for_each_pair(spark, tmp_path):
    """Near copies with common words: the right pairs, two classes under one number apart, and keys only where sets are near."""
    from corpusmill.operators import leakage

    common = [f"the{i}" for i in range(30)]
    near = [[*common, f"x{i}"] for i in range(40)]
    far = [[*common, *(f"y{i}_{j}" for j in range(12))] for i in range(300)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(near + far)], "id int, tokens array<string>")
    got = {(r.a, r.b): r.score for r in leakage.similar_sets(rows, rows).collect()}
    assert got == {(i, j): 1.0 if i == j else 30 / 32 for i in range(40) for j in range(40)} | {(i, i): 1.0 for i in range(40, 340)}
    keys = rows.selectExpr("cast(id as long) as c", "cast(size(tokens) as long) as n", "transform(tokens, w -> xxhash64(w)) as h").mapInArrow(leakage._part_keys(0.9), "key long, c long, own boolean")
    shared = keys.where("c >= 40").groupBy("key").count().where("count > 1")
    assert shared.agg({"count": "max"}).first()[0] is None or shared.count() < 20
