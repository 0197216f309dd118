"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, leakage, selection
from corpusmill.operators.gates import GateError
from corpusmill.sources import records, sinks
from corpusmill.streaming import attempts as stream


def put(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_json_sources(spark, tmp_path):
    rows = [{"id": "1", "v": 2}, "", {"id": "2", "v": 3}]
    assert records.jsonl(spark, put(tmp_path / "a.jsonl", rows), "id string, v int").count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"other": 1, "train": [{"id": "1", "v": 2}]}))
    assert records.read(spark, str(tmp_path / "b.json"), "id string, v int").first().v == 2
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    assert records.json_list(spark, str(tmp_path / "c.json"), "id string").count() == 2
    with pytest.raises(GateError):
        records.strict_jsonl(spark, put(tmp_path / "d.jsonl", [{"id": "1"}, "[1]"]), "id string")
    (tmp_path / "e.csv").write_text('a,b\n1,"x\ny"\n')
    assert records.csv(spark, str(tmp_path / "e.csv")).first().b == "x\ny"


def test_attempt_log_keeps_the_last(spark, tmp_path):
    rows = [{"problem_id": "p", "attempt_index": 0, "ok": False}, "{broken", {"problem_id": "p", "attempt_index": 0, "ok": True}, {"problem_id": "p", "attempt_index": 1, "ok": False}]
    got = records.attempt_log(spark, put(tmp_path / "log.jsonl", rows), "problem_id string, attempt_index int, ok boolean")
    assert {(r.attempt_index, r.ok) for r in got.collect()} == {(0, True), (1, False)}


def test_lines_kinds_and_protected(spark, tmp_path):
    put(tmp_path / "x.txt", ["one", "two"])
    b = spark.createDataFrame([("x.txt", 2), ("x.txt", 9)], "path string, line int")
    assert {(r.line, r.text) for r in records.line_addressed(spark, b, str(tmp_path / "x.txt")).collect()} == {(2, "two"), (9, None)}
    assert records.dataset_kind("org/Lean-Workbook") == "lean_workbook"
    with pytest.raises(ValueError):
        records.split_file("dev")
    paths = [put(tmp_path / "unseen_a.jsonl", [{"id": "1"}]), put(tmp_path / "plain.jsonl", [{"id": "2"}, {"id": "3"}])]
    _, inventory = records.protected(spark, paths, "id string")
    assert {(r.records, r.role) for r in inventory.collect() if "plain" in r.path} == {(2, "evaluation_protected")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "z int, a string")
    sinks.write_jsonl(df, str(tmp_path / "out"), exclusive=True)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_jsonl(df, str(tmp_path / "out"), exclusive=True)
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy("z"))
    m = sinks.file_manifest(spark, str(tmp_path / "out")).cache()
    assert m.count() and sinks.verify_manifest(m, spark, str(tmp_path / "out")).isEmpty()
    assert "| 2 | b |" in sinks.markdown(df, "t")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "z int, a string")
    assert {tuple(r) for r in sinks.upsert(df, new, "z").collect()} == {(1, "a"), (2, "c"), (3, "d")}


SCHEMA = "event_id long, problem_id long, attempt_index int, success boolean"


def attempts(spark, path):
    rows = [(p * 10 + i, p, i, p == 1 and i == 1) for p in (1, 2) for i in range(3)] + [(10, 1, 0, False)]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "log")
    attempts(spark, path)
    log = lambda: stream.read_log(spark, path, SCHEMA, files_each=20)
    assert len(run(stream.once(log()), "once")) == 6
    assert {(r.problem_id, r.successes) for r in run(stream.when_complete(log(), 3), "complete")} == {(1, 1), (2, 0)}
    assert {r.event_id for r in run(stream.cancel_after_success(log()), "cancel") if r.canceled} == {12}
    for _ in range(2):
        q = stream.resume(log(), str(tmp_path / "receipts"), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "receipts")).count() == 6


def test_dedup_order_and_ids(spark):
    rows = spark.createDataFrame([(0, "1", "a"), (1, "1", "b"), (2, "2", "a"), (3, "1", "b"), (4, None, None), (5, None, None)], "i int, id string, k string")
    kept = {r.i for r in dedup.first_wins(rows, ["k"], "i").where("kept").collect()}
    assert kept == {0, 1, 4}
    ids = [r.unique_id for r in dedup.disambiguate(rows.where("id is not null"), "id", "i", "k").orderBy("i").collect()]
    assert ids[0] == "1" and ids[1].startswith("1::") and ids[2] == "2" and ids[3] == ids[1] + "-2"


def test_similar_sets_is_exact(spark):
    import random

    rnd = random.Random(3)
    base = [rnd.sample(range(60), rnd.randint(0, 25)) for _ in range(60)]
    sets = base + [s[:-1] + [99] for s in base if len(s) > 18] + [[]]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id int, tokens array<string>")
    for t in (0.5, 0.9):
        got = {(r.a, r.b) for r in leakage.similar_sets(df, df, t).collect()}
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if (not a and not b) or (a or b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= t}
        assert got == want


def test_split_and_budget(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc")
    assert selection.split(df, 3, "doc", 0.137).where("validation").count() == 137
    twice = df.union(df)
    assert selection.split(twice, 3, "doc", 0.1).where("validation").count() == 200
    assert selection.split(spark.range(1).withColumnRenamed("id", "doc"), 3, "doc", 0.5).where("validation").count() == 0
    assert selection.repeats(df, 1234, 1, "doc").agg(F.sum("repeat")).first()[0] == 1234
