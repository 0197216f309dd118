"""Arrays of JSON objects read in byte ranges, against the json module."""

import json
import random

import pytest

from corpusmill.sources import json_arrays


def objects(spark, path, size):
    rows = json_arrays.read(spark, path, range_bytes=size).collect()
    assert all(r.value.startswith("{") for r in rows)
    return [json.loads(r.value) for r in sorted(rows, key=lambda r: (r.path, r.start, r.nth))]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return "".join(rng.choice('{}[]",:\\ a\n é😀') for _ in range(rng.randrange(30)))
    if kind == 1:
        return rng.choice([None, True, 1.5, -3, "", "\\", '"', "}", '\\"}'])
    if kind == 2:
        return rng.randrange(10**6)
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "}", "[", '"', "\\", "{,"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [40, 1000])
def test_random_arrays_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    wanted = []
    for n in range(3):  # one compact, one with line breaks, one with escapes for all that isn't ASCII
        rows = [{"n": i, "v": value(rng), "long": "x{\\" * (200 if i == 5 else 0)} for i in range(40)] + [{}]
        text = json.dumps(rows, indent=2 if n == 1 else None, ensure_ascii=n == 2)
        (tmp_path / f"{n}.json").write_text(f" {text}\n" if n else text, encoding="utf-8")
        wanted += rows
    assert objects(spark, str(tmp_path), size) == wanted


def test_empty_and_single(spark, tmp_path):
    for name, text in [("a", "[]"), ("b", " [ \n] "), ("c", ""), ("d", '[{"a": null, "path2": "}"}]')]:
        (tmp_path / f"{name}.json").write_text(text)
    assert objects(spark, str(tmp_path), 4) == [{"a": None, "path2": "}"}]
    rows = json_arrays.read(spark, str(tmp_path), "a int, path2 string, other string").collect()
    assert [(r.a, r.path2, r.other, r.nth) for r in rows] == [(None, "}", None, 0)]


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}', '[{"a": 1},', '[{"a": 1', '[{"a": "x', '[{"a": 1}]]', '[{"a": 1}] x', '[{"a": 1}] {}', '[{"a": 1},]', '[1, {"a": 1}]', '[{"a": 1}, 2]', "[1]", '[[{"a": 1}]]', '[{"a": 1} {"b": 2}]', '{"a": 1}', '[{"a": 1}, [2], {"b": 1}]', "x", '[,{"a": 1}]'],
)
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not an array of objects|not one whole JSON array"):
        json_arrays.read(spark, str(tmp_path), range_bytes=9).collect()


def test_a_malformed_object_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a" 2}]')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        json_arrays.read(spark, str(tmp_path), "a int").collect()


def test_written_arrays_come_back_from_several_tasks(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "repeat('\"{,]}\\\\', cast(id % 90 as int)) as text", "if(id % 7 = 0, null, id) as v")
    path = f"file://{tmp_path}/out"
    json_arrays.write(rows.repartition(3), path)
    for f in (tmp_path / "out").glob("*.txt"):
        assert isinstance(json.loads(f.read_text()), list)
    got = json_arrays.read(spark, path, "id long, text string, v long", range_bytes=20_000)
    assert got.select("id", "text", "v").exceptAll(rows).count() == 0 and got.count() == 3000
    assert got.select("path", "start").distinct().count() > 10


def test_many_ranges_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "SENT", 0)
    rows = [{"n": i, "v": "}" * (i % 11)} for i in range(200)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    assert objects(spark, str(tmp_path), 300) == rows
