"""The driver's contract: the entry query, the registry, and what is left without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert sorted(r.k for r in entry.entry(spark).collect()) == [1, 4, 8, 16, 32]


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql(); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert got.stdout.strip() == "fine", got.stderr


@needs_data
def test_queries_match_sql(spark):
    """Every query with SQL gives the rows that DuckDB gives."""
    duckdb = pytest.importorskip("duckdb")
    from corpusmill.plans import catalog

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "conversations", "events", "embeddings", "lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    wrong = []
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        want = con.sql(sql)
        at = [list(want.columns).index(c) for c in columns]
        if plain([tuple(r[c] for c in columns) for r in df.collect()]) != plain([tuple(r[i] for i in at) for r in want.fetchall()]):
            wrong.append(name)
    assert not wrong
