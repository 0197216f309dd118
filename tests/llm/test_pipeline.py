"""The pipeline: its stages in order, each on what the one before kept."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]  # as in any language, most words recur
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, leak, base = text(55), text(14), text(120)
    data, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        data.append((i, text(60) + (" moronish idiotly" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    data += [(1000 + i, base, "en", "s", 0) for i in range(3)] + [(1010, base + " tail", "en", "s", 0)]
    data += [(1020 + i, f"{text(40)} {passage} {text(40)}", "en", "s", 0) for i in range(3)]
    data += [(1030, f"{text(20)} {leak.upper()} {text(20)}", "en", "s", 0), (1031, "", "en", "s", 0), (1032, None, "en", "s", 0)]
    sf = f"{tmp_path}/sf"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, columns).repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    a, b, c, d = (kept[n] for n, _ in pipeline.STAGES[:-1])
    assert sum(i in a for i in range(0, 300, 5)) <= 3 and sum(i in a for i in range(300) if i % 5) >= 235
    assert [i for i in (1000, 1001, 1002, 1010) if i in b] == [1000]
    assert passage in c[1020] and passage not in c[1021] and passage not in c[1022]
    assert 1030 in c and 1030 not in d and set(d) == set(c) - {1030}
    assert {r.doc_id for r in pipeline.run(spark, sf).select("doc_id").collect()} == set(d)


def test_stages_against_brute_force(spark, tmp_path):
    """From the classifier's own verdicts on, each stage by plain Python."""
    from tokenizers import Tokenizer

    from corpusmill.llm import bpe, toxicity
    from tests.llm.test_documents import brute_components, brute_leaks, rows

    data = [(i, t, "en", "s", len(t or "")) for i, t, *_ in rows(7)]
    leak = " ".join(data[30][1].split()[:11])
    sf = f"{tmp_path}/sf"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i, *_ in data], "doc_id long, quality int, toxic int")
    spark.createDataFrame(data, columns).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    verdicts = {r.doc_id: r.predicted for r in toxicity.predict(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {i: t for i, t, *_ in data if not verdicts[i]}
    kept = {i: kept[i] for i, (_, c) in brute_components(kept, 80).items() if i == c}
    seen, cut = set(), {}
    for i, t in sorted(kept.items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        cut[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else t
    left = {i: t for i, t in cut.items() if not brute_leaks(cut, [(1, leak)], 10)[i][4]}
    library = Tokenizer.from_file(bpe.default_path())
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in left.items()}
    assert {r.doc_id: r.n_tokens for r in pipeline.run(spark, sf).collect()} == want


def test_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
