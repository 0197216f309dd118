"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The posterior of a page's language is proportional to
  P(text | language)      character trigrams, multinomial with add-one smoothing, counted over all
                          documents that carry a language;
  P(declared | language)  the lang attribute of the html element, if there is one;
  P(suffix | language)    the last label of the host's name;
  P(language | host)      counts of the host's pages, smoothed by those of its parent domain, and
                          these by those of all pages.
The tables of the last three are grouped aggregations over all pages, by the language that the text
alone suggests. Trigrams overlap and are far from independent, so the text's log-likelihood is scaled
to that of at most `WEIGHT` trigrams, else no other evidence could ever count.

Edge cases: pages without text, a null html or a null url lean on what is left; documents without a
language are not counted; without any such document every page's language is null; ties go to the
language that sorts first; repeated rows count each; an empty table gives no rows. Languages are taken
to be at most `MOST`: the tables have one column each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import html
from corpusmill.llm.common import materialise

BUCKETS, WEIGHT, MOST = 1 << 14, 60, 400
STRENGTH = 5.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def trigrams(text: str) -> np.ndarray:
    """Bucket of each character trigram of the lowered text, white space as one space."""
    code = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    h = (code[:-2] * _A + code[1:-1]) * _B + code[2:]
    h ^= h >> np.uint64(29)
    return ((h * _A) >> np.uint64(50)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(c[some], pa.int64())})
        total.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in total:
                if len(total) >= 100:
                    yield from out()
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    yield from out()


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each trigram bucket in each): grouped counts over all documents."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    n = rows.select("lang").distinct().count()
    if n > MOST:
        raise ValueError(f"{n} languages; at most {MOST} are supported")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect()  # languages x buckets at most
    langs = sorted(r["lang"] for r in got)
    table = np.ones((len(langs), BUCKETS))
    for r in got:
        i = langs.index(r["lang"])
        for b, n in r["c"]:
            table[i, b] += n
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def primary(tag: str | None) -> str | None:
    """The language part of a tag like en-GB."""
    m = re.match(r"\s*([a-zA-Z]{2,3})(?![a-zA-Z])", tag or "")
    return m[1].lower() if m else None


def page_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, parent, suffix, declared, ll array<double>, text_lang of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(table)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            hosts, parents, suffixes, said, lls, best = [], [], [], [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                host = html.host_of(url)
                labels = host.split(".")
                text, other, _, prose = html.settle(page or "")
                g = trigrams(text if text is not None else " ".join(prose) if prose else " ".join(t[t.index(" ") + 1 :] for t in other))
                ll = t[:, g].sum(1, dtype=np.float64) * (min(1.0, WEIGHT / len(g)) if len(g) else 0.0)
                hosts.append(host), parents.append(".".join(labels[-3:] if len(labels) > 3 else labels[1:])), suffixes.append(labels[-1])
                said.append(primary(html.declared(page or "")))
                lls.append(ll.tolist())
                best.append(langs[int(ll.argmax())] if len(g) and langs else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hosts, pa.string()), pa.array(parents, pa.string()), pa.array(suffixes, pa.string()), pa.array(said, pa.string()), pa.array(lls, pa.list_(pa.float64())), pa.array(best, pa.string())],
                names=["page_id", "host", "parent", "suffix", "declared", "ll", "text_lang"],
            )

    schema = f"page_id {kind}, host string, parent string, suffix string, declared string, ll array<double>, text_lang string"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def _counts(rows: DataFrame, key: str, langs: list[str], name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*(F.count_if(F.col("text_lang") == x).cast("double") for x in langs)).alias(name))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared for every page row."""
    langs, table = fit(docs)
    rows = materialise(page_evidence(pages, langs, table), "evidence")
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "text_lang", "declared")
    k = len(langs)
    everything = rows.agg(*(F.count_if(F.col("text_lang") == x) for x in langs)).first()
    total = sum(everything)
    base = [(n + 1.0) / (total + k) for n in everything]
    lang_array = "array(" + ",".join(f"{p}D" for p in base) + ")"
    by_lang = "array(" + ",".join(f"{float(n)}D" for n in everything) + ")"
    hosts = _counts(rows, "host", langs, "hc").join(rows.groupBy("host").agg(F.first("parent").alias("parent")), "host")
    parents = _counts(rows, "parent", langs, "pc")
    hosts = hosts.join(parents, "parent", "left").select("host", "hc", "pc")
    def smooth(counts: str, prior: str) -> str:
        return f"zip_with({counts}, {prior}, (c, p) -> (c + {STRENGTH}D * p) / (aggregate({counts}, 0D, (s, v) -> s + v) + {STRENGTH}D))"

    hosts = hosts.withColumn("pp", F.expr(smooth("pc", lang_array))).withColumn("hp", F.expr(smooth("hc", "pp"))).select("host", "hp")
    # P(value | language), smoothed by the value's share of all pages
    likely = lambda name: f"zip_with({name}, {by_lang}, (c, n) -> ln((c + 1D) / (n + 20D)))"
    said, ends = _counts(rows, "declared", langs, "dc"), _counts(rows, "suffix", langs, "sc")
    flat = f"array_repeat(0D, {k})"
    fused = (
        rows.join(hosts, "host", "left").join(said, "declared", "left").join(ends, "suffix", "left")
        .withColumn("d", F.expr(f"coalesce({likely('dc')}, {flat})"))
        .withColumn("s", F.expr(f"coalesce({likely('sc')}, {flat})"))
        .withColumn("h", F.expr(f"transform(coalesce(hp, {lang_array}), p -> ln(p))"))
        .withColumn("log", F.expr("zip_with(zip_with(zip_with(ll, d, (a, b) -> a + b), s, (a, b) -> a + b), h, (a, b) -> a + b)"))
        .withColumn("most", F.expr("array_max(log)"))
    )
    names = "array(" + ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in langs) + ")"
    return fused.select(
        "page_id",
        F.expr(f"element_at({names}, cast(array_position(log, most) as int))").alias("lang"),
        F.expr("1D / aggregate(log, 0D, (s, x) -> s + exp(x - most))").alias("probability"),
        "text_lang",
        "declared",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
