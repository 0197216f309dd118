"""Source divergence audit: how far the word use of each source of a language is from the others' and from the language's.

A language keeps the terms that at least `MIN_DOCS` of its documents hold. Each (lang, source) group
gives each kept term a share p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), in decimals, so exact.
Counts are pivoted to one wide row a term: an array with a place for each source of the language.
Higher-order functions turn that row into the differences of all pairs of sources; partial sums in
the map tasks leave at most one row a pair and task for the shuffle. A term that neither source of a
pair has adds the same to each such pair; that part is added once, times V, so only terms that one of
the two has make rows.

No key gathers rows: words are counted in the map tasks before they move, a wide row has one entry a
source, and the ranks of a group are cut to `TOP` in the map tasks (a group limit under the window).
What is wide grows with the sources of one language alone: the arrays, the row of `langs`, and the
report itself, which has a row for each pair.

Edge cases: null text, lang or source count as ''; a text without terms still makes its group and
counts as a document; repeated rows are documents of their own; ties are ranked by the item's UTF-8
bytes; a language without kept terms has pairs of value 0 and no terms; one with a single source has
no pairs; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Sources of all `langs` that are sent to every task; beyond it the join is shuffled.
SENT = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates terms: ASCII but letters.
SEPARATORS = r"[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _terms_of(docs: DataFrame, terms: str) -> DataFrame:
    """(lang, source, term): a row for each of these terms of each text; terms is SQL over its words w."""
    words = f"split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}')"
    return docs.selectExpr("coalesce(lang, '') as lang", "coalesce(source, '') as source", f"explode({terms.format(w=words)}) as term").where("term <> ''")


def wide_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, at): kept terms with their count in each source that has them, by source."""
    kept = _terms_of(docs, "array_distinct({w})").groupBy("lang", "term").count().where(F.col("count") >= min_docs).select("lang", "term")
    counts = _terms_of(docs, "{w}").groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
    return counts.join(kept, ["lang", "term"]).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("at"))


def languages(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, sources, n array, total, v): the sources of a language in order, and the kept occurrences in each."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = wide.select("lang", F.explode("at").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total"))
    in_order = groups.join(kept, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    return in_order.join(vocabulary, "lang", "left").selectExpr("lang", "s.source as sources", "s.n as n", "coalesce(total, 0L) as total", "coalesce(v, 0L) as v")


def _share(count: str, n: str, v: str) -> str:
    """SQL: the share of a term, exact in decimals; null without kept terms."""
    return f"(1 + (cast({count} + {PRIOR} as decimal(20,0)) * {SCALE}) div nullif(cast({n} as decimal(20,0)) + {PRIOR} * {v}, 0))"


def _pairs(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources: the sum over kept terms of their distance."""
    apart = "abs(p[i] - p[j]) - abs(p0[i] - p0[j])"
    places = "transform(sources, (s, k) -> k)"
    held = f"filter({places}, k -> c[k] > 0)"
    # i has the term; j is any other, but of two that have it only the larger one
    each = f"transform(filter({places}, j -> j <> i and (c[j] = 0 or i < j)), j -> named_struct('i', least(i, j), 'j', greatest(i, j), 'f', {apart}))"
    given = terms.selectExpr("lang", f"inline(flatten(transform({held}, i -> {each})))").where("f <> 0").groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    bare = langs.selectExpr("lang", "sources", "v", f"transform(n, m -> {_share('0L', 'm', 'v')}) as p0")
    bare = bare.selectExpr("lang", "sources", "v", "p0", f"explode({places}) as i").selectExpr("lang", "sources", "v", "p0", "i", f"explode(filter({places}, j -> j > i)) as j")
    bare = bare.selectExpr("lang", "i", "j", "sources[i] as a", "sources[j] as b", "coalesce(v * abs(p0[i] - p0[j]), 0L) as base")
    whole = bare.join(given, ["lang", "i", "j"], "left").selectExpr("lang", "a", "b", "base + coalesce(f, 0L) as value")
    return whole.selectExpr("lang", "inline(array(named_struct('source', a, 'item', b, 'value', value), named_struct('source', b, 'item', a, 'value', value)))")


def _terms(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has and that have a larger share there than in the language."""
    more = "transform(filter(transform(sources, (s, k) -> k), k -> c[k] > 0 and p[k] > q), k -> named_struct('source', sources[k], 'value', p[k] - q))"
    return terms.selectExpr("lang", "term as item", f"inline({more})").select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources by distance, and the terms that a source has more of than its language."""
    wide = materialise(wide_terms(docs, min_docs), "wide")
    langs = materialise(languages(docs, wide), "languages")
    size = langs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    small = (F.broadcast(langs) if size <= SENT else langs).withColumnRenamed("total", "every")
    terms = wide.join(small, "lang").selectExpr("lang", "term", "sources", "n", "v", f"{_share('total', 'every', 'v')} as q", "transform(sources, s -> coalesce(at[s], 0L)) as c")
    terms = terms.selectExpr("*", f"zip_with(c, n, (x, m) -> {_share('x', 'm', 'v')}) as p", f"transform(n, m -> {_share('0L', 'm', 'v')}) as p0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(_pairs(terms, langs), "pair").union(ranked(_terms(terms), "term").where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, term, id, count(*) AS n FROM (SELECT lang, source, id, unnest(w) AS term FROM d) x GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, CAST(sum(t.n) AS HUGEINT) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS c,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.total + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM gn JOIN v ON v.lang = gn.lang JOIN kept k ON k.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) x WHERE rank <= 50)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
