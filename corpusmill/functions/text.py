"""Text functions with the string semantics the operators need: Unicode white space, lines, tokens, declarations.

All are Column expressions. NFC is the one thing Spark lacks; `nfc` adds it with an Arrow UDF that only
rows with other than ASCII characters reach.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.rows import by_slices

# fixed values: the token, declaration and fence patterns
TOKEN = r"(?U)[A-Za-z_\u0080-\uffff][\w'.\u0080-\uffff]*|\d+|:=|=>|->|[^\s]"
TACTICS = (
    "simp norm_num linarith nlinarith aesop omega ring ring_nf exact refine rw intro rintro constructor cases induction decide".split()
)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, stripped (P-01)."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in columns))


def identifier(*columns: Column) -> Column:
    """The first non-blank identifier; whole numbers lose their fraction (P-02)."""
    return first_text(*(F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1") for c in columns))


def lines(c: Column) -> Column:
    r"""Lines by \R; a last empty one is dropped (str.splitlines)."""
    parts = F.split(c, r"\R", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse(c: Column) -> Column:
    """All white space runs as one space, stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lexical tokens (H-12)."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


@by_slices(T.StringType())
def _nfc(t):
    return None if t is None else unicodedata.normalize("NFC", t)


def nfc(df: DataFrame, column: str) -> DataFrame:
    """The frame with one column in NFC; only rows that may need it go through Python."""
    other = F.col(column).rlike(r"[^\x00-\x7F]")
    return df.where(~F.coalesce(other, F.lit(False))).unionByName(df.where(other).withColumn(column, _nfc(column)))


def _trim(c: Column) -> Column:
    """`strip`, whose pattern only reads a text that has white space at an end."""
    return let(c, lambda x: F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"(?U)\s"), strip(x)).otherwise(x))


def normalize_lexical(c: Column) -> Column:
    """Line ends, spaces at line ends and runs of blanks, on text already in NFC (H-05).

    Patterns over Unicode classes cost most of this, so each reads only texts in which it has something to replace.
    """
    t = let(c, lambda x: F.when(x.contains("\r"), F.regexp_replace(x, r"\r\n|\r", "\n")).otherwise(x))
    # what $ stands before with (?m), after a blank; there is no \r any more
    ends = lambda x: x.rlike(r"(?Us)[\n\x85\u2028\u2029](?<=[^\S\n].)") | F.right(x, F.lit(1)).rlike(r"(?U)[^\S\n]")
    t = let(t, lambda x: F.when(ends(x), F.regexp_replace(x, r"(?Um)[^\S\n]+$", "")).otherwise(x))
    return _trim(let(t, lambda x: F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)))


def drop_assignment(c: Column) -> Column:
    """Without a trailing := (F-11); only what stands around the last one is read by a pattern."""

    def cut(x, after):
        head = F.left(x, F.length(x) - F.length(after) - 2)
        bare = let(head, lambda h: F.when(F.right(h, F.lit(1)).rlike(r"(?U)\s"), F.regexp_extract(h, r"(?Us)\A(.*\S)", 1)).otherwise(h))
        return F.when(after.rlike(r"(?U)\A\s*\z"), bare).otherwise(x)

    return let(c, lambda x: F.when(x.contains(":="), let(F.substring_index(x, ":=", -1), lambda after: cut(x, after))).otherwise(x))


def statement_form(c: Column) -> Column:
    """The lexical form with the first declaration's name as <DECL_NAME> (H-07)."""
    t = drop_assignment(normalize_lexical(c))
    return F.regexp_replace(t, r"(?s)\A(.*?)((?m:^)\s*(?:theorem|lemma|example|def|instance)\s+)([^\s:(\[{]+)", "$1$2<DECL_NAME>")


def strip_fence(c: Column) -> Column:
    """A Markdown fence around the whole text goes (F-04)."""
    t = strip(c)
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"\n?```\s*\z", "")
    return F.when(t.startswith("```"), strip(inner)).otherwise(c)


def proof_rhs(c: Column) -> Column:
    """Unfenced, stripped, without a leading := (F-06)."""
    return strip(F.regexp_replace(strip(strip_fence(c)), r"^:=", ""))


def proof_format(c: Column) -> Column:
    """full_declaration, full_proof, term_proof or tactic_body (F-08)."""
    t = proof_rhs(c)
    return (
        F.when(declaration_prefix(t), "full_declaration")
        .when(t.rlike(r"^by(?:\s|$)"), "full_proof")
        .when(t.rlike(r"^(?:fun|show|calc|match|nomatch|if|let)(?:\s|$)|^[⟨(@]"), "term_proof")
        .otherwise("tactic_body")
    )


def declaration_prefix(c: Column) -> Column:
    """Whether the text begins a theorem, lemma or example (V-01)."""
    return c.rlike(r"^\s*(?:@\[[^\]]*\]\s*)*(?:(?:private|protected|nonrec)\s+)*(?:theorem|lemma|example)(?:\s+|\()")


def strip_placeholder(c: Column) -> Column:
    """A proof of sorry or admit at the end goes (the three patterns of F-05)."""
    for pattern in (r"(?is)\s*:?\s*=\s*by\s+(?:sorry|admit)\s*$", r"(?is)\s+by\s+(?:sorry|admit)\s*$", r"(?is)\s+(?:sorry|admit)\s*$"):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def completion(c: Column) -> Column:
    """A proof as a completion: by stays, a term becomes by exact (F-17)."""
    t = strip(c)
    return F.when(t.rlike(r"^by(?:\s|$)"), t).otherwise(F.concat(F.lit("by\n  exact "), t))


def prefixes(c: Column, sep: str = ".") -> Column:
    """All prefixes of a dotted name (P-11)."""
    parts = F.split(c, F.lit("\\" + sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def file_name(c: Column) -> Column:
    """Safe file name of at most 120 characters (F-24)."""
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit(120))


def tactic_signature(c: Column) -> Column:
    """Known tactics in order; without any, the first word (F-32)."""
    body = collapse(F.regexp_replace(proof_rhs(c), r"^by\s*", ""))
    words = F.regexp_extract_all(body, F.lit(r"[A-Za-z_][A-Za-z0-9_']*"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(*TACTICS))
    return F.when(F.size(known) > 0, known).otherwise(F.slice(words, 1, 1))


def extract_proof(c: Column) -> Column:
    """The proof within a raw completion (F-25)."""
    t = strip(c)
    fenced = F.regexp_extract(t, r"(?is)```(?:lean\d*|lean)?\s*\n(.*?)(?:\n```|\z)", 1)
    t = F.when(t.rlike(r"(?is)```(?:lean\d*|lean)?\s*\n.*?(?:\n```|\z)"), strip(fenced)).otherwise(t)
    for marker in ("\n\n###", "\n### Informal", "\n### Lean statement"):
        t = F.substring_index(t, marker, 1)
    t = F.substring_index(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), "```", 1)
    prose = t.rlike(r"(?i)^(?:here(?:'s| is)|the proof|we (?:need|show)|this (?:proof|theorem)|to prove|sure\b|i will)\b")
    return F.when(prose, F.lit("")).otherwise(proof_rhs(t))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it (a plain Column is pasted into each lambda)."""
    return F.transform(F.array(value), body)[0]


def output_class(c: Column) -> Column:
    """empty, unterminated_code_fence, multiple_proofs, repetitive_output or normal (F-26)."""
    t = strip(c)
    words = F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: F.array_join(F.slice(w, i, F.lit(3)), "\x00"))
    few = let(words, lambda w: (F.size(w) >= 24) & (F.size(F.array_distinct(grams(w))) / (F.size(w) - 2) < 0.55))
    full = F.array_sort(F.filter(F.transform(lines(t), strip), lambda x: x != ""))
    often = (F.size(words) >= 24) & (longest_run(full) >= 3)
    return (
        F.when(t == "", "empty")
        .when(F.regexp_count(t, F.lit("```")) % 2 == 1, "unterminated_code_fence")
        .when(F.regexp_count(t, F.lit(r"(?m)^\s*by\b")) > 1, "multiple_proofs")
        .when(F.regexp_count(t, F.lit(r"(?m)^\s*(?:theorem|lemma|example)\b")) > 1, "multiple_proofs")
        .when(few | often, "repetitive_output")
        .otherwise("normal")
    )


def longest_run(items: Column) -> Column:
    """Longest run of equal neighbours in an array (W-12 on lines, W-13 on characters)."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["last"].eqNullSafe(x), a["now"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(items, start, step, lambda a: a["most"])


def line_run(c: Column) -> Column:
    return longest_run(F.filter(F.transform(lines(c), strip), lambda x: x != ""))


def char_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
