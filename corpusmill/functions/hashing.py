"""Fingerprints and identities: SHA-256 over exact text, canonical JSON, length-prefixed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text


def exact(c: Column) -> Column:
    """H-01."""
    return F.sha2(c, 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept (H-04)."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def json_hash(**fields: Column) -> Column:
    return exact(canonical_json(**fields))


def statement_prep(c: Column) -> Column:
    """Statement hash that keeps the name and collapses white space (H-02)."""
    return exact(text.collapse(text.strip_fence(text.drop_assignment(text.strip(c)))))


def proof(c: Column) -> Column:
    """H-03."""
    return exact(text.collapse(text.proof_rhs(c)))


def normalized(c: Column) -> Column:
    """H-06."""
    return exact(text.normalize_lexical(c))


def statement(c: Column) -> Column:
    """Statement hash without the declaration's name (H-07)."""
    return exact(text.statement_form(c))


def theorem_group(c: Column) -> Column:
    """H-10."""
    return F.concat(F.lit("theorem_"), statement(c))


def structural(c: Column) -> Column:
    """Tokens without declaration kind and name (H-11)."""
    form = text.drop_assignment(text.normalize_lexical(c))
    bare = F.regexp_replace(form, r"(?s)\A(.*?)(?m:^\s*(?:theorem|lemma|example|def|instance)\s+[^\s:(\[{]+)", "$1<DECL> <DECL_NAME>")
    return exact(F.array_join(text.tokens(bare), " "))


def source_identity(commit: Column, file: Column, name: Column, span: Column) -> Column:
    """H-08; rows without any source share one hash, as in the source contract."""
    return json_hash(repository_commit=commit, source_file=file, qualified_name=name, source_span=F.coalesce(span, F.lit("{}")))


def premises(c: Column) -> Column:
    """Sorted distinct premise names (H-09)."""
    return F.array_sort(F.array_distinct(c))


def attestation(*parts: Column) -> Column:
    """H-14: parts joined by |, null as empty."""
    return exact(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def length_prefixed(*parts: Column) -> Column:
    """H-17: an 8-byte big-endian length before each part."""
    out = []
    for p in parts:
        out += [F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary")]
    return F.sha2(F.concat(*out), 256)


def order_key(seed: int, *parts: Column) -> Column:
    """O-02 and O-03: SHA-256 of seed:part:part."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def jaccard(a: Column, b: Column) -> Column:
    """H-13: of two token arrays as sets; 1 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def payload(df: DataFrame, without: str) -> Column:
    """H-18: hash of a row as JSON, but for the column that holds its hash."""
    return json_hash(**{c: F.col(c) for c in df.columns if c != without})
