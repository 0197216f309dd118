"""P-12: records in four layers (raw, executable, training, fingerprint), their tactic traces checked within the row."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import hashing, text

# fixed values: the layers' version and what each holds, and the fields that may name a premise
VERSION = "leandojo-v2-four-layer-v1"
LAYERS = {
    "raw": "source-faithful fields prefixed raw_",
    "executable": "metadata.assembled_source and assembled_source_hash",
    "training": "training_statement/training_proof/training_declaration",
    "fingerprint": "exact and conservative normalized hashes",
}
PREMISE_NAMES = ("qualified_name", "full_name", "name", "declaration")
#: Strings of a step, in the order in which they are laid out.
STEP = ("state_before", "tactic", "state_after")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfc(c: pa.Array) -> pa.Array:
    values = c.flatten()
    other = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
    if pc.any(other).as_py():
        values = pc.replace_with_mask(values, other, pa.array([unicodedata.normalize("NFC", x) for x in values.filter(other).to_pylist()], values.type))
    lengths = pc.fill_null(pc.list_value_length(c), 0)
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False)))), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=c.is_null() if c.null_count else None)


def nfc(c: Column) -> Column:
    """An array of strings in NFC; only rows with other than ASCII characters carry their strings to Python."""
    return F.coalesce(_nfc(F.when(F.exists(c, lambda x: F.octet_length(x) != F.length(x)), c)), c)


def display(c: Column) -> Column:
    """F-44: line ends as line feeds, no white space before them or at the ends, on text in NFC."""
    feeds = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", "")
    lined = F.when(c.contains("\r") | (c.contains("\n") & c.rlike(r"(?U)\n(?<=[\s&&[^\n]]\n)")), feeds).otherwise(c)
    # patterns over Unicode classes cost most of this, so what has no blank before a line end, or no blank end, is spared them
    return text.let(lined, lambda x: F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"(?U)\s"), text.strip(x)).otherwise(x))


def style(proof: Column, declared: Column) -> Column:
    """tactic_by, term, or mixed where that is declared (F-09)."""
    mixed = F.coalesce(F.lower(declared), F.lit("")) == "mixed"
    return F.when(mixed, "mixed").when(proof.rlike(r"^(?U:\s*)by(?:\z|[\n ])"), "tactic_by").otherwise("term")


def premise_names(c: Column) -> Column:
    """H-09: sorted distinct names of premises that are names or JSON objects; an object without a name stands by its hash."""

    def name(p):
        fields = (F.nullif(F.get_json_object(p, f"$.{k}"), F.lit("")) for k in PREMISE_NAMES)
        return F.when(p.startswith("{"), F.coalesce(*fields, hashing.exact(p))).otherwise(p)

    given = F.array_distinct(F.coalesce(c, F.expr("cast(array() as array<string>)")))  # a premise that is named often is looked at once
    return F.sort_array(F.array_distinct(F.transform(F.filter(given, lambda p: p.isNotNull()), name)))


def identity(commit: Column, file: Column, name: Column, span: Column) -> Column:
    """H-08 with the span as a JSON object."""
    body = F.to_json(F.struct(name.alias("qualified_name"), commit.alias("repository_commit"), file.alias("source_file")), {"ignoreNullFields": "false"})
    return hashing.exact(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"source_span":'), F.coalesce(span, F.lit("{}")), F.lit("}")))


def normalised(rows: DataFrame) -> DataFrame:
    """Candidates with all their columns as they are, and their layers beside them; `error` says why a row has none.

    Columns: statement, proof; and, where there are such, declaration_source, raw_declaration, proof_style,
    premises (array<string>: names or JSON objects with sorted keys), tactic_trace (array<struct<step_index, state_before,
    tactic, state_after, ...>>), file_dependencies, repository_commit, source_commit, mathlib_commit, source_file,
    qualified_name, source_declaration, source_span (struct), metadata (struct), verification
    (struct<compile_success, timed_out, error_category>). Empty strings count as missing, as does null; a null step keeps its place
    but is no step. Nothing is shuffled. Columns named like a layer's are replaced.
    """
    have = set(rows.columns)
    column = lambda *names: F.coalesce(F.lit(None).cast("string"), *(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have))
    trace = F.col("tactic_trace") if "tactic_trace" in have else F.expr("cast(array() as array<struct<step_index int, state_before string, tactic string, state_after string>>)")
    trace = F.coalesce(trace, F.expr("array()").cast(rows.schema["tactic_trace"].dataType)) if "tactic_trace" in have else trace
    check = "verification" in have
    flag = lambda name: F.coalesce(F.col(f"verification.{name}") if check else F.lit(None).cast("boolean"), F.lit(False))
    category = F.nullif(F.col("verification.error_category"), F.lit("")) if check else F.lit(None).cast("string")

    strings = F.concat(F.array(column("statement"), column("proof")), F.flatten(F.transform(trace, lambda s: F.array(*(s[k] for k in STEP)))))
    df = rows.withColumns({"__trace": trace, "__strings": strings, "__declared": column("declaration_source", "raw_declaration")})
    df = df.withColumn("__nfc", nfc(F.col("__strings")))
    df = df.withColumn("__shown", F.transform("__nfc", display))
    at = lambda i, k: F.get("__shown", F.lit(2) + i * 3 + F.lit(k))
    named = lambda s, i: [F.when(s.isNotNull(), i).alias("normalized_step_index"), *(at(i, k).alias(f"normalized_{c}") for k, c in enumerate(STEP))]
    fields = [f.name for f in df.schema["__trace"].dataType.elementType.fields]
    steps = F.transform("__trace", lambda s, i: F.when(s.isNotNull(), F.struct(*(s[f].alias(f) for f in fields), *named(s, i))))
    statement, proof = F.get("__shown", F.lit(0)), F.get("__shown", F.lit(1))
    missing = column("statement").isNull() | column("proof").isNull() | F.col("__declared").isNull()
    df = df.withColumns({"training_statement": text.drop_assignment(statement), "training_proof": proof, "normalized_tactic_trace": steps})
    df = df.withColumn("error", F.when(missing, "statement, proof, and declaration source are required").when(proof == "", "training proof is empty"))

    success, late = flag("compile_success"), flag("timed_out")
    span = F.col("source_span") if "source_span" in have else None
    if span is not None:
        span = F.to_json(F.struct(*(span[f].alias(f) for f in sorted(x.name for x in rows.schema["source_span"].dataType.fields))))
    raw = F.col("premises") if "premises" in have else F.expr("cast(array() as array<string>)")
    layers = F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair))
    form = F.get("__nfc", F.lit(0))
    out = {
        "raw_statement": column("statement"), "raw_proof": column("proof"), "raw_declaration_source": F.col("__declared"), "raw_tactic_trace": F.col("__trace"),
        "raw_premises": F.coalesce(raw, F.expr("cast(array() as array<string>)")), "raw_file_dependencies": F.col("file_dependencies") if "file_dependencies" in have else F.expr("cast(array() as array<string>)"),
        "training_statement": F.col("training_statement"), "training_proof": F.col("training_proof"),
        "training_declaration": F.concat("training_statement", F.lit(" := "), "training_proof"),
        "proof_style": style(F.col("training_proof"), column("proof_style")),
        "statement_hash_exact": hashing.exact(column("statement")), "statement_hash_normalized": hashing.statement(form),
        "proof_hash_exact": hashing.exact(column("proof")), "proof_hash_normalized": hashing.normalized(F.get("__nfc", F.lit(1))),
        "declaration_hash_exact": hashing.exact(F.col("__declared")),
        "source_identity_hash": identity(column("repository_commit", "source_commit", "mathlib_commit"), column("source_file"), column("qualified_name", "source_declaration"), span if span is not None else F.lit(None).cast("string")),
        "premise_set_canonical": premise_names(raw),
        "verification_status": F.when(success & ~late, "verified_default_timeout").when(late, "timeout_quarantine").otherwise("compile_failure_quarantine"),
        "verification_class": F.coalesce(category, F.when(success, "success").otherwise("unknown")),
        "normalization_version": F.lit(VERSION), "normalized_tactic_trace": F.col("normalized_tactic_trace"), "tactic_trace_validation": validation(F.col("normalized_tactic_trace")),
    }
    meta = F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("normalization_layers", layers)) if "metadata" in have else F.struct(layers.alias("normalization_layers"))
    out["metadata"] = F.coalesce(meta, F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema["metadata"].dataType.fields), layers.alias("normalization_layers"))) if "metadata" in have else meta
    df = df.withColumns({k: F.when(F.col("error").isNull(), v) for k, v in out.items()})
    df = df.withColumns({"theorem_group_id": F.concat(F.lit("theorem_"), "statement_hash_normalized"), "premise_set_hash": hashing.exact(F.to_json("premise_set_canonical"))})
    return df.drop("__trace", "__strings", "__nfc", "__shown", "__declared")


def validation(trace: Column) -> Column:
    """Of a normalised trace: steps numbered from 0 without gaps, each beginning with the state that the last left, the last with no goals."""

    def checks(steps):
        n = F.size(steps)
        indices = F.transform(steps, lambda s: s["step_index"])
        meets = F.zip_with(F.slice(steps, 1, F.greatest(n - 1, F.lit(0))), F.slice(steps, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.coalesce(a["normalized_state_after"] == b["normalized_state_before"], F.lit(True)))
        last = F.coalesce(F.lower(F.get(steps, n - 1)["normalized_state_after"]), F.lit(""))
        return F.struct(
            F.forall(F.transform(indices, lambda x, i: F.coalesce(x == i, F.lit(False))), lambda x: x).alias("step_indices_continuous"),
            F.forall(meets, lambda x: x).alias("adjacent_states_aligned"), last.isin("no goals", "").alias("final_goal_closed"), n.alias("step_count"),
        )

    return text.let(F.filter(trace, lambda s: s.isNotNull()), checks)
