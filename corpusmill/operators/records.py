"""Record adapters and projections: source rows to normalised rows, manifests, prompts, states and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import hashing, scanner, text
from corpusmill.sources.records import register_adapter


def first_match(rules: dict[str, Column], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds (P-28 to P-31)."""
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(otherwise) if otherwise is not None else out


def imports_valid(imports: Column) -> Column:
    """P-03: null, a string, or a JSON list of strings (given as JSON text)."""
    items = F.from_json(imports, "array<string>")
    return imports.isNull() | ~imports.startswith("[") | (items.isNotNull() & F.forall(items, lambda x: x.isNotNull()))


# fixed values: how a line of context begins, and what a bare module name looks like
CONTEXT_LINES = (
    "open ", "open scoped ", "namespace ", "section", "variable ", "variables ", "universe ", "universes ", "noncomputable section", "set_option ",
    "local notation ", "local instance ", "notation ", "attribute ", "include ", "omit ",
)
MODULE = r"^[A-Z][A-Za-z0-9_']*(?:\.[A-Z][A-Za-z0-9_']*)*$"


def preamble(lines: Column, header: Column | None = None) -> Column:
    """F-15: preamble lines as imports (distinct), context and unknown ones; unknown lines are context too, in their place.

    Lines of a header are imports only where they say so; a bare module name among them is unknown.
    """
    kind = lambda x, bare: F.when(x.startswith("import "), "import").when(_any_start(x, CONTEXT_LINES), "context").when(bare & x.rlike(MODULE), "import").otherwise("unknown")
    cut = lambda xs, bare: F.transform(F.filter(F.transform(xs, text.strip), lambda x: x != ""), lambda x: F.struct(kind(x, F.lit(bare)).alias("kind"), x.alias("line")))
    found = cut(lines, True)
    if header is not None:
        found = F.concat(found, cut(text.lines(F.coalesce(header, F.lit(""))), False))
    of = lambda *kinds: F.transform(F.filter(found, lambda x: x["kind"].isin(*kinds)), lambda x: x["line"])
    modules = F.filter(F.transform(of("import"), lambda x: text.strip(F.regexp_replace(x, r"^import ", ""))), lambda x: x != "")
    return F.struct(F.array_distinct(modules).alias("imports"), of("context", "unknown").alias("context"), of("unknown").alias("unknown"))


def _any_start(c: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | c.startswith(s)
    return out


def open_scopes(context: Column) -> Column:
    """F-13: how many namespaces and sections are open after these lines; an end without one closes nothing."""
    step = lambda n, x: F.when(x.startswith("namespace ") | (x == "section") | x.startswith("section "), n + 1).when((x == "end") | x.startswith("end "), F.greatest(n - 1, F.lit(0))).otherwise(n)
    return F.aggregate(F.transform(context, text.strip), F.lit(0), step)


def wrapped_source(declaration: Column, context: Column, namespace: Column, label: Column) -> Column:
    """F-13: a declaration below its context lines, within a namespace, with an end for each scope left open; null parts are left out."""
    lines_ = F.filter(F.transform(F.coalesce(context, F.array().cast("array<string>")), text.strip), lambda x: x != "")
    ends = F.array_repeat(F.lit("end"), open_scopes(lines_))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.when(namespace.isNotNull(), F.array(F.concat(F.lit("namespace "), namespace), F.lit(""))).otherwise(none),
        F.when(F.size(lines_) > 0, F.concat(lines_, F.array(F.lit("")))).otherwise(none),
        F.when(label.isNotNull(), F.array(F.concat(F.lit("-- label: "), label))).otherwise(none),
        F.array(text.strip(declaration)),
        F.when(F.size(ends) > 0, F.concat(F.array(F.lit("")), ends)).otherwise(none),
        F.when(namespace.isNotNull(), F.array(F.lit(""), F.concat(F.lit("end "), namespace))).otherwise(none),
    )
    return F.concat(text.strip(F.array_join(parts, "\n")), F.lit("\n"))


def reconstruction_reason(recovered: Column, found: Column, steps: Column, contiguous: Column, final_state: Column, proof: Column, forbidden: Column, name: Column) -> Column:
    """P-30: why a reconstructed declaration is quarantined, first match wins; null: it is not."""
    return first_match({
        "invalid_syntax": ~recovered,
        "missing_context": ~found,
        "empty_proof": steps == 0,
        "corrupt_tactic_trace": ~contiguous,
        "unsolved_goals": text.strip(F.coalesce(final_state, F.lit(""))) != "no goals",
        "empty_proof_text": F.coalesce(proof, F.lit("")) == "",
        "forbidden_declaration": forbidden,
        "private_declaration": name.contains("_private."),
    })


def workbook(df: DataFrame) -> DataFrame:
    """P-05, P-13: id, formal_statement, tactic to id, statement, proof and their hashes."""
    rows = df.select(text.identifier(F.col("id")).alias("id"), text.strip_placeholder(F.col("formal_statement")).alias("statement"), text.proof_rhs(F.col("tactic")).alias("proof"))
    return rows.withColumns({"statement_hash": hashing.statement_prep(F.col("statement")), "proof_hash": hashing.proof(F.col("proof"))})


def generic(df: DataFrame, column: str = "code") -> DataFrame:
    """P-07: a statement and a proof of their own, else those that the code splits into."""
    split = scanner.split_declaration(df, column)
    return split.withColumns({"statement": F.coalesce(text.first_text(F.col("statement")), F.col("parts.statement")), "proof": F.coalesce(text.first_text(F.col("proof")), F.nullif(F.col("parts.proof"), F.lit("")))}).drop("parts")


def benchmark_rows(df: DataFrame) -> DataFrame:
    """P-06: verified rows of the valid and test splits."""
    return df.where(F.col("split").isin("valid", "test") & F.col("verified"))


def statement_only(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """P-09, P-10, P-19: rows must carry no proof; they are returned with the fields that do."""
    bad = F.array_compact(F.array(*(F.when(text.first_text(F.col(c)).isNotNull(), F.lit(c)) for c in forbidden if c in df.columns)))
    return df.withColumn("proof_fields", bad)


def sft_pair(df: DataFrame) -> DataFrame:
    """P-18, P-20: prompt and completion."""
    return df.select("id", F.concat("statement", F.lit(" :=\n")).alias("prompt"), text.completion(F.col("proof")).alias("completion"))


def evaluation_row(df: DataFrame) -> DataFrame:
    """P-21."""
    return df.select("id", "statement", F.lit("grpo").alias("data_stage"), F.lit("train").alias("split"), F.lit("evaluation_data").alias("schema_version"))


def transition(df: DataFrame) -> DataFrame:
    """P-24: (statement_verified, proof_verified, environment) to a state and its attestation."""
    ok = F.coalesce(F.col("statement_verified") & F.col("proof_verified"), F.lit(False))
    out = df.withColumn("status", F.when(ok, "verified").otherwise("quarantined"))
    return out.withColumn("attestation_id", F.when(ok, hashing.attestation(F.col("id"), F.col("environment"))))


def annotate(df: DataFrame, source: str, experiment: str) -> DataFrame:
    """P-25."""
    return df.drop("weight").withColumns({"manifest_source": F.lit(source), "experiment": F.lit(experiment)})


def goals_closed(state: Column, vocabulary: tuple[str, ...] = ("no goals",)) -> Column:
    """The final state says that nothing is left (each source has its own vocabulary)."""
    return F.coalesce(text.strip(state).isin(*vocabulary), F.lit("") == F.lit("x"))


def hypotheses(state: Column) -> Column:
    """F-19: locals of a proof state: names and types of the lines before the goal."""
    before = F.filter(text.lines(state), lambda x: x.contains(" : ") & ~x.startswith("⊢"))
    return F.transform(before, lambda x: F.struct(F.split(F.substring_index(x, " : ", 1), " ").alias("names"), F.regexp_replace(x, r"^.*? : ", "").alias("type")))


def prompt_parts(prompt: Column) -> Column:
    """F-41: the sections that ### headings begin."""
    return F.transform(F.filter(F.split(prompt, r"(?m)^### "), lambda x: text.strip(x) != ""), lambda x: F.struct(text.strip(F.substring_index(x, "\n", 1)).alias("title"), text.strip(F.regexp_replace(x, r"\A[^\n]*\n?", "")).alias("body")))


def module_name(path: Column) -> Column:
    """F-45: a source path as a dotted module."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./|\.lean$", ""), F.lit("/"), F.lit("."))


def declaration_name(code: Column) -> Column:
    """F-46."""
    return F.nullif(F.regexp_extract(code, r"(?m)^\s*(?:theorem|lemma|example|def|instance)\s+([^\s:(\[{]+)", 1), F.lit(""))


def split_last_declaration(source: Column) -> Column:
    """F-10: what stands before the last declaration, and that declaration."""
    pattern = r"(?s)\A(.*)((?m:^)\s*(?:theorem|lemma|example)\b.*)\z"
    return F.struct(text.strip(F.regexp_extract(source, pattern, 1)).alias("context"), text.strip(F.regexp_extract(source, pattern, 2)).alias("target"))


def legacy_diagnostics(diagnostics: Column) -> Column:
    """F-47: one text of messages as errors and warnings."""
    found = F.filter(F.transform(text.lines(F.coalesce(diagnostics, F.lit(""))), text.strip), lambda x: x != "")
    return F.struct(F.filter(found, lambda x: x.rlike(r"\berror\b")).alias("errors"), F.filter(found, lambda x: x.rlike(r"\bwarning\b")).alias("warnings"))


register_adapter("lean_workbook", workbook)
register_adapter("minif2f", benchmark_rows)


#: Fields of a source context, by the part of it that they belong to; each part is hashed as JSON with sorted keys.
CONTEXT_PARTS = {
    "namespace": {"lexical": "namespaces", "sections": "sections"},
    "scope": {"open_namespaces": "open_namespaces", "scopes": "scopes", "local_notations": "local_notations", "local_attributes": "local_attributes", "options": "option_commands"},
    "variables": {"variables": "variables", "hypotheses": "hypotheses", "variable_commands": "variable_commands", "local_instances": "local_instances"},
}


def context_hashes(df: DataFrame, inside: str | None = None) -> Column:
    """H-15: imports_hash, namespace_hash, scope_hash, variable_context_hash and context_hash of a context's columns, or of those of a struct; a field that is absent is an empty list."""
    kinds = {f.name: f.dataType for f in (df.schema[inside].dataType if inside else df.schema)}
    at = lambda c: F.col(f"{inside}.{c}" if inside else c)
    field = lambda c: F.coalesce(at(c), F.array().cast(kinds[c])) if c in kinds else F.array().cast("array<string>")
    part = lambda name: F.struct(*(field(c).alias(k) for k, c in sorted(CONTEXT_PARTS[name].items())))
    one = lambda c: at(c).cast("string") if c in kinds else F.lit(None).cast("string")
    hashed = lambda c: hashing.exact(F.to_json(c, {"ignoreNullFields": "false"}))
    whole = F.struct(
        field("active_commands").alias("active_commands"), field("closing_commands").alias("closing_commands"), part("namespace").alias("namespace"),
        F.coalesce(one("recovery_method"), F.lit("")).alias("recovery_method"), part("scope").alias("scope"), one("source_hash").alias("source_hash"), part("variables").alias("variables"),
    )
    return F.struct(
        hashed(field("imports")).alias("imports_hash"), hashed(part("namespace")).alias("namespace_hash"), hashed(part("scope")).alias("scope_hash"),
        hashed(part("variables")).alias("variable_context_hash"), hashed(whole).alias("context_hash"),
    )
