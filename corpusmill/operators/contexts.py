"""Source contexts on records: recovered, put on the record, projected, and replayed around a declaration.

A context is a struct column with the lists of `functions.contexts` and how it was come by. Rows whose
context cannot be recovered stay in the frame, quarantined, with the reason; `sides` parts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import contexts as C
from corpusmill.functions import hashing, scanner, text
from corpusmill.operators.records import context_hashes
from corpusmill.sources.shared import materialise

# fixed values: what a partial context warns of
PARTIAL_WARNINGS = (
    "source_file_unavailable", "imports_not_recovered_using_fixed_target_import_Mathlib", "namespace_unavailable", "open_namespace_unavailable", "scope_unavailable",
    "section_context_unavailable", "local_notation_unavailable", "proof_state_locals_are_audit_only_and_not_replayed",
)
PARTIAL_ERROR = "source_lookup_unavailable: Lean-Workbook exposes no source file or declaration location"
_NONE = "cast(array() as array<string>)"


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr(_NONE)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr(_NONE))


def trace_proof(tactics: Column) -> Column:
    """The tactics of a trace as one proof; null where there are none."""
    lines = F.flatten(F.transform(F.filter(tactics, lambda t: text.strip(F.coalesce(t, F.lit(""))) != ""), lambda t: text.lines(text.strip(t))))
    body = F.array_join(F.transform(lines, lambda x: F.when(text.strip(x) != "", F.concat(F.lit("  "), x)).otherwise("")), "\n")
    return F.when(F.size(lines) > 0, F.concat(F.lit("by\n"), body))


def from_sources(records: DataFrame) -> DataFrame:
    """P-17: the context of each record's source line, and its statement and proof as the source has them.

    records: record_id, source (the file's text, null where none was found), source_file, source_commit,
    source_line, raw_declaration, tactics array<string>, statement, proof, imports, namespace. Each row
    comes back once, with data_state 'raw' and a context, or 'quarantined' and all that was against it.
    """
    df = records.withColumns({"_c": C.contexts("source", "source_line"), "_d": F.struct(F.lit(None).cast("string").alias("x"))})
    df = scanner.split_declaration(df, "raw_declaration", "_d")
    blank = lambda c: F.coalesce(text.strip(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank("source_file") | blank("source_commit") | F.col("source_line").isNull(), "record lacks source_file, source_commit, or declaration line")
        .when(F.col("source").isNull(), F.concat(F.lit("source file not found: "), "source_file"))
        .when(F.col("_c.error").isNotNull(), F.col("_c.error"))
        .when(blank("raw_declaration"), "corpus declaration has no parseable declaration header")
        .when(F.col("_d.error").isNotNull(), F.col("_d.error"))
        .when(F.coalesce(F.col("_d.statement"), F.lit("")) == "", "corpus declaration has no parseable declaration header")
    )
    df = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    lost = {"imports": _list("imports"), "namespaces": F.filter(F.split(F.coalesce("namespace", F.lit("")), r"\."), lambda x: x != "")}
    pick = lambda c: F.when(good, F.col(f"_c.{c}")).otherwise(lost.get(c, F.expr(_NONE))).alias(c)
    context = F.struct(
        *map(pick, C.LISTS),
        F.when(good, F.col("_c.variables")).otherwise(F.array().cast(C.CONTEXT["variables"].dataType)).alias("variables"),
        F.array().cast(C.CONTEXT["variables"].dataType).alias("hypotheses"),
        "source_file", "source_commit", "source_line", good.alias("context_recovered"),
        F.when(good, "historical_git_source_and_declaration_location").otherwise("source_file_lookup_failed").alias("recovery_method"),
        F.when(good, "full").otherwise("unavailable").alias("recovery_status"),
        F.when(good, _strings("source_file", "declaration_location")).otherwise(F.expr(_NONE)).alias("recovery_sources"),
        F.expr(_NONE).alias("context_warnings"), F.when(good, F.expr(_NONE)).otherwise(F.array("reason")).alias("recovery_errors"),
        F.when(good, F.col("_c.source_hash")).alias("source_hash"),
    )
    head = text.strip(F.col("_d.statement"))
    return df.withColumns({
        "context": context, "proof_state_statement": F.col("statement"), "statement": F.when(good, head).otherwise(F.col("statement")),
        "proof": F.when(good, F.coalesce(trace_proof(F.col("tactics")), "proof")).otherwise(F.col("proof")),
        "data_state": F.when(good, "raw").otherwise("quarantined"), "verification_error_type": F.when(~good, "missing_context"),
    }).withColumn("statement_id", F.when(good, F.concat(F.lit("stmt_"), hashing.statement_prep(F.col("statement"))))).drop("_c", "_d")


def from_states(records: DataFrame, steps: DataFrame) -> DataFrame:
    """P-16: a partial context from the first proof state of each record's steps (record_id, step, state_before, tactic, state_after); nothing of it is replayed.

    The hash is of the steps in order, each as JSON with sorted keys. Every record comes back once, whether it has steps or not.
    """
    row = F.struct("step", F.struct("state_after", "state_before", "tactic").alias("row"))
    rows = steps.groupBy("record_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    df = records.join(rows, "record_id", "left").withColumn("_rows", F.transform(F.coalesce("_rows", F.array().cast(rows.schema["_rows"].dataType)), lambda x: x["row"]))
    state = F.coalesce(F.get("_rows", F.lit(0))["state_before"], F.lit(""))
    df = df.withColumn("_l", C.locals_of(state))
    sources = F.array_compact(F.array(F.when(state.contains("⊢"), "proof_state"), F.when(F.coalesce("statement", F.lit("")) != "", "statement"), F.when(F.size("_rows") > 0, "tactic_trace")))
    empty = [F.expr(_NONE).alias(c) for c in C.LISTS if c not in ("imports", "local_instances")]
    context = F.struct(
        F.when(F.size(_list("imports")) > 0, F.col("imports")).otherwise(_strings("Mathlib")).alias("imports"), "_l.local_instances", *empty, "_l.variables", "_l.hypotheses",
        F.lit(None).cast("string").alias("source_file"), "source_commit", "source_line", F.lit(False).alias("context_recovered"),
        F.lit("proof_state_statement_and_tactic_trace_only").alias("recovery_method"), F.lit("partial").alias("recovery_status"), sources.alias("recovery_sources"),
        _strings(*PARTIAL_WARNINGS).alias("context_warnings"), _strings(PARTIAL_ERROR).alias("recovery_errors"),
        hashing.exact(F.to_json("_rows", {"ignoreNullFields": "false"})).alias("source_hash"),
    )
    return df.withColumn("context", context).drop("_l", "_rows")


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows in quarantine): every row is on exactly one side."""
    bad = F.coalesce(F.col("data_state") == "quarantined", F.lit(False))
    return df.where(~bad), df.where(bad)


#: Lists that a record takes from its context as they are.
TAKEN = ("namespaces", "open_namespaces", "scopes", "variables", "hypotheses", "local_instances", "local_notations", "local_attributes", "context_warnings")


def applied(df: DataFrame, environment: str) -> DataFrame:
    """P-14: the context's fields on the record; imports, namespace, file and commit stay the record's own where the context has none."""
    c = lambda name: F.col(f"context.{name}")
    some = lambda name: F.when(F.size(c(name)) > 0, c(name))
    return df.withColumns({
        **{name: c(name) for name in TAKEN}, "id": F.col("record_id"),
        "imports": F.coalesce(some("imports"), "imports"), "namespace": F.coalesce(F.nullif(F.array_join(c("namespaces"), "."), F.lit("")), "namespace"),
        "source_kind": F.when(F.lower("source_dataset").contains("leandojo"), "leandojo").otherwise("lean_workbook"),
        "section_context": F.struct(*(c(name).alias(name) for name in ("sections", "active_commands", "closing_commands"))),
        "source_file": F.coalesce(F.nullif(c("source_file"), F.lit("")), "source_file"), "source_commit": F.coalesce(F.nullif(c("source_commit"), F.lit("")), "source_commit"),
        "environment_hash": F.lit(environment), "context_hashes": context_hashes(df, "context"), "recovered_source_hash": c("source_hash"),
        **{f"context_{name}": c(name) for name in ("recovery_method", "recovery_status", "recovery_sources")} | {"context_recovered": c("context_recovered")},
        "source_lookup_attempted": F.coalesce(c("source_file"), F.lit("")) != "",
    })


def payload(df: DataFrame) -> DataFrame:
    """P-15: the schema that audits of contexts read, of records that `applied` gives; no value is null but statement and proof."""
    given = lambda name, other: F.coalesce(F.col(name), F.lit(other)).alias(name)
    return df.select(
        F.coalesce("id", "record_id").alias("id"), F.coalesce("source_kind", "source_dataset").alias("source"), "statement", "proof", "imports", *TAKEN[:7], "section_context",
        given("source_file", ""), given("environment_hash", ""), "context_recovered", "context_recovery_method", "context_recovery_status", "context_recovery_sources",
        "context_warnings", F.struct("context", "context_hashes", "source_lookup_attempted").alias("metadata"),
    )


def assembled(df: DataFrame) -> DataFrame:
    """F-43: the frame with `assembled`, the declaration between the commands of its context and their closings, and `assembly_error`.

    Where the context has no commands to replay, they are made from the record's own lists: variables,
    opens, scopes, notations, attributes and namespaces, which are closed from the innermost out.
    """
    lines = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    active, closing = lines(_list("context.active_commands")), lines(_list("context.closing_commands"))
    spaces = F.when(F.size(_list("namespaces")) > 0, F.col("namespaces")).otherwise(F.array_compact(F.array(F.nullif("namespace", F.lit("")))))
    each = lambda c, word: F.transform(c, lambda x: F.concat(F.lit(word), x))
    own = F.concat(
        F.array_compact(F.array(F.nullif("variable_context", F.lit("")))), each(_list("open_namespaces"), "open "), each(_list("scopes"), "open scoped "),
        _list("local_notations"), _list("local_attributes"), each(spaces, "namespace "),
    )
    df = df.withColumn("_x", scanner.compose("statement", "proof"))
    none = F.size(active) == 0
    parts = F.concat(F.when(none, own).otherwise(active), F.array("_x.code"), F.when(none, each(F.reverse(spaces), "end ")).otherwise(closing))
    return df.withColumns({"assembled": F.when(F.col("_x.error").isNull(), text.strip(F.array_join(parts, "\n\n"))), "assembly_error": F.col("_x.error")}).drop("_x")


def needed_by_joins(df: DataFrame, key: str) -> DataFrame:
    """F-21 as an iterated join: (key, name) of the variables that each row's statement needs, of df (key, statement, variables).

    Round by round the names that the types of the last round's variables use are added, until none is new;
    rounds are as many as the longest chain of types, and each is written, so the plan stays small. What is
    taken of df is written first, since every branch of the joins would read its sources again.
    """
    df = materialise(df.select(key, "statement", F.transform("variables", lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"))).alias("variables")), "statements")
    rows = df.select(key, F.explode("variables").alias("v")).select(key, F.col("v.name").alias("name"), F.col("v.type").alias("type")).where("name <> ''")
    names = rows.select(key, "name").distinct()
    uses = rows.select(key, "name", F.explode(C.identifiers("type")).alias("to")).distinct()
    uses = materialise(uses.join(names.withColumnRenamed("name", "to"), [key, "to"], "left_semi"), "uses")
    last = df.select(key, F.explode(C.free_names("statement")).alias("name")).distinct()
    last = materialise(last.join(names, [key, "name"], "left_semi"), "needed")
    every = last
    while not last.isEmpty():
        found = uses.join(last, [key, "name"]).select(key, F.col("to").alias("name")).distinct()
        last = materialise(found.join(every, [key, "name"], "left_anti"), "needed")
        every = materialise(every.unionByName(last), "needed")
    return every
