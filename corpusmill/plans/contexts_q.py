"""Queries over source contexts. The sources are the documents: every word of a text gives a line of its source.

What kind of line it is follows from the word's hash, so files have scopes that open, end and nest, commands over
several lines, comments that open and close anywhere, and imports; the declaration stands after the last line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import contexts as C
from corpusmill.functions import hashing, standalone, text
from corpusmill.operators import contexts as K
from corpusmill.plans.registry import query

#: A line for each kind of word; {n} is the word as a name.
LINES = (
    "namespace {n}", "section", "noncomputable section {n}", "end", "end {n}", "open {n}", "open scoped {n}", "variable {{{n} : Type*}} (h{n} : {n} = {n})", "  [Monoid {n}]",
    'local notation "{n}" => True', "/- {n}", "-/ open {n}", "set_option linter.{n} false", "import M.{n}", "theorem {n} : True := by", "-- open {n}", "attribute [local simp] {n}",
    "variable ({n} : Nat) in", "set_option maxRecDepth 9", "public section {n}",
)


def _lines():
    name = lambda w: F.regexp_replace(w, "[^A-Za-z0-9_]", "_")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")

    forms = F.array(*(F.lit(form.format(n="\1")) for form in LINES))

    def line(w):
        return F.replace(F.get(forms, F.pmod(F.xxhash64(w), F.lit(len(LINES))).cast("int")), F.lit("\1"), name(w))

    return F.transform(words, line)


def records(t):
    """Records with the file that their document makes; of some, by their hash, the file, its commit or the line is missing or wrong."""
    n = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    docs = t.documents.select("doc_id", "lang", "source", _lines().alias("lines"), n.alias("n"))
    return docs.select(
        F.col("doc_id").alias("record_id"), F.when(F.col("n") != 3, F.array_join("lines", "\n")).alias("source"),
        F.when(F.col("n") != 4, F.concat(F.col("source"), F.lit(".lean"))).alias("source_file"), F.col("lang").alias("source_commit"),
        (F.size("lines") + F.when(F.col("n") == 5, 9).when(F.col("n") == 6, -F.size("lines")).otherwise(1)).cast("int").alias("source_line"),
        F.when(F.col("n") != 7, F.concat(F.lit("theorem t"), "doc_id", F.lit(" (h := "), "lang", F.lit(") : True := by\n  trivial"))).alias("raw_declaration"),
        F.when(F.col("n") % 2 == 0, F.array(F.lit("intro h\n\nsimp"), F.lit(" "), F.col("lang"))).otherwise(F.expr("cast(array() as array<string>)")).alias("tactics"),
        F.concat(F.lit("theorem t : "), "lang").alias("statement"), F.lit("trivial").alias("proof"), F.array(F.lit("Mathlib"), F.col("lang")).alias("imports"),
        F.concat("lang", F.lit("."), "source").alias("namespace"), F.when(F.col("n") < 8, "leandojo_v2").otherwise("workbook").alias("source_dataset"), F.lit(None).cast("string").alias("variable_context"),
    )


@query("f20_scopes")
def _(t):
    lines = t.documents.select("doc_id", _lines().alias("lines"))
    x = lines.select("doc_id", C.contexts(F.array_join("lines", "\n"), (F.size("lines") + 1).cast("int")).alias("x"))
    joined = [F.array_join(f"x.{c}", "|").alias(c) for c in C.LISTS]
    return x.select("doc_id", *joined, F.size("x.variables").alias("n_variables"), "x.source_hash")


@query("p17_source_contexts")
def _(t):
    x = K.from_sources(records(t))
    return x.select("record_id", "data_state", "reason", "statement", "proof", "statement_id", F.array_join("context.active_commands", "\n").alias("active"), "context.recovery_status", "verification_error_type")


@query("p14_applied_contexts")
def _(t):
    x = K.applied(K.from_sources(records(t)), "environment")
    return x.select("id", "source_kind", F.array_join("imports", "|").alias("imports"), "namespace", "source_lookup_attempted", "context_recovered", "context_hashes.*")


@query("p15_context_payloads")
def _(t):
    x = K.payload(K.applied(K.from_sources(records(t)), "environment"))
    return x.select("id", "source", hashing.exact(F.to_json(F.struct(*x.columns), {"ignoreNullFields": "false"})).alias("payload_sha256"))


@query("f43_assembled_declarations")
def _(t):
    x = K.assembled(K.applied(K.from_sources(records(t)), "environment"))
    return x.select("id", "assembly_error", F.length("assembled").alias("n_chars"), hashing.exact(F.col("assembled")).alias("assembled_source_hash"))


@query("p16_partial_contexts")
def _(t):
    """Steps are turns of conversations, whose words are the locals of a proof state."""
    name = F.lower(F.regexp_replace(F.substring_index(text.strip(F.col("text")), " ", 1), "[^A-Za-z0-9_]", "_"))
    state = F.concat(name, F.lit(" y : Nat\ncase inl\ninst_1 : Monoid "), name, F.lit("\nh : "), F.substring_index("text", "\n", -1), F.lit("\n"), F.when(F.col("role") != "assistant", "⊢ True").otherwise("no goals"))
    steps = t.conversations.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("step"), state.alias("state_before"), F.col("text").alias("tactic"), F.lit("no goals").alias("state_after"))
    kept = t.conversations.select(F.col("conv_id").alias("record_id")).distinct().select(
        "record_id", F.lit("theorem t : True").alias("statement"), F.expr("cast(array() as array<string>)").alias("imports"), F.lit(None).cast("string").alias("source_commit"), F.lit(None).cast("int").alias("source_line")
    )
    x = K.from_states(kept, steps).select("record_id", "context.*")
    return x.select("record_id", *(F.array_join(F.transform(c, lambda v: F.concat_ws(":", v["name"], v["type"], v["binder"])), ";").alias(c) for c in ("variables", "hypotheses")), F.array_join("local_instances", ";").alias("instances"), F.array_join("recovery_sources", ",").alias("recovery_sources"), "source_hash")


def _statements(t):
    """(doc_id, statement, variables, local_instances, source): a statement over some of the names that a file's variables have, and the variables in force where it stands."""
    lines = t.documents.select("doc_id", _lines().alias("lines"))
    x = lines.select("doc_id", "lines", C.contexts(F.array_join("lines", "\n"), (F.size("lines") + 1).cast("int")).alias("x"))
    names = F.filter(F.transform("x.variables", lambda v: v["name"]), lambda n: F.pmod(F.xxhash64(n), F.lit(3)) == 0)
    statement = F.concat(F.lit("theorem t (x : Nat) {"), F.coalesce(F.get(names, F.lit(0)), F.lit("y")), F.lit(" : Type u} : "), F.array_join(names, " = "), F.lit(" μ"))
    return x.select("doc_id", statement.alias("statement"), "x.variables", "x.local_instances", F.array_join("lines", "\n").alias("source"))


@query("f21_needed_variables")
def _(t):
    x = _statements(t).select("doc_id", C.needed_variables("statement", "variables", "local_instances").alias("x"))
    return x.select("doc_id", *(F.array_join(f"x.{c}", "|").alias(c) for c in C.NEEDED.names))


@query("f21_needed_by_joins")
def _(t):
    return K.needed_by_joins(_statements(t), "doc_id")


@query("f22_standalone_commands")
def _(t):
    """Instances come cut off after their bracket, as an older reading left them; the file has them whole."""
    source = F.regexp_replace("source", r"\[Monoid (\w+)\]", "[Monoid (M $1)]")
    cut = F.transform("local_instances", lambda i: F.regexp_replace(i, r"^Monoid .*", "Monoid (M"))
    x = _statements(t).select("doc_id", standalone.standalone("statement", "variables", cut, source).alias("x"))
    return x.select("doc_id", F.size("x").alias("n_commands"), F.size(F.filter("x", lambda c: c.startswith("variable ["))).alias("n_instances"), hashing.exact(F.array_join("x", "\n")).alias("commands_sha256"))


@query("f22_qualified_texts")
def _(t):
    """Every text with the names qualified that its own file declares."""
    x = t.documents.select("doc_id", "text", standalone.qualified("text", F.concat("lang", F.lit(".Lp")), F.array_join(_lines(), "\n")).alias("q"))
    return x.select("doc_id", (F.length("q") - F.length("text")).alias("n_added"), hashing.exact(F.col("q")).alias("text_sha256"))


@query("f22_plain_opens")
def _(t):
    """A text's words as entries of an open command, some of which begin or end a selection."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(9)) == 0, F.concat(F.lit("("), w)).when(F.pmod(F.xxhash64(w), F.lit(9)) == 1, F.concat(w, F.lit(")"))).otherwise(w))
    x = t.documents.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("n_entries"), F.filter("words", lambda w: ~w.rlike(r"[()\s]") & (w != "")).alias("plain"), standalone.plain_opens(F.col("words")).alias("x"))
    return x.select("doc_id", "n_entries", F.size("plain").alias("n_plain"), F.size("x").alias("n_kept"), hashing.exact(F.array_join("x", " ")).alias("kept_sha256"))


@query("f23_theorems")
def _(t):
    """Each turn of a conversation as a proof state: its first word is a local, its text a hypothesis of as many lines as it has."""
    name = F.regexp_replace(F.substring_index(text.strip(F.col("text")), " ", 1), r"[\s:(),{}\[\]]", "_")
    state = F.concat(
        F.lit("case h\n"), name, F.lit("✝ b : Type u_1\ninst✝¹ : Monoid (Type ?u.12) "), name, F.lit("✝\n"), F.when(F.col("turn") % 5 != 4, F.lit("h : ")).otherwise(""), "text",
        F.when(F.col("role") != "system", F.concat(F.lit("\n⊢ "), name, F.lit("✝ = b"))).otherwise(""),
    )
    x = t.conversations.select("conv_id", "turn", standalone.theorems(state, F.concat(F.lit("leandojo_"), "conv_id", F.lit("_"), "turn")).alias("x"))
    return x.select("conv_id", "turn", "x.error", hashing.exact(F.col("x.statement")).alias("statement_sha256"), F.array_join("x.universes", "|").alias("universes"), F.array_join(F.map_keys("x.replacements"), "|").alias("renamed"))
