"""Queries over four-layer records. Each document is a candidate: its text is what is stated, and its sentences are the states of its proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import layers
from corpusmill.plans.registry import query


def candidates(t):
    """Documents as candidates; by hash, some lack a statement or a declaration, were late, failed, or have a gap in their trace."""
    n = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    states = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s")
    docs = t.documents.select("doc_id", "lang", "source", "text", n.alias("n"), states.alias("states"))
    step = lambda s, i: F.struct((i + (F.col("n") == 3).cast("int")).alias("step_index"), s.alias("state_before"), F.substring_index(s, " ", 1).alias("tactic"), F.coalesce(F.get("states", i + 1), F.when(F.col("n") != 4, "no goals")).alias("state_after"))
    return docs.select(
        "doc_id", F.when(F.col("n") != 0, F.concat(F.lit("theorem t"), "doc_id", F.lit(" : "), "text", F.lit(" :="))).alias("statement"),
        F.concat(F.when(F.col("n") % 2 == 0, "by\r\n  ").otherwise(""), "text").alias("proof"), F.when(F.col("n") != 1, F.concat("source", F.lit(" := "), "text")).alias("declaration_source"),
        F.when(F.col("n") == 2, "mixed").alias("proof_style"), F.split("text", r"\s+").alias("premises"), F.transform("states", step).alias("tactic_trace"),
        F.col("lang").alias("repository_commit"), F.col("source").alias("source_file"), F.struct(F.size("states").alias("end_line"), F.lit(1).alias("start_line")).alias("source_span"),
        F.struct((F.col("n") != 5).alias("compile_success"), (F.col("n") == 6).alias("timed_out"), F.when(F.col("n") == 7, F.col("lang")).alias("error_category")).alias("verification"),
    )


@query("p12_four_layers")
def _(t):
    found = layers.normalised(candidates(t))
    checks = [F.col(f"tactic_trace_validation.{c}").alias(c) for c in ("step_indices_continuous", "adjacent_states_aligned", "final_goal_closed", "step_count")]
    hashes = ("statement_hash_exact", "statement_hash_normalized", "proof_hash_exact", "proof_hash_normalized", "declaration_hash_exact", "source_identity_hash", "premise_set_hash", "theorem_group_id")
    return found.select("doc_id", "error", "proof_style", "verification_status", "verification_class", *hashes, F.sha2("training_declaration", 256).alias("training_sha256"), F.size("premise_set_canonical").alias("n_premises"), *checks)
