"""Scalar scores of attempts: pass@k, routes, weights, priorities, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text

K_VALUES = (1, 4, 8, 16, 32)
# fixed values: error patterns, in the order in which they are tried
API = {
    "unknown_identifier": r"(?i)\bunknown identifier\b",
    "unknown_constant_or_declaration": r"(?i)\bunknown (?:constant|declaration|namespace|tactic)\b",
    "missing_field": r"(?i)\b(?:no|unknown) field (?:named )?\b",
    "invalid_field_name": r"(?i)\binvalid field (?:name|notation)\b",
}
PROJECTION = r"(?i)\binvalid projection\b"
SYNTAX = r"(?i)unexpected (?:token|identifier)|expected (?:token|command|term)|parser|invalid syntax"
TYPE = (
    r"(?is)application type mismatch|type mismatch|failed to synthesize|function expected|invalid argument|"
    r"typeclass instance problem|has type .* but is expected"
)
TACTIC = r"(?i)tactic .*failed|linarith failed|omega could not|simp made no progress|no goals to be solved|unsolved goals"
API_SYMBOL = r"(?i)\bunknown (?:identifier|constant|declaration|namespace|tactic)\b\s*[`'\"]?([A-Za-z_][A-Za-z0-9_'.]*)"
WEIGHTS_E2 = {1: 1.20, 2: 1.10, 3: 1.00, 4: 0.90}
#: Weights at 1 to 5 successes of eight.
WEIGHTS_V2 = (1.30, 1.10, 0.80, 0.60, 0.0)
#: Rewards of a compiled proof, of a well-formed one, and of the most that brevity can add.
COMPILE, FORMAT, BREVITY, FAILURE = 1.0, 0.1, 0.1, 0.0
# fixed values: (status, detail, patterns that all match the message), first match wins; a flag comes before all messages
_ENVIRONMENT = r"(?i)environment|failed\s+to\s+import|unknown\s+module|module\s+.+not\s+found|pantograph\s+server"
_PARSE = r"(?i)syntax\s+error|parser|unexpected\s+(?:token|end\s+of\s+input)|expected\s+.+\s+token"
_NAME = r"(?i)unknown\s+(?:identifier|constant)|invalid\s+field\s+notation"
ENVIRONMENT_STATUS = (
    ("environment_error", "missing_import", (r"(?i)import|module",)),
    ("environment_error", "environment_unavailable", ()),
)
MESSAGE_STATUS = (
    ("unsolved_goals", "unsolved_goals", (r"(?i)unsolved goal",)),
    ("syntax_error", "unexpected_token", (_PARSE, r"(?i)unexpected")),
    ("syntax_error", "parser_error", (_PARSE,)),
    ("elaboration_error", "invalid_field", (_NAME, r"(?i)invalid field")),
    ("elaboration_error", "unknown_constant", (_NAME, r"(?i)constant")),
    ("elaboration_error", "unknown_identifier", (_NAME,)),
    ("tactic_error", "tactic_execution_failed", (r"(?i)tactic|no\s+goals\s+to\s+be\s+solved",)),
    ("elaboration_error", "application_type_mismatch", (r"(?i)application type mismatch",)),
    ("elaboration_error", "type_mismatch", (r"(?i)type mismatch",)),
    ("elaboration_error", "failed_to_synthesize", (r"(?i)failed to synthesize",)),
    ("elaboration_error", "unclassified_elaboration", ()),
)
# fixed values: classes of verification failures by what the message says, first match wins; an unknown name is classed in between
_BEFORE_NAMES = (("timeout", (r"(?i)timeout|timed out",)), ("environment_error", (r"(?i)pantograph", r"(?i)server|connection|environment")))
UNKNOWN_NAME = r"Unknown (?:identifier|constant) `([^`]+)`"
NAMES_OF_OTHER_VERSIONS = ("exp", "one_le_rpow")
_AFTER_NAMES = (
    ("reference_syntax_error", (r"(?i)unexpected token",)),
    ("reference_syntax_error", (r"(?i)expected", r"(?i)syntax")),
    ("source_extraction_corruption", (r"(?i)invalid `", r"(?i)notation")),
    ("reference_unsolved_goals", (r"(?i)unsolved goals",)),
    ("reference_tactic_failure", (r"(?i)linarith failed|made no progress|tactic|no goals to be solved",)),
    ("missing_namespace", (r"(?i)unknown namespace",)),
    ("missing_local_notation", (r"(?i)unknown parser|unknown syntax",)),
)


def unbiased_pass(n: Column, c: Column, k: int) -> Column:
    """A-21: 1 - C(n-c, k) / C(n, k), as a product."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1 - miss)


def route(initial: Column, total: Column, attempts: Column) -> Column:
    """F-37, six routes."""
    return (
        F.when(initial >= 5, "mastered")
        .when(initial >= 1, "active_pass8")
        .when(attempts == 8, "need_pass16_topup")
        .when(total > 0, "active_after_topup")
        .when(attempts == 16, "need_pass32_topup")
        .otherwise("hard_bank")
    )


def screen_route(initial: Column, total: Column, attempts: Column) -> Column:
    """F-37, the five routes of a screened group."""
    return (
        F.when(initial >= 5, "mastered")
        .when(initial > 0, "active_pass8")
        .when(total > 0, "active_after_topup")
        .when(attempts == 32, "hard_bank")
        .otherwise("unresolved_zero")
    )


def scarcity_weight(successes: Column, attempts: Column) -> Column:
    """F-35: the weight by the rate alone, whatever the number of attempts."""
    rare = F.least(F.lit(1.30), 1.0 + 0.30 * F.greatest(F.lit(0.0), 1.0 - (successes / attempts) / 0.125))
    return F.when((successes <= 0) | (attempts <= 0), 0.0).otherwise(rare)


def problem_weight(successes: Column, attempts: Column) -> Column:
    """F-35."""
    table = F.coalesce(*(F.when(successes == k, v) for k, v in WEIGHTS_E2.items()), F.lit(0.0))
    return F.when((successes <= 0) | (attempts <= 0), 0.0).when(attempts == 8, table).otherwise(scarcity_weight(successes, attempts))


def difficulty_weight(successes: Column, attempts: Column, anchors=WEIGHTS_V2) -> Column:
    """F-36: the rate as successes of eight, interpolated between anchors for 1 to 5; below 1 as at 1."""
    x = 8.0 * successes / attempts
    low, high = F.floor(x), F.ceil(x)
    at = lambda i: F.element_at(F.array(*(F.lit(a) for a in anchors)), i.cast("int"))
    between = at(low) * (1.0 - (x - low)) + at(F.least(high, F.lit(len(anchors)))) * (x - low)
    return F.when(successes == 0, 0.0).when(x >= len(anchors), 0.0).when(x <= 1.0, anchors[0]).otherwise(between)


def mass_scale(attempts: Column) -> Column:
    """F-36: a group of more attempts weighs no more than one of eight."""
    return 8.0 / attempts


def step_scale(effective: Column, slots: int = 16, most: float = 1.5) -> Column:
    """F-36: what makes up for groups of a step that say nothing."""
    return F.when(effective == 0, 0.0).otherwise(F.least(F.lit(most), F.lit(float(slots)) / effective))


def reward(proof: Column, forbidden: Column, compiled: Column, tokens: Column, reference_tokens: Column) -> Column:
    """F-34: the components format, compile and brevity, and their sum; brevity is the share by which a compiled proof is shorter."""
    formed = (text.strip(F.coalesce(proof, F.lit(""))) != "") & ~forbidden
    shorter = compiled & (reference_tokens > 0) & (tokens < reference_tokens)
    parts = {
        "format": F.when(formed, FORMAT).otherwise(0.0),
        "compile": F.when(formed & compiled, COMPILE).otherwise(0.0),
        "brevity": F.when(formed & shorter, BREVITY * (reference_tokens - tokens) / reference_tokens).otherwise(0.0),
    }
    total = F.when(formed, sum(parts.values(), F.lit(0.0))).otherwise(FAILURE)
    return F.struct(*(c.alias(k) for k, c in parts.items()), total.alias("reward"))


def rollout_priority(successes: Column, attempts: Column, group: int = 8) -> Column:
    """F-38: probability of 1 to 4 successes in the next group under a Beta(1, 1) prior, by rising factorials."""
    a, b = successes + 1.0, attempts - successes + 1.0
    rising = lambda x, n: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(1.0), lambda s, i: s * (x + i)) if n else F.lit(1.0)
    choose = {1: 8.0, 2: 28.0, 3: 56.0, 4: 70.0} if group == 8 else None
    if choose is None:
        raise ValueError("groups of eight only")
    return sum((choose[k] * rising(a, k) * rising(b, group - k) / rising(a + b, group) for k in choose), F.lit(0.0))


def error_type(success: Column, timed_out: Column, rejected: Column, explicit: Column, errors: Column, status: Column) -> Column:
    """F-27."""
    from corpusmill.functions.text import strip

    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return (
        F.when(success, "success").when(timed_out, "timeout").when(blank(rejected).isNotNull(), "rejected")
        .when(blank(explicit).isNotNull(), blank(explicit)).when(F.size(F.coalesce(errors, F.array())) > 0, "lean_compilation")
        .otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("backend_error")))
    )


def api_types(text: Column) -> Column:
    """The strict API patterns that match."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in API.items())))


def error_class(success: Column, timed_out: Column, rejected: Column, text: Column, proof: Column) -> Column:
    """F-28."""
    forbidden = proof.rlike(r"(?i)\b(?:sorry|admit)\b")
    any_api = text.rlike("|".join(f"(?:{p})" for p in API.values()))
    return (
        F.when(success, "success").when(timed_out, "timeout").when(F.coalesce(rejected, F.lit("")) != "", "rejected_or_forbidden")
        .when(forbidden, "rejected_or_forbidden").when(any_api, "hallucinated_api_strict").when(text.rlike(PROJECTION), "invalid_projection")
        .when(text.rlike(SYNTAX), "syntax_or_parser").when(text.rlike(TYPE), "type_or_elaboration")
        .when(text.rlike(TACTIC), "tactic_or_unsolved_goal").otherwise("other_lean_failure")
    )


def _all(message: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & message.rlike(p)
    return out


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds."""
    return F.coalesce(*(F.when(rule, value) for rule, value in cases))


def diagnostics_status(message: Column, **flags: Column) -> Column:
    """F-30: (status, detail) of a run: what its flags say, else what its message says.

    Flags: success, timed_out, extraction_error, forbidden_token, environment_error, internal_error.
    """
    case = lambda status, detail: F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))
    flag = lambda name: flags.get(name, F.lit(False))
    message = text.strip(F.coalesce(message, F.lit("")))
    environment = flag("environment_error") | message.rlike(_ENVIRONMENT)
    cases = [
        (flag("success"), case("success", "none")),
        (flag("timed_out"), case("timeout", "timeout")),
        (flag("extraction_error") & (message == ""), case("extraction_error", "empty_generation")),
        (flag("extraction_error"), case("extraction_error", "proof_extraction_failed")),
        (flag("forbidden_token"), case("forbidden_token", "forbidden_declaration")),
        *((environment & _all(message, p), case(s, d)) for s, d, p in ENVIRONMENT_STATUS),
        (flag("internal_error"), case("internal_error", "internal_exception")),
        *((_all(message, p), case(s, d)) for s, d, p in MESSAGE_STATUS),
    ]
    return _first(cases)


def failure_class(message: Column, timed_out: Column, has_errors: Column) -> Column:
    """F-29: one of 14 classes of a failed verification."""
    message = F.coalesce(message, F.lit(""))
    name = F.regexp_extract(message, UNKNOWN_NAME, 1)
    by_name = (
        F.when(name.isin(*NAMES_OF_OTHER_VERSIONS), "version_incompatible_identifier")
        .when(name.startswith("h") | (name == "this"), "missing_hypothesis")
        .when((F.left(name, F.lit(1)) == F.lower(F.left(name, F.lit(1)))) & (F.left(name, F.lit(1)) != F.upper(F.left(name, F.lit(1)))), "missing_local_variable")
        .otherwise("missing_import")
    )
    cases = [
        (F.coalesce(timed_out, F.lit(False)), F.lit("timeout")),
        *((_all(message, p), F.lit(k)) for k, p in _BEFORE_NAMES),
        (name != "", by_name),
        *((_all(message, p), F.lit(k)) for k, p in _AFTER_NAMES),
        (F.coalesce(has_errors, F.lit(False)), F.lit("reference_elaboration_error")),
        (F.lit(True), F.lit("unknown")),
    ]
    return _first(cases)


def coerce_success(boolean: Column, number: Column) -> Column:
    """F-39: a boolean as it is, else a number above one half."""
    return F.coalesce(boolean, number > 0.5)


def layout(world: int, per_device: int, generations: int, problems: int) -> dict[str, int]:
    """F-40: sizes of an update, checked for divisibility."""
    batch = problems * generations
    if batch % (world * per_device):
        raise ValueError("the update does not divide over the devices")
    return {"generation_batch_size": batch, "gradient_accumulation_steps": batch // (world * per_device), "prompt_rows_per_update": problems}
