"""Behaviour diff (missing / extra actions) and policy violations.

All joins are equi-joins or literal-list predicates; a policy is a list of
literals, so it never needs a join. Long lists of paths become an automaton.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuth.functions.columns import fmt1
from sleuth.session import let_import

DEFAULT_MAX_RISK = 1.0  # fixed value: policy default of the studied tool
FEW_RULES = 16  # paths that are looked for one by one
RULE_BYTES = 4 << 20  # of paths in one automaton
EVENT_REF = ["id", "timestamp", "event_type", "source", "target", "risk_score", "agent_id", "incident_id"]


@dataclass(frozen=True)
class Policy:
    blocked_tools: Sequence[str] = field(default_factory=tuple)
    blocked_paths: Sequence[str] = field(default_factory=tuple)
    max_risk_score: float = DEFAULT_MAX_RISK

    @staticmethod
    def of(p: Policy | Mapping | None) -> Policy | None:
        """None or an empty mapping means *no* policy checks."""
        if p is None or isinstance(p, Policy):
            return p
        if not p:
            return None
        return Policy(
            tuple(p.get("blocked_tools", ()) or ()),
            tuple(p.get("blocked_paths", ()) or ()),
            float(p.get("max_risk_score", DEFAULT_MAX_RISK)),
        )


def _ref(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in EVENT_REF if c in df.columns]


def _key_cond(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def missing_actions(actual: DataFrame, expected: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Types expected more often than performed: one row per type, carrying the
    first expected event of that type (text order)."""
    keys = [*partition_by, "event_type"]
    ref = [c for c in EVENT_REF if c in expected.columns]
    exp = expected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.min_by(F.struct(*[F.col(c) for c in ref]), F.struct("timestamp", "id")).alias("_first"),
    )
    act = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_actual"))
    j = exp.join(act, _key_cond(exp, act, keys), "left").select(
        *[exp[c] for c in keys], "n_expected", F.coalesce(act["n_actual"], F.lit(0)).alias("n_actual"), "_first"
    )
    return j.where(F.col("n_actual") < F.col("n_expected")).select(
        F.lit("missing_action").alias("type"),
        F.lit("expected").alias("event_side"),
        F.format_string("Expected action '%s' was not performed by the agent", F.col("event_type")).alias("description"),
        F.lit(0).alias("phase"),
        F.lit(0).alias("sub"),
        *[F.col(c) for c in partition_by],
        "n_expected",
        "n_actual",
        *[F.col("_first")[c].alias(c) for c in ref if c not in partition_by],
    )


def extra_actions(actual: DataFrame, expected: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Performed events whose type never occurs in the expected behaviour
    (NULL type counts as extra unless NULL is expected too)."""
    keys = [*partition_by, "event_type"]
    types = expected.select(*keys).distinct()
    extra = actual.join(types, _key_cond(actual, types, keys), "left_anti")
    return extra.select(
        F.lit("extra_action").alias("type"),
        F.lit("actual").alias("event_side"),
        F.format_string("Unexpected action '%s' performed by agent", F.coalesce(F.col("event_type"), F.lit("None"))).alias(
            "description"
        ),
        F.lit(1).alias("phase"),
        F.lit(0).alias("sub"),
        *_ref(extra),
    )


def blocked_tool(actual: DataFrame, tools: Sequence[str]) -> DataFrame:
    tools = list(dict.fromkeys(tools))
    cond = F.col("event_type").isin(tools) if tools else F.lit(False)
    return actual.where(cond).select(
        F.lit("policy_violation").alias("type"),
        F.lit("actual").alias("event_side"),
        F.format_string("Agent used blocked tool '%s'", F.col("event_type")).alias("description"),
        F.lit(2).alias("phase"),
        F.lit(0).alias("sub"),
        F.lit("blocked_tool").alias("rule"),
        *_ref(actual),
    )


def _slices(paths: Sequence[str], limit: int) -> list[list[str]]:
    """The rules in order, cut into lists of about ``limit`` bytes of text."""
    out: list[list[str]] = [[]]
    size = 0
    for p in paths:
        size += len(p.encode())
        if size > limit and out[-1]:
            out.append([])
            size = len(p.encode())
        out[-1].append(p)
    return out


@lru_cache(maxsize=4)
def _automaton(rules: tuple[str, ...]):
    """A multi-pattern automaton whose words carry their least place in the list."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for i, rule in enumerate(rules):
        if rule not in words:
            words.add_word(rule, i)
    words.make_automaton()
    return words


def _first_of(rules: list[str]):
    """Arrow UDF over two lower-cased texts: the first rule that one of them contains."""
    low = tuple(r.lower() for r in rules)
    always = low.index("") if "" in low else None  # an empty rule is in every text
    known = low[:always]

    def first(target: pa.Array, text: pa.Array) -> pa.Array:
        find = _automaton(known).iter if known else lambda _: ()
        found = []
        for pair in zip(target.to_pylist(), text.to_pylist(), strict=True):
            places = [i for t in pair for _, i in find(t)]
            at = min(places) if places else always
            found.append(None if at is None else rules[at])
        return pa.array(found, pa.string())

    # it filters and is shown: as nondeterministic it is computed once
    return F.arrow_udf(first, "string").asNondeterministic()


def first_matching_path(paths: Sequence[str], target: Column, description: Column) -> Column:
    """First rule (list order) contained case-insensitively in target or description; NULL if none.

    Up to ``FEW_RULES`` rules are looked for one by one. More of them are an automaton
    that reads each text once, whatever their number; it travels with the tasks, in
    slices of ``RULE_BYTES`` of rules, so its size is bounded.
    """
    if not paths:
        return F.lit(None).cast("string")
    t = F.lower(F.coalesce(target, F.lit("")))
    d = F.lower(F.coalesce(description, F.lit("")))
    if len(paths) > FEW_RULES:
        return F.coalesce(*[_first_of(part)(t, d) for part in _slices(paths, RULE_BYTES)])
    rules = F.array(*[F.struct(F.lit(p).alias("rule"), F.lit(p.lower()).alias("low")) for p in paths])
    hits = F.filter(rules, lambda r: F.contains(t, r["low"]) | F.contains(d, r["low"]))
    return F.get(hits, 0)["rule"]


def blocked_path(actual: DataFrame, paths: Sequence[str], text_col: str = "description") -> DataFrame:
    """At most one violation per event: the first matching rule wins.

    ``text_col`` is the free text checked besides ``target`` (whole text, no prefix).
    """
    let_import(actual.sparkSession)
    target = F.col("target") if "target" in actual.columns else F.lit("")
    hit = first_matching_path(list(paths), target, F.col(text_col))
    x = actual.withColumn("_rule", hit).where(F.col("_rule").isNotNull())
    return x.select(
        F.lit("policy_violation").alias("type"),
        F.lit("actual").alias("event_side"),
        F.format_string("Agent accessed blocked target '%s'", F.col("_rule")).alias("description"),
        F.lit(2).alias("phase"),
        F.lit(1).alias("sub"),
        F.col("_rule").alias("rule"),
        *_ref(x),
    )


def risk_limit(actual: DataFrame, max_risk: float = DEFAULT_MAX_RISK) -> DataFrame:
    """Strictly above the policy's limit."""
    risk = F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))
    limit_text = repr(float(max_risk))
    return actual.where(risk > F.lit(float(max_risk))).select(
        F.lit("policy_violation").alias("type"),
        F.lit("actual").alias("event_side"),
        F.format_string(f"Risk score %s exceeds policy limit {limit_text}", fmt1(risk)).alias("description"),
        F.lit(2).alias("phase"),
        F.lit(2).alias("sub"),
        F.lit("risk_limit").alias("rule"),
        *_ref(actual),
    )


def policy_violations(actual: DataFrame, policy: Policy | Mapping | None) -> DataFrame | None:
    p = Policy.of(policy)
    if p is None:
        return None
    parts = [blocked_tool(actual, p.blocked_tools), blocked_path(actual, p.blocked_paths), risk_limit(actual, p.max_risk_score)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def diff_behavior(
    actual: DataFrame,
    expected: DataFrame | None = None,
    policy: Policy | Mapping | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """missing -> extra -> policy (tool, path, risk); order by (phase, timestamp, id, sub)."""
    parts: list[DataFrame] = []
    if expected is not None:
        parts += [missing_actions(actual, expected, partition_by), extra_actions(actual, expected, partition_by)]
    pv = policy_violations(actual, policy)
    if pv is not None:
        parts.append(pv)
    if not parts:
        return actual.sparkSession.createDataFrame(
            [],
            "type string, event_side string, description string, phase int, sub int, rule string, id long, "
            "timestamp string, event_type string, source string, target string, risk_score double, "
            "agent_id string, incident_id string",
        )
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
