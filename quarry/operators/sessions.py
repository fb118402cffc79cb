"""Sessions as a table: how they begin, what they have done, and what an exploration leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import gates


def created(requests: DataFrame) -> DataFrame:
    """(session_id, intent, query, gate_level, phase) of requests(session_id, intent, query, gate_level, at); an id is made of the time where there is none."""
    name = F.coalesce("session_id", F.concat(F.lit("session_"), F.date_format("at", "yyyyMMdd_HHmmss")))
    phase = F.when((F.col("intent") == "QUESTION") | (F.col("gate_level") == "none"), "READY").otherwise("EXPLORATION")
    return requests.select(name.alias("session_id"), "intent", "query", F.coalesce("gate_level", F.lit("high")).alias("gate_level"), phase.alias("phase"))


def active(sessions: DataFrame, order: str) -> DataFrame:
    """The session made last."""
    return sessions.orderBy(F.col(order).desc(), F.col("session_id").desc()).limit(1)


def status(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """sessions with allowed_tools and tool_calls_count, from calls(session_id, ...)."""
    tools = F.coalesce(*(F.when(F.col("phase") == p, F.array(*(F.lit(t) for t in ts)).cast("array<string>")) for p, ts in gates.ALLOWED.items()))
    n = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls_count"))
    return sessions.join(n, "session_id", "left").withColumn("allowed_tools", tools).withColumn("tool_calls_count", F.coalesce("tool_calls_count", F.lit(0)))


def begun(starts: DataFrame) -> DataFrame:
    """starts with mode and phase: how a task begins.

    starts has intent, gate_level, skip_branch, skip_exploration (booleans) and resume (the phase of a session that waits
    on its branch, or null). What waits is resumed in its phase; without a branch or an exploration a task begins READY or
    as it would with one; else a branch is made.
    """
    plain = gates.start_phase(F.col("intent"), F.coalesce("skip_exploration", F.lit(False)) | (F.col("gate_level") == "none"))
    mode = F.when(F.col("resume").isNotNull(), "resume").when(F.col("skip_exploration"), "skip_exploration").when(F.col("skip_branch"), "skip_branch").otherwise("normal")
    return starts.withColumn("mode", mode).withColumn("phase", F.coalesce("resume", plain)).withColumn("branch", mode == "normal")


def write_error(intent: Column) -> Column:
    """Why nothing may be written under an intent; null if it may."""
    return F.when(intent == "INVESTIGATE", "Intent is INVESTIGATE but Write was requested. Re-classify intent to IMPLEMENT or MODIFY first.")


def unmapped(terms: Column, symbols: Column) -> Column:
    """array<string>: terms that no symbol answers to."""
    loose = F.filter(terms, lambda t: (F.length(t) > 0) & ~F.exists(symbols, lambda s: X.term_matches_symbol(t, s)))
    return F.transform(loose, lambda t: F.concat(F.lit("nl_symbol: '"), t, F.lit("' not linked to any symbol")))


def submitted(explorations: DataFrame) -> DataFrame:
    """explorations with missing, evaluated_confidence, success and next_phase.

    They have phase, intent, risk, tools, evidenced, terms, slot_source (a map), the lists that gates.COUNTED names, and
    mapped (array<struct<name, source>>). What requirements, consistency, terms and hypotheses lack is put together; only
    where nothing is lacking does a session go on to the analysis of impact, else to the semantic search.
    """
    lists = {c: F.col(c) for c in gates.COUNTED}
    lacking = gates.missing_requirements(lists, F.col("tools"), F.col("evidenced"), F.col("intent"), F.col("risk"))
    loose = gates.inconsistencies(*(F.col(c) for c in ("symbols_identified", "entry_points", "files_analyzed", "existing_patterns")))
    every = F.concat(lacking, F.transform(loose, lambda e: F.concat(F.lit("consistency: "), e)), unmapped(F.col("terms"), F.col("symbols_identified")), gates.ready_errors(F.col("slot_source"), F.col("mapped")))
    here = F.col("phase") == "EXPLORATION"
    out = explorations.withColumn("missing", F.when(here, every).otherwise(F.array().cast("array<string>"))).withColumn("success", here)
    confident = gates.confidence(F.col("missing"))
    return out.withColumn("evaluated_confidence", F.when(here, confident)).withColumn("next_phase", F.when(~here, F.col("phase")).when(confident == "high", "IMPACT_ANALYSIS").otherwise("SEMANTIC"))


# What to do next in each phase.
INSTRUCTIONS = {
    "EXPLORATION": "submit_exploration",
    "SEMANTIC": "submit_semantic",
    "VERIFICATION": "submit_verification",
    "IMPACT_ANALYSIS": "submit_impact_analysis",
    "READY": "submit_for_review",
    "PRE_COMMIT": "finalize_changes",
    "QUALITY_REVIEW": "merge_to_base",
}


def next_instruction(phase: Column) -> Column:
    return F.coalesce(*(F.when(phase == p, F.lit(t)) for p, t in INSTRUCTIONS.items()))
