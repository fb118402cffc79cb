"""From a question to the operators that answer it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

SLOTS = ("target_feature", "trigger_condition", "observed_issue", "desired_action")
# Tools by missing slot, and tools that help to fill it.
SLOT_TOOLS = {
    "target_feature": ("find_definitions", "search_text", "get_symbols"),
    "trigger_condition": ("find_references", "search_text"),
    "observed_issue": ("search_text", "analyze_structure"),
    "desired_action": (),
}
SLOT_HINTS = {
    "target_feature": ("query", "get_symbols", "analyze_structure"),
    "observed_issue": ("search_text", "query"),
    "trigger_condition": ("search_text", "find_definitions"),
    "desired_action": ("find_references", "analyze_structure"),
}
# Intents, and the phases that each goes through.
INTENTS = ("IMPLEMENT", "MODIFY", "DELETE", "EXPLORE")
PHASES = {"EXPLORE": ("EXPLORATION",)}
CODE_PHASES = ("EXPLORATION", "VERIFICATION", "READY")
CODE_FIRST = ("target_feature", "observed_issue", "trigger_condition", "desired_action")


def _list(xs: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(x) for x in xs)).cast("array<string>")


def _of(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, _list(v)) for k, v in table.items()), F.array().cast("array<string>"))


def missing_slots(slots: dict[str, Column]) -> Column:
    """Names of the slots that are empty, in fixed order."""
    return F.array_compact(F.array(*(F.when(F.length(F.coalesce(slots[s], F.lit(""))) == 0, s) for s in SLOTS)))


def intent_of(intent: Column) -> Column:
    """An intent that isn't known is EXPLORE."""
    return F.when(intent.isin(*INTENTS), intent).otherwise("EXPLORE")


def tools_for(missing: Column) -> Column:
    """Tools in order of the slots, each once."""
    return F.array_distinct(F.flatten(F.transform(missing, lambda s: _of(SLOT_TOOLS, s))))


def guidance_tools(missing: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(missing, lambda s: _of(SLOT_HINTS, s))))


def required_phases(intent: Column) -> Column:
    return F.when(intent_of(intent) == "EXPLORE", _list(("EXPLORATION",))).otherwise(_list(CODE_PHASES))


def risk(missing: Column) -> Column:
    return F.when(F.size(missing) >= 3, "HIGH").when(F.size(missing) == 2, "MEDIUM").otherwise("LOW")


def frame_risk(intent: Column, slots: dict[str, Column], hypothesis: Column) -> Column:
    """By how complete a frame is. High: an action without an issue, a change without a target, or nothing at all to
    implement. Medium: an issue of fewer than ten characters, or slots that are hypotheses."""
    some = {s: F.length(F.coalesce(slots[s], F.lit(""))) > 0 for s in SLOTS}
    anything = some["target_feature"] | some["trigger_condition"] | some["observed_issue"] | some["desired_action"]
    high = (some["desired_action"] & ~some["observed_issue"]) | ((intent == "MODIFY") & ~some["target_feature"]) | ((intent == "IMPLEMENT") & ~anything)
    return F.when(high, "HIGH").when(some["observed_issue"] & (F.length(slots["observed_issue"]) < 10), "MEDIUM").when(hypothesis, "MEDIUM").otherwise("LOW")


def priority_slots(intent: Column, missing: Column) -> Column:
    return F.when(intent_of(intent) == "EXPLORE", F.array_intersect(_list(SLOTS), missing)).otherwise(F.array_intersect(_list(CODE_FIRST), missing))


def frame_of(query: Column, extracted: dict[str, tuple[Column, Column]]) -> Column:
    """struct(slots, source, quotes), maps by slot, of what was extracted from a query: (value, quote) for each slot.

    A slot counts only if its value is quoted from the query and agrees with its quote; it is a fact then.
    """
    kind = "map<string,string>"
    ok = {s: X.slot_valid(query, *extracted[s]) for s in SLOTS if s in extracted}
    of = lambda value: F.map_from_entries(F.array_compact(F.array(*(F.when(ok[s], F.struct(F.lit(s).alias("k"), value(s).alias("v"))) for s in ok)))).cast(kind)
    return F.struct(of(lambda s: extracted[s][0]).alias("slots"), of(lambda s: F.lit("FACT")).alias("source"), of(lambda s: extracted[s][1]).alias("quotes"))


def plan(frames: DataFrame) -> DataFrame:
    """frames with missing, intent, tools, steps (tool and priority, first highest), phases, risk and needs_bootstrap.

    frames has the columns of SLOTS, intent, and first_query (boolean).
    """
    missing = missing_slots({s: F.col(s) for s in SLOTS})
    rows = frames.withColumn("missing", missing).withColumn("intent", intent_of(F.col("intent")))
    tools = F.when(F.col("intent") == "EXPLORE", F.array_union(tools_for(F.col("missing")), _list(("analyze_structure",)))).otherwise(tools_for(F.col("missing")))
    rows = rows.withColumn("tools", tools)
    steps = F.transform("tools", lambda t, i: F.struct(t.alias("tool"), (F.size("tools") - i).alias("priority")))
    code = F.col("intent") != "EXPLORE"
    reason = F.when(code, F.concat(F.lit("intent_"), F.lower("intent"))).when(F.col("first_query"), "first_query")
    return rows.withColumns({"steps": steps, "required_phases": required_phases(F.col("intent")), "risk_level": risk(F.col("missing")), "needs_bootstrap": code | F.coalesce(F.col("first_query"), F.lit(False)), "bootstrap_reason": reason})


@dataclass
class Corpus:
    """The tables that a plan's steps read."""

    files: DataFrame
    nodes: DataFrame
    tags: DataFrame


def execute(corpus: Corpus, tools: list[str], text: str) -> DataFrame:
    """(tool, file, start_line, snippet): the results of all steps as one table, snippets cut to 200 characters."""
    from functools import reduce

    from quarry.operators import symbols as S
    from quarry.operators.search import search

    def unified(tool: str, df: DataFrame, line: str, snippet: str) -> DataFrame:
        return df.select(F.lit(tool).alias("tool"), F.col("path").alias("file"), F.col(line).cast("int").alias("start_line"), F.substring(F.coalesce(F.col(snippet), F.lit("")), 1, 200).alias("snippet"))

    builders = {
        "search_text": lambda: unified("search_text", search(corpus.files, text, literal=True), "line_number", "line_content"),
        "find_definitions": lambda: unified("find_definitions", S.find_definitions(corpus.tags, text), "line", "name"),
        "find_references": lambda: unified("find_references", S.find_references(corpus.files, corpus.tags, text), "line", "content"),
        "get_symbols": lambda: unified("get_symbols", corpus.tags, "line", "name"),
        "analyze_structure": lambda: unified("analyze_structure", corpus.nodes, "start_line", "name"),
    }
    parts = [builders[t]() for t in tools if t in builders]
    return reduce(DataFrame.unionByName, parts) if parts else corpus.files.select(F.lit("").alias("tool"), F.col("path").alias("file"), F.lit(0).alias("start_line"), F.lit("").alias("snippet")).limit(0)
