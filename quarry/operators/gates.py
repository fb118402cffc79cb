"""Gates between the phases of a session, as rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tools that a phase allows; * allows all.
ALLOWED = {
    "EXPLORATION": ("query", "search_text", "find_definitions", "find_references", "analyze_structure", "get_symbols", "get_function_at_line", "search_files", "submit_exploration"),
    "SEMANTIC": ("semantic_search", "submit_semantic", "search_text", "find_definitions", "find_references"),
    "VERIFICATION": ("query", "search_text", "find_definitions", "find_references", "analyze_structure", "submit_verification"),
    "IMPACT_ANALYSIS": ("analyze_impact", "submit_impact_analysis", "query", "search_text", "find_definitions", "find_references", "analyze_structure"),
    "READY": ("*", "submit_for_review"),
    "PRE_COMMIT": ("review_changes", "finalize_changes", "merge_to_base"),
    "QUALITY_REVIEW": (),
}
# Least numbers of symbols, entry points, files and patterns, and slots that need evidence.
THRESHOLDS = {
    "HIGH": (5, 2, 4, 2, ("target_feature", "observed_issue")),
    "MEDIUM": (3, 1, 2, 1, ("target_feature",)),
    "LOW": (3, 1, 2, 1, ()),
    "OTHER": (1, 0, 1, 0, ()),
}
COUNTED = ("symbols_identified", "entry_points", "files_analyzed", "existing_patterns")
REQUIRED_TOOLS = ("find_definitions", "find_references")
# Reasons for a semantic search by what is missing; two hold for anything.
REASONS = {
    "symbols_identified": ("no_definition_found", "architecture_unknown"),
    "entry_points": ("no_definition_found", "no_reference_found"),
    "existing_patterns": ("no_similar_implementation", "architecture_unknown"),
    "files_analyzed": ("context_fragmented", "architecture_unknown"),
    "required_tools": (),
}
ALWAYS = ("context_fragmented", "architecture_unknown")
# Tools that can be evidence.
EVIDENCE_TOOLS = ("find_definitions", "find_references", "search_text", "analyze_structure", "query")
# Each phase to the next.
NEXT = {"EXPLORATION": "SEMANTIC", "SEMANTIC": "VERIFICATION", "VERIFICATION": "IMPACT_ANALYSIS", "IMPACT_ANALYSIS": "READY", "READY": "PRE_COMMIT", "PRE_COMMIT": "QUALITY_REVIEW", "QUALITY_REVIEW": "READY"}


def _list(xs: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(x) for x in xs)).cast("array<string>")


def allowed_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, t) for p, ts in ALLOWED.items() for t in ts], "phase string, tool string")


def tool_allowed(phase: Column, tool: Column) -> Column:
    """Without a phase (no session) everything is."""
    out = F.when(phase.isNull(), True)
    for p, tools in ALLOWED.items():
        out = out.when(phase == p, F.lit("*" in tools) | (F.array_contains(_list(tools), tool) if tools else F.lit(False)))
    return out.otherwise(False)


def blocked_calls(calls: DataFrame) -> DataFrame:
    return calls.filter(~tool_allowed(F.col("phase"), F.col("tool")))


def blocked_reason(phase: Column, tool: Column) -> Column:
    return F.when(~tool_allowed(phase, tool), F.concat(F.lit("Tool '"), tool, F.lit("' is not allowed in phase "), phase))


def level(intent: Column, risk: Column) -> Column:
    return F.when(~intent.isin("IMPLEMENT", "MODIFY"), "OTHER").when(risk.isin("HIGH", "MEDIUM"), risk).otherwise("LOW")


def missing_requirements(lists: dict[str, Column], tools: Column, evidenced: Column, intent: Column, risk: Column) -> Column:
    """array<string>: what an exploration lacks, as `key: have/need` and the like, in fixed order."""
    at = level(intent, risk)
    need = lambda k: F.coalesce(*(F.when(at == name, F.lit(t[k])) for name, t in THRESHOLDS.items()))
    parts = [F.when(F.size(lists[c]) < need(k), F.concat(F.lit(f"{c}: "), F.size(lists[c]).cast("string"), F.lit("/"), need(k).cast("string"))) for k, c in enumerate(COUNTED)]
    lacking = F.array_except(_list(REQUIRED_TOOLS), tools)
    parts.append(F.when(F.size(lacking) > 0, F.concat(F.lit("required_tools: missing "), F.array_join(F.array_sort(lacking), ", "))))
    for slot in ("target_feature", "observed_issue"):
        asked = at.isin(*(n for n, t in THRESHOLDS.items() if slot in t[4]))
        parts.append(F.when(asked & ~F.array_contains(evidenced, slot), f"slot_evidence: {slot} not evidenced"))
    return F.array_compact(F.array(*parts))


def confidence(missing: Column) -> Column:
    return F.when(F.size(missing) == 0, "high").otherwise("low")


def inconsistencies(symbols: Column, entries: Column, files: Column, patterns: Column) -> Column:
    """array<string>: entry points without a symbol, patterns without files, and repeated symbols or files."""
    base = lambda e: F.trim(F.split_part(F.split_part(e, F.lit("."), F.lit(1)), F.lit("("), F.lit(1)))
    loose = F.filter(entries, lambda e: ~F.exists(symbols, lambda s: F.contains(s, base(e)) | F.contains(base(e), s)))
    again = lambda xs, name: F.when(F.size(F.array_distinct(xs)) < F.size(xs), F.concat(F.lit(f"duplicate {name} detected: "), F.size(xs).cast("string"), F.lit(" given, "), F.size(F.array_distinct(xs)).cast("string"), F.lit(" unique")))
    some = F.array_compact(F.array(F.when((F.size(patterns) > 0) & (F.size(files) == 0), "patterns provided but no files analyzed"), again(symbols, "symbols"), again(files, "files")))
    return F.concat(F.transform(loose, lambda e: F.concat(F.lit("entry_point '"), e, F.lit("' not linked to any symbol in symbols_identified"))), some)


def semantic_reason_allowed(missing: Column, reason: Column) -> Column:
    """Whether a reason answers to what is missing; without anything missing none does."""
    keys = F.transform(missing, lambda m: F.trim(F.split_part(m, F.lit(":"), F.lit(1))))
    fits = F.lit(False)
    for key, reasons in REASONS.items():
        if reasons:
            fits = fits | (F.array_contains(keys, key) & reason.isin(*reasons))
    return (F.size(missing) > 0) & (fits | reason.isin(*ALWAYS))


def evidence_valid(e: Column) -> Column:
    return F.coalesce(e["tool"].isin(*EVIDENCE_TOOLS) & (F.length(F.trim(e["target"])) > 0) & (F.length(F.trim(e["result"])) > 0), F.lit(False))


def verification_result(verified: DataFrame, by: str = "session_id") -> DataFrame:
    """(session, all_confirmed, rejected) from verified(session, hypothesis, status)."""
    return verified.groupBy(by).agg(F.every(F.col("status") == "confirmed").alias("all_confirmed"), F.array_sort(F.collect_list(F.when(F.col("status") == "rejected", F.col("hypothesis")))).alias("rejected"))


def write_allowed(targets: DataFrame, explored: DataFrame, by: str = "session_id") -> DataFrame:
    """targets(session, path, is_new) with allowed: an explored path, or one of its name; for a new file an explored one in its directory.

    A session that has explored nothing may write anything. Explored files come to one
    row for each way of asking, so each target meets one row at most.
    """
    norm = lambda c: F.regexp_replace(c, r"^\./", "")
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    parent = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    p = norm(F.col("path"))
    keys = explored.select(by, F.explode(F.array(F.concat(F.lit("p:"), p), F.concat(F.lit("n:"), name(p)), F.concat(F.lit("d:"), parent(p)), F.lit("any"))).alias("k")).distinct()
    asked = targets.withColumn("_id", F.monotonically_increasing_id())
    wants = asked.select("_id", by, F.explode(F.array_compact(F.array(F.concat(F.lit("p:"), p), F.concat(F.lit("n:"), name(p)), F.when(F.col("is_new"), F.concat(F.lit("d:"), parent(p))), F.lit("any")))).alias("k"))
    got = wants.join(keys, [by, "k"]).groupBy("_id").agg(F.max(F.col("k") != "any").alias("hit"))
    return asked.join(got, "_id", "left").select(*targets.columns, (F.col("hit").isNull() | F.col("hit")).alias("allowed"))


def assessment_valid(required: Column, reason: Column) -> Column:
    return required.isNotNull() & (F.length(F.trim(F.coalesce(reason, F.lit("")))) >= 10)


def next_phase(phase: Column, needed: Column, gate: Column) -> Column:
    """full runs every phase; auto follows the assessment; impact analysis that isn't needed leads to READY."""
    step = F.coalesce(*(F.when(phase == a, F.lit(b)) for a, b in NEXT.items()))
    return F.when((gate == "full") | needed, phase).otherwise(F.when(phase == "IMPACT_ANALYSIS", "READY").otherwise(step))


def start_phase(intent: Column, skip_exploration: Column) -> Column:
    return F.when((intent == "QUESTION") | skip_exploration, "READY").otherwise("EXPLORATION")


def ready_errors(slot_source: Column, symbols: Column) -> Column:
    """array<string>: slots, then symbols, that are still hypotheses. slot_source is a map, symbols array<struct<name, source>>."""
    slots = F.transform(F.filter(F.map_entries(slot_source), lambda e: e["value"] == "HYPOTHESIS"), lambda e: F.concat(F.lit("Slot '"), e["key"], F.lit("' is still HYPOTHESIS.")))
    loose = F.transform(F.filter(symbols, lambda s: s["source"] == "HYPOTHESIS"), lambda s: s["name"])
    return F.concat(slots, F.when(F.size(loose) > 0, F.array(F.concat(F.lit("Symbols "), F.array_join(loose, ", "), F.lit(" are still HYPOTHESIS.")))).otherwise(F.array().cast("array<string>")))


def fold_symbols(updates: DataFrame, order: list[str], session: str = "session_id") -> DataFrame:
    """updates(session, name, source, confidence) to one row for each name of a session: a fact overwrites what was before, and so does higher confidence.

    What is left is the last fact, or of what came after it the first with the highest confidence, if that is higher. So
    it is two aggregates by session and name, partial before the shuffle; no session is gathered.
    """
    at = F.struct(*order)
    facts = updates.groupBy(session, "name").agg(F.max(F.when(F.col("source") == "FACT", at)).alias("_fact"))
    since = updates.withColumn("_at", at).join(facts, [session, "name"]).filter(F.col("_fact").isNull() | (F.col("_at") >= F.col("_fact")))
    best = since.groupBy(session, "name").agg(F.max(F.coalesce("confidence", F.lit(float("-inf")))).alias("_best"))
    first = since.join(best, [session, "name"]).filter(F.coalesce("confidence", F.lit(float("-inf"))) == F.col("_best"))
    return first.groupBy(session, "name").agg(F.min_by(F.struct("source", "confidence"), "_at").alias("_s")).select(session, "name", "_s.source", "_s.confidence")


def add_explored(old: Column, new: Column) -> Column:
    return F.array_union(old, new)


def discard_reasons_missing(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter((F.col("decision") == "discard") & (F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0))


# What to do after a phase has been checked, where it is needed, and where what follows it is next.
NEEDED = {
    "SEMANTIC": "Execute SEMANTIC phase: Use semantic_search to gather additional information, then call submit_semantic.",
    "VERIFICATION": "Execute VERIFICATION phase: Verify hypotheses using code-intel tools, then call submit_verification.",
    "IMPACT_ANALYSIS": "Execute IMPACT_ANALYSIS phase: Analyze impact range using analyze_impact, then call submit_impact_analysis.",
}
SKIPPED = {
    "Q2_CHECK": "SEMANTIC skipped. Now check VERIFICATION necessity using check_phase_necessity(phase='VERIFICATION', assessment={...}).",
    "Q3_CHECK": "VERIFICATION skipped. Now check IMPACT_ANALYSIS necessity using check_phase_necessity(phase='IMPACT_ANALYSIS', assessment={...}).",
    "READY": "IMPACT_ANALYSIS skipped. Proceed to READY phase for implementation.",
}
OTHERWISE = "Proceed to next step."


def instruction(phase: Column, needed: Column, following: Column) -> Column:
    """What to do after a check of whether a phase is needed."""
    pick = lambda key, texts: F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in texts.items()), F.lit(OTHERWISE))
    return F.when(needed, pick(phase, NEEDED)).otherwise(pick(following, SKIPPED))


def submitted_for_review(sessions: DataFrame) -> DataFrame:
    """sessions(session_id, phase, branch) with success and next_phase: one that is READY and has its branch goes on to PRE_COMMIT."""
    good = F.coalesce((F.col("phase") == "READY") & F.col("branch"), F.lit(False))
    return sessions.withColumn("success", good).withColumn("next_phase", F.when(good, "PRE_COMMIT").otherwise(F.col("phase")))


def reviewed(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, success, kept, discarded, message) of what sessions(session_id, phase) hand in: files(session_id, pos, path, decision, reason).

    A session must be in PRE_COMMIT, and who discards a file must say why; of several without a reason the first is named.
    Without a decision a file is kept. Paths come in the order of pos.
    """
    decision = F.coalesce("decision", F.lit("keep"))
    place = F.struct("pos", "path")
    paths = lambda keep: F.transform(F.array_sort(F.collect_list(F.when((decision == "keep") == F.lit(keep), place))), lambda x: x["path"])
    wordless = (decision == "discard") & (F.length(F.coalesce("reason", F.lit(""))) == 0)
    by = files.groupBy("session_id").agg(paths(True).alias("kept"), paths(False).alias("discarded"), F.min(F.when(wordless, place))["path"].alias("lacking"))
    none = F.array().cast("array<string>")
    here = F.coalesce(F.col("phase") == "PRE_COMMIT", F.lit(False))
    good = here & F.col("lacking").isNull()
    # The messages.
    message = (
        F.when(~here, F.concat(F.lit("Cannot submit review in phase "), F.col("phase"), F.lit(". Must be in PRE_COMMIT phase.")))
        .when(F.col("lacking").isNotNull(), F.concat(F.lit("Discarding '"), F.col("lacking"), F.lit("' requires a reason.")))
        .otherwise(F.format_string("Review complete. %d files to keep, %d files to discard.", F.size(F.coalesce("kept", none)), F.size(F.coalesce("discarded", none))))
    )
    of = lambda c: F.when(good, F.coalesce(c, none)).otherwise(none).alias(c)
    return sessions.join(by, "session_id", "left").select("session_id", good.alias("success"), of("kept"), of("discarded"), message.alias("message"))
