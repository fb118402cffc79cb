"""Logs of decisions and outcomes, and what they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OUTCOMES = ("success", "failure", "partial")
RISKS = ("HIGH", "MEDIUM", "LOW")


def last_n(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows; each task keeps n of its own."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def outcome_counts(by: Column | None = None) -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]


def outcome_stats(outcomes: DataFrame, n: int = 1000, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(total, success, failure, partial) of the last n; others count in the total only."""
    return last_n(outcomes, n, list(order)).agg(F.count("*").alias("total"), *outcome_counts())


def by_group(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, success, failure, partial); a null key is "unknown"; a group without known outcomes has zeros."""
    return outcomes.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(*outcome_counts())


def correlation(outcomes: DataFrame, key: str, values: tuple[str, ...] | None = None) -> DataFrame:
    """(key, success, failure): how successes and failures fall on a key's values, partial ones aside."""
    rows = outcomes.filter(F.col("outcome").isin("success", "failure"))
    rows = rows.filter(F.col(key).isin(*values)) if values else rows
    return rows.groupBy(key).agg(F.count_if(F.col("outcome") == "success").alias("success"), F.count_if(F.col("outcome") == "failure").alias("failure"))


def first_decision(decisions: DataFrame, order: list[str], session: str = "session_id") -> DataFrame:
    return _one(decisions, session, [F.col(c) for c in order])


def last_decision(decisions: DataFrame, order: list[str], session: str = "session_id") -> DataFrame:
    return _one(decisions, session, [F.col(c).desc() for c in order])


def _one(rows: DataFrame, session: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(*order))).filter("_r = 1").drop("_r")


def matched(outcomes: DataFrame, decisions: DataFrame, order: list[str], session: str = "session_id") -> DataFrame:
    """outcomes with the last decision of their session (struct decision, null without one).

    Decisions are brought to one a session by an aggregate that is partial before the
    shuffle, so a session with many decisions is no hot key of the join.
    """
    last = decisions.groupBy(session).agg(F.max_by(F.struct(*(c for c in decisions.columns if c != session)), F.struct(*order)).alias("decision"))
    return outcomes.join(last, session, "left")


def tool_failures(joined: DataFrame, tools: str = "decision.tools_planned") -> DataFrame:
    """(tool, failures): tools planned in sessions that failed."""
    rows = joined.filter((F.col("outcome") == "failure") & F.col("decision").isNotNull())
    return rows.select(F.explode(tools).alias("tool")).groupBy("tool").agg(F.count("*").alias("failures"))


def risk_correlation(joined: DataFrame) -> DataFrame:
    rows = joined.filter(F.col("decision").isNotNull()).withColumn("risk_level", F.col("decision.risk_level"))
    return correlation(rows, "risk_level", RISKS)


def failure_points(outcomes: DataFrame, point: str = "failure_point") -> DataFrame:
    """(failure_point, n) of failures that name one."""
    return outcomes.filter((F.col("outcome") == "failure") & (F.length(F.col(point)) > 0)).groupBy(F.col(point).alias("failure_point")).agg(F.count("*").alias("n"))


def matched_count(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count_if(F.col("decision").isNotNull()).alias("matched"))


def session_analysis(decisions: DataFrame, outcomes: DataFrame, order: list[str], session: str = "session_id") -> DataFrame:
    """(session, has_decision, n_outcomes, final_outcome, failure_point); a session of either side is there."""
    d = decisions.select(session).distinct().withColumn("has_decision", F.lit(True))
    o = outcomes.groupBy(session).agg(F.count("*").alias("n_outcomes"), F.max_by("outcome", F.struct(*order)).alias("final_outcome"), F.max_by("failure_point", F.struct(*order)).alias("failure_point"))
    return d.join(o, session, "full_outer").select(session, F.coalesce("has_decision", F.lit(False)).alias("has_decision"), F.coalesce("n_outcomes", F.lit(0)).alias("n_outcomes"), "final_outcome", "failure_point")


def phase_durations(history: DataFrame, session: str = "session_id", at: str = "started_at", order: tuple[str, ...] = ()) -> DataFrame:
    """history with ended_at (the next phase's start) and duration_seconds."""
    w = Window.partitionBy(session).orderBy(at, *order)
    seconds = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return history.withColumn("ended_at", F.lead(at).over(w)).withColumn("duration_seconds", seconds / 1e6)


def call_durations(calls: DataFrame) -> DataFrame:
    """Tool calls with their seconds; one that never ended has none."""
    return calls.withColumn("duration_seconds", (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)


def failure_runs(events: DataFrame, failed: Column, reset: Column, order: list[str], session: str = "session_id", threshold: int = 3) -> DataFrame:
    """events with failure_count since the last reset, near (one below the threshold), intervene and interventions so far."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    era = events.withColumn("_f", failed.cast("int")).withColumn("interventions", F.sum(reset.cast("int")).over(w).cast("long"))
    within = Window.partitionBy(session, "interventions").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = era.withColumn("failure_count", F.sum("_f").over(within).cast("long"))
    return counted.withColumn("near", F.col("failure_count") >= threshold - 1).withColumn("intervene", F.col("failure_count") >= threshold).withColumn("escalate", F.col("interventions") >= 2).drop("_f")


def revert_cap(events: DataFrame, reverted: Column, order: list[str], session: str = "session_id", most: int = 3) -> DataFrame:
    """events with how often a session has gone back, and whether it has to end."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(reverted.cast("int")).over(w).cast("long")
    return events.withColumn("reverts", n).withColumn("forced", n > most)


def fan_out(outcomes: DataFrame) -> DataFrame:
    """(session_id, nl_term, symbol, similarity, code_evidence) of successes: a row for each mapped symbol."""
    rows = outcomes.filter("outcome = 'success'").select("session_id", F.explode("mapped_symbols").alias("s"))
    return rows.groupBy("session_id", F.col("s.nl_term").alias("nl_term"), F.col("s.symbol").alias("symbol")).agg(F.max("s.confidence").alias("similarity"), F.array_join(F.array_sort(F.collect_set("s.evidence")), "; ").alias("code_evidence"))


def outcome_cube(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """An extension: counts over all combinations of keys."""
    return outcomes.cube(*keys).agg(F.count("*").alias("n"))
