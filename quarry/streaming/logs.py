"""Streams of logs: failures and interventions by session, outcomes with their decisions, learned pairs that expire.

Each ends with the rows of its batch form, also when it was stopped and run again: state
and sinks go with the checkpoint, and a file sink counts a batch's files once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources import merge


def files_as_stream(spark: SparkSession, folder: str, schema: object, per_batch: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream, so many a batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


#: Rows in a file of a log, about.
FILE_ROWS = 500_000


def in_files(rows: DataFrame, folder: str, order: str, files: int, by: str | None = None) -> int:
    """Appends rows to a folder in files that follow each other by `order`, one written after the other (as logs come in); in how many files each.

    by: rows with one value of it stay together, and with many rows there are files beside each other, written by tasks
    of their own; those of one value still follow each other by `order`.
    """
    beside = max(1, -(-rows.count() // (files * FILE_ROWS))) if by else 1
    edges = rows.select(F.percentile_approx(order, [k / files for k in range(1, files)], 1000)).first()[0] if files > 1 else []
    for k in range(files):
        low = F.col(order) > F.lit(edges[k - 1]) if k else F.lit(True)
        high = F.col(order) <= F.lit(edges[k]) if k < files - 1 else F.lit(True)
        own = rows.filter(low & high)
        (own.coalesce(1) if beside == 1 else own.repartition(beside, by)).write.mode("append").parquet(folder)
    return beside


def to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream gives to Parquet files, then stops when all that is there has been taken; run it again for more."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


COUNTS = "failure_count long, interventions long, reverts long"


def counted(events: DataFrame, failed: Column, reset: Column, reverted: Column, order: list[str], session: str = "session_id", threshold: int = 3, most: int = 3, idle: str | None = None) -> DataFrame:
    """As logs.failure_runs and logs.revert_cap together, for a stream in which no session's events come late.

    A session's state is three counts. Within a batch events are taken by `order`. idle: a time after whose passing, by the
    watermark of a timestamp order[0], a session is forgotten and begins anew.
    """
    marked = events.select(*events.columns, failed.cast("boolean").alias("_failed"), reset.cast("boolean").alias("_reset"), reverted.cast("boolean").alias("_reverted"))
    seconds = pd.Timedelta(idle).total_seconds() if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = list(batches)
        rows = own[0] if len(own) == 1 else pd.concat(own, ignore_index=True)
        if len(rows) > 1:
            rows = rows.sort_values(order, kind="stable", ignore_index=True)
        failures, interventions, reverts = state.get if state.exists else (0, 0, 0)
        fail, again, back = (rows.pop(c).fillna(False).to_numpy(dtype=np.int64) for c in ("_failed", "_reset", "_reverted"))
        so_far = failures + np.cumsum(fail)
        # What had been counted before the last reset; a reset's own row counts after it.
        gone = np.maximum.accumulate(np.where(again == 1, so_far - fail, 0))
        rows["failure_count"], rows["interventions"], rows["reverts"] = so_far - gone, interventions + np.cumsum(again), reverts + np.cumsum(back)
        state.update(tuple(int(rows[c].iloc[-1]) for c in ("failure_count", "interventions", "reverts")))
        if idle:
            state.setTimeoutTimestamp(int((pd.Timestamp(rows[order[0]].iloc[-1]).timestamp() + seconds) * 1000))
        yield rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    found = marked.groupBy(session).applyInPandasWithState(step, f"{kinds}, {COUNTS}", COUNTS, "append", timeout)
    n, i = F.col("failure_count"), F.col("interventions")
    return found.withColumns({"near": n >= threshold - 1, "intervene": n >= threshold, "escalate": i >= 2, "forced": F.col("reverts") > most})


def with_decisions(outcomes: DataFrame, decisions: DataFrame, within: str = "1 hour", late: str = "10 minutes", session: str = "session_id") -> DataFrame:
    """outcomes(session_id, ts, event_id, ...) with the decisions(session_id, ts, event_id, ...) of the session in the time before, one row each; those without have one with nulls.

    For streams and tables alike. In a stream both sides have watermarks, and an outcome without a decision comes out when none can come any more.
    """
    left = outcomes.withWatermark("ts", late)
    right = decisions.select(F.col(session).alias("_session"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id")).withWatermark("decided_at", late)
    near = (F.col(session) == F.col("_session")) & (F.col("decided_at") <= F.col("ts")) & (F.col("decided_at") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "left_outer").drop("_session")


def keep_newest(stream: DataFrame, path: str, checkpoint: str, order: str, learned_at: str = "learned_at", days: int = 30) -> StreamingQuery:
    """Learned pairs merged into the table at a path: the newest of each by `order` stays, and those go that are older than `days` before the newest of all.

    The table is one of quarry.sources.merge, with the pair as its key. A batch that is run again changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = merge.merge(path, rows, order=order, stored_later=order)
        table = now.read()
        old = table.join(F.broadcast(table.agg(F.max(learned_at).alias("_now"))), F.col(learned_at) <= F.col("_now") - F.make_dt_interval(days=F.lit(days)))
        merge.merge(path, gone=old.select(*now.keys))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
