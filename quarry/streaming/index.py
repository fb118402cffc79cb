"""Streaming: an index that follows its files, and event-time windows over tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text as X
from quarry.operators.chunks import COLUMNS, SCHEMA, chunk
from quarry.sources import merge
from quarry.sources.sinks import clear, folders

#: Buckets of an index's state; a batch reads and writes those of its paths.
BUCKETS = 64


def file_stream(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(path, content, hash, lang) of files as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(root)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), X.content_hash(F.col("content")).alias("hash"), X.language_of(F.col("path")).alias("lang"))


STATE = "path string, hash string, batch long"


def _table(spark: SparkSession, index: str, buckets: int = BUCKETS) -> str:
    """Where the index's state is: a table that merges, with the path as its key."""
    if not merge.snapshots(spark, f"{index}/state"):
        merge.create(spark.createDataFrame([], STATE), f"{index}/state", ["path"], buckets)
    return f"{index}/state"


def state(spark: SparkSession, index: str) -> DataFrame:
    """(path, hash, batch) of the files in an index; batch is the one that wrote a file's chunks."""
    return merge.Snapshot(spark, _table(spark, index)).read()


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """Chunks of all files as they are now: those that a file's last batch wrote."""
    now = state(spark, index).select(F.col("path").alias("file"), "batch")
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{index}/chunks").join(now, ["file", "batch"], "left_semi").drop("batch").select(*COLUMNS)


def index_batch(batch: DataFrame, batch_id: int, index: str) -> None:
    """Adds a batch's files to the index at a path; run again it gives the same. Files whose content is known already are left alone.

    The batch's chunks are written to a folder of their own, and then its state is merged, by which they count; of the
    state only the buckets of its paths are read and written, so a batch costs the same at any age of the index but for
    their size. Old chunks stay until compact().
    """
    spark = batch.sparkSession
    table = merge.Snapshot(spark, _table(spark, index))
    touched = [r["b"] for r in batch.select(merge.bucket_of(["path"], table.buckets).alias("b")).distinct().collect()]
    # What this batch has written itself, before it was broken off, doesn't count as known.
    before = table.read(touched).filter(F.col("batch") != batch_id)
    # A null hash beside a new one is a change, too.
    known = before.select("path", F.col("hash").alias("was"), F.lit(True).alias("there"))
    changed = batch.join(known, "path", "left").filter("there IS NULL OR NOT hash <=> was").drop("was", "there")
    chunk(changed).write.mode("overwrite").parquet(f"{index}/chunks/batch={batch_id}")
    merge.merge(f"{index}/state", changed.select("path", "hash", F.lit(batch_id).cast("long").alias("batch")))


def forget(spark: SparkSession, gone: DataFrame, index: str) -> None:
    """Takes files (path) that have gone out of the index."""
    merge.merge(_table(spark, index), gone=gone)


def compact(spark: SparkSession, index: str) -> None:
    """Makes one batch of all chunks that count, in place, and removes the others. Batches made so have numbers below zero."""
    old = folders(spark, f"{index}/chunks")
    number = min([0, *(int(n.removeprefix("batch=")) for n in old)]) - 1
    indexed(spark, index).write.mode("overwrite").parquet(f"{index}/chunks/batch={number}")
    merge.merge(f"{index}/state", state(spark, index).withColumn("batch", F.lit(number).cast("long")))
    merge.vacuum(spark, f"{index}/state", keep=1)
    for name in old:
        clear(spark, f"{index}/chunks/{name}")


def follow(spark: SparkSession, root: str, index: str, checkpoint: str) -> StreamingQuery:
    """Indexes what is new at root, then stops; call it again when its time to live is over."""
    return file_stream(spark, root).writeStream.foreachBatch(lambda df, i: index_batch(df, i, index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Timestamps without a zone can't have a watermark; they are taken as UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], window: str = "1 hour", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """An extension: counts by window and keys."""
    return event_time(events, column).withWatermark(column, late).groupBy(F.window(column, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sliding(events: DataFrame, keys: list[str], window: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """An extension: counts by overlapping windows and keys."""
    return event_time(events, column).withWatermark(column, late).groupBy(F.window(column, window, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """An extension: runs of events of a key with no gap as long as that."""
    return event_time(events, column).withWatermark(column, late).groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
