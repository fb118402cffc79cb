"""Runs that keep what they know in tables: the tag cache, the index's state and chunks with a stamp for each run, and the context's summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X
from quarry.operators import symbols, sync
from quarry.operators.chunks import chunk, chunk_lists
from quarry.sources import files as S
from quarry.sources import merge, sinks

# Extensions of the files that a scan for definitions reads.
TAG_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".php", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb")
TAG = "struct<name:string,line:int,kind:string,scope:string,signature:string>"
CACHE = f"path string, hash string, language string, tags array<{TAG}>"
STATE = "path string, hash string, mtime double, indexed_at string, chunk_count long"
RUNS = "run long, ran_at string, added long, modified long, deleted long, unchanged long, errors long"
BUCKETS = 64


def _table(spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str]) -> merge.Snapshot:
    return merge.Snapshot(spark, path) if merge.snapshots(spark, path) else merge.create(spark.createDataFrame([], schema), path, keys, BUCKETS)


def scan_tags(files: DataFrame, cache: str, language: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(name, path, line, kind, scope, signature) of all that source files define, and how many files were scanned and how many of these came from the cache.

    files(path, content, hash, lang). The cache is a table that merges, with the path as its key; an entry holds for the
    content and the language asked for. Only files that it lacks are read for tags, and only they are put into it.
    """
    spark = files.sparkSession
    wanted = S.symbol_files(files).filter(X.extension(F.col("path")).isin(*TAG_EXTENSIONS))
    known = _table(spark, cache, CACHE, ["path"])
    found, seen = symbols.looked_up(wanted.select("path", "hash"), known.read(), language)
    marked = sinks.cut(found)
    # A file's text meets its mark by its path; of those that hit nothing more is read.
    missing = wanted.join(marked.filter("NOT hit").select("path"), "path", "left_semi")
    own = symbols.tags(symbols.structure(missing.select("path", "content", "lang")))
    lists = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "line", "kind", "scope", "signature").cast(TAG))).alias("tags"))
    fresh = marked.filter("NOT hit").select("path", "hash").join(lists, "path", "left").select("path", "hash", F.lit(language).cast("string").alias("language"), F.coalesce("tags", F.array().cast(f"array<{TAG}>")).alias("tags"))
    now = merge.merge(cache, fresh)
    out = now.read().join(marked.select("path"), "path", "left_semi").select("path", F.explode("tags").alias("t")).select("t.name", "path", "t.line", "t.kind", "t.scope", "t.signature")
    counts = seen.get
    return out, {"files_scanned": counts["hits"] + counts["misses"], "files_cached": counts["hits"]}


def run(files: DataFrame, folder: str, at: str) -> dict[str, int]:
    """One incremental run into the tables below a folder: chunks (a row a file), state and runs; what it did, as its row in runs says.

    files(path, content, hash, mtime, lang). Chunks are merged first, then the state by which changes are found, then the
    run's stamp; a run that was broken off does the rest when it is run again. Only buckets with changes are written.
    """
    spark = files.sparkSession
    state = _table(spark, f"{folder}/state", STATE, ["path"])
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("chunks", T.ArrayType(chunk(files.limit(0)).schema))])
    _table(spark, f"{folder}/chunks", kind, ["path"])
    changed, seen = sync.observed_changes(sync.changes(files, state.read()))
    changed = sinks.cut(changed)
    counts = seen.get
    fresh = files.join(changed.filter("change IN ('added', 'modified')").select("path"), "path", "left_semi")
    gone = changed.filter("change = 'deleted'").select("path")
    new = sinks.cut(chunk_lists(fresh.select("path", "content", "lang", "hash", F.col("mtime").cast("double").alias("mtime"), F.col("content").isNull().alias("error"))))
    merge.merge(f"{folder}/chunks", new.select("path", "chunks"), gone)
    merge.merge(f"{folder}/state", new.select("path", "hash", "mtime", F.lit(at).alias("indexed_at"), F.size("chunks").cast("long").alias("chunk_count")), gone)
    done = {c: counts[c] for c in ("added", "modified", "deleted", "unchanged")} | {"errors": new.filter("error").count()}
    runs = _table(spark, f"{folder}/runs", RUNS, ["run"])
    merge.merge(f"{folder}/runs", spark.createDataFrame([(runs.count() + 1, at, *done.values())], RUNS))
    return done


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks in the tables below a folder."""
    return merge.Snapshot(spark, f"{folder}/chunks").read().select(F.explode("chunks").alias("c")).select("c.*")


def save_context(new: DataFrame, folder: str, now: Column) -> None:
    """Writes the context's summaries(path, summary, content_hash) in place of those stored, whose notes they keep, and stamps all; without new ones the stored ones are stamped.

    A version counts from when it is finished (sinks.swap).
    """
    spark = new.sparkSession
    there = sinks.exists(spark, folder)
    old = sinks.read(spark, folder) if there else spark.createDataFrame([], "path string, summary string, content_hash string, extra_notes string, last_synced string")
    some = new.limit(1).count() > 0
    rows = sync.merge_summaries(old, new) if some else old.drop("last_synced")
    sinks.swap(rows.withColumn("last_synced", now.cast("string")), folder)
