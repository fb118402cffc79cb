"""Incremental indexing: what changed since the last time, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.sources.sinks import cut, upsert, without


def changes(files: DataFrame, state: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change): added, modified, deleted or unchanged, from files(key, value) and state(key, value)."""
    a, b = files.select(key, F.col(value).alias("now")), state.select(key, F.col(value).alias("was"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


#: Digests of buckets, and of groups of so many buckets.
BUCKETS, GROUPED = 4096, 64


def digests(rows: DataFrame, buckets: int = BUCKETS, key: str = "path", value: str = "hash") -> DataFrame:
    """(bucket, n, x, s): of each bucket of keys, digests of its rows that don't depend on their order; tasks send one row a bucket."""
    h = F.xxhash64(key, value)
    # One by exclusive or, one by sum (of another hash, in halves, so that it can't run over): 128 bits and a count.
    other = F.xxhash64(F.lit(1), value, key)
    half = lambda shift: F.sum(F.shiftright(other, shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    return rows.groupBy(bucket).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.concat_ws(",", half(0), half(32)).alias("s"))


def _unlike(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Where two tables of digests differ."""
    both = a.join(b.select(by, *(F.col(c).alias(f"_{c}") for c in ("n", "x", "s"))), by, "full_outer")
    return both.filter("NOT (n <=> _n AND x <=> _x AND s <=> _s)").select(by)


def rolled(found: DataFrame) -> DataFrame:
    """Digests of groups of buckets, from those of the buckets."""
    group = F.floor(F.col("bucket") / GROUPED).cast("int").alias("group")
    return found.groupBy(group).agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("bucket", "x")).alias("x"), F.sum(F.xxhash64("bucket", "s").cast("decimal(38,0)")).cast("string").alias("s"))


def unlike_buckets(now: DataFrame, was: DataFrame) -> DataFrame:
    """(bucket): the buckets whose digests differ, by way of the groups that do."""
    top = _unlike(rolled(now), rolled(was), "group")
    group = F.floor(F.col("bucket") / GROUPED).cast("int")
    under = lambda t: t.withColumn("group", group).join(F.broadcast(top), "group", "left_semi").drop("group")
    return _unlike(under(now), under(was), "bucket")


def changes_by_digest(files: DataFrame, state: DataFrame, was: DataFrame | None = None, buckets: int = BUCKETS, key: str = "path", value: str = "hash") -> DataFrame:
    """As changes(), but rows of buckets that are alike are unchanged without being shuffled.

    was: the state's digests, if they have been kept; files and state are best stored with their hashes, as they are read
    twice. As many buckets as are unlike go to every worker, `buckets` at most.
    """
    now = cut(digests(files, buckets, key, value))
    unlike = cut(unlike_buckets(now, was if was is not None else cut(digests(state, buckets, key, value))))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    marked = lambda t: t.select(key, value).withColumn("bucket", bucket)
    touched = lambda t: marked(t).join(F.broadcast(unlike), "bucket", "left_semi").select(key, value)
    alike = marked(files).join(F.broadcast(unlike), "bucket", "left_anti").select(key, F.lit("unchanged").alias("change"))
    return changes(touched(files), touched(state), key, value).unionByName(alike)


def summary(changed: DataFrame) -> DataFrame:
    """(added, modified, deleted, unchanged, total_processed, has_changes)."""
    by = changed.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "unchanged")))
    return by.withColumn("total_processed", F.col("added") + F.col("modified") + F.col("deleted")).withColumn("has_changes", F.col("total_processed") > 0)


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and the number of those that each condition holds for, gathered while they are computed for what they are wanted for."""
    seen = Observation()
    return rows.observe(seen, *(F.count_if(c).alias(n) for n, c in counts.items())), seen


def observed_changes(changed: DataFrame) -> tuple[DataFrame, Observation]:
    """changed, and what summary() says of it but for the last two columns, without a second job."""
    return observed(changed, **{c: F.col("change") == c for c in ("added", "modified", "deleted", "unchanged")})


def next_state(state: DataFrame, files: DataFrame, changed: DataFrame, chunk_counts: DataFrame, now: Column, key: str = "path") -> DataFrame:
    """The state after a run: deleted files gone, added and modified ones as they are now, with their chunks after deduplication."""
    fresh = files.join(changed.filter(F.col("change").isin("added", "modified")).select(key), key).join(chunk_counts, key, "left")
    rows = fresh.select(key, "hash", "mtime", now.alias("indexed_at"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
    return upsert(without(state, changed.filter("change = 'deleted'"), [key]), rows, [key])


def run(files: DataFrame, state: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One incremental run: (chunks, state, counts) as they are after it.

    files(path, content, hash, mtime, lang), state(path, hash, mtime, indexed_at, chunk_count), chunks as operators.chunks has
    them. Chunks of deleted and modified files go, modified and added files are chunked anew, and their state is stamped. A
    file without content counts as an error and has no chunks.
    """
    from quarry.operators.chunks import chunk

    changed = changes(files, state)
    touched = changed.filter("change <> 'unchanged'")
    fresh = files.join(changed.filter(F.col("change").isin("added", "modified")).select("path"), "path")
    new = chunk(fresh.select("path", "content", "lang"))
    kept = without(chunks, touched.select(F.col("path").alias("file")), ["file"])
    sizes = new.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("chunk_count"))
    errors = fresh.agg(F.count_if(F.col("content").isNull()).alias("errors"))
    return kept.unionByName(new.select(*kept.columns)), next_state(state, files, changed, sizes, now), summary(changed).join(F.broadcast(errors))


def chunk_counts(files: DataFrame, chunks: DataFrame, asked: list[str]) -> DataFrame:
    """(path, chunk_count) of the files asked for; one that isn't there has 0."""
    names = files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(asked)], "path string")
    n = chunks.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("chunk_count"))
    return names.join(n, "path", "left").select("path", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def due(last: Column, now: Column, hours: float) -> Column:
    """Whether the time to live is over; without a last time it is."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(last)) / 3.6e9 > hours, F.lit(True))


def invalidated(cache: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """What of a cache is still good."""
    return without(cache, changed.filter("change <> 'unchanged'"), [key])


def index_stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.max("indexed_at").alias("last_sync"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("tags"))


def document_changes(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, change): documents that are new or modified against their stored summaries; an empty stored hash is neither."""
    j = docs.join(summaries.select("path", F.col("content_hash").alias("was")), "path", "left")
    kind = F.when(F.col("was").isNull(), "new").when((F.col("was") != "") & (F.col("was") != F.col("hash")), "modified")
    return j.select("path", kind.alias("change")).filter("change is not null")


def rules_change(now: Column, was: Column) -> Column:
    """Of a rules file: an empty stored hash is new."""
    return F.when(F.coalesce(was, F.lit("")) == "", "new").when(now != was, "modified")


def context_updates(docs: DataFrame, summaries: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(type, path, change): design documents and rules files, docs(path, hash), that are new or changed since known(path, content_hash)."""
    documents = document_changes(docs, summaries).select(F.lit("design_docs").alias("type"), "path", "change")
    ruled = rules.join(known.select("path", "content_hash"), "path", "left")
    own = ruled.select(F.lit("project_rules").alias("type"), "path", rules_change(F.col("hash"), F.col("content_hash")).alias("change")).filter("change is not null")
    return documents.unionByName(own)


def merge_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """new summaries with the notes that old ones had."""
    return new.join(old.select("path", F.col("extra_notes").alias("_n")), "path", "left").select("path", "summary", "content_hash", F.coalesce("_n", F.lit("")).alias("extra_notes"))


def merge_changes(committed: DataFrame, uncommitted: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, change_type, origin): uncommitted changes win over committed ones; untracked files count if nothing else does."""
    rows = committed.withColumn("_p", F.lit(2)).unionByName(uncommitted.withColumn("_p", F.lit(1))).unionByName(untracked.withColumn("_p", F.lit(3)))
    return rows.groupBy("path").agg(F.min_by(F.struct("change_type", "origin"), "_p").alias("r")).select("path", "r.*")


def keep_discard(all_files: DataFrame, keep: DataFrame) -> DataFrame:
    """(path, action): keep or discard."""
    k = keep.select("path").distinct().withColumn("_k", F.lit(True))
    return all_files.select("path").join(k, "path", "left").select("path", F.when(F.col("_k"), "keep").otherwise("discard").alias("action"))
