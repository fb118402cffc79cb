"""Tables that merge: rows lie in buckets by a hash of their keys, and a manifest says in which folder each bucket is.

A merge writes the buckets anew that it touches, in a folder of its own, and then a
manifest that names them beside all others; other buckets keep their files. A manifest
counts from when it is finished, so a crash at any point leaves the table as it was or as
it is to be, and older snapshots can be read until vacuum(). Two writers of one snapshot
can't both finish: the second finds its manifest's place taken.

Rows with a null in a key are rows of that key; of new rows with one key the last by
`order` stays (ties: the one with the greatest hash). A new column is not taken over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.sinks import clear, folders, stored

#: What a manifest has for each bucket, and for the table: keys, number of buckets, schema, and what was merged.
MANIFEST = "bucket int, folder string, rows long"
ABOUT = "keys array<string>, buckets int, schema string, merged string"


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(buckets)).cast("int")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, oldest first."""
    return [int(n[1:]) for n in folders(spark, f"{path}/manifest") if stored(spark, f"{path}/manifest/{n}/about/_SUCCESS")]


class Snapshot:
    """A table as it is at one time."""

    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        known = snapshots(spark, path)
        if not known or number is not None and number not in known:
            raise ValueError(f"no snapshot {'' if number is None else number} at {path}")
        self.spark, self.path, self.number = spark, path, known[-1] if number is None else number
        at = f"{path}/manifest/v{self.number:08d}"
        about = spark.read.schema(ABOUT).parquet(f"{at}/about").first()
        self.keys, self.buckets, self.merged = list(about["keys"]), about["buckets"], about["merged"]
        self.schema = T.StructType.fromJson(json.loads(about["schema"]))
        self.places = {r["bucket"]: (r["folder"], r["rows"]) for r in spark.read.schema(MANIFEST).parquet(f"{at}/buckets").collect()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets if wanted; only their files are opened."""
        wanted = [f"{self.path}/{folder}/bucket={b}" for b, (folder, _) in sorted(self.places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def count(self) -> int:
        """The number of rows, from the manifest."""
        return sum(n for _, n in self.places.values())


def _finish(spark: SparkSession, path: str, number: int, places: dict[int, tuple[str, int]], about: tuple) -> None:
    at = f"{path}/manifest/v{number:08d}"
    spark.createDataFrame([(b, f, n) for b, (f, n) in sorted(places.items())], MANIFEST).coalesce(1).write.parquet(f"{at}/buckets")
    spark.createDataFrame([about], ABOUT).coalesce(1).write.parquet(f"{at}/about")


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> dict[int, tuple[str, int]]:
    """Writes rows by bucket into a folder of their own; where the buckets are, and how many rows they have."""
    folder = f"data/{uuid.uuid4().hex}"
    marked = rows.withColumn("bucket", bucket_of(keys, buckets))
    marked.repartitionById(buckets, F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    spark = rows.sparkSession
    sizes = spark.read.schema(T.StructType([*rows.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{folder}").groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: (folder, r["n"]) for r in sizes.collect()}


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> Snapshot:
    """A table with these rows, whose keys are different."""
    spark = rows.sparkSession
    if snapshots(spark, path):
        raise ValueError(f"there is a table at {path}")
    _finish(spark, path, 1, _write(rows, path, keys, buckets), (keys, buckets, rows.schema.json(), "create"))
    return Snapshot(spark, path)


def last_by(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key; an aggregate, so tasks leave one of theirs each before anything is shuffled."""
    rest = [quoted(c) for c in rows.columns if c not in keys]
    hashed = F.xxhash64(*(quoted(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()))
    by = F.struct(*([quoted(order)] if order else []), hashed)
    one = rows.groupBy(*map(quoted, keys)).agg(F.max_by(F.struct(*rest, F.lit(True).alias("_")), by).alias("_r"))
    return one.select(*(quoted(c) if c in keys else F.col("_r").getField(c).alias(c) for c in rows.columns))


def merge(path: str, new: DataFrame | None = None, gone: DataFrame | None = None, order: str | None = None, insert: bool = True, update: bool = True, stored_later: str | None = None) -> Snapshot:
    """The table with new rows in place of those with their keys, and without the keys in gone, as its next snapshot.

    insert, update: whether keys that aren't there come in, and those that are change. stored_later: a column by which a
    stored row that is later than a new one stays. Where a key is both new and gone, it is new.
    """
    spark = (new if new is not None else gone).sparkSession
    now = Snapshot(spark, path)
    keys, names = now.keys, now.schema.names
    bucket = bucket_of(keys, now.buckets)
    touched = (new.select(bucket.alias("b")) if new is not None else gone.select(bucket.alias("b")))
    if new is not None and gone is not None:
        touched = touched.unionByName(gone.select(bucket.alias("b")))
    # As many numbers as there are buckets, at most.
    some = sorted(r["b"] for r in touched.distinct().collect())
    if not some:
        return now
    same = lambda a, b: [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys]
    rows = now.read(some)
    if gone is not None:
        rows = rows.alias("o").join(gone.select(*map(quoted, keys)).distinct().alias("g"), same("o", "g"), "left_anti")
    if new is not None:
        fresh = last_by(new.select(*map(quoted, names)), keys, order).withColumn("_new", F.lit(True))
        both = rows.withColumn("_old", F.lit(True)).alias("o").join(fresh.alias("n"), same("o", "n"), "full_outer")
        is_new, is_old = F.col("n._new").isNotNull(), F.col("o._old").isNotNull()
        wins = is_new & (~is_old | F.lit(update))
        if stored_later:
            wins = wins & (~is_old | F.coalesce(F.col(f"n.{stored_later}") >= F.col(f"o.{stored_later}"), F.lit(True)))
        keep = is_old | F.lit(insert)
        rows = both.filter(keep).select(*(F.when(wins, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).cast(now.schema[c].dataType).alias(c) for c in names))
    written = _write(rows, path, keys, now.buckets)
    places = {b: p for b, p in now.places.items() if b not in some} | written
    kinds = [k for k, x in (("upsert", new), ("delete", gone)) if x is not None]
    _finish(spark, path, now.number + 1, places, (keys, now.buckets, now.schema.json(), "+".join(kinds)))
    return Snapshot(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last snapshots, and the files of buckets that none of these names; of how many buckets."""
    known = snapshots(spark, path)
    named = {(folder.removeprefix("data/"), f"bucket={b}") for n in known[-keep:] for b, (folder, _) in Snapshot(spark, path, n).places.items()}
    for n in known[:-keep]:
        clear(spark, f"{path}/manifest/v{n:08d}")
    old = [(f, b) for f in folders(spark, f"{path}/data") for b in folders(spark, f"{path}/data/{f}") if (f, b) not in named]
    for f, b in old:
        clear(spark, f"{path}/data/{f}/{b}")
    return len(old)
