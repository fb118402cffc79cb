"""Sinks. Without a table format that merges, a table is written anew as its next version."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of new rows with one key the last by order stays."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Finished versions of the table at path, oldest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and re.fullmatch(r"v\d{8}", s.getPath().getName())]
    done = [(int(v.getName()[1:]), v.toString()) for v in found if fs.exists(_path(spark, v.toString() + "/_SUCCESS")[0])]
    return sorted(done)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; only where all runs in one process may it be unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at path; none if there is nothing."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path."""
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's last finished version."""
    return spark.read.parquet(_versions(spark, path)[-1][1])


def swap(df: DataFrame, path: str) -> None:
    """Writes df as the next version of the table at path, which df may read.

    A version counts from when it is finished, and the one before it stays for those who read it. So a crash at any
    point leaves the table as it was or as it is to be.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/v{(known[-1][0] if known else 0) + 1:08d}")
    for _, old in known[:-1]:
        clear(spark, old)


def clear(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_files(files: DataFrame, folder: str, most: int = 10_000) -> int:
    """Writes files(file, content) below a folder, each in place of one of its name; how many there are. More than `most` are an error.

    For what people read, such as agreements: rows come through the driver one by one.
    """
    if files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    n = 0
    for n, r in enumerate(files.select("file", "content").toLocalIterator(), 1):
        p, fs = _path(files.sparkSession, f"{folder.rstrip('/')}/{r['file']}")
        out = fs.create(p, True)
        out.write(bytearray((r["content"] or "").encode()))
        out.close()
    return n


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def agreement_markdown(r: dict[str, Column]) -> Column:
    """An agreement as Markdown with front matter, in the format that front_matter() and the curated collection read.

    r has nl_term, symbol, similarity, code_evidence, session_id, intent, learned_at, related_files and frame (a map).
    """
    words = X.split_camel_case(r["symbol"])
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    front = F.concat_ws("\n", F.lit("---\ndoc_type: agreement"), line("nl_term", r["nl_term"]), line("symbol", r["symbol"]), line("symbol_normalized", words), line("similarity", F.format_string("%.3f", r["similarity"])), line("session_id", r["session_id"]), line("intent", r["intent"]), line("learned_at", r["learned_at"].cast("string")), F.lit("---"))
    or_else = lambda body, text: F.when(F.length(body) > 0, body).otherwise(text)
    files = F.array_join(F.transform(r["related_files"], lambda f: F.concat(F.lit("- `"), f, F.lit("`"))), "\n")
    # The headings and what stands where there is nothing.
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), r["nl_term"], F.lit(" → "), r["symbol"]), F.concat(F.lit("**シンボル（分解）**: "), words), F.lit("## 根拠 (Code Evidence)"), or_else(r["code_evidence"], "（根拠なし）"), F.lit("## 関連ファイル"), or_else(files, "（なし）"))
    said = F.transform(F.map_entries(F.map_filter(r["frame"], lambda k, v: F.length(v) > 0)), lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"], F.lit("\n")))
    frame = F.when(F.size(r["frame"]) > 0, F.concat(F.lit("\n## QueryFrame\n\n"), F.array_join(said, ""))).otherwise("")
    return F.concat(front, F.lit("\n\n"), body, F.lit("\n"), frame)


def agreement_file(term: Column, symbol: Column) -> Column:
    return F.concat(X.safe_file_name(term), F.lit("_"), X.safe_file_name(symbol), F.lit(".md"))
