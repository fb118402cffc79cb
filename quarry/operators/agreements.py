"""The curated collection (map): agreements as documents, with what they say as metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.sources.sinks import upsert

COLUMNS = ["id", "content", "metadata"]


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(X.file_name(path), r"(?<=.)\.[^.]*$", "")


def entries(docs: DataFrame) -> DataFrame:
    """docs(id, content, metadata) as the collection keeps them: without metadata they say where they come from."""
    default = F.create_map(F.lit("source"), F.lit("agreement"), F.lit("doc_id"), F.col("id"))
    return docs.select("id", "content", F.when(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) > 0, F.col("metadata")).otherwise(default).alias("metadata"))


def map_upsert(old: DataFrame, docs: DataFrame) -> DataFrame:
    return upsert(old.select(*COLUMNS), entries(docs), ["id"])


def map_sync(old: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The collection with every Markdown file of files(path, content), and one row (added, errors) of what was done."""
    own = files.filter(X.extension(F.col("path")) == ".md")
    readable = own.filter("content is not null").select(stem(F.col("path")).alias("id"), "content", F.lit(None).cast("map<string,string>").alias("metadata"))
    done = own.agg(F.count_if(F.col("content").isNotNull()).alias("added"), F.count_if(F.col("content").isNull()).alias("errors"))
    return map_upsert(old, readable), done


def quoted_list(names: Column) -> Column:
    """Names as a JSON list with a space behind each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.regexp_replace(F.to_json(F.array(n)), r"^\[|\]$", "")), ", "), F.lit("]"))


def added(found: DataFrame) -> DataFrame:
    """(file, id, content, metadata) of agreements on several symbols, from (nl_term, symbols, code_evidence, session_id, similarity, created_at)."""
    term, names = F.col("nl_term"), quoted_list(F.col("symbols"))
    name = F.concat(F.date_format("created_at", "yyyyMMdd_HHmmss"), F.lit("_"), X.safe_term(term))
    front = [F.concat(F.lit(k), v) for k, v in (("nl_term: ", term), ("symbols: ", names), ("similarity: ", F.format_string("%.2f", "similarity")), ("session_id: ", F.col("session_id")), ("created_at: ", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")))]
    # The headings.
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), term, F.lit(" → "), F.array_join("symbols", ", ")), F.lit("## 根拠 (Code Evidence)"), F.col("code_evidence"), F.lit("## 関連シンボル"), F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("- `"), s, F.lit("`"))), "\n"))
    content = F.concat(F.concat_ws("\n", F.lit("---\ndoc_type: agreement"), *front, F.lit("---")), F.lit("\n\n"), body, F.lit("\n"))
    meta = F.create_map(F.lit("nl_term"), term, F.lit("symbols"), names, F.lit("similarity"), F.col("similarity").cast("string"), F.lit("session_id"), F.col("session_id"))
    return found.select(F.concat(name, F.lit(".md")).alias("file"), name.alias("id"), content.alias("content"), meta.alias("metadata"))
