"""The operators as stages of a pipeline: documents in, documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, free_names, quoted, table, tuned, without
from quarry.llm.decontamination import decontaminate
from quarry.llm.ngram_jaccard import ngram_jaccard
from quarry.llm.packing import pack
from quarry.llm.quality_rules import quality_filter
from quarry.llm.queries import PIECE_BPE, WORD_BPE
from quarry.llm.secret_scans import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quality rules keep; a row is judged by its text, so rows that repeat a text share its lot, and null texts go."""
    tuned(spark)
    return quality_filter(docs, public_tokenizers.path(PIECE_BPE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the least id, and of those the one with the least hash of id and text.

    Of rows that repeat id and text one stays, the least by the hash of all its columns that can be hashed. Rows of one
    id with different texts, and those with a null id, are documents like all others; a null id comes last. Texts without
    words are linked with nothing and all stay, as do null ones.
    """
    tuned(spark)
    key, id_, n = free_names(docs, "key", "id", "n")
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text").cast("string")))
    found = cut(ngram_jaccard(marked, id_col=key).filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n")))
    ids = marked.select(F.col(key).alias("doc_id"), F.col("doc_id").alias(id_)).distinct()
    first = F.min(F.struct(F.col(id_).isNull(), F.col(id_), F.col("doc_id"))).alias("first")
    linked = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    groups = cut(found.join(linked, "component_id").join(ids, "doc_id").select("component_id", "doc_id", id_))
    kept = groups.groupBy("component_id").agg(first).select(F.col("first.doc_id").alias("doc_id"))
    gone = cut(groups.select("doc_id").distinct().join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias(key)))
    again = cut(found.filter("n > 1").select(F.col("doc_id").alias(key)))
    left = without(marked, gone, [key])
    if again.limit(1).count():
        hashed = [c for c, f in zip(quoted(docs), docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
        one = left.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*quoted(docs)), F.xxhash64(*hashed)).alias(n))
        return without(left, again, [key]).select(*quoted(docs)).unionByName(one.select(f"{n}.*"))
    return left.select(*quoted(docs))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null ids and texts, repeated rows and ids are judged row by row."""
    id_, key = free_names(docs, "id", "key")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    gone = cut(found.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(id_), F.col("key").alias(key)).distinct())
    marked = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), key: F.xxhash64(F.col("text").cast("string"))})
    return without(marked, gone, [id_, key]).select(*quoted(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars as it then is; a null text stays null, and a table without a source has no paths."""
    (path,) = free_names(docs, "path")
    out = redact(docs if "source" in docs.columns else docs.withColumn(path, F.lit(None).cast("string")), path_col="source" if "source" in docs.columns else path)
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*quoted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text is an empty one, and repeated rows are packed each."""
    tuned(spark)
    return pack(docs, public_tokenizers.path(WORD_BPE))
