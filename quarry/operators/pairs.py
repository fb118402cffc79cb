"""Learned pairs of terms and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.sinks import upsert


def latest(pairs: DataFrame, order: list[str]) -> DataFrame:
    """For each (nl_term, symbol) the last row by order; partial before the shuffle."""
    rest = [c for c in pairs.columns if c not in ("nl_term", "symbol")]
    return pairs.groupBy("nl_term", "symbol").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("nl_term", "symbol", *(F.col(f"r.{c}").alias(c) for c in rest))


def add(old: DataFrame, new: DataFrame, order: str = "learned_at") -> DataFrame:
    return upsert(old, new, ["nl_term", "symbol"], order)


def find(pairs: DataFrame, term: str, symbols: list[str] | DataFrame) -> DataFrame:
    """Pairs of a term whose symbol is asked for."""
    rows = pairs.filter(F.col("nl_term") == term)
    return rows.filter(F.col("symbol").isin(symbols)) if isinstance(symbols, list) else rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def unexpired(pairs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return pairs.filter(F.col("learned_at") > now - F.make_dt_interval(days=F.lit(days)))


def stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), F.countDistinct("nl_term").alias("terms"), F.countDistinct("symbol").alias("symbols"))
