"""Terms and symbols that answer to each other: one holds the other, or they share a word. No pair is tried that has no key in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.sinks import cut

#: Characters of a piece by which a shorter text is looked for in longer ones.
PIECE = 3


def _pieces(text: Column, n: int) -> Column:
    """The different runs of n characters in a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def _held(short: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b): texts of short(a) that stand in texts of long(b); each is looked for by its rarest piece, and verified once a pair."""
    whole = short.filter(F.length("a") >= PIECE)
    where = cut(long.select("b", F.explode(_pieces(F.col("b"), PIECE)).alias("piece")))
    often = where.groupBy("piece").agg(F.count("*").alias("n"))
    # A text one of whose pieces stands nowhere is held by nothing.
    each = whole.select("a", F.size(_pieces(F.col("a"), PIECE)).alias("k"), F.explode(_pieces(F.col("a"), PIECE)).alias("piece")).join(often, "piece")
    rarest = each.groupBy("a", "k").agg(F.count("*").alias("there"), F.min(F.struct("n", "piece")).alias("r")).filter("there = k").select("a", F.col("r.piece").alias("piece"))
    met = rarest.join(where, "piece").filter(F.contains("b", F.col("a"))).select("a", "b")
    for n in range(1, PIECE):  # the shortest are pieces themselves
        tiny = short.filter(F.length("a") == n)
        met = met.unionByName(long.select("b", F.explode(_pieces(F.col("b"), n)).alias("a")).join(tiny, "a").select("a", "b"))
    return met


def answering(terms: DataFrame, symbols: DataFrame) -> DataFrame:
    """(term, symbol): all pairs of terms(term) and symbols(symbol) of which one holds the other or which share a word, underscores counting as spaces and case aside.

    Each pair of different texts comes once. Blank and null texts answer to nothing.
    """
    blank = lambda c: F.length(F.trim(c)) > 0
    t = terms.filter(blank("term")).select("term", F.lower("term").alias("a")).distinct()
    s = symbols.filter(blank("symbol")).select("symbol", F.lower("symbol").alias("b")).distinct()
    a, b = cut(t.select("a").distinct()), cut(s.select("b").distinct())
    turned = lambda d, x, y: d.select(F.col(x).alias("a"), F.col(y).alias("b"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.replace(F.col(c), F.lit("_"), F.lit(" ")), r"\s+", -1), lambda w: w != ""))
    shared = a.select("a", F.explode(words("a")).alias("w")).join(b.select("b", F.explode(words("b")).alias("w")), "w").select("a", "b")
    in_symbols, in_terms = _held(a, b), turned(_held(turned(b, "b", "b").select("a"), turned(a, "a", "a").select("b")), "b", "a")
    pairs = in_symbols.unionByName(in_terms).unionByName(shared).distinct()
    return pairs.join(t, "a").join(s, "b").select("term", "symbol")
