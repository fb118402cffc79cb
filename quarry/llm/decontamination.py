r"""Benchmark decontamination by a stored positional inverted index.

A posting is a term of a training document with the document's row and the position.
The postings of all test terms are written once, in one pass over the texts, to a table
in the shared folder (row, term, pos); a second table has a line for each row. Terms are
64-bit hashes of folded words. All else works on these tables, whatever the size of the
benchmark:

Test items become windows of n words (an item of fewer words is one window). The lengths
of the lists of their terms are counted; a window with a term that never occurs is given
up. Each window starts from the list of its rarest term, as candidates (row, start); the
list of the second rarest is intersected at its adjusted offset; and only then the lists
of all its terms, which have to be there at their offsets, each once.

Only lists of terms that candidates ask for, in rows that have candidates, are shuffled,
by row and position, which no two postings share; so no term's list is a hot key, and
neither is a document with a null id or a text that occurs often. The test terms and the
anchors are sent to the workers while there are `most_sent` of them at most, which is
counted; beyond that the joins are dealt out. Spark expressions only.

Defined cases: a null text has no words, so n_words, n_hit and n_items are 0,
items_sha256 is that of the empty string, and contaminated is false; an item without
words has no window; a null item text likewise; repeated rows each give a row; two
rows with one id and different texts are two documents; an empty benchmark leaves all
documents clean; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut, id_text
from quarry.llm.key_counts import Scratch

#: Words are runs of ASCII digits, letters and all that isn't ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows that are sent to every worker at most, of terms, anchors or numbers of documents.
MOST_SENT = 1_000_000


def words_of(text: Column) -> Column:
    """Words as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def term_of(word: Column) -> Column:
    return F.xxhash64(folded(word))


def few(df: DataFrame, most: int) -> DataFrame:
    """df (kept already), marked to be sent to every worker if it is small enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass
class Index:
    """postings(row, term, pos) of test terms; rows(row, doc_id, key, n_words), a line for each document."""

    postings: DataFrame
    rows: DataFrame
    scratch: Scratch

    def lengths(self) -> DataFrame:
        """(term, n): how many postings each term has."""
        return self.postings.groupBy("term").agg(F.count("*").alias("n"))

    def drop(self) -> None:
        self.scratch.drop()


def index(docs: DataFrame, words: DataFrame, most_sent: int = MOST_SENT) -> Index:
    """The index of (doc_id, text) for the test words(word), stored. A row's number is made as it is written, and read ever after."""
    # Letters are folded beyond ASCII to find words, which is cheap; terms are exact.
    low = words.select(F.lower("word").alias("low")).distinct()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    # The last entry stands for the document itself.
    spread = numbered.select("row", "doc_id", "key", F.size("words").alias("n_words"), F.posexplode(F.concat("words", F.array(F.lit("\0")))).alias("pos", "word"))
    # A table of Python's rows would start more Python workers on each executor, which stay for a minute.
    own = low.unionByName(low.sparkSession.range(0, 1, 1, 1).select(F.lit("\0").alias("low")))
    found = spread.join(few(cut(own), most_sent), F.lower("word") == F.col("low"), "left_semi")
    ends = F.col("word") == "\0"
    stored = Scratch(found.select("row", F.when(ends, F.col("doc_id")).alias("doc_id"), F.when(ends, F.col("key")).alias("key"), F.when(ends, F.col("n_words")).alias("n_words"), F.when(~ends, term_of(F.col("word"))).alias("term"), "pos"))
    return Index(stored.df.filter("term is not null").select("row", "term", "pos"), stored.df.filter("term is null").select("row", "doc_id", "key", "n_words"), stored)


def test_windows(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(window, words), each different window of n words once, and (window, item_id)."""
    words = items.select("item_id", words_of(folded(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))).alias("s"))
    each = cut(starts.select("item_id", F.slice("words", F.col("s"), F.lit(n)).alias("words")).withColumn("window", F.xxhash64("words")))
    return each.groupBy("window").agg(F.first("words").alias("words")), each.select("window", "item_id").distinct()


def matches(found: Index, windows: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(row, start, length, window) of each exact match of windows(window, words)."""
    each = cut(windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("off", "word")).withColumn("term", term_of(F.col("word"))))
    lengths = cut(found.lengths().join(few(cut(each.select("term").distinct()), most_sent), "term", "left_semi"))
    listed = each.join(few(lengths, most_sent), "term", "left").groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("r"))
    # The rarest term and the next one; the same one where a window has no other.
    possible = cut(listed.filter(F.col("r")[0]["n"] > 0).select("window", "length", F.col("r")[0].alias("a"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("b")))
    anchors = cut(possible.select(F.col("a.term").alias("term"), F.col("a.off").alias("off"), "window", "length", F.col("b.term").alias("second"), F.col("b.off").alias("second_off")))
    start = F.col("pos") - F.col("off")
    first = cut(found.postings.join(few(anchors, most_sent), "term").filter(start >= 0).select("row", start.alias("start"), "window", "length", "second", "second_off"))

    def lists(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Of the lists of these terms, what lies in these rows; only that is shuffled."""
        own = found.postings.join(few(cut(wanted.select("term").distinct()), most_sent), "term", "left_semi")
        return own.join(few(cut(rows.select("row").distinct()), most_sent), "row", "left_semi")

    at = first.select("row", "start", "window", "length", F.col("second").alias("term"), (F.col("start") + F.col("second_off")).alias("pos"))
    both = cut(at.join(lists(first, at), ["row", "term", "pos"]).select("row", "start", "window", "length"))
    # All terms at their offsets; a posting occurs once, so so many are all.
    asked = both.join(few(each.select("window", "off", "term"), most_sent), "window").select("row", "start", "window", "length", "term", (F.col("start") + F.col("off")).alias("pos"))
    there = asked.join(lists(both, each), ["row", "term", "pos"]).groupBy("row", "start", "window", "length").agg(F.count("*").alias("n"))
    return there.filter(F.col("n") == F.col("length")).select("row", "start", "length", "window")


def nearby(found: Index, items: DataFrame, terms: int, span: int, most_sent: int = MOST_SENT) -> DataFrame:
    """(row, item_id, start): where all of the `terms` rarest terms of items(item_id, word) lie within `span` words.

    A term that the corpus lacks makes an item's match impossible. Items of fewer different words are looked up by those they have.
    """
    words = items.select("item_id", folded(F.col("word")).alias("word")).distinct().withColumn("term", term_of(F.col("word")))
    lengths = cut(found.lengths())
    rare = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "word")
    chosen = words.join(few(lengths, most_sent), "term", "left").withColumn("r", F.row_number().over(rare)).filter(F.col("r") <= terms)
    need = chosen.groupBy("item_id").agg(F.count("*").alias("need"), F.min(F.coalesce("n", F.lit(0))).alias("least")).filter("least > 0")
    probe = cut(chosen.join(need, "item_id").select("item_id", "term", "need"))
    near = Window.partitionBy("row", "item_id").orderBy("pos").rangeBetween(0, span - 1)
    seen = found.postings.join(few(probe, most_sent), "term").withColumn("got", F.size(F.collect_set("term").over(near)))
    return seen.filter(F.col("got") == F.col("need")).select("row", "item_id", F.col("pos").alias("start"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, terms: int = 3, span: int = 20, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every document its words, the words inside matches, the items matched, whether it is contaminated, and the items near.

    contaminated: some word is hit and share * n_hit >= n_words. items is the list of matched items,
    key the hash of the text (xxhash64), n_near the number of items whose `terms` rarest terms lie within `span` words.
    """
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    words = tests.select("item_id", F.explode(F.array_distinct(words_of(folded(F.col("text"))))).alias("word"))
    windows, of_items = test_windows(tests, n)
    found = index(id_text(docs, id_col, text_col), words.select("word").distinct(), most_sent)
    exact = cut(matches(found, windows, most_sent))
    near = cut(nearby(found, words, terms, span, most_sent).groupBy("row").agg(F.count_distinct("item_id").alias("n_near")))
    rows = cut(found.rows)
    found.drop()
    w = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    spans = exact.select("row", "start", "length").distinct().withColumn("hit", F.greatest(stop - F.greatest("start", F.coalesce(F.max(stop).over(w), F.lit(0))), F.lit(0)))
    hits = spans.groupBy("row").agg(F.sum("hit").cast("long").alias("n_hit"))
    named = exact.select("row", "window").distinct().join(few(of_items, most_sent), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    by = rows.join(hits, "row", "left").join(named, "row", "left").join(near, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), "key", F.coalesce("n_near", F.lit(0)).alias("n_near")
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return by.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_near",
        "items",
        "key",
    )


def proximity(docs: DataFrame, items: DataFrame, terms: int = 3, span: int = 20, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start) where all of an item's `terms` rarest terms lie within `span` words of a document."""
    words = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(words_of(folded(F.col(item_text).cast("string"))))).alias("word"))
    found = index(id_text(docs, id_col, text_col), words.select("word").distinct(), most_sent)
    near = cut(nearby(found, words, terms, span, most_sent).join(found.rows, "row").select("doc_id", "item_id", "start"))
    found.drop()
    return near
