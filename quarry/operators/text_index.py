"""Indexed text search: an inverted index of trigrams, and regular expressions read as the trigrams that they ask for.

A batch of files is stored in parts of some PART_BYTES, with its files numbered, and beside
it postings: for each part and each three ASCII characters that neighbour in a line (A-Z
folded), the numbers of the files with them. A search asks for the postings of its
patterns' trigrams alone, intersects and joins their lists part by part, reads the parts
that are left, and tries the patterns on the files that are left. So what it reads
follows what it may find, and its rows are those of search() over all files.

Files that come again in a later batch count as they are there; forget() takes files
away. A batch counts from when its postings are finished. Null contents match nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import patterns_of, search
from quarry.sources.sinks import folders, stored

#: Text in a part, about, and folders of postings.
PART_BYTES, BUCKETS = 32 << 20, 32
#: Places in postings that a worker gathers, about, and bytes of a text that it looks at, at once.
POSTED, STRETCH = 1_000_000, 1 << 20
#: Parts that a search names to the scan at most; beyond, they are joined.
MOST_PARTS = 10_000
#: Ways in which a pattern may be written out, before it is taken to ask for nothing there.
WAYS = 64

#: What a way to match has for sure: (start, whole pieces between, end), or a string that is all of it.
Way = str | tuple[str, tuple[str, ...], str]
OPEN: Way = ("", (), "")


class Unread(Exception):
    """A pattern in a notation that isn't read here; it asks for nothing."""


def _then(x: Way, y: Way) -> Way:
    if isinstance(x, str) and isinstance(y, str):
        return x + y
    if isinstance(x, str):
        return (x + y[0], y[1], y[2])
    if isinstance(y, str):
        return (x[0], x[1], x[2] + y)
    return (x[0], (*x[1], x[2] + y[0], *y[1]), y[2])


def _row(parts: Iterator[list[Way]]) -> list[Way]:
    """All ways of one part after the other; parts with too many are left open."""
    out: list[Way] = [""]
    for ways in parts:
        if len(out) * len(ways) > WAYS:
            ways = [OPEN]
        out = list(dict.fromkeys(_then(x, y) for x in out for y in ways))
    return out


class _Reader:
    """Ways in which text matches a regular expression of Java's notation, each with what it has for sure."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def next(self) -> str:
        self.at += 1
        if self.at > len(self.p):
            raise Unread
        return self.p[self.at - 1]

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def any_of(self) -> list[Way]:
        out = self.row()
        while self.peek() == "|":
            self.at += 1
            out = out + self.row()
        return list(dict.fromkeys(out)) if len(out) <= WAYS else [OPEN]

    def row(self) -> list[Way]:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.one()))
        return _row(parts)

    def repeated(self, ways: list[Way]) -> list[Way]:
        while self.peek() and self.peek() in "*+?{":
            low, high = {"*": (0, 2), "+": (1, 2), "?": (0, 1)}.get(kind := self.next(), (0, 0))
            if kind == "{":
                said = ""
                while (c := self.next()) != "}":
                    said += c
                first, comma, last = said.partition(",")
                if not first.isdigit() or last and not last.isdigit():
                    raise Unread
                low, high = int(first), int(last or first) if not comma or last else int(first) + 1
            if self.peek() in ("?", "+") and self.peek():
                self.at += 1
            if (low, high) == (0, 1):
                ways = ["", *ways]
            elif low == 0:
                ways = [""] if high == 0 else [OPEN]
            else:
                ways = _row([ways] * min(low, 8) + ([[OPEN]] if high > min(low, 8) else []))
        return ways

    def one(self) -> list[Way]:
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            return self.letters()
        if c == "\\":
            return self.escaped()
        if c in "^$":
            return [""]
        if c == ".":
            return [OPEN]
        return [c]

    def group(self) -> list[Way]:
        looks = False
        if self.peek() == "?":
            self.at += 1
            c = self.next()
            if c == "<" and self.peek() not in ("=", "!"):
                while self.next() != ">":
                    pass
            elif c in "=!<":
                looks = True
                if c == "<":
                    self.at += 1
            elif c not in ":>":
                flags = c
                while (c := self.next()) not in ":)":
                    flags += c
                if set(flags) - set("ims-"):
                    raise Unread
                if c == ")":
                    return [""]
        ways = self.any_of()
        if self.next() != ")":
            raise Unread
        return [""] if looks else ways

    def letters(self) -> list[Way]:
        """One of some characters; written out if they are few, and neither negated nor nested."""
        found: list[str] = []
        negated = self.peek() == "^"
        self.at += negated
        few, first = not negated, True
        while (c := self.next()) != "]" or first:
            first = False
            if c in "[&":
                raise Unread
            if c == "\\":
                ways = self.escaped()
                if ways == [OPEN]:
                    few = False
                    continue
                if ways == [""]:
                    raise Unread
                c = ways[0]
            if self.peek() == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", "[", ""):
                self.at += 1
                last = self.next()
                if last == "\\":
                    raise Unread
                few &= ord(last) - ord(c) < 8
                found += map(chr, range(ord(c), ord(last) + 1)) if few else []
            else:
                found.append(c)
        return list(dict.fromkeys(found)) if few and 0 < len(found) <= 8 else [OPEN]

    def escaped(self) -> list[Way]:
        c = self.next()
        if c in "bBAzZG":
            return [""]
        if c in "dDwWsShHvVRX123456789":
            return [OPEN]
        if c.isalnum():
            plain = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(c)
            if not plain:
                raise Unread
            return [plain]
        return [c]


def trigrams(text: str) -> set[int]:
    """The trigrams of ASCII characters in a text, A-Z folded, as numbers."""
    raw = text.encode("utf-8", "replace").lower()
    return {a << 16 | b << 8 | c for a, b, c in zip(raw, raw[1:], raw[2:], strict=False) if max(a, b, c) < 128 and 10 not in (a, b, c)}


def asked_for(pattern: str, literal: bool = False) -> list[set[int]]:
    """Sets of trigrams, of one of which a file that matches has all; [] if it may have none."""
    if literal:
        ways: list[Way] = [pattern]
    else:
        try:
            reader = _Reader(pattern)
            ways = reader.any_of()
            if reader.peek():
                return []
        except Unread:
            return []
    sets = [set().union(*map(trigrams, [w] if isinstance(w, str) else [w[0], *w[1], w[2]])) for w in ways]
    if not all(sets):
        return []
    return [s for s in sets if not any(t < s for t in sets)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of a part, numbered as they come."""
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows, dtype=np.int32))], names=[*b.schema.names, "number"])
        n += b.num_rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of files (part, number, content), a row for each part and trigram, with the numbers of the files that have it."""
    held: list[np.ndarray] = []  # of files of one part: 64-bit numbers of trigram and file

    def out(part: int) -> pa.RecordBatch:
        both = np.unique(np.concatenate(held))
        held.clear()
        gram, number = (both >> 32).astype(np.int32), both.astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), pa.array(number))
        return pa.RecordBatch.from_arrays([pa.array(gram[first] % BUCKETS), pa.array(gram[first]), pa.array(np.full(len(first), part, dtype=np.int32)), lists], names=["bucket", "gram", "part", "numbers"])

    size, last = 0, -1
    for b in batches:
        for at in range(b.num_rows):  # text by text, as a batch of them is large
            part, number, content = (c[at].as_py() for c in b.columns)
            if held and (part != last or size > POSTED):
                yield out(last)
                size = 0
            last = part
            x = np.frombuffer((content or b"").lower(), dtype=np.uint8)
            for k in range(0, max(0, len(x) - 2), STRETCH):
                y = x[k : k + STRETCH + 2]
                good = (y < 128) & (y != 10)
                code = y[:-2].astype(np.int32) << 16 | y[1:-1].astype(np.int32) << 8 | y[2:]
                own = np.unique(code[good[:-2] & good[1:-1] & good[2:]])
                held.append(own.astype(np.int64) << 32 | number)
                size += len(own)
    if held:
        yield out(last)


def batches_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches of an index."""
    return [int(n.removeprefix("batch=")) for n in folders(spark, f"{folder}/postings") if stored(spark, f"{folder}/postings/{n}/_SUCCESS")]


def append(files: DataFrame, folder: str, key: str = "path", content: str = "content") -> int:
    """Adds files to the index at a folder, as its next batch; the batch's number. Only the batch's own files are written."""
    spark = files.sparkSession
    batch = max([0, *batches_of(spark, folder)]) + 1
    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0) // PART_BYTES))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, content string, part int, number int"
    numbered = rows.withColumn("part", part).repartitionById(parts, F.col("part")).mapInArrow(_numbered, schema)
    numbered.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/texts/batch={batch}")
    texts = spark.read.schema(schema).parquet(f"{folder}/texts/batch={batch}").select("part", "number", F.col("content").cast("binary").alias("content"))
    lists = texts.mapInArrow(_postings, "bucket int, gram int, part int, numbers array<int>")
    by_bucket = lists.repartitionById(BUCKETS, F.col("bucket")).sortWithinPartitions("bucket", "gram", "part")
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/batch={batch}")
    return batch


def forget(gone: DataFrame, folder: str, key: str = "path") -> None:
    """Takes files away, as they are in the batches so far."""
    batch = max([0, *batches_of(gone.sparkSession, folder)])
    gone.select(F.col(key).alias("key"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{folder}/gone")


def candidates(spark: SparkSession, folder: str, sets: list[set[int]]) -> DataFrame:
    """(batch, part, numbers) of the files that have all trigrams of one of the sets."""
    grams = sorted(set().union(*sets))
    rows = spark.read.option("basePath", f"{folder}/postings").parquet(*(f"{folder}/postings/batch={b}" for b in batches_of(spark, folder)))
    rows = rows.filter(F.col("bucket").isin(sorted({g % BUCKETS for g in grams})) & F.col("gram").isin(grams))
    # A part has few files, and the lists of a pattern's trigrams in it are as few as those trigrams.
    by = rows.groupBy("batch", "part").agg(F.collect_list(F.struct("gram", "numbers")).alias("lists"))
    of = lambda g: F.flatten(F.transform(F.filter("lists", lambda x: x["gram"] == g), lambda x: x["numbers"]))
    met = None
    for s in sets:
        own = None
        for g in sorted(s):
            own = of(g) if own is None else F.array_intersect(own, of(g))
        met = own if met is None else F.array_union(met, own)
    return by.select("batch", "part", met.alias("numbers")).filter(F.size("numbers") > 0)


def files_of(spark: SparkSession, folder: str, sets: list[set[int]] | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content) of the files in the index as they are now; of those only that may match, if sets are given."""
    known = batches_of(spark, folder)
    if not known:
        raise ValueError(f"no index at {folder}")
    texts = spark.read.option("basePath", f"{folder}/texts").parquet(*(f"{folder}/texts/batch={b}" for b in known))
    rows = texts
    if sets:
        found = candidates(spark, folder, sets)
        places = found.select("batch", "part").limit(MOST_PARTS + 1).collect()
        if len(places) <= MOST_PARTS:
            by_batch = itertools.groupby(sorted(map(tuple, places)), lambda p: p[0])
            named = [(F.col("batch") == b) & F.col("part").isin([p for _, p in own]) for b, own in by_batch]
            some = F.lit(False)
            for n in named:
                some = some | n
            rows = rows.filter(some)
            found = F.broadcast(found)
        rows = rows.join(found, ["batch", "part"]).filter(F.array_contains("numbers", F.col("number"))).drop("numbers")
    gone = spark.read.parquet(f"{folder}/gone") if stored(spark, f"{folder}/gone") else None
    if len(known) > 1 or gone is not None:
        last = texts.select("key", "batch")
        if sets:
            last = last.join(rows.select("key").distinct(), "key", "left_semi")
        last = last.groupBy("key").agg(F.max("batch").alias("batch"))
        if gone is not None:
            last = last.join(gone.groupBy("key").agg(F.max("batch").alias("until")), "key", "left").filter("until IS NULL OR until < batch").drop("until")
        rows = rows.join(last, ["key", "batch"], "left_semi")
    return rows.select(F.col("key").alias(key), F.col("content").alias(content))


def search_index(spark: SparkSession, folder: str, pattern: str | list[str], literal: bool = False, key: str = "path", **how: object) -> DataFrame:
    """As search(), over the files of an index."""
    found = patterns_of(pattern)
    each = [asked_for(p, literal) for p in found]
    # A pattern that asks for nothing is tried on all files, and so are the others, then.
    sets = list(itertools.chain.from_iterable(each)) if found and all(each) else None
    return search(files_of(spark, folder, sets, key), found, literal, key=key, **how)
