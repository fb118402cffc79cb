"""Sums over the terms of documents of values that a dictionary of terms gives.

The terms used most are few; they go to every worker, as long as they take `most_sent`
bytes at most (measured by a count, not assumed). The rest are many but rare: a
document sends each of its rare terms with its number, and a join brings the value.
No frequent term is ever shuffled, so no key of that join is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, on_batches, parts
from quarry.llm.word_tokens import Terms, TermsOf

#: What a term takes in a worker besides its own bytes.
ENTRY_BYTES = 120
#: Text that is taken at once, in bytes.
TEXT = 8 << 20


def word_counts(rows: DataFrame, terms: Callable[[], TermsOf], most: int = 600_000) -> DataFrame:
    """(word, n) over all rows (doc_id, text); each task adds up its own before anything is shuffled. terms makes, in a worker, what splits texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        split = terms()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for _, texts in parts(batches, TEXT):
            t = split(texts)
            for w, n in zip(t.different, np.bincount(t.which, minlength=len(t.different)).tolist(), strict=True):
                if n:
                    seen[w] = seen.get(w, 0) + n
            if len(seen) > most:
                yield out()
                seen.clear()
        yield out()

    return on_batches(rows, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_use(counted: DataFrame, most_sent: int) -> int:
    """The least power of two so that the terms of counted(word, n) used as often take at most `most_sent` bytes."""
    size = F.sum(F.octet_length("word").cast("long") + ENTRY_BYTES)
    found = {r["b"]: r["k"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(size.alias("k")).collect()}
    total, b = 0, 63
    while b >= 0 and total + found.get(b, 0) <= most_sent:
        total += found.get(b, 0)
        b -= 1
    return 1 << (b + 1)


@dataclass
class Head:
    """The terms sent to every worker, with two values of each."""

    at: dict[bytes, int]
    a: np.ndarray
    b: np.ndarray


def head_of(sent, name: str, kind: str) -> Head:
    """From a broadcast Arrow stream; name is the broadcast's own, as workers outlive one."""

    def make() -> Head:
        t = pa.ipc.open_stream(sent.value).read_all()
        return Head(dict(zip(t.column(0).to_pylist(), range(t.num_rows), strict=True)), *(np.append(t.column(k).to_numpy(), 0) for k in (1, 2)))

    return held(kind, "head", make, name)


def text_keys(texts: pa.Array) -> np.ndarray:
    """A hash of each text."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer() or b"") - (1 << 63) for t in texts), dtype=np.int64, count=len(texts))


def summed(rows: DataFrame, terms: Callable[[], TermsOf], values: DataFrame, most_sent: int, extra: Callable[[Terms, pa.Array], list[pa.Array]], kinds: str, names: tuple[str, str] = ("a", "b"), missing: tuple[float, int] = (0.0, 0), kind: str = "counts", also: DataFrame | None = None) -> DataFrame:
    """For each row (doc_id, text), the sums over its terms of the values a (double) and b (long).

    values: (word, n, a, b), computed already (cut), as it is read several times.
    extra: gives, for some documents' terms and texts, a column for each of the given kinds; doubles may come in several rows, to be added up.
    Rows that repeat id and text are summed together and come out as often as they came in.
    kind names what workers keep together. also: (doc_id, key, some of kinds) from
    elsewhere, for columns that extra leaves null; key is the text's xxh3 less 2 ** 63.
    """
    spark = rows.sparkSession
    least = least_use(values, most_sent)
    head = values.filter(F.col("n") >= least).select("word", "a", "b").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as w:
        w.write_table(head)
    sent, name = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    spread = [x.split() for x in kinds.split(", ")] if kinds else []
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = ["doc_id", "key", "word", "k", "a0", "b0", "m", *(n for n, _ in spread)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = head_of(sent, name, kind), terms()
        for ids, texts in parts(batches, TEXT):
            t, key, n = split(texts), text_keys(texts), len(texts)
            at = np.fromiter(map(known.at.get, t.different, repeat(-1)), dtype=np.int64, count=len(t.different))
            full = np.flatnonzero(np.diff(t.bounds))
            sums = []
            for value in (known.a, known.b):
                own = np.zeros(n, dtype=value.dtype)
                if len(full):
                    own[full] = np.add.reduceat(value[at][t.which], t.bounds[full])
                sums.append(own)
            # A term has no space in front and digits behind, so this one meets nothing and lies anywhere.
            word = pa.array([b"  %d" % k for k in key.tolist()], pa.binary())
            zero = np.zeros(n, dtype=np.int64)
            more = [c.cast(arrow[k]) for c, (_, k) in zip(extra(t, texts), spread, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(key), word, pa.array(zero), *map(pa.array, sums), pa.array(zero + 1), *more], names=columns)
            place = np.flatnonzero((at < 0)[t.which])
            if len(place):
                doc = np.searchsorted(t.bounds, place, side="right") - 1
                pair, k = np.unique(doc * len(t.different) + t.which[place], return_counts=True)
                doc, code = np.divmod(pair, len(t.different))
                words = pa.array(t.different, pa.binary()).take(pa.array(code))
                zero = np.zeros(len(pair), dtype=np.int64)
                nothing = [pa.nulls(len(pair), arrow[k]) for _, k in spread]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(key[doc]), words, pa.array(k), pa.array(zero.astype(np.float64)), pa.array(zero), pa.array(zero), *nothing], names=columns)

    schema = "doc_id long, key long, word binary, k long, a0 double, b0 long, m long" + (f", {kinds}" if kinds else "")
    sent_rows = on_batches(rows, run, schema)
    tail = values.filter(F.col("n") < least).select("word", F.col("a").alias("a1"), F.col("b").alias("b1"))
    found = sent_rows.join(tail.hint("merge"), "word", "left")
    if also is not None:
        zero = {"k": "0L", "a0": "0D", "b0": "0L", "m": "0L"}
        found = found.unionByName(also.select("*", *(F.expr(v).alias(c) for c, v in zero.items())), allowMissingColumns=True)
    a = F.sum(F.col("a0") + F.col("k") * F.coalesce("a1", F.lit(missing[0])))
    b = F.sum(F.col("b0") + F.col("k") * F.coalesce("b1", F.lit(missing[1])))
    by = found.groupBy("doc_id", "key").agg(F.sum("m").alias("m"), a.alias("a"), b.alias("b"), *((F.sum if k == "double" else F.max)(n).alias(n) for n, k in spread))
    each = lambda c: F.col(c) / F.col("m")
    once = by.select("doc_id", "m", each("a").alias(names[0]), each("b").cast("long").alias(names[1]), *(each(n).alias(n) if k == "double" else n for n, k in spread))
    return once.select("doc_id", *names, *(n for n, _ in spread), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_copy")).drop("_copy")
