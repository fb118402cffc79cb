"""Spelling variants by forward and reversed sorted dictionaries.

Words of the corpus are counted once; all that follows works on the dictionary. If one
code point inserted, deleted or replaced makes one word of another, the longer of M code
points, then what they share at the front and at the back adds up to M - 1 at least: one
of the halves is intact. So words stand in a forward dictionary, in blocks of those with
the same first M // 2, and in a reversed one, in blocks of those with the same last
M // 2. Blocks with more words than `most` are subdivided: what is between the shared
ends is halved again, and a pair shares the one half or the other. Where one code point
is left, a block can't have more words than there are letters, so every block gets small
without a cap. Blocks are read in order as ranges of the sorted entries and verified by
the lengths that neighbours share in forward and in reversed order. A block takes only
pairs that share as much at the front as its path of halves says, so each pair is
verified and made once.

Defined cases: a null text has no words; a null id reads as an empty text in the digest;
repeated rows count each; words of any length take part; ties of counts go to the
smallest word in code-point order; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import FOLD, cut, id_text, on_batches

RUN = re.compile("[a-zÀ-ÿ]+")
FOLDED = str.maketrans({k: v for k, v in enumerate(FOLD) if k != v})
#: Every run whose digest this number divides loses a code point.
NOISE = 199
#: Code points and occurrences of a word, and how often a form is as frequent as its variants, at least.
LENGTH, LEAST, TIMES = 6, 5, 5
#: Words in a block at most, and words that a task counts at once.
MOST, COUNTED = 128, 400_000
#: More than any word shares with another.
ALL = 2_147_483_647
BLOCK = ["m", "a", "b", "q", "piece"]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least `length` code points and `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(RUN.findall((text or "").translate(FOLDED))).items():
                    if len(word) < length:
                        continue
                    h = zlib.crc32(word.encode(), begin)
                    if not h % noise:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    seen[word] = seen.get(word, 0) + n
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    words = on_batches(id_text(docs, id_col, text_col), run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def entries(words: DataFrame) -> DataFrame:
    """Each word in the blocks of both dictionaries, with the words of its own length and with those that are one longer."""
    size, half = F.length("word"), F.expr("cast(m div 2 as int)")
    each = words.withColumn("m", F.explode(F.array(size, size + 1)))
    front = each.select("word", "n", "m", half.alias("a"), F.lit(0).alias("b"), F.lit(ALL).alias("q"), F.expr("substring(word, 1, cast(m div 2 as int))").alias("piece"))
    back = each.select("word", "n", "m", F.lit(0).alias("a"), half.alias("b"), half.alias("q"), F.expr("right(word, cast(m div 2 as int))").alias("piece"))
    return front.unionByName(back)


def subdivided(large: DataFrame) -> DataFrame:
    """Entries of large blocks, each in the two blocks that share half of what was left between the ends."""
    half = F.expr("cast((m - a - b) div 2 as int)")
    front = large.withColumns({"a": F.col("a") + half})
    back = large.withColumns({"b": F.col("b") + half, "q": F.least("q", F.col("a") + half)})
    return front.unionByName(back).withColumn("piece", F.expr("concat(substring(word, 1, a), right(word, b))"))


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """Entries whose blocks have `most` words at most, or one code point between the shared ends."""
    done, rest = [], entries(words)
    while True:
        rest = cut(rest)
        sizes = rest.groupBy(*BLOCK).agg(F.count("*").alias("k"))
        large = cut(sizes.filter((F.col("k") > most) & (F.expr("m - a - b") > 1)).drop("k"))
        few = large.limit(10_001).count()
        if not few:
            done.append(rest)
            break
        sent = F.broadcast(large) if few <= 10_000 else large
        done.append(rest.join(sent, BLOCK, "left_anti"))
        rest = subdivided(rest.join(sent, BLOCK, "left_semi"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def shared(x: str, y: str) -> int:
    """How many code points two words share at the front."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while low < n:  # the first half that differs, by halves
        mid = (low + n + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            n = mid - 1
    return low


def verified(words: list[str], m: int, a: int, q: int) -> Iterator[tuple[int, int]]:
    """Pairs of a block's sorted words, the longer of m code points, that are one edit apart and share at the front from a to less than q."""
    k = len(words)
    front = [shared(x, y) for x, y in zip(words, words[1:], strict=False)]
    turned = [w[::-1] for w in words]
    size = [len(w) == m for w in words]
    if k <= 12:
        for i in range(k):
            p = ALL
            for j in range(i + 1, k):
                p = min(p, front[j - 1])
                if p < a:
                    break
                if p < q and (size[i] or size[j]) and p + shared(turned[i], turned[j]) >= m - 1:
                    yield i, j
        return

    def all_pairs(neighbours: list[int]) -> np.ndarray:
        """The least of neighbours i to j - 1 at (i, j) for i < j."""
        own = np.where(np.arange(k)[:, None] < np.arange(k), np.concatenate([[0], neighbours]), ALL)
        return np.minimum.accumulate(own, axis=1)

    order = sorted(range(k), key=turned.__getitem__)
    rank = np.argsort(order)
    back = all_pairs([shared(turned[x], turned[y]) for x, y in zip(order, order[1:], strict=False)])
    p, s = all_pairs(front), back[np.minimum(rank[:, None], rank), np.maximum(rank[:, None], rank)]
    long = np.array(size)
    found = (p + np.minimum(s, m) >= m - 1) & (p >= a) & (p < q) & (long[:, None] | long)
    yield from zip(*(x.tolist() for x in np.nonzero(np.triu(found, 1))), strict=True)


def near(words: DataFrame, most: int = MOST, tasks: int | None = None) -> DataFrame:
    """(word, n, other, other_n): all pairs one edit apart, from both sides."""
    schema = [("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, rows = None, [], []

        def scanned() -> None:
            if len(block) > 1:
                m, a, _, q, _ = key
                for i, j in verified([w for w, _ in block], m, a, q):
                    rows.append((*block[i], *block[j]))
                    rows.append((*block[j], *block[i]))

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for word, n, *own in zip(*cols, strict=True):
                if own != key:
                    scanned()
                    key, block = own, []
                block.append((word, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[x for x, _ in schema])
                rows.clear()
        scanned()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[x for x, _ in schema])

    of = F.col
    sorted_ = blocks(words, most).select("word", "n", *BLOCK).repartition(*([tasks] if tasks else []), *BLOCK).sortWithinPartitions(*BLOCK, of("word"))
    return on_batches(sorted_, run, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end. Each round doubles the way that has been gone, and counts grow fivefold a step, so there are few."""
    found = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not found.filter("moved").limit(1).count():
            return found.select("word", "root")
        found = found.select("word", "root")


def spelling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word; limits: see vocabulary."""
    words = cut(vocabulary(docs, id_col, text_col, **limits))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    by = near(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(by, "word", "left")
    enough = -F.col("best.less") >= TIMES * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
