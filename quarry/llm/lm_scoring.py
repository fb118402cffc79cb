"""Scores of documents under an n-gram model whose counts lie in a log-frequency Bloom filter.

An n-gram with count c is entered once for each level 1 .. 1 + floor(log2 c). To read
its count, levels are probed one after the other until one is missing; counts of one,
two and three words give smoothed probabilities. The filter lies in stretches, by part of
the hash range. A stretch has as many bits as the n-grams counted in its part ask
for, so none is left out at any size of corpus. The number of parts follows the input
and KEY bits of a hash tell the n-grams of a part apart, so that what two n-grams share
by chance doesn't grow either (about one in two hundred reads another's count, as with probes). No worker has the whole filter: each
block of documents sends its n-grams to their parts, where they are counted and then
probed, and the levels found come back to the block, where its texts are scored. Blocks
are made twice from the same rows; a number made of what they hold tells if that fails.

The score of a text is the log10 of probabilities smoothed with those of the shorter context
as a prior: P(w | uv) = (c(uvw) + PRIOR * P(w | v)) / (c(uv) + PRIOR), and so on down to
(c(w) + 1) / (N + V + 1). All that a context doesn't spend on what it has been followed by
goes to the shorter one, so the probabilities of all words and of one unknown word add up to
one, but for the steps of the counts (a count is read within a factor of 1.42); a context
never seen leaves all to the shorter one. The base score is exact: unigram counts of frequent
words lie in the workers, others are joined (see dictionary).

Defined cases: a null or empty text is one token, the end; repeated rows each give a
row; without training rows N and V are 0, so every base probability is 1 and base
scores are 0; a null id counts as training; texts are scored whole, very long ones in
several blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import key_counts as kc
from quarry.llm.common import cut, mix, on_batches, parts, word_hashes
from quarry.llm.dictionary import summed, text_keys, word_counts
from quarry.llm.word_tokens import Terms, spaced

#: The end of a text. No word is a space.
END = b" "
#: Bits that tell the n-grams of one part apart, and bytes of a word's hash.
KEY, WORD_BYTES = 28, 6
#: Probes of a level.
PROBES = 4
#: Probes entered for each bit of a stretch, at most; three quarters of the bits are unset then.
FULL = 0.29
#: How many times a context of one word, and of two, must have been seen to count as much as the shorter one.
PRIORS = (256.0, 1.0)
#: Bytes of words that are sent to every worker at most.
MOST_SENT = 50_000_000
#: Text and tokens of a block, at most.
TEXT, TOKENS = 8 << 20, 5 << 18


def words_of(texts: pa.Array) -> Terms:
    return spaced(texts, fold=True, end=END)


def spots(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """Where in a stretch of 2 ** size bits each of these keys (KEY bits) is entered for a level."""
    base = mix(keys + np.uint64(level << 48))
    for k in range(PROBES):
        yield ((base >> np.uint64(16 * k)) ^ (base << np.uint64(11 + k))) % np.uint64(1 << size)


class Stretch:
    """The filter of one part, of all its n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        level = np.frexp(counts.astype(np.float64))[1]
        self.size = max(10, int(np.ceil(np.log2(max(1, PROBES * int(level.sum())) / FULL))))
        own = np.zeros(1 << self.size, dtype=np.uint8)
        for j in range(1, int(level.max(initial=0)) + 1):
            for s in spots(keys[level >= j], j, self.size):
                own[s.astype(np.int64)] = 1
        self.data = np.packbits(own, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found of each of these different keys, by repeated probes."""
        level, left = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys))
        for j in range(1, 60):
            there = np.ones(len(left), dtype=bool)
            for s in spots(keys[left], j, self.size):
                there &= (self.data[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[there]
            if not len(left):
                break
            level[left] = j
        return level


def middle(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the middle of those that reach it and no more."""
    return np.where(level > 1, 2.0 ** (level.astype(np.float64) - 1) * 1.4142135623730951, np.minimum(level, 1))


def ngrams(words: np.ndarray, at: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Keys of a block's n-grams, of bits + KEY bits: each different word, then the pair and the triple that end at each token.

    words are hashes, the end's last; it stands before a text, too.
    """
    h = words[at]
    before = np.concatenate([words[-1:], h[:-1]])
    before[starts] = words[-1]
    pair = mix(mix(before + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15) + h)
    context = np.concatenate([pair[:1], pair[:-1]])
    context[starts] = 0
    return np.concatenate([mix(words + np.uint64(1)), pair, mix(context * np.uint64(0xD6E8FEB86659FD93) + h)]) >> np.uint64(64 - bits - KEY)


def stretches(bounds: np.ndarray, most: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Blocks of about `most` tokens: (text, from, to, how many of these stand there as context only)."""
    out, size = [], 0
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        at = a
        while at < b:
            to, skip = min(b, at + most - size), min(2, at - a)
            out.append((k, at - skip, to, skip))
            size += to - at
            at = to
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


@dataclass
class Block:
    """Some texts: their tokens as numbers of words, and where each text's begin."""

    number: int
    words: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    skips: list[int]
    names: list[int | None]
    keys: np.ndarray
    train: np.ndarray


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Blocks of rows (doc_id, text, held_out). A block's number comes from what it holds; blocks of the same texts share it."""
    for batch in batches:
        at_row, train = 0, ~np.asarray(batch.column(2))
        for ids, texts in parts(iter([batch]), TEXT):
            names, keys, t, trained = ids.to_pylist(), text_keys(texts), words_of(texts), train[at_row : at_row + len(texts)]
            at_row += len(texts)
            hashes = word_hashes(t.different) >> np.uint64(64 - 8 * WORD_BYTES)
            for pieces in stretches(t.bounds, most):
                which = np.concatenate([t.which[a:b] for _, a, b, _ in pieces])
                there = np.zeros(len(hashes), dtype=bool)
                there[which] = there[-1] = True
                docs, lengths = [k for k, *_ in pieces], np.array([b - a for _, a, b, _ in pieces])
                offsets = np.array([a - t.bounds[k] for k, a, *_ in pieces])
                number = xxhash.xxh3_64_intdigest(keys[docs].tobytes() + lengths.tobytes() + offsets.tobytes()) >> 1
                yield Block(number, hashes[there], (np.cumsum(there) - 1)[which], np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths, [s for *_, s in pieces], [names[k] for k in docs], keys[docs], trained[docs])


#: A block's n-grams of one part: keys and counts, or (answered) levels.
NGRAMS = [("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
#: A block's texts, and what their tokens are.
TEXTS = [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("skips", pa.list_(pa.int8())), ("words", pa.binary()), ("at", pa.binary())]
TEXTS_SQL = "block long, ids array<long>, texts array<long>, lengths array<long>, skips array<tinyint>, words binary, at binary"


def ngram_blocks(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """N-grams of each block by part, counted where they aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, most):
            found, back = kc.ranked(ngrams(b.words, b.at, b.starts, bits), bits + KEY)
            weight = np.repeat(b.train.astype(np.float64), b.lengths)
            for k in np.flatnonzero(b.skips).tolist():
                weight[b.starts[k] : b.starts[k] + b.skips[k]] = 0
            counts = np.bincount(back, np.concatenate([np.bincount(b.at, weight, len(b.words)), weight, weight])).astype(np.int64)
            del back, weight
            within = found & np.uint64((1 << KEY) - 1)
            yield kc.batch([(p, b.number, kc.squeezed(np.diff(within[x:y], prepend=np.uint64(0))), kc.squeezed(counts[x:y])) for p, x, y in kc.by_part(found, KEY)], NGRAMS)

    return on_batches(rows, run, "part int, block long, keys binary, counts binary")


def text_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Texts and tokens of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, most):
            yield kc.batch([(b.number, b.names, b.keys.tolist(), b.lengths.tolist(), b.skips, kc.planes(b.words, WORD_BYTES), kc.squeezed(b.at))], TEXTS)

    return on_batches(rows, run, TEXTS_SQL)


def probed(blocks: DataFrame) -> DataFrame:
    """(part, block, levels): what the filter of all training documents has of each block's n-grams."""

    def run(group: pa.Table) -> pa.Table:
        each = [np.cumsum(kc.unsqueezed(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        keys, back = kc.ranked(np.concatenate(each), KEY)
        counts = np.bincount(back, np.concatenate([kc.unsqueezed(c) for c in group.column("counts").to_pylist()]))
        level = Stretch(keys[counts > 0], counts[counts > 0]).levels(keys)[back]
        answers = [kc.squeezed(x) for x in np.split(level, np.cumsum([len(k) for k in each])[:-1])]
        return pa.Table.from_arrays([group.column("part"), group.column("block"), pa.array(answers, pa.binary())], names=["part", "block", "levels"])

    return blocks.groupBy("part").applyInArrow(run, "part int, block long, levels binary")


def smoothed(count: np.ndarray, context: np.ndarray, shorter: np.ndarray, prior: float) -> np.ndarray:
    """P in a context seen so often, given P in the shorter one. As counts are read in steps, one may exceed its context's."""
    return np.where(context > 0, (count + prior * shorter) / (np.maximum(context, count) + prior), shorter)


def scores(words: np.ndarray, at: np.ndarray, lengths: np.ndarray, skips: np.ndarray, level: np.ndarray, bits: int, total: int) -> np.ndarray:
    """Scores of a block's texts; level has the levels of its different n-grams, in order of their keys."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    _, back = kc.ranked(ngrams(words, at, starts, bits), bits + KEY)
    count = middle(level)[back]
    single, pair, triple = count[: len(words)], count[len(words) : len(words) + len(at)], count[len(words) + len(at) :]
    before = np.concatenate([[0.0], single[at][:-1]])
    before[starts] = single[-1]
    context = np.concatenate([[0.0], pair[:-1]])
    context[starts] = 0
    logs = np.log10(smoothed(triple, context, smoothed(pair, before, np.minimum((single[at] + 1) / total, 1.0), PRIORS[0]), PRIORS[1]))
    for k in np.flatnonzero(skips).tolist():
        logs[starts[k] : starts[k] + skips[k]] = 0
    return np.add.reduceat(logs, starts)


def scored(texts: DataFrame, answered: DataFrame, bits: int, total: int) -> DataFrame:
    """(doc_id, key, score) of every document, or of stretches of it; key is the text's hash."""
    names = [("doc_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]

    def run(group: pa.Table) -> pa.Table:
        asked = np.asarray(group.column("levels").is_valid())
        # Blocks of the same texts have the same answers.
        own = {r["part"]: r["levels"] for r in group.filter(pa.array(asked)).select(["part", "levels"]).to_pylist()}
        docs = group.filter(pa.array(~asked)).to_pylist()
        if not own or not docs:
            raise RuntimeError("rows came in another order when they were read again; write them to a table first")
        level = np.concatenate([kc.unsqueezed(own[p]) for p in sorted(own)])
        lengths, skips = np.array(docs[0]["lengths"]), np.array(docs[0]["skips"])
        found = scores(kc.unplaned(docs[0]["words"], WORD_BYTES), kc.unsqueezed(docs[0]["at"]).astype(np.int64), lengths, skips, level, bits, total)
        out = [pa.array([x for d in docs for x in d[c]], pa.int64()) for c in ("ids", "texts")]
        return pa.Table.from_arrays([*out, pa.array(np.tile(found, len(docs)))], schema=pa.schema(names))

    return answered.unionByName(texts, allowMissingColumns=True).groupBy("block").applyInArrow(run, "doc_id long, key long, score double")


def lm_scoring(docs: DataFrame, held_out: Column, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text", block: int = TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; learns from rows that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    # Blocks are made twice, once for their n-grams and once for their tokens, which saves a shuffle of the tokens. A
    # scan gives the same rows in the same order again; what has been shuffled needn't, and is written first.
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows)
    train, every = rows.filter("not held_out").select("doc_id", "text"), rows.select("doc_id", "text")
    split = lambda: words_of
    values = cut(word_counts(train, split).select("word", "n", F.log10(F.col("n") + 1).alias("a"), F.lit(1).cast("long").alias("b")))
    tokens, types = values.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = kc.part_bits(3 * kc.text_bytes(every), 30)
    also = scored(text_blocks(rows, block), probed(ngram_blocks(rows, bits, block)), bits, tokens + types + 1)
    lengths = lambda t, texts: [pa.array(np.diff(t.bounds)), pa.nulls(len(texts))]
    found = summed(every, split, values, most_sent, lengths, "n_tokens long, score double", ("known_log", "n_known"), kind="lm", also=also)
    total = float(np.log10(tokens + types + 1))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("known_log") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score")
