"""Packing token ids into training sequences, in order.

Documents are laid end to end as they come in their partition. Where to cut that
stream is found by dynamic programming over the ends of documents, sentences and,
at a higher price, clauses:
f(j) = min over i of f(i) + padding of (i, j] + penalty of cutting at j, with
j - i at most the length of a sequence. Padding is linear in i, so the least of
f(i) + position(i) over a sliding window is enough; a monotone queue gives it in
constant time a cut. Where no end comes for a whole sequence, cuts inside a
sentence are allowed at a higher penalty.

One pass, no shuffle: each task packs its own rows, block by block, and hands the
open sequence on to its next block. It pads at most one sequence of its own beyond
the plan's, its last.

Defined cases: a null text is an empty one and has the end id only; repeated rows
and ids each are packed; documents longer than a sequence are cut at sentences; an
empty table gives an empty result; other columns are not read. The result depends
on how the rows lie in partitions, but a task that is run again gives the same.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import held, id_bytes, on_batches, parts, release
from quarry.llm.word_tokens import word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What a cut costs, in tokens of padding: between sentences of a document, between clauses, and elsewhere.
SENTENCE_CUT, CLAUSE_CUT, HARD_CUT = 2.0, 6.0, 64.0
#: Tokens that are planned at once.
BLOCK = 1 << 19
#: Bytes of text that are tokenised at once. Two workers and an executor's JVM share its memory, so this is little.
TEXT = 1 << 20


def cuts(ends: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """The best cuts among rising `ends`; the last of them is always one. No gap may exceed `length`.

    As each sequence costs its length, no new value is below the queue's first. So all ends in the
    reach of the queue's first are entered at once, and of these the queue keeps those that have
    none behind them that is as cheap.
    """
    pos, pen, n = [0, *ends.tolist()], [0.0, *penalty.tolist()], len(ends)
    #: Ends that are cheaper than the next, and a last one that no run reaches.
    cheaper = [*(np.flatnonzero(penalty[:-1] < penalty[1:]) + 1).tolist(), n + 1]
    # What may come before the next end: its f + position, rising, and which end it is; what lies before head is out of reach.
    value, cut = [0.0], [0]
    head, c, a = 0, 0, 1
    stops, backs = [], []
    while a <= n:
        low = pos[a] - length
        while pos[cut[head]] < low:
            head += 1
        first = cut[head]
        base = value[head] + length
        b = bisect_right(pos, pos[first] + length, a, min(n + 1, a + length))
        stops.append(b)
        backs.append(first)
        k = 0
        while k < b - 1:
            k = min(cheaper[c], b - 1)
            c += k == cheaper[c]
            v = base + pen[k]
            while value[-1] >= v:
                value.pop()
                cut.pop()
            value.append(v)
            cut.append(k)
        if head > 65536:
            del value[:head], cut[:head]
            head = 0
        a = b
    out, j = [], n
    while j > 0:
        out.append(pos[j])
        j = backs[bisect_right(stops, j)]
    return np.array(out[::-1], dtype=np.int64)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, price: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and what each costs; price is what a cut after each token costs, 0 for none."""
    after = price[ids]
    after[doc_ends - 1] = -1
    pos = np.flatnonzero(after) + 1
    pen = np.maximum(after[pos - 1], 0).astype(np.float64)
    gap = np.diff(np.concatenate([[0], pos]))
    if (gap > length).any():
        step = max(1, length // 32)
        more = np.concatenate([np.arange(pos[k] - gap[k] + step, pos[k], step) for k in np.flatnonzero(gap > length)])
        pos, pen = np.concatenate([pos, more]), np.concatenate([pen, np.full(len(more), HARD_CUT)])
        order = np.argsort(pos, kind="stable")
        pos, pen = pos[order], pen[order]
    return pos, pen


def prices(tokenizer) -> np.ndarray:
    """What a cut after each id costs, by the last mark of its token, closing marks aside; 0 where none may be."""
    known = tokenizer.get_vocab()
    out = np.zeros(max(known.values()) + 2, dtype=np.float32)
    for token, i in known.items():
        mark = token.removesuffix("</w>").rstrip("\"')]}")[-1:]
        out[i] = SENTENCE_CUT if mark in set(".!?") else CLAUSE_CUT if mark in set(",;:|") else 0
    return out


class Packer:
    """Lays documents end to end and gives back columns of rows for the sequences that are settled."""

    def __init__(self, price: np.ndarray, length: int, first_id: int):
        self.price, self.length, self.sequence = price, length, first_id
        self.ids: list[np.ndarray] = []
        #: Of the open documents: ids and tokens in all; and how many of the first one's tokens are given out.
        self.names: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.done = self.open = 0

    def add(self, names: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with their ids one after the other."""
        self.ids.append(ids)
        self.names += names
        self.sizes.append(sizes)
        self.open += len(ids)

    def settle(self, last: bool) -> list[pa.Array]:
        """Rows of all sequences but the open one, or of all if this is the end."""
        if not self.names:
            return [pa.array([], pa.int64())] * 7
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        ends = np.cumsum(sizes) - self.done
        pos, pen = candidates(ids, ends, self.price, self.length)
        stops = cuts(pos, pen, self.length)
        kept = len(stops) if last else len(stops) - 1
        limit = int(stops[kept - 1]) if kept else 0
        edges = np.union1d(stops[:kept], ends[ends <= limit])
        starts = np.concatenate([[0], edges[:-1]])[: len(edges)]
        doc = np.searchsorted(ends, starts, side="right")
        seq = np.searchsorted(stops[:kept], starts, side="right")
        view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        checks = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), edges.tolist(), strict=True)]
        out = [pa.array([self.names[d] for d in doc.tolist()], pa.int64()), starts - (ends - sizes)[doc], edges - starts, checks, sizes[doc], self.sequence + seq, starts - np.concatenate([[0], stops[:kept]])[seq]]
        self.sequence += kept
        at = int(np.searchsorted(ends, limit, side="right"))
        self.names, self.sizes, self.ids, self.open = self.names[at:], [sizes[at:]], [ids[limit:]], len(ids) - limit
        self.done = limit - int((ends - sizes)[at]) if self.names else 0
        return [pa.array(c, pa.int64()) for c in out]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document and place there, its sequence and place there, and the checksum of its ids.

    tokenizer: a tokeniser file, at the same place on every worker, to which word_tokens applies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(held("pack", "prices", lambda: prices(words.tokenizer), tokenizer), length, TaskContext.get().partitionId() << 33)

        def out(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(packer.settle(last), names=[x.split()[0] for x in SCHEMA.split(", ")])

        for names, texts in parts(batches, TEXT):
            ids, sizes = words(texts)
            packer.add(names.to_pylist(), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
            if packer.open >= BLOCK:
                yield out(last=False)
                release()
        yield out(last=True)

    return on_batches(id_bytes(docs, id_col, text_col), run, SCHEMA)
