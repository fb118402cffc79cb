"""Alignment of two tokenisers' tokens over the same text.

A byte-level BPE (A) and a piece model with byte fallback (B) cut the same bytes, a
space and the text. Tokens' ends are running sums of their byte lengths; the ends that
both have cut the text into groups; an A and a B token are linked where their bytes
overlap. Corpus-wide each linked id pair has a count, the documents that hold it; a
document is described by the counts of its links.

No token of A or B goes from a character that isn't white space into a space, and none
from a letter into a mark or from a mark into a letter (B's vocabulary is looked through
for one; A's pre-tokens see to it). So a text is cut there, and each different chunk of a
slice of texts is tokenised and aligned once, all of them as one array: ends by cumsum,
cuts by intersect1d, groups by searchsorted, links by repeat. Texts are read once; what
they come to, with their different id pairs, is kept in the shared folder.

Counts go through two shuffles: tasks add up their own documents, salted sums follow,
then the sums of those; no id pair is hot. Pairs held by most documents go to every
worker, as many as `most_sent` (counted, not assumed); a document sends its other,
rare pairs to a join. A best pair's count is the highest of its A id, which a table of
at most 65,536 rows tells.

Defined cases: null and empty texts, and those whose joined tokens of A or B aren't a
space and the text (B's own sign for a space in the text, say), have no tokens: zeros
and an empty string, and they count nowhere. Repeated rows each count as a document
and give a row; a null id stays null; texts are taken whole, one by one in a worker
(about 20 times a text's size); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, held, id_bytes, on_batches, parts
from quarry.llm.key_counts import Scratch
from quarry.llm.word_tokens import expanded

LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: From a space (or spaces) to the next one that doesn't follow other white space.
SPACED = r" *[^ ]*(?:(?<=\s) +[^ ]*)*"
#: Letters before a mark, a space or the end; marks before a letter (but for an apostrophe, which may go with it), a space or the end; or else all up to the next space.
CHUNK = re.compile(rf"(?!\Z)(?: *[{LETTERS}]++(?=[{MARKS} ]|\Z)| *[{MARKS}]++(?:(?= |\Z)|(?<!')(?=[{LETTERS}]))|{SPACED})")
#: Where B has tokens of letters and marks.
WIDE = re.compile(rf"(?!\Z){SPACED}")
ACROSS = re.compile(rf"[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]")
#: Bits of an id of B in an id pair; both ids have as many at most.
ID_BITS = 16
#: Text that is taken at once, in bytes, and chunks that a worker keeps.
TEXT, KEPT = 2 << 20, 200_000
#: Id pairs that a task adds up before it sends them, and that go to every worker at most (17 bytes each).
SUMMED, MOST_SENT = 1_000_000, 2_000_000
#: Sums of a pair that its first shuffle makes.
SALTS = 8


def spelled(token: str, of: dict[str, int]) -> bytes:
    """A byte-level entry's bytes."""
    return bytes(of[c] for c in token)


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64)


class Aligner:
    """Tokenises and aligns chunks; those of late are kept, in two generations."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        a_bytes = [b""] * (vocabulary[-1][1] + 1)
        for token, i in vocabulary:
            a_bytes[i] = spelled(token, of) if all(c in of for c in token) else b""
        n = self.b.get_piece_size()
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        if max(len(a_bytes), n) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.pools = [(np.fromiter(map(len, x), dtype=np.int64, count=len(x)), np.frombuffer(b"".join(x), dtype=np.uint8)) for x in (a_bytes, b_bytes)]
        across = any(ACROSS.search(self.b.id_to_piece(i)) for i in range(n) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i))
        self.cut = (WIDE if across else CHUNK).findall
        #: What stands before a chunk without a space, for B, and its tokens.
        self.fronts = {x: (x, len(self.b.encode(x))) for x in "x("}
        self.late: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def of(self, chunks: list[str]) -> list[tuple]:
        """For each of these different chunks: valid, numbers of A's and B's tokens and of groups, linked id pairs as bytes, groups as text."""
        if len(self.late) > KEPT:
            self.late, self.before = {}, self.late
        found = list(map(self.late.get, chunks))
        missing = []
        for k, x in enumerate(found):
            if x is None:
                old = self.before.get(chunks[k])
                if old is None:
                    missing.append(k)
                else:
                    found[k] = self.late[chunks[k]] = old
        for at in range(0, len(missing), 20_000):
            own = missing[at : at + 20_000]
            for k, x in zip(own, self.made([chunks[k] for k in own]), strict=True):
                found[k] = self.late[chunks[k]] = x
        return found

    def ids(self, chunks: list[str]) -> list[list[list[int]]]:
        """A's and B's ids of chunks. B adds the space that a chunk begins with; one without follows a letter or a mark, and is told so."""
        fronts = [("", 0) if c[0] == " " else self.fronts["(" if c[0].isalpha() else "x"] for c in chunks]
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([f + c if f else c[1:] for (f, _), c in zip(fronts, chunks, strict=True)], num_threads=1)
        space = self.b.piece_to_id("▁")  # B has no tokens for a space alone
        return [a, [[space] if c == " " else y[n:] if n else y for (_, n), c, y in zip(fronts, chunks, b, strict=True)]]

    def bytes_of(self, side: int, ids: np.ndarray) -> bytes:
        lengths, pool = self.pools[side]
        return expanded(ids, lengths, pool)[0].tobytes()

    def made(self, chunks: list[str]) -> list[tuple]:
        both = self.ids(chunks)
        raw = [c.encode() for c in chunks]
        good = [True] * len(chunks)
        joined = b"".join(raw)
        for side in (0, 1):
            if self.bytes_of(side, flat(both[side])) != joined:
                for k, x in enumerate(both[side]):
                    good[k] &= self.bytes_of(side, np.array(x, dtype=np.int64)) == raw[k]
        if not all(good):
            keep = [k for k, x in enumerate(good) if x]
            rest = iter(self.aligned(*[[side[k] for k in keep] for side in both]))
            return [next(rest) if x else (False, 0, 0, 0, b"", "") for x in good]
        return self.aligned(*both)

    def aligned(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """Chunks whose tokens have the same bytes, laid end to end."""
        if not a:
            return []
        ids = [flat(side) for side in (a, b)]
        ends = [np.cumsum(self.pools[s][0][ids[s]]) for s in (0, 1)]
        starts = [ends[s] - self.pools[s][0][ids[s]] for s in (0, 1)]
        # A token without bytes would share its end; there is none where the bytes are the text's.
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        low = np.searchsorted(ends[1], starts[0], side="right")
        n = np.searchsorted(starts[1], ends[0], side="left") - low
        from_a = np.repeat(np.arange(len(n)), n)
        to_b = np.arange(len(from_a)) + np.repeat(low - (np.cumsum(n) - n), n)
        pair = ids[0][from_a] << ID_BITS | ids[1][to_b]
        names = [list(map(str, x.tolist())) for x in ids]
        bounds = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(cuts)))]).tolist() for g in group]
        text = [",".join(names[0][p:q]) + "|" + ",".join(names[1][r:s]) for p, q, r, s in zip(bounds[0], bounds[0][1:], bounds[1], bounds[1][1:], strict=False)]
        sizes = [np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (a, b)]
        last = np.cumsum(sizes[0])
        links = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], last])].tolist()
        groups = [0, *(group[0][last - 1] + 1).tolist()]
        return [(True, na, nb, g1 - g0, pair[p0:p1].tobytes(), ";".join(text[g0:g1])) for na, nb, g0, g1, p0, p1 in zip(sizes[0].tolist(), sizes[1].tolist(), groups, groups[1:], links, links[1:], strict=False)]


@dataclass
class Chunked:
    """Chunks of some texts: the different ones, their numbers, those of text k from bounds[k] to bounds[k + 1] (none for a text without tokens), and the id pairs of each."""

    own: list[tuple]
    which: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunked(aligner: Aligner, texts: pa.Array) -> Chunked:
    whole = [aligner.cut(" " + t.decode("utf-8", "replace")) if t else [] for t in texts.to_pylist()]
    coded = pa.array(chain.from_iterable(whole), pa.string()).dictionary_encode()
    own = aligner.of(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
    which, text = coded.indices.to_numpy(), np.repeat(np.arange(len(whole)), sizes)
    bad = np.fromiter((not x[0] for x in own), dtype=bool, count=len(own))
    if bad.any():
        gone = np.zeros(len(whole), dtype=bool)
        gone[text[bad[which]]] = True
        which, sizes = which[~gone[text]], np.where(gone, 0, sizes)
    pairs = np.frombuffer(b"".join([x[4] for x in own]), dtype=np.int64)
    return Chunked(own, which, np.concatenate([[0], np.cumsum(sizes)]), pairs, np.fromiter((len(x[4]) >> 3 for x in own), dtype=np.int64, count=len(own)))


def packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted id pairs of a text, as byte planes of their differences, and how often each is linked."""
    if not len(pairs):
        return b""
    step = np.diff(pairs, prepend=0).astype("<u4")
    raw = len(pairs).to_bytes(4, "little") + np.ascontiguousarray(np.stack([step, n.astype("<u4")]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, offset=4).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4").reshape(2, -1)
    return np.cumsum(both[0].astype(np.int64)), both[1].astype(np.int64)


SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def described(rows: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of each row; pairs: its different id pairs, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held("alignment", "aligner", lambda: Aligner(a_file, b_file), (a_file, b_file))
        for ids, texts in parts(batches, TEXT):
            t = chunked(aligner, texts)
            per_chunk = [np.fromiter((x[k] for x in t.own), dtype=np.int64, count=len(t.own)) for k in (1, 2, 3)] + [t.sizes]
            per_text = [np.diff(np.concatenate([[0], np.cumsum(x[t.which])])[t.bounds]) for x in per_chunk]
            groups, bounds = [x[5] for x in t.own], t.bounds.tolist()
            digest = [hashlib.sha256(";".join([groups[c] for c in t.which[p:q].tolist()]).encode()).hexdigest() if q > p else "" for p, q in zip(bounds, bounds[1:], strict=False)]
            # A text's different chunks, then their different pairs.
            code, k = np.unique(t.texts() * len(t.own) + t.which, return_counts=True)
            text, chunk = np.divmod(code, max(1, len(t.own)))
            pair, n = expanded(chunk, t.sizes, t.pairs)
            text, k = np.repeat(text, n), np.repeat(k, n)
            order = np.argsort(text << (2 * ID_BITS) | pair, kind="stable")
            text, pair, k = text[order], pair[order], k[order]
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])) if len(pair) else np.zeros(0, dtype=np.int64)
            text, pair, k = text[first], pair[first], np.add.reduceat(k, first) if len(first) else k
            at = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            packs = [packed(pair[p:q], k[p:q]) for p, q in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, per_text), pa.array(digest, pa.string()), pa.array(packs, pa.binary())], names=["doc_id", *SUMS, "groups_sha256", "pairs"])

    return on_batches(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string, pairs binary")


def pair_counts(kept: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold an id pair linked, and whether no pair of the A id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held_back: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pair, at = np.unique(np.concatenate([p for p, _ in held_back]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in held_back]), minlength=len(pair)).astype(np.int64)
            held_back[:] = [(pair, n)]
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), salt, dtype=np.int32)), pa.array(n)], names=["pair", "salt", "n"])

        for batch in batches:
            found = [unpacked(x)[0] for x in batch.column(0).to_pylist()]
            if found:
                held_back.append(np.unique(np.concatenate(found), return_counts=True))
            if sum(len(p) for p, _ in held_back) > SUMMED:
                sums = out()
                if sums.num_rows > SUMMED // 2:
                    held_back.clear()
                    yield sums
        if held_back:
            yield out()

    sent = on_batches(kept.select("pairs"), run, "pair long, salt int, n long")
    counted = sent.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("a", F.shiftright("pair", ID_BITS)))
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    return counted.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_held(counts: DataFrame, most_sent: int) -> int:
    """The least power of two so that at most `most_sent` pairs are held by as many documents."""
    found = {r["b"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("k")).collect()}
    total, b = 0, 63
    while b >= 0 and total + found.get(b, 0) <= most_sent:
        total += found.get(b, 0)
        b -= 1
    return 1 << (b + 1)


def align(docs: DataFrame, a_file: str, b_file: str, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every document.

    a_file: a byte-level BPE for the tokenizers library; b_file: a sentencepiece model that adds a space; both at the same place on every worker.
    """
    spark = docs.sparkSession
    # A row's number is written with it, so it is the same whenever it is read.
    kept = Scratch(described(id_bytes(docs, id_col, text_col), a_file, b_file).withColumn("row", F.monotonically_increasing_id())).df
    counts = cut(pair_counts(kept))
    least = least_held(counts, most_sent)
    head = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast([np.ascontiguousarray(head.column(k).to_numpy()) for k in range(3)])
    name = uuid.uuid4().hex
    rare = counts.filter(F.col("n") < least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_of, best_of = held("alignment", "head", lambda: sent.value, name)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [unpacked(x) for x in batch.column(1).to_pylist()]
            pairs, k = (np.concatenate([x[j] for x in found]) for j in (0, 1))
            bounds = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])])
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            sums = []
            for value in (best_of, n_of):
                own = np.zeros(len(pairs), dtype=np.int64)
                own[there] = k[there] * value[place[there]]
                sums.append(np.diff(np.concatenate([[0], np.cumsum(own)])[bounds]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), *map(pa.array, sums)], names=columns)
            if not there.all():
                left = np.flatnonzero(~there)
                row = batch.column(0).take(pa.array(np.searchsorted(bounds, left, side="right") - 1))
                zero = pa.array(np.zeros(len(left), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([row, pa.array(pairs[left]), pa.array(k[left]), zero, zero], names=columns)

    columns = ["row", "pair", "k", "n_best", "count_sum"]
    own = on_batches(kept.select("row", "pairs"), run, ", ".join(f"{c} long" for c in columns))
    if not rare.limit(1).count():  # every pair has gone to the workers, and a row has one line
        sums = own.select("row", "n_best", "count_sum")
    else:
        found = own.join(rare.select("pair", "n", "best").hint("merge"), "pair", "left")
        more = [F.coalesce(F.col("k") * x, F.lit(0)) for x in (F.col("best").cast("long"), F.col("n"))]
        sums = found.groupBy("row").agg(*(F.sum(F.col(c) + m).alias(c) for c, m in zip(("n_best", "count_sum"), more, strict=True)))
    return kept.drop("pairs").join(sums, "row").select("doc_id", *SUMS, "n_best", "count_sum", "groups_sha256")
