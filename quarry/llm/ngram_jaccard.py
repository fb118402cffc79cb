r"""All links between documents of similar word n-grams: an exact Jaccard self-join.

A document's set is its different shingles (n words; 64-bit hashes stand for them).
Documents with one set are one class, which is joined once. Sets travel as 48 bits of
each hash, which makes two of them meet by chance in one pair of a billion.

1. Shingles are counted over the corpus. Those of many documents get a place at the
   end of the global order, by number; the others come first, by hash. Any order that
   all documents share gives right results; this one makes prefixes rare.
2. A class of n shingles is found by its prefix, its first n - ceil(t n) + 1. What
   occurs in one document only is not sent (a bitmap of fixed size knows most of it).
3. Prefix entries meet by shingle. Pairs have to pass the length filter, the
   positional filter and the suffix filter: sets are compared by parity bitmaps, whose
   difference is never larger than that of the sets.
4. First, neighbours in order of length are verified, on their whole sets, once each.
   Their links make components. Then each class is verified against the nearest one (by
   bitmap) of another component, and at last all pairs whose classes are still in
   different components are. A pair inside a component can change nothing and isn't made,
   so a group of near copies costs its size, not its square, and no link between different
   components is lost.

Blocks of entries are handled by part of the hash range, a bounded number in each.
What goes to the workers is bounded: the bitmap (BITMAP bits) and the frequent
shingles (`most_frequent`).

Defined cases: texts with fewer than n words have their whole word sequence as one
shingle; null texts and those without words have an empty set, n_shingles 0, and are
linked with nothing, so component_id is their own id; repeated rows each give a row;
rows of one id are linked if their sets are; a null id is kept, and no component is
named by it unless all its ids are null; a set that only such rows have is linked with
nothing else; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import key_counts as kc
from quarry.llm.common import chained, cut, id_bytes, on_batches, parts, release, word_hashes
from quarry.llm.components import components
from quarry.llm.word_tokens import spaced

#: Bits, as a power of two, of the bitmap of shingles that several documents have: 16 MB.
BITMAP = 27
#: Frequent shingles that are sent to the workers at most.
MOST_FREQUENT = 1_000_000
#: 64-bit words of a set's parity bitmap.
PARITY = 8
#: Candidate classes whose ids are sent to the workers at most, to read their texts again.
MOST_SENT = 1_000_000


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text, its sorted different 64-bit shingles."""
    t = spaced(texts, fold=True)
    h = word_hashes(t.different)[t.which]
    windows, out = chained(h, n), []
    for a, b in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True):
        out.append(np.unique(windows[a : b - n + 1] if b - a >= n else chained(h[a:b], b - a) if b > a else h[:0]))
    return out


def signature(shingles: np.ndarray) -> int:
    """What names a set's class."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY words: bit b is the parity of the number of shingles that fall on b."""
    bit = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * PARITY - 1).bit_length())
    odd = np.bincount(bit.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


class Order:
    """The global order and what is known of shingles, in a worker."""

    def __init__(self, frequent: bytes, ranks: bytes, bitmap: list[tuple[int, bytes]], bits: int):
        self.frequent, self.ranks = np.frombuffer(frequent, dtype="<u8"), np.frombuffer(ranks, dtype="<u4")
        self.bitmap, stretch = np.zeros(1 << (BITMAP - 3), dtype=np.uint8), 1 << (BITMAP - bits - 3)
        for part, own in bitmap:
            self.bitmap[part * stretch : (part + 1) * stretch] = np.frombuffer(pa.decompress(own, stretch, "zstd"), dtype=np.uint8)

    def prefix(self, shingles: np.ndarray, length: int) -> np.ndarray:
        if not len(self.frequent):
            return shingles[:length]
        key = shingles >> np.uint64(64 - kc.BITS)
        at = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
        often = self.frequent[at] == key
        late = shingles[often]
        return np.concatenate([shingles[~often], late[np.lexsort((late, self.ranks[at[often]]))]])[:length]

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """False for what at most one document has."""
        bit = shingles >> np.uint64(64 - BITMAP)
        return (self.bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


PROFILE = [("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())]
ENTRIES = [("part", pa.int32()), ("keys", pa.binary()), ("sigs", pa.binary()), ("ns", pa.binary()), ("places", pa.binary()), ("parities", pa.binary())]


def profile(rows: DataFrame, n: int, bits: int) -> DataFrame:
    """A row for each document with its class, and blocks of counted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for ids, texts in parts(batches):
            out = []
            for i, s in zip(ids.to_pylist(), shingle_sets(texts, n), strict=True):
                out.append((None, None, None, i, len(s), signature(s) if len(s) else None))
                kept.append(s)
                size += len(s)
            yield kc.batch(out, PROFILE)
            if size > kc.SORTED:
                yield kc.batch([(*b, None, None, None) for b in kc.blocks(*kc.counted(kept), bits)], PROFILE)
                kept, size = [], 0
        if size:
            yield kc.batch([(*b, None, None, None) for b in kc.blocks(*kc.counted(kept), bits)], PROFILE)

    return on_batches(rows, run, "part int, keys binary, counts binary, doc_id long, n long, sig long")


def part_tables(found: DataFrame, bits: int) -> DataFrame:
    """For each part its stretch of the bitmap (compressed, as most of it may be empty), its shingles of 8 documents and more, and a histogram of counts."""
    names = [("part", pa.int32()), ("bitmap", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("histogram", pa.list_(pa.int64()))]

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        keys, counts = kc.merged(group.column("keys").to_pylist(), group.column("counts").to_pylist())
        bit = (keys[counts > 1] >> np.uint64(kc.BITS - BITMAP)).astype(np.int64) - (part << (BITMAP - bits))
        own = np.zeros(1 << (BITMAP - bits), dtype=np.uint8)
        own[bit] = 1
        often = counts >= 8
        row = (part, pa.compress(np.packbits(own, bitorder="little").tobytes(), "zstd", asbytes=True), keys[often].tobytes(), counts[often].astype("<u4").tobytes(), kc.levels(counts[often]).tolist())
        return pa.Table.from_batches([kc.batch([row], names)])

    return found.filter("part is not null").select("part", "keys", "counts").groupBy("part").applyInArrow(run, "part int, bitmap binary, keys binary, counts binary, histogram array<long>")


def order_of(tables: DataFrame, bits: int, most: int):
    """A broadcast of the frequent shingles, their ranks and the bitmap, whose stretches stay as the parts have compressed them."""
    least = max(8, kc.least_count(kc.histogram_of(tables), most))
    bitmap = [(r["part"], bytes(r["bitmap"])) for r in tables.select("part", "bitmap").collect()]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, dtype="<u8"), np.frombuffer(c, dtype="<u4")
                yield kc.batch([(keys[counts >= least].tobytes(), counts[counts >= least].tobytes())], [("keys", pa.binary()), ("counts", pa.binary())])

    got = on_batches(tables.select("keys", "counts"), often, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype="<u8") for r in got] or [np.zeros(0, dtype="<u8")])
    counts = np.concatenate([np.frombuffer(r["counts"], dtype="<u4") for r in got] or [np.zeros(0, dtype="<u4")])
    order = np.argsort(keys)
    return tables.sparkSession.sparkContext.broadcast((keys[order].tobytes(), counts[order].tobytes(), bitmap, bits))


def entries(rows: DataFrame, n: int, percent: int, bits: int, order) -> DataFrame:
    """Blocks of prefix entries by part of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Order(*order.value), set()
        kept: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, sig, count, place = (np.concatenate([h[k] for h in kept]) for k in range(4))
            par = np.concatenate([h[4] for h in kept])
            by = np.argsort(key, kind="stable")
            part = (key[by] >> np.uint64(64 - bits)).astype(np.int64)
            at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(by)]])
            return kc.batch([(int(part[a]), key[by[a:b]].tobytes(), sig[by[a:b]].tobytes(), count[by[a:b]].tobytes(), place[by[a:b]].tobytes(), par[by[a:b]].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], ENTRIES)

        for _, texts in parts(batches):
            for s in shingle_sets(texts, n):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                if len(seen) < 50_000:
                    seen.add(sig)
                if 100 * int(known.shared(s).sum()) < percent * len(s):
                    continue  # more shingles are its own than a link allows
                prefix = known.prefix(s, len(s) - -(-percent * len(s) // 100) + 1)
                place = np.flatnonzero(known.shared(prefix))
                kept.append((prefix[place], np.full(len(place), sig, dtype="<i8"), np.full(len(place), len(s), dtype="<i4"), place.astype("<i4"), np.tile(parity(s), (len(place), 1))))
                size += len(place)
            if size > 60_000:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    return on_batches(rows, run, "part int, keys binary, sigs binary, ns binary, places binary, parities binary")


class Part:
    """The entries of one part, by shingle; classes by length and signature within each."""

    def __init__(self, group: pa.Table):
        col = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)
        key, sig, n, place = col("keys", "<u8"), col("sigs", "<i8"), col("ns", "<i4"), col("places", "<i4")
        par = col("parities", "<u8").reshape(-1, PARITY)
        by = np.lexsort((sig, n, key))
        by = by[np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (sig[by][1:] != sig[by][:-1])])] if len(by) else by
        self.key, self.sig, self.n, self.place, self.par = key[by], sig[by], n[by].astype(np.int64), place[by].astype(np.int64), par[by]
        at = np.concatenate([[0], np.flatnonzero(np.diff(self.key)) + 1, [len(by)]])
        self.groups = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1]

    def passing(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of entries pass the length, positional and suffix filters."""
        nx, ny = self.n[x], self.n[y]
        both = nx + ny
        need = -(-percent * both // (100 + percent))
        ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - self.place[x], ny - self.place[y]) >= need)
        at = np.flatnonzero(ok)
        differ = np.bitwise_count(self.par[x[at]] ^ self.par[y[at]]).sum(axis=1)
        ok[at[differ > (both - 2 * need)[at]]] = False
        return ok

    def table(self, x: list[np.ndarray], y: list[np.ndarray]) -> pa.Table:
        """Different pairs of signatures, the smaller first."""
        a = self.sig[np.concatenate([*x, np.zeros(0, dtype=np.int64)])]
        b = self.sig[np.concatenate([*y, np.zeros(0, dtype=np.int64)])]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def first_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each shingle, neighbours in order."""

    def run(group: pa.Table) -> pa.Table:
        part = Part(group)
        x = np.arange(max(0, len(part.key) - 1))
        x = x[part.key[x] == part.key[x + 1]]
        x = x[part.passing(x, x + 1, percent)]
        return part.table([x], [x + 1])

    return blocks.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def crossing_pairs(blocks: DataFrame, labels: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """(a, b): pairs of classes that share a shingle and are in different components; labels(v, p).

    All of them, or for each shingle and class the nearest of another component only.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.unique(np.frombuffer(sigs, dtype="<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(own)], names=["part", "v"])

    placed = on_batches(blocks.select("part", "sigs"), names, "part int, v long").join(labels, "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        label = dict(zip(right.column("v").to_pylist(), right.column("p").to_pylist(), strict=True))
        comp = np.fromiter((label.get(s, s) for s in part.sig.tolist()), dtype=np.int64, count=len(part.sig))
        xs, ys = [], []
        for a, b in part.groups:
            if (comp[a:b] == comp[a]).all():
                continue
            for x in range(a, b):
                # Classes are in order of length, so those that may match lie close.
                stop = a + int(np.searchsorted(part.n[a:b], 100 * part.n[x] // percent, side="right"))
                start = a + int(np.searchsorted(part.n[a:b], -(-percent * part.n[x] // 100))) if nearest else x + 1
                y = np.arange(start, stop)
                y = y[comp[y] != comp[x]]
                if len(y):
                    y = y[part.passing(np.full(len(y), x), y, percent)]
                if nearest and len(y) > 1:
                    y = y[[np.bitwise_count(part.par[x] ^ part.par[y]).sum(axis=1).argmin()]]
                if len(y):
                    xs.append(np.full(len(y), x))
                    ys.append(y)
        return part.table(xs, ys)

    return blocks.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that are linked, by their whole sets."""
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes.select("sig", "doc_id"), "sig").select("doc_id"))
    few = need.count() <= MOST_SENT
    texts = rows.join(F.broadcast(need) if few else need, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in parts(batches):
            keep = [s for s in shingle_sets(own, n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in keep], pa.int64()), pa.array([kc.planes(s >> np.uint64(16), 6) for s in keep], pa.binary())], names=["sig", "shingles"])

    have = on_batches(texts, sets, "sig long, shingles binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                x, y = (kc.unplaned(b.column(c)[k].as_buffer(), 6) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    # The sets are dealt out by class once, and read from there for either end of a pair.
    both = pairs.join(have.alias("y").hint("merge"), F.col("b") == F.col("y.sig")).select("a", "b", F.col("y.shingles").alias("set_b"))
    both = both.join(have.alias("x").hint("merge"), F.col("a") == F.col("x.sig")).select("a", "b", F.col("x.shingles").alias("set_a"), "set_b")
    return cut(on_batches(both, judge, "a long, b long").distinct())


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, most_frequent: int = MOST_FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links lead to) for every document.

    Two documents are linked if 100 * intersection >= percent * union of their sets.
    """
    rows = id_bytes(docs, id_col, text_col)
    bits = kc.part_bits(kc.text_bytes(rows))
    scratch = kc.Scratch(profile(rows, n, bits))
    own = cut(scratch.df.filter("n is not null").select("doc_id", "n", "sig"))
    tables = cut(part_tables(scratch.df, bits))
    scratch.drop()
    order = order_of(tables, bits, most_frequent)
    classes = cut(own.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    blocks = kc.Scratch(entries(rows, n, percent, bits, order))
    order.destroy()
    release()
    tested = cut(first_pairs(blocks.df, percent))
    links = verified(tested, rows, classes, n, percent)
    labels = components(links)
    for nearest in (True, False):
        more = cut(crossing_pairs(blocks.df, labels, percent, nearest).join(tested, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        found = verified(more, rows, classes, n, percent)
        # What was a component stays one: its nodes are drawn to its name.
        labels = components(labels.select(F.col("v").alias("a"), F.col("p").alias("b")).unionByName(found))
        tested = tested.unionByName(more)
    blocks.drop()
    placed = classes.join(labels, classes["sig"] == labels["v"], "left").select("sig", "doc_id", F.coalesce("p", "sig").alias("p"))
    least = placed.groupBy("p").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "p").select("sig", "component_id")
    full = own.filter("sig is not null").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = own.filter("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)
