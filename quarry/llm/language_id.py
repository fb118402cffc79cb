"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its
letters' vectors, each permuted (rotated) by its place; a text is the sum of its
n-grams; a language is the sum of its texts, each scaled to unit length. A text
gets the language whose prototype has the largest cosine with it.

Two passes over the texts. The first sends one vector for each language and task,
split in blocks of dimensions, so that sums are partial before the shuffle and no
group is larger than the number of tasks; what comes back to the driver is
languages x dimensions, checked against max_languages. The second pass has no shuffle.

Defined cases: a null text, or one without a letter, gets `und` and score 0, as
everything does if nothing can be learned; rows whose label is null teach nothing;
ties go to the first label by name; repeated rows each give a row; very long texts
are taken whole; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, id_bytes, on_batches, slices

SCALE = 1 << 20
#: Vectors of n-grams that are taken out and added up at once: few enough to stay in a core's cache.
TAKEN = 64


class Profiles:
    """Vectors of texts. The same letters give the same vectors everywhere."""

    def __init__(self, dims: int = 1024, n: int = 3, seed: int = 7, most: int = 8_000):
        self.dims, self.n, self.seed, self.most = dims, n, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.grams = np.zeros((0, dims), dtype=np.float32)
        self.taken = np.empty((TAKEN, dims), dtype=np.float32)

    def letter(self, point: int) -> np.ndarray:
        v = self.letters.get(point)
        if v is None:
            v = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims).astype(np.int8) * 2 - 1
            if len(self.letters) > 4096:
                self.letters.clear()
            self.letters[point] = v
        return v

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dims, dtype=np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter(code & 0x1FFFFF), place)
            code >>= 21
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The places of these n-grams' vectors in self.grams."""
        if len(self.place) + len(codes) > 2 * self.most:
            self.place.clear()
        asked = codes.tolist()
        found = np.array([*map(self.place.get, asked, repeat(-1))], dtype=np.int64)
        if len(found) and found.min() >= 0:
            return found
        for c in asked:
            if c not in self.place:
                at = self.place[c] = len(self.place)
                if at >= len(self.grams):
                    self.grams = np.concatenate([self.grams, np.empty((max(1024, len(self.grams)), self.dims), dtype=np.float32)])
                self.grams[at] = self.gram(c)
        return np.fromiter(map(self.place.__getitem__, asked), dtype=np.int64, count=len(asked))

    def codes(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's n-grams of letters, runs of anything else counting as one gap, and their numbers."""
        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        points = np.where(letter_table()[points], points, 32).astype(np.int64)
        if not (points != 32).any():
            return none, none
        points = np.concatenate([[32], points, [32]])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        code = np.zeros(len(points) - self.n + 1, dtype=np.int64)
        for k in range(self.n):
            code |= points[k : len(points) - self.n + 1 + k] << (21 * k)
        return np.unique(code, return_counts=True)

    def vector(self, text: bytes | None) -> np.ndarray | None:
        """Of unit length; None if the text has no letter."""
        codes, n = self.codes(text)
        if not len(codes):
            return None
        v = np.zeros(self.dims, dtype=np.float32)
        for at in range(0, len(codes), self.most):
            rows, times = self.rows(codes[at : at + self.most]), n[at : at + self.most].astype(np.float32)
            for k in range(0, len(rows), TAKEN):
                some = rows[k : k + TAKEN]
                v += times[k : k + TAKEN] @ self.grams.take(some, axis=0, out=self.taken[: len(some)], mode="clip")
        size = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
        return v / size if size else v


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def learn(docs: DataFrame, label: Column, profiles: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, dim, value): for each label the sum of its texts' vectors, in whole numbers of 1/SCALE, so that no order of adding matters."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), label.cast("string").alias("label")).filter("label is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, sums = held("language", "profiles", lambda: Profiles(**profiles), str(profiles)), {}

        def out() -> pa.RecordBatch:
            keys = [k for k in sums for _ in range(hd.dims)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(range(hd.dims)) * len(sums), pa.int32()), pa.array(np.concatenate([*sums.values(), np.zeros(0, dtype=np.int64)]))], names=["label", "dim", "value"])

        for batch in batches:
            at = 0
            labels = batch.column(2).to_pylist()
            for _, texts in slices(iter([batch])):
                for text in texts:
                    v = hd.vector(text)
                    if v is not None:
                        sums.setdefault(labels[at], np.zeros(hd.dims, dtype=np.int64))
                        sums[labels[at]] += np.rint(v * SCALE).astype(np.int64)
                    at += 1
            if len(sums) > 64:
                yield out()
                sums.clear()
        yield out()

    return on_batches(rows, run, "label string, dim int, value long").groupBy("label", "dim").agg(F.sum("value").alias("value"))


def prototypes(sums: DataFrame, dims: int, max_languages: int) -> tuple[list[str], np.ndarray]:
    """Labels by name and their vectors of unit length, on the driver; languages x dims numbers, checked."""
    labels = [r[0] for r in sums.select("label").distinct().orderBy("label").limit(max_languages + 1).collect()]
    if len(labels) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; raise max_languages if that is meant")
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), dims))
    for r in sums.collect() if labels else []:
        out[at[r["label"]], r["dim"]] = r["value"]
    return labels, out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def language_id(docs: DataFrame, label: str = "lang", held_out: Column | None = None, dims: int = 1024, n: int = 3, max_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) for every document.

    Learns from the rows where held_out is not true and the label is not null;
    a prediction sees the text only.
    """
    from quarry.llm.common import cut

    profiles = {"dims": dims, "n": n}
    sums = cut(learn(docs.filter(~F.coalesce(held_out, F.lit(False))) if held_out is not None else docs, F.col(label), profiles, id_col, text_col))
    labels, vectors = prototypes(sums, dims, max_languages)
    payload = base64.b64encode(vectors.astype(np.float32).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd = held("language", "profiles", lambda: Profiles(**profiles), str(profiles))
        proto = np.frombuffer(base64.b64decode(payload), dtype=np.float32).reshape(-1, dims)
        for ids, texts in slices(batches):
            pred, score = [], []
            for text in texts:
                v = hd.vector(text) if labels else None
                cos = proto @ v if v is not None else np.zeros(1)
                best = int(cos.argmax())
                pred.append("und" if v is None else labels[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return on_batches(id_bytes(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")
