"""Counting 64-bit keys over the corpus in blocks, and small tables made of the counts.

A row for each key would cost more than the key. So each task sorts and counts its
own keys, splits them by their top bits into parts, and sends a row for each part
with the keys as byte planes: sorted keys have almost equal high bytes, which the
shuffle's compression takes away. A part is counted by one task; the number of parts
follows the input, so a part stays as large as it is (about PART_KEYS keys).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_folder

#: Bits of a key that are counted.
BITS = 40
#: Keys in a part, about, and the bounds of the number of parts (as bits).
PART_KEYS, LEAST_PARTS, MOST_PARTS = 1_500_000, 6, 20
#: Keys that a task sorts at once.
SORTED = 1_000_000


def part_bits(text_bytes: int, most: int = MOST_PARTS) -> int:
    """So many of a key's top bits name its part, for a corpus of so many bytes (about six to a key)."""
    return min(most, max(LEAST_PARTS, int(np.ceil(np.log2(max(1.0, text_bytes / 6 / PART_KEYS))))))


def ranked(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys of `width` bits, and which of them each key is."""
    low = len(keys).bit_length()
    if width + low <= 64:  # a key and its place in one number are sorted faster
        both = np.sort(keys << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
        order, keys = (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(first) - 1
    return keys[first], back


def planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8")


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, by byte planes and an entropy code."""
    return len(numbers).to_bytes(8, "little") + pa.compress(planes(numbers, 4), "zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return unplaned(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), 4)


def counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, cut to BITS bits, and their counts."""
    return np.unique(np.concatenate(keys) >> np.uint64(64 - BITS), return_counts=True)


def by_part(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys; a part is what is left of a key without its last `shift` bits."""
    part = keys >> np.uint64(shift)
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else np.zeros(0, dtype=int)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(part[a]), a, b


def blocks(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, keys, counts) of sorted keys."""
    for part, a, b in by_part(keys, BITS - bits):
        yield part, planes(keys[a:b], 5), planes(counts[a:b], 4)


def merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys of one part, and their counts over all its blocks."""
    k = np.concatenate([unplaned(x, 5) for x in keys])
    c = np.concatenate([unplaned(x, 4) for x in counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def levels(counts: np.ndarray) -> np.ndarray:
    """floor(log2) of counts, as a histogram of 40 bins."""
    return np.bincount(np.minimum(np.frexp(counts.astype(np.float64))[1] - 1, 39), minlength=40)[:40]


def least_count(histogram: list[int], most: int) -> int:
    """The least power of two that at most `most` counts reach."""
    total, b = 0, 39
    while b >= 0 and total + histogram[b] <= most:
        total += histogram[b]
        b -= 1
    return 1 << (b + 1)


def histogram_of(parts: DataFrame, column: str = "histogram") -> list[int]:
    """The sum of histograms over all parts."""
    found = {r["pos"]: r["n"] for r in parts.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("n")).collect()}
    return [found.get(b, 0) for b in range(40)]


class Scratch:
    """Rows kept as a table in the shared folder until they have been used."""

    def __init__(self, df: DataFrame):
        self.spark: SparkSession = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/quarry-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of text in rows (doc_id, text)."""
    return rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])
