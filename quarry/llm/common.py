"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case of the 26 letters that the text contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Text that a worker handles at once, in bytes.
SLICE_BYTES = 4 << 20
#: Rows that are sent to every worker at most, to take rows away without a shuffle of the texts.
MOST_SENT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python workers small enough that two of them and the JVM share 3 GB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")
    return spark


_held: dict[tuple[str, str], tuple[Any, Any]] = {}


def held(kind: str, slot: str, make: Callable[[], Any], token: Any = None) -> Any:
    """What make() gives, kept in a worker process for its next tasks, as long as the token is the same.

    There is one object for each slot. Whatever another kind of operator has kept goes.
    """
    if any(k != kind for k, _ in _held):
        _held.clear()
    if _held.get((kind, slot), (None, None))[0] != (token,):
        _held[kind, slot] = ((token,), make())
    return _held[kind, slot][1]


def release() -> None:
    """Gives memory that a task has freed back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def on_batches(df: DataFrame, run: Run, schema: Any) -> DataFrame:
    """df.mapInArrow(run), with memory given back after each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, which spark.checkpoint.dir names.

    Only where all runs in one process may it be unset; the folder is then a temporary one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of docs has them."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in names]


def quoted(docs: DataFrame) -> list[Column]:
    """All columns by their very names, dots and all."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows whose keys are in gone (a small table, kept already)."""
    few = gone.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.join(F.broadcast(gone) if few else gone, keys, "left_anti")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, as doc_id long and text; all others are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As id_text, with the text as UTF-8 bytes for the workers."""
    return id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))


def parts(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of at most `most` bytes of text, but of one document at least; small batches come together."""
    held_back: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64))
        own = int(ends[-1]) if len(ends) else 0
        if held_back and size + own > most:
            yield joined(held_back)
            held_back, size = [], 0
        at = 0
        while own - (ends[at - 1] if at else 0) > most:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
            at = to
        if at < batch.num_rows:
            held_back.append(batch.slice(at))
            size += own - int(ends[at - 1] if at else 0)
    if held_back:
        yield joined(held_back)


def joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(k) for b in batches]) for k in (0, 1))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """As parts, with Python lists; batch by batch."""
    for batch in batches:
        for ids, texts in parts(iter([batch]), most):
            yield ids.to_pylist(), texts.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n neighbouring word hashes."""
    if len(h) < n:
        return h[:0]
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def key_of(*cols: Column) -> Column:
    """A grouping key under which only equal rows meet."""
    return F.xxhash64(*cols)
