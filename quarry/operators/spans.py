"""Lines and spans of files: which span is around a line, by a sweep over both in order."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a file that one task sweeps at most; a span is there in each such stretch that it reaches into.
STRETCH = 100_000


def enclosing(lines: DataFrame, spans: DataFrame, file: str = "path", line: str = "line", innermost: bool = False) -> DataFrame:
    """lines with the span (start_line, end_line) of the same file around each, the outermost unless innermost; lines outside all are left out.

    Lines and the starts of spans come in order, and the spans that are open are kept in a heap, so a file takes time by
    its lines and spans, not by their product, and a task holds the open spans only. Of spans of one size the first by
    start counts. Rows with a null file or line are outside; spans may overlap.
    """
    rest = [c for c in spans.columns if c != file]
    at, reach = (lambda c: (F.col(c) / STRETCH).cast("long")), F.explode(F.sequence((F.col("start_line") / STRETCH).cast("long"), (F.col("end_line") / STRETCH).cast("long")))
    own = lines.filter(F.col(file).isNotNull() & F.col(line).isNotNull()).select(F.col(file).alias("file"), at(line).alias("stretch"), F.col(line).cast("long").alias("pos"), F.lit(None).cast("long").alias("end"), F.struct(*lines.columns).alias("l"), F.lit(None).cast(spans.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("s"))
    around = spans.filter((F.col(file).isNotNull()) & (F.col("start_line") <= F.col("end_line"))).select(F.col(file).alias("file"), reach.alias("stretch"), F.col("start_line").cast("long").alias("pos"), F.col("end_line").cast("long").alias("end"), F.lit(None).cast(own.schema["l"].dataType).alias("l"), F.struct(*rest).alias("s"))
    both = own.unionByName(around.withColumn("pos", F.greatest("pos", F.col("stretch") * STRETCH)))
    # Spans come before the lines of their place.
    order = ["file", "stretch", "pos", F.col("end").isNull()]
    swept = both.repartition("file", "stretch").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, n = None, [], 0
        for batch in batches:
            file_, stretch, pos, end = (batch.column(k).to_pylist() for k in range(4))
            kept, found = [], []
            for i, key in enumerate(zip(file_, stretch, strict=True)):
                if key != now:
                    now, open_ = key, []
                if end[i] is not None:
                    s = batch.column(5)[i].as_py()
                    start = s["start_line"]
                    size = end[i] - start
                    heappush(open_, (size if innermost else -size, start, n, end[i], s))
                    n += 1
                    continue
                while open_ and open_[0][3] < pos[i]:
                    heappop(open_)
                if open_:
                    kept.append(i)
                    found.append(open_[0][4])
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(kept, pa.int32())), pa.array(found, batch.column(5).type)], names=["l", "s"])

    out = swept.mapInArrow(run, both.select("l", "s").schema)
    return out.select("l.*", *(F.col("s").getField(c).alias(c) for c in ["start_line", "end_line", *(c for c in rest if c not in ("start_line", "end_line"))]))
