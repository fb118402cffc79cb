"""Vector index: an inverted file. Vectors lie in cells around centroids; a query looks into the cells that are nearest to it.

Centroids are fitted on a bounded sample (`sample` rows, those with the least hashes of their
ids); every vector is assigned and stored. Cells that hold many vectors are read in
slices, and those that many queries ask for are asked in blocks, so no cell is hot. A
cell knows how far its farthest vector is: after the first look a query can tell which
other cells may still hold a nearer one, and exact=True looks into just these. Without
that, how many cells hold a wanted share of the nearest depends on the vectors: it is
measured when the index is built, by brute force for SAMPLED stored vectors (`reach`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.operators import vectors as exact_search
from quarry.operators.vectors import by_dimension, nearest, top_k, whole
from quarry.sources.sinks import cut

#: Vectors in a slice of a cell, and queries in a block, about.
SLICE, BLOCK = 20_000, 2_000
#: Stored vectors whose nearest are measured, so many each, and the share of them that may fall short of a recall.
SAMPLED, NEAREST, SHORT = 300, 10, 0.01
#: Added to bounds on distances, for what is lost in sums.
SLACK = 1e-6


def centroids(vectors: DataFrame, cells: int, sample: int = 50_000, seed: int = 7) -> np.ndarray:
    """Centres of the vectors (id, v), of one length, by k-means on a sample of bounded size."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=15).fit(some)
    return np.array(model.clusterCenters())


def build(vectors: DataFrame, folder: str, cells: int = 64, sample: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Stores all vectors, which have one length, by cell: cells(cell, id, v) and centres(cell, centre, radius, n). Vectors with a null aren't stored."""
    spark = vectors.sparkSession
    own = whole(vectors, id_col, vec_col)
    least, most = own.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most or not most:
        raise ValueError(f"vectors of lengths {least} to {most}")
    centres = centroids(own, cells, sample)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, v in by_dimension(batch):
                far = (centres * centres).sum(axis=1)[None, :] - 2 * v @ centres.T
                cell = far.argmin(axis=1)
                distance = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * n), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), ids, lists, pa.array(distance)], names=["cell", "id", "v", "distance"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(assigned, f"cell int, id {kind}, v array<double>, distance double")
    # A cell of any size is written by many tasks.
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cell").parquet(f"{folder}/cells")
    stored = spark.read.schema(f"id {kind}, v array<double>, distance double, cell int").parquet(f"{folder}/cells")
    sizes = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    spark.createDataFrame([(k, x.tolist(), float(sizes[k]["radius"]), sizes[k]["n"]) for k, x in enumerate(centres) if k in sizes], "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{folder}/centres")
    _reach(spark, folder).coalesce(1).write.parquet(f"{folder}/reach")


def _reach(spark: SparkSession, folder: str) -> DataFrame:
    """(ranks): for each of SAMPLED stored vectors, how many cells are nearer to it than the one in which each of its NEAREST others lies."""
    stored = spark.read.parquet(f"{folder}/cells")
    some = cut(stored.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLED).select(F.col("id").alias("query_id"), F.col("v").alias("query")))
    others = exact_search.knn(stored, some, NEAREST + 1, "id", "v").filter(~F.col("id").eqNullSafe(F.col("query_id"))).select("query_id", "id")
    # A few numbers of each of few vectors.
    places = F.broadcast(_probed(some, spark.read.parquet(f"{folder}/centres").collect(), 1).select("query_id", "cell", "nearer"))
    return stored.select("id", "cell").join(F.broadcast(others), "id").join(places, ["query_id", "cell"]).groupBy("query_id").agg(F.array_sort(F.collect_list("nearer")).alias("ranks")).select("ranks")


def probes_for(spark: SparkSession, folder: str, recall: float) -> int:
    """The fewest cells with which all but SHORT of the sampled vectors find this share of their nearest; all cells, if nothing was measured."""
    need = sorted(r["ranks"][max(0, int(np.ceil(recall * len(r["ranks"]) - 1e-9)) - 1)] + 1 for r in spark.read.schema("ranks array<int>").parquet(f"{folder}/reach").collect())
    return need[int(np.ceil((1 - SHORT) * len(need))) - 1] if need else spark.read.parquet(f"{folder}/centres").count()


def _probed(queries: DataFrame, centres: list, probes: int) -> DataFrame:
    """(query_id, cell, gap, first, nearer): all cells of each query with the least distance that a vector in them can have and how many are nearer; the `probes` nearest are looked into first."""
    cell, middle, radius = np.array([r["cell"] for r in centres], dtype=np.int32), np.array([r["centre"] for r in centres]), np.array([r["radius"] for r in centres])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, q in by_dimension(batch):
                if n != middle.shape[1]:
                    continue
                far = np.sqrt(((q[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)) if q.size * len(middle) < 1 << 24 else np.stack([np.sqrt(((x - middle) ** 2).sum(axis=1)) for x in q])
                order = np.argsort(far, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(cell))[None, :], axis=1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(q)), len(cell)))), pa.array(np.tile(cell, len(q))), pa.array(np.maximum(0, far - radius - SLACK).reshape(-1)), pa.array((rank < probes).reshape(-1)), pa.array(rank.reshape(-1).astype(np.int32))], names=["query_id", "cell", "gap", "first", "nearer"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", F.col("query").alias("v")).mapInArrow(run, f"query_id {kind}, cell int, gap double, first boolean, nearer int")


def _looked(stored: DataFrame, asked: DataFrame, queries: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, id, distance): candidates from the cells asked(query_id, cell). Slices of a cell meet blocks of its queries."""
    n = F.element_at(F.create_map(*(F.lit(x) for c, s in sizes.items() for x in (c, -(-s // SLICE)))), F.col("cell"))
    vectors = stored.withColumn("slice", F.pmod(F.xxhash64("id"), n).cast("int"))
    n_blocks = F.ceil(F.col("k") / BLOCK)
    blocks = F.pmod(F.xxhash64("query_id"), n_blocks).cast("int")
    wanted = asked.groupBy("cell").agg(F.count("*").alias("k"))
    # Few numbers a cell: as many cells as there are centres.
    wanted = F.broadcast(cut(wanted))
    parts = asked.join(wanted, "cell").select("query_id", "cell", blocks.alias("block"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("slice"))
    parts = parts.join(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "query_id")
    read = vectors.join(wanted, "cell").select("cell", "slice", "id", "v", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block"))
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, distance double"

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("id")
        q, v = (np.stack(t.column(c).to_numpy()) for t, c in ((left, "query"), (right, "v")))
        i, x, far = nearest(q.astype(np.float64), v.astype(np.float64), k)
        return pa.table({"query_id": left.column("query_id").take(pa.array(i)), "id": right.column("id").take(pa.array(x)), "distance": pa.array(far)})

    by = ["cell", "slice", "block"]
    return parts.groupBy(*by).cogroup(read.groupBy(*by)).applyInArrow(met, types)


def knn(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, recall: float | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank): k near vectors of each of queries(query_id, query), from the `probes` nearest cells.

    recall: from as many cells as hold this share of the nearest, as measured when the index was built (probes_for). exact: then from all cells too that may hold one as near as the k found so far, so the result is that of vectors.knn. A
    query of another length, or with a null, finds nothing.
    """
    queries = queries.filter(F.col("query").isNotNull() & ~F.exists("query", lambda x: x.isNull()))
    centres = spark.read.parquet(f"{folder}/centres").collect()
    stored = spark.read.parquet(f"{folder}/cells")
    sizes = {r["cell"]: r["n"] for r in centres}
    asked = cut(_probed(queries, centres, probes if recall is None else probes_for(spark, folder, recall)))
    order = [F.col("distance"), F.col("id")]
    found = top_k(_looked(stored, asked.filter("first"), queries, sizes, k), k, ["query_id"], order)
    if exact:
        found = cut(found)
        edge = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("edge"))
        # Without k so far, any cell may hold one.
        rest = asked.filter("not first").join(edge, "query_id", "left").filter(F.col("edge").isNull() | (F.col("gap") * F.col("gap") <= F.col("edge") + SLACK))
        more = _looked(stored, rest.select("query_id", "cell"), queries, sizes, k)
        found = top_k(found.drop("rank").unionByName(more), k, ["query_id"], order)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round(V.score(F.col("distance")), 6).alias("score"), "rank")


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """(n_queries, n_right, n_found, recall): what of the right neighbours was found."""
    both = right.select("query_id", "id").join(found.select("query_id", "id").withColumn("_f", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_right"), F.count("_f").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_right"))
