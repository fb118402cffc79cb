"""Vector search: exact nearest neighbours, a short cut by a curated collection, ranking and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector as V

#: From this score of the curated collection's best hit on, nothing else is searched.
SHORT_CUT = 0.7
#: Queries that are sent to every worker at most.
MOST_QUERIES = 10_000
#: Distances that a worker holds at once, about.
TILE = 1 << 20


def top_k(pairs: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task and group before it shuffles (a rank below a limit is pushed down)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(asked: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch of vectors (id, v), the k nearest of each query: a matrix product leaves few, whose distances are then summed exactly."""
    asked_by = {n: (ids, q) for batch in asked.combine_chunks().to_batches() for n, ids, q in by_dimension(batch)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, v in by_dimension(batch):
                if n in asked_by:
                    names, q = asked_by[n]
                    i, x, exact = nearest(q, v, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(x)), pa.array(exact)], names=["query_id", "id", "distance"])

    return run


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length in a batch (id, v), by id."""
    batch = batch.filter(batch.column(1).is_valid())
    batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
    sizes = np.asarray(pc.list_value_length(batch.column(1)))
    for n in np.unique(sizes).tolist():
        own = batch.filter(pa.array(sizes == n))
        yield n, own.column(0), own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, n)


def nearest(queries: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance): of the vectors the k nearest of each query, ties in their order; a matrix product leaves few, whose distances are summed exactly.

    Queries are taken so many at once that no matrix has more than TILE numbers.
    """
    squares = (v * v).sum(axis=1)
    most = min(k, len(v))
    found = [_nearest_of(queries[at : at + step], v, squares, most, at) for step in [max(1, TILE // max(1, len(v)))] for at in range(0, len(queries) if most else 0, step)]
    none = np.zeros(0, dtype=np.int64)
    q, x, exact = (np.concatenate(c) for c in zip((none, none, np.zeros(0)), *found, strict=True))
    return q, x, exact


def _nearest_of(queries: np.ndarray, v: np.ndarray, squares: np.ndarray, most: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As nearest(), of a few queries, numbered from `first` on."""
    lengths = (queries * queries).sum(axis=1)
    far = lengths[:, None] + squares[None, :] - 2 * queries @ v.T
    edge = np.partition(far, most - 1, axis=1)[:, most - 1]
    q, x = np.nonzero(far <= (edge + 1e-9 * (1 + lengths + squares.max()))[:, None])
    exact = np.zeros(len(q))
    step = max(1, TILE // max(1, v.shape[1]))
    for at in range(0, len(q) if v.shape[1] else 0, step):
        # Summed from the first place to the last, as SQL does.
        exact[at : at + step] = np.add.accumulate((v[x[at : at + step]] - queries[q[at : at + step]]) ** 2, axis=1)[:, -1]
    order = np.lexsort((x, exact, q))
    q, x, exact = q[order], x[order], exact[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[near] + first, x[near], exact[near]


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors without a null; others are no vectors, and are found by nothing."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, score, rank): for each of queries(query_id, query) its k nearest vectors by squared L2; ties go by id.

    Queries are a stated set; they go to the workers in blocks of MOST_QUERIES, vectors stay where they are. A query meets the
    vectors of its length; a vector or a query with a null in it meets nothing.
    """
    queries = queries.filter(~F.exists("query", lambda x: x.isNull()))
    blocks = -(-queries.count() // MOST_QUERIES) or 1
    own = whole(vectors, id_col, vec_col)
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, distance double"
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        near = own.mapInArrow(_nearest(part.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query is not null").toArrow(), k), types)
        best = top_k(near, k, ["query_id"], [F.col("distance"), F.col("id")])
        out = best if out is None else out.unionByName(best)
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round(V.score(F.col("distance")), 6).alias("score"), "rank")


def by_ids(chunks: DataFrame, ids: list[str], id_col: str = "id") -> DataFrame:
    """Chunks by their ids, in the order asked for; those that aren't there have no row."""
    asked = {x: k for k, x in reversed(list(enumerate(ids)))}
    if not asked:
        return chunks.limit(0)
    place = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair))
    return chunks.filter(F.col(id_col).isin(*asked)).orderBy(place[F.col(id_col)])


def search_collections(vectors: DataFrame, queries: DataFrame, is_map: Column, k: int = 10, map_k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Hits of the curated collection (map) where its best reaches SHORT_CUT, else those of the rest (forest).

    confidence: high for map hits, medium for forest hits; a query without hits has one row with low and a null id.
    """
    curated = knn(vectors.filter(is_map), queries, map_k, id_col, vec_col)
    rest = knn(vectors.filter(~is_map), queries, k, id_col, vec_col)
    best = curated.groupBy("query_id").agg(F.max("score").alias("top"))
    asked = queries.select("query_id").join(best, "query_id", "left").select("query_id", (F.coalesce("top", F.lit(0.0)) >= SHORT_CUT).alias("short"))
    hits = curated.withColumn("source", F.lit("map")).unionByName(rest.withColumn("source", F.lit("forest")))
    wanted = F.when(F.col("short"), "map").otherwise("forest")
    return asked.withColumn("source", wanted).join(hits, ["query_id", "source"], "left").select("query_id", "source", "id", "distance", "score", "rank", F.when(F.col("id").isNull(), "low").when(F.col("short"), "high").otherwise("medium").alias("confidence"))


def rank_symbols(symbols: DataFrame, query: Column, k: int = 5, order: str = "pos", vec_col: str = "embedding") -> DataFrame:
    """symbols with similarity (3 places) and rank, the first k; ties stay in the given order."""
    scored = symbols.withColumn("similarity", F.round(V.cosine(F.col(vec_col), query), 3))
    best = scored.orderBy(F.col("similarity").desc(), F.col(order)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), F.col(order))))


def embed_symbols(symbols: DataFrame, name: str = "name", dims: int = 64) -> DataFrame:
    return symbols.withColumn("embedding", V.hashed_embedding(X.split_camel_case(F.replace(F.col(name), F.lit("_"), F.lit(" "))), dims))


def judged(pairs: DataFrame, similarity: str = "similarity") -> DataFrame:
    """pairs with status and risk."""
    return pairs.withColumn("_v", V.verdict(F.col(similarity))).select(*pairs.columns, "_v.status", "_v.risk")


def judged_together(pairs: DataFrame, by: str, symbol: str = "symbol", similarity: str = "similarity") -> DataFrame:
    """(by, approved, rejected, risk): HIGH if any approved one is grey."""
    v = judged(pairs, similarity)
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col(symbol))))
    return v.groupBy(by).agg(names("FACT").alias("approved"), names("REJECTED").alias("rejected"), F.when(F.bool_or(F.col("risk") == "HIGH"), "HIGH").otherwise("LOW").alias("risk"))


def confirm(relevant: DataFrame, mapped: DataFrame, scores: DataFrame, default: float = 0.7) -> DataFrame:
    """(symbol, confidence, found): confirmed symbols with their score, 0.7 without one; those that aren't mapped are not found."""
    known = mapped.select("symbol").distinct().withColumn("found", F.lit(True))
    return relevant.select("symbol").distinct().join(scores.select("symbol", "score"), "symbol", "left").join(known, "symbol", "left").select("symbol", F.coalesce("score", F.lit(default)).alias("confidence"), F.coalesce("found", F.lit(False)).alias("found"))


def validated(requests: DataFrame, symbols: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(request_id, term, symbol, cached, similarity, rank): what is known or likely of symbols asked for.

    requests(request_id, term, query) with a vector, symbols(request_id, symbol, embedding), pairs(nl_term, symbol). A symbol
    is there if a learned pair has it (cached) or if it is among the k most similar (rank); of equal ones the first by name.
    """
    asked = symbols.join(requests, "request_id").withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("query")), 3))
    w = Window.partitionBy("request_id").orderBy(F.col("similarity").desc_nulls_last(), "symbol")
    known = pairs.select(F.col("nl_term").alias("term"), "symbol").distinct().withColumn("cached", F.lit(True))
    found = asked.withColumn("rank", F.row_number().over(w)).join(known, ["term", "symbol"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return found.filter((F.col("rank") <= k) | F.col("cached")).select("request_id", "term", "symbol", "cached", "similarity", F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))


# How much each kind of hit counts.
WEIGHTS = {"vector": 0.4, "keyword": 0.2, "definition": 0.3, "reference": 0.1}


def hybrid(hits: DataFrame, found: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """An extension: hits with the weighted sum of their score and of whether (0 to 1) they are found otherwise."""
    w = WEIGHTS | (weights or {})
    total = w["vector"] * F.col("score")
    for kind, value in found.items():
        total = total + w[kind] * value.cast("double")
    return hits.withColumn("hybrid", F.round(total, 6))
