"""The trigram index, cells of vectors, merged tables and digests against the plain ways."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import search, text_index

TEXTS = {"a.py": "def token():\n  return tokenise(x)\n", "b.py": "The THEN\nthan, then\n\n", "c.md": "Ünïcode token\r\nlicense granted", "d": "", "e": None, "f": "ab\ncx", "g": "x" * 5000 + "needle", "h": "caat cat ct\na+b*c"}
PATTERNS = ["token", "th[ae]n", "^The", "a[^x]*+$", "(?i)THE", "to(ken|tal)", "ca{1,2}t", "ca*t", "need(le)?", r"a\+b", "x{20}", "", "^$", "licen[cs]e.*granted", r"\btoken\b", "(?:ab|cd)?x", "[a-z]{3}", "to(?=ken)", "Ünï", "(?<n>de)f t", "to++ken", "tok|zzzz"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_index_is_search(spark, tmp_path):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    folder = str(tmp_path / "index")
    text_index.append(files.withColumn("content", search.F.when(search.F.col("path") == "h", "token old").otherwise(search.F.col("content"))).filter("path <> 'g'"), folder)
    text_index.append(files.filter("path in ('h', 'g')"), folder)
    for p in PATTERNS:
        want = rows(search.search(files, p))
        assert rows(text_index.search_index(spark, folder, p)) == want, p
        lines = [(f, i + 1) for f, t in TEXTS.items() if t is not None for i, x in enumerate(t.split("\n")) if re.search(p.replace("(?<n>", "(?P<n>"), x)]
        assert sorted((w[1], w[2]) for w in want) == sorted(lines), p
    assert rows(text_index.search_index(spark, folder, ["token", "needle"])) == rows(search.search(files, ["token", "needle"]))
    assert rows(text_index.search_index(spark, folder, "a+b*", literal=True)) == rows(search.search(files, "a+b*", literal=True))
    text_index.forget(files.filter("path = 'a.py'"), folder)
    assert rows(text_index.search_index(spark, folder, "token")) == rows(search.search(files.filter("path <> 'a.py'"), "token"))
    text_index.append(files.filter("path = 'a.py'"), folder)
    assert rows(text_index.search_index(spark, folder, "token")) == rows(search.search(files, "token"))


def test_only_parts_with_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PART_BYTES", 200)
    files = spark.createDataFrame([(str(i), f"line {i} of words\n" * 9 + ("needle" if i == 7 else "")) for i in range(60)], "path string, content string")
    folder = str(tmp_path / "index")
    text_index.append(files, folder)
    found = text_index.files_of(spark, folder, text_index.asked_for("ne+dle"))
    assert [r.path for r in found.collect()] == ["7"]
    assert len({f.rsplit("/", 2)[1] for f in text_index.files_of(spark, folder).inputFiles()}) > 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d+", plan) or re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN", plan)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc"), max_size=12), st.from_regex(r"[abc](\?|\*|\+|\{2\}|\{1,3\})?([abc]|\(ab\|c\)|\[ab\]|\.|\(a\)\*)*", fullmatch=True))
def test_what_matches_has_what_is_asked_for(text, pattern):
    if re.search(pattern, text):
        sets = text_index.asked_for(pattern)
        assert not sets or any(s <= text_index.trigrams(text) for s in sets)


@pytest.mark.parametrize("pattern", [r"\Qa.b\E", r"[a&&b]", "(?x)a b c", r"\x41bc", "abc(", "a{x}", "[abc"])
def test_patterns_that_are_not_read_ask_for_nothing(pattern):
    assert text_index.asked_for(pattern) == []


# --- vectors ---


@pytest.fixture(scope="module")
def points(spark):
    import random

    r = random.Random(3)
    own = [(i, [r.gauss(i % 5, 1.0) for _ in range(8)]) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    return spark.createDataFrame(own, "vec_id long, embedding array<double>")


def asked(points):
    return points.filter("vec_id % 50 = 0").select(search.F.col("vec_id").alias("query_id"), search.F.col("embedding").alias("query"))


def test_cells_are_exact_and_recall_what_is_near(spark, points, tmp_path, monkeypatch):
    from quarry.operators import vector_index, vectors

    monkeypatch.setattr(vector_index, "SLICE", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    folder = str(tmp_path / "cells")
    vector_index.build(points.unionByName(spark.createDataFrame([(2000, [1.0, None, *[0.0] * 6]), (2001, None)], "vec_id long, embedding array<double>")), folder, 12)
    want = vectors.knn(points, asked(points))
    assert rows(vector_index.knn(spark, folder, asked(points), exact=True, probes=1)) == rows(want)
    r = vector_index.recall(vector_index.knn(spark, folder, asked(points), probes=6), want).first()
    assert r.recall >= 0.9 and r.n_queries == asked(points).count()
    with pytest.raises(Exception, match="lengths 2 to 8"):
        vector_index.build(points.unionByName(spark.createDataFrame([(3000, [1.0, 2.0])], "vec_id long, embedding array<double>")), str(tmp_path / "no"), 2)


def test_an_index_knows_how_many_cells_hold_what_is_near(spark, tmp_path):
    """Vectors without clusters: half of the cells is not enough, and the index says so."""
    import numpy as np
    from pyspark.sql import functions as F

    from quarry.operators import vector_index, vectors

    v = np.random.default_rng(3).normal(size=(600, 32))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    vector_index.build(points, str(tmp_path / "i"), 16)
    want = vectors.knn(points, q)
    r = vector_index.recall(vector_index.knn(spark, str(tmp_path / "i"), q, recall=0.9), want).first()
    assert (r["n_queries"], r["n_right"]) == (30, 300) and r["recall"] >= 0.9
    assert 8 < vector_index.probes_for(spark, str(tmp_path / "i"), 0.9) <= 16 and vector_index.probes_for(spark, str(tmp_path / "i"), 0.2) < 8


def test_neighbours_in_tiles_are_few_and_those_of_the_plain_way(monkeypatch):
    """However many queries, vectors and ties there are: no large matrix, and k rows a query."""
    import tracemalloc

    import numpy as np

    from quarry.operators import vectors

    r = np.random.default_rng(5)
    v = r.integers(0, 3, (3000, 6)).astype(float)
    q = v[:700]
    plain = ((q[:, None] - v) ** 2).sum(axis=2)
    want = np.argsort(plain, axis=1, kind="stable")[:, :10]
    monkeypatch.setattr(vectors, "TILE", 30_000, raising=False)
    tracemalloc.start()
    i, x, far = vectors.nearest(q, v, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (i == np.repeat(np.arange(700), 10)).all() and (x == want.reshape(-1)).all() and (far == np.take_along_axis(plain, want, 1).reshape(-1)).all()
    assert peak < 8_000_000
    assert [len(c) for c in vectors.nearest(q, v[:0], 10)] == [0, 0, 0]


def test_neighbours_of_other_lengths_and_nulls(spark):
    from quarry.operators import vectors

    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, None]), (5, None), (6, [])], "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [0.0, 0.1]), (2, [0.0, 0.0, 0.0]), (3, [None, 1.0]), (4, None), (5, [1.0])], "query_id long, query array<double>")
    assert [(r.query_id, r.id, r["rank"]) for r in vectors.knn(v, q, 2).orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (2, 3, 1)]


# --- tables that merge ---


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    from quarry.sources import merge

    path = str(tmp_path / "table")
    old = spark.range(400).select(search.F.col("id").alias("k"), search.F.lit(0).cast("long").alias("v"), search.F.lit("x").alias("b.c"))
    first = merge.create(old, path, ["k"], 16)
    new = spark.createDataFrame([(3, 1, "y"), (3, 2, "z"), (None, 7, "n"), (900, 9, None)], "k long, v long, `b.c` string")
    second = merge.merge(path, new, spark.createDataFrame([(5,), (3,), (77777,)], "k long"), order="v")
    want = {(k, 0, "x") for k in range(400) if k not in (3, 5)} | {(3, 2, "z"), (None, 7, "n"), (900, 9, None)}
    assert set(map(tuple, second.read().collect())) == want and second.count() == 401
    assert set(map(tuple, merge.Snapshot(spark, path, 1).read().collect())) == {(k, 0, "x") for k in range(400)}
    touched = {b for b in second.places if second.places[b][0] != first.places.get(b, ("",))[0]}
    assert 1 <= len(touched) <= 5 and all(second.places[b] == first.places[b] for b in set(first.places) - touched)
    assert len(second.read([min(touched)]).inputFiles()) == 1
    # Not updated, not inserted, and late.
    merge.merge(path, spark.createDataFrame([(3, 50, "q"), (901, 1, "q")], "k long, v long, `b.c` string"), update=False)
    merge.merge(path, spark.createDataFrame([(4, 51, "q"), (902, 1, "q")], "k long, v long, `b.c` string"), insert=False)
    last = merge.merge(path, spark.createDataFrame([(3, 1, "late"), (4, 60, "now")], "k long, v long, `b.c` string"), stored_later="v")
    assert set(map(tuple, last.read().collect())) == (want - {(4, 0, "x")}) | {(901, 1, "q"), (4, 60, "now")}
    assert merge.merge(path, new.limit(0)).number == last.number == 5
    assert merge.vacuum(spark, path) >= 1 and merge.snapshots(spark, path) == [4, 5]
    assert merge.Snapshot(spark, path).count() == 402 == merge.Snapshot(spark, path).read().count()
    with pytest.raises(ValueError):
        merge.Snapshot(spark, path, 1)


def test_two_writers_of_one_snapshot(spark, tmp_path, monkeypatch):
    from quarry.sources import merge

    path = str(tmp_path / "table")
    merge.create(spark.range(10).select(search.F.col("id").alias("k")), path, ["k"], 2)
    kept = merge._write

    def slow(*a):
        monkeypatch.setattr(merge, "_write", kept)
        merge.merge(path, spark.range(20, 22).select(search.F.col("id").alias("k")))
        return kept(*a)

    monkeypatch.setattr(merge, "_write", slow)
    with pytest.raises(Exception, match="exist"):
        merge.merge(path, spark.range(30, 33).select(search.F.col("id").alias("k")))
    assert {r.k for r in merge.Snapshot(spark, path).read().collect()} == {*range(10), 20, 21}


# --- digests ---


def test_changes_by_digest_are_changes(spark):
    from quarry.operators import sync

    files = spark.range(5000).select(search.F.col("id").alias("path"), search.F.md5(search.F.col("id").cast("string")).alias("hash"))
    state = files.filter("path not in (7, 4000)").withColumn("hash", search.F.when(search.F.col("path") == 9, "old").otherwise(search.F.col("hash"))).unionByName(spark.createDataFrame([(9999, "gone")], "path long, hash string"))
    assert rows(sync.changes_by_digest(files, state)) == rows(sync.changes(files, state))
    assert sync.unlike_buckets(sync.digests(files), sync.digests(state)).count() == 4
    assert sync.unlike_buckets(sync.digests(files), sync.digests(files)).count() == 0
    nothing = files.limit(0)
    assert rows(sync.changes_by_digest(files, nothing)) == rows(sync.changes(files, nothing)) and sync.changes_by_digest(nothing, nothing).count() == 0
    # Rows that are shuffled follow the buckets that differ.
    plan = sync.changes_by_digest(files, state)
    plan.collect()
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_postings_are_handed_on_text_by_text(monkeypatch):
    """However many texts a batch has, a worker gathers few postings, and long texts are looked at in stretches."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(text_index, "POSTED", 200, raising=False)
    monkeypatch.setattr(text_index, "STRETCH", 16, raising=False)
    words = ["token", "Ünïcode licence", "a\nbcd", "", None, "then than granted reserved " * 4]
    texts = [(k // 150, k, words[k % 6] if k % 6 != 1 else f"{words[1]} {k}") for k in range(300)]
    part, number, content = zip(*texts, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(number, pa.int32()), pa.array([c and c.encode() for c in content], pa.binary())], names=["part", "number", "content"])
    out = list(text_index._postings(iter([batch])))
    assert len(out) > 10 and max(len(b.column(3).flatten()) for b in out) <= 400
    found = [(p, g, n) for b in out for g, p, ns in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True) for n in ns]
    assert sorted(found) == sorted((p, g, n) for p, n, c in texts for g in text_index.trigrams(c or ""))
    assert all(b.column(0).to_pylist() == (np.array(b.column(1)) % text_index.BUCKETS).tolist() for b in out)
