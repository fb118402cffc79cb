"""Logs, pairs, incremental state, gates and streams."""

import datetime as dt
import glob
import hashlib
import os

from pyspark.sql import functions as F

from quarry.operators import gates, logs, pairs, sync, vectors
from quarry.sources import sinks
from quarry.sources import merge
from quarry.streaming import index


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    was = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, hash string")
    changed = sync.changes(now, was)
    assert {r.path: r.change for r in changed.collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"}
    s = sync.summary(changed).first()
    assert (s.added, s.modified, s.deleted, s.unchanged, s.total_processed, s.has_changes) == (1, 1, 1, 1, 3, True)


def test_state_and_swap(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    path = str(tmp_path / "t")
    sinks.swap(sinks.upsert(old, new, ["k"], "v"), path)
    assert {r.k: r.v for r in sinks.read(spark, path).collect()} == {"a": 1, "b": 4, "c": 5}
    sinks.swap(sinks.without(sinks.read(spark, path), new, ["k"]), path)
    assert [r.k for r in sinks.read(spark, path).collect()] == ["a"]
    # A version that was never finished doesn't count, nor does it stand in the way.
    (tmp_path / "t" / "v00000003").mkdir()
    assert [r.k for r in sinks.read(spark, path).collect()] == ["a"]
    sinks.swap(old, path)
    assert sinks.read(spark, path).count() == 2
    sinks.clear(spark, path)
    assert not sinks.exists(spark, path)


def test_document_changes(spark):
    docs = spark.createDataFrame([("docs/new.md", "h1"), ("docs/arch.md", "h2"), ("docs/empty.md", "h3"), ("docs/same.md", "h4")], "path string, hash string")
    stored = spark.createDataFrame([("docs/arch.md", "old_hash_12345678"), ("docs/empty.md", ""), ("docs/same.md", "h4")], "path string, content_hash string")
    assert {r.path: r.change for r in sync.document_changes(docs, stored).collect()} == {"docs/new.md": "new", "docs/arch.md": "modified"}
    t = dt.datetime(2024, 1, 2)
    r = spark.range(1).select(sync.due(F.lit(None).cast("timestamp"), F.lit(t), 1).alias("a"), sync.due(F.lit(t), F.lit(t + dt.timedelta(minutes=30)), 1).alias("b"), sync.rules_change(F.lit("x"), F.lit("")).alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, "new")


def test_outcomes(spark):
    o = spark.createDataFrame([("s1", "failure", "p", 1), ("s1", "success", None, 2), ("s2", "partial", None, 3), ("s3", "odd", None, 4)], "session_id string, outcome string, failure_point string, seq long").withColumn("ts", F.col("seq"))
    d = spark.createDataFrame([("s1", "HIGH", ["a"], 1), ("s1", "LOW", ["b", "c"], 2), ("s9", "LOW", ["z"], 3)], "session_id string, risk_level string, tools_planned array<string>, seq long")
    s = logs.outcome_stats(o).first()
    assert (s.total, s.success, s.failure, s.partial) == (4, 1, 1, 1)
    j = logs.matched(o, d, ["seq"])
    assert {r.tool: r.failures for r in logs.tool_failures(j).collect()} == {"b": 1, "c": 1}
    assert logs.matched_count(j).first().matched == 2
    assert logs.first_decision(d, ["seq"]).filter("session_id = 's1'").first().risk_level == "HIGH"
    a = {r.session_id: (r.has_decision, r.n_outcomes, r.final_outcome) for r in logs.session_analysis(d, o, ["seq"]).collect()}
    assert a["s1"] == (True, 2, "success") and a["s9"] == (True, 0, None) and a["s2"] == (False, 1, "partial")
    assert [r.seq for r in logs.last_n(o, 2, ["seq"]).orderBy("seq").collect()] == [3, 4]


def test_failure_runs(spark):
    e = spark.createDataFrame([("s", i, k) for i, k in enumerate("ffrfff")], "session_id string, seq int, kind string")
    r = logs.failure_runs(e, F.col("kind") == "f", F.col("kind") == "r", ["seq"]).orderBy("seq").collect()
    assert [x.failure_count for x in r] == [1, 2, 0, 1, 2, 3]
    assert [x.intervene for x in r] == [False] * 5 + [True] and r[1].near and r[-1].interventions == 1


def test_pairs(spark):
    old = spark.createDataFrame([("t", "A", 0.5, 1), ("t", "B", 0.6, 1)], "nl_term string, symbol string, similarity double, learned_at int")
    new = spark.createDataFrame([("t", "A", 0.9, 2)], "nl_term string, symbol string, similarity double, learned_at int")
    got = pairs.add(old, new)
    assert {r.symbol: r.similarity for r in got.collect()} == {"A": 0.9, "B": 0.6}
    assert [r.symbol for r in pairs.find(got, "t", ["B", "C"]).collect()] == ["B"]
    s = pairs.stats(got).first()
    assert (s.total, s.terms, s.symbols) == (2, 1, 2)


def test_gates(spark):
    of = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")) if n else F.array().cast("array<string>")
    m = lambda a, b, c, d, intent, risk, tools=gates.REQUIRED_TOOLS: spark.range(1).select(gates.missing_requirements(dict(zip(gates.COUNTED, map(of, (a, b, c, d)), strict=True)), F.array(*(F.lit(t) for t in tools)), F.array().cast("array<string>"), F.lit(intent), F.lit(risk)).alias("m")).first().m
    assert m(3, 1, 2, 1, "MODIFY", "LOW") == []
    assert m(3, 1, 2, 1, "MODIFY", "HIGH") == ["symbols_identified: 3/5", "entry_points: 1/2", "files_analyzed: 2/4", "existing_patterns: 1/2", "slot_evidence: target_feature not evidenced", "slot_evidence: observed_issue not evidenced"]
    assert m(1, 0, 1, 0, "QUESTION", "HIGH", ("find_definitions",)) == ["required_tools: missing find_references"]
    ok = lambda p, t: spark.range(1).select(gates.tool_allowed(F.lit(p).cast("string"), F.lit(t)).alias("x")).first().x
    assert ok(None, "anything") and ok("READY", "anything") and ok("SEMANTIC", "semantic_search")
    assert not ok("EXPLORATION", "semantic_search") and not ok("QUALITY_REVIEW", "query")
    reason = lambda miss, r: spark.range(1).select(gates.semantic_reason_allowed(F.array(*(F.lit(x) for x in miss)).cast("array<string>"), F.lit(r)).alias("x")).first().x
    assert reason(["symbols_identified: 0/3"], "no_definition_found") and not reason(["symbols_identified: 0/3"], "no_similar_implementation")
    assert reason(["required_tools: missing x"], "architecture_unknown") and not reason([], "architecture_unknown")


def test_consistency(spark):
    a = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    r = spark.range(1).select(gates.inconsistencies(a("Cart", "Cart"), a("Cart.add()", "Order.x()"), a(), a("p")).alias("x")).first().x
    assert r == ["entry_point 'Order.x()' not linked to any symbol in symbols_identified", "patterns provided but no files analyzed", "duplicate symbols detected: 2 given, 1 unique"]


def test_write_gate(spark):
    t = spark.createDataFrame([("s", "./src/a.py", False), ("s", "x/a.py", False), ("s", "src/new.py", True), ("s", "other/new.py", True), ("t", "any.py", False)], "session_id string, path string, is_new boolean")
    e = spark.createDataFrame([("s", "src/a.py")], "session_id string, path string")
    assert [r.allowed for r in gates.write_allowed(t, e).orderBy("session_id", "path").collect()] == [True, False, True, True, True]


def test_symbol_fold(spark):
    """Against going through the updates one by one."""
    import random

    r = random.Random(2)
    rows = [(k % 3, k, r.choice("AB"), r.choice(["HYPOTHESIS"] * 4 + ["FACT"]), r.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for k in range(60)]
    want = {}
    for s, _, n, source, c in rows:
        old = want.get((s, n))
        if old is None or source == "FACT" or c > old[1]:
            want[s, n] = (source, c)
    d = spark.createDataFrame(rows, "session_id long, seq long, name string, source string, confidence double").repartition(3)
    assert {(x.session_id, x.name): (x.source, x.confidence) for x in gates.fold_symbols(d, ["seq"]).collect()} == want


def test_short_cut(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [5.0, 5.0], 1), (3, [5.1, 5.0], 1)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(10, [0.1, 0.0]), (11, [5.0, 5.0])], "query_id long, query array<double>")
    got = {(r.query_id, r.source, r.id, r.confidence) for r in vectors.search_collections(v, q, F.col("label") == 0).collect()}
    assert got == {(10, "map", 1, "high"), (11, "forest", 2, "medium"), (11, "forest", 3, "medium")}
    none = vectors.search_collections(v.limit(0), q, F.col("label") == 0).collect()
    assert {r.confidence for r in none} == {"low"}


def test_merge_changes(spark):
    c = lambda rows: spark.createDataFrame(rows, "path string, change_type string, origin string")
    got = sync.merge_changes(c([("a", "added", "committed"), ("b", "added", "committed")]), c([("a", "deleted", "uncommitted")]), c([("b", "added", "untracked"), ("d", "added", "untracked")]))
    assert {r.path: r.origin for r in got.collect()} == {"a": "uncommitted", "b": "committed", "d": "untracked"}


def test_streaming_index(spark, tmp_path):
    root, store, check = (tmp_path / x for x in ("src", "index", "check"))
    root.mkdir()
    for i in range(3):
        (root / f"t{i}.py").write_text(f"def func{i}(): pass\n")
    index.follow(spark, str(root), str(store), str(check)).awaitTermination()
    names = lambda: {r.name for r in index.indexed(spark, str(store)).filter("type = 'function'").collect()}
    assert names() == {"func0", "func1", "func2"}
    (root / "t9.py").write_text("def later(): pass\n")
    index.follow(spark, str(root), str(store), str(check)).awaitTermination()
    assert names() == {"func0", "func1", "func2", "later"} and index.state(spark, str(store)).count() == 4


def test_index_batches(spark, tmp_path):
    """A batch writes its own files only, whatever there is; run again, changed, gone and compacted files come out right."""
    store = str(tmp_path / "index")
    files = lambda *rows: spark.createDataFrame([(p, c, hashlib.sha256(c.encode()).hexdigest()[:16], "python") for p, c in rows], "path string, content string, hash string, lang string")
    names = lambda i=store: sorted(r.name for r in index.indexed(spark, i).filter("type = 'function'").collect())
    index.index_batch(files(("a.py", "def a(): pass\n"), ("b.py", "def b(): pass\n")), 0, store)
    before = {p: os.path.getmtime(p) for p in glob.glob(store + "/**/*.parquet", recursive=True)}
    kept = merge.Snapshot(spark, store + "/state").places
    for _ in range(2):
        index.index_batch(files(("a.py", "def a2(): pass\n"), ("b.py", "def b(): pass\n"), ("c.py", "def c(): pass\n")), 1, store)
        assert names() == ["a2", "b", "c"]
    assert all(os.path.getmtime(p) == t for p, t in before.items())
    bucket = {r.path: r.b for r in index.state(spark, store).select("path", merge.bucket_of(["path"], index.BUCKETS).alias("b")).collect()}
    now = merge.Snapshot(spark, store + "/state").places
    assert {b for b in now if now[b] != kept.get(b)} == {bucket["a.py"], bucket["c.py"]}
    index.forget(spark, spark.createDataFrame([("b.py",)], "path string"), store)
    assert names() == ["a2", "c"]
    index.compact(spark, store)
    assert names() == ["a2", "c"] and [os.path.basename(p) for p in glob.glob(store + "/chunks/*")] == ["batch=-1"]
    index.index_batch(files(("b.py", "def b(): pass\n"), ("c.py", "def c(): pass\n")), 3, store)
    assert names() == ["a2", "b", "c"]
    index.compact(spark, store)
    assert names() == ["a2", "b", "c"]


def test_session_windows(spark):
    e = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 50)], "user string, ts timestamp_ntz")
    assert sorted(r.n for r in index.sessions(e, "user").collect()) == [1, 2]
