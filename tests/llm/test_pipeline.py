"""The pipeline's stages on a small table, each against what its operator says."""

import os
import pickle

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.decontamination import decontaminate
from quarry.llm import secret_scans, stages
from quarry.llm.ngram_jaccard import ngram_jaccard

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, docs, tmp_path):
    made = docs.select("doc_id", "text", "lang", "source", "n_chars")
    before = made
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, before, DATA).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == before.columns
        if name == "ngram_jaccard":
            keyed = before.withColumn("k", F.xxhash64("doc_id", "text"))
            found = ngram_jaccard(keyed, id_col="k")
            groups = found.filter("n_shingles > 0").select("component_id").distinct().count()
            assert after.count() == groups + found.filter("n_shingles = 0").count()
        if name == "decontamination":
            assert after.count() == before.count() - decontaminate(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").count()
        if name == "secret_scans":
            assert after.count() == before.count()
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()


def test_empty(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, DATA).count() == 0


def test_near_duplicates_by_id_and_text(spark):
    """One of each group stays, the least id; nulls among ids, repeated rows and ids with two texts; columns named as the stage's own."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a, "x"), (2, a, "y"), (None, a, "z"), (None, b, "p"), (None, b, "p"), (5, c, "q"), (5, d, "r"), (6, None, "s"), (6, None, "s"), (7, "", "t"), (9, c + " more", "u"), (8, d, "v"), (8, d, "v")]
    docs = spark.createDataFrame([(*r, "k", 1, "i") for r in rows], "doc_id long, text string, note string, key string, n int, ID string")
    out = stages.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:1], r.note) for r in out.collect())
    assert got == [(False, 2, "a", "y"), (False, 5, "c", "q"), (False, 5, "d", "r"), (False, 6, "", "s"), (False, 6, "", "s"), (False, 7, "", "t"), (True, 0, "b", "p")]
    assert {(r.key, r.n, r.ID) for r in out.collect()} == {("k", 1, "i")}


def test_contaminated_with_clashing_names(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, text, "mine", 7), (None, text, "mine", 7), (2, "clean words", "mine", 7), (None, None, "mine", 7)], "doc_id long, text string, id string, key long")
    out = stages.contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(2, "clean words", "mine", 7), (None, None, "mine", 7)]
    marked = docs.select("doc_id", "text", F.col("id").alias("_key"), F.col("key").alias("_id"))
    assert stages.contaminated(spark, marked, str(tmp_path)).columns == marked.columns


def test_stages_take_odd_names_and_no_source(spark, docs):
    odd = docs.filter("doc_id < 12").withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("x")).drop("source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns and out.count() >= 1


def test_contaminated_starts_no_workers_for_rows(spark, docs, monkeypatch):
    """Not even for a table of one row: such workers would stay beside those of the next stages."""
    made = docs.select("doc_id", "text", "lang", "source", "n_chars")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows from Python"))
    assert stages.contaminated(spark, made, DATA).count() == made.count()


def test_near_duplicates_send_little_of_few_documents(spark, docs, monkeypatch):
    """What goes through the driver follows the corpus, and none of it stays."""
    sent, context = [], type(spark.sparkContext)
    make = context.broadcast

    def broadcast(self, value):
        sent.append((len(pickle.dumps(value)), found := make(self, value)))
        monkeypatch.setattr(found, "destroy", lambda *a, f=found.destroy: (gone.append(found), f(*a)))
        return found

    gone = []
    monkeypatch.setattr(context, "broadcast", broadcast)
    assert ngram_jaccard(docs).count() == docs.count()
    assert sent and all(n < 1 << 20 for n, _ in sent) and len(gone) == len(sent)


def test_secrets_parse_no_forest(spark, docs, monkeypatch):
    """The trees are columns: the parser's memory of a long SQL text would stay in the driver."""
    made = docs.select("doc_id", "text", "lang", "source", "n_chars")
    monkeypatch.setattr(F, "expr", lambda text: pytest.fail("an expression is parsed"))
    assert stages.secrets(spark, made, DATA).count() == made.count()


def test_forest_of_columns_is_that_of_sql(spark):
    made = secret_scans.findings(spark, 500)
    trees = secret_scans.trained(made, trees=5)
    x = made.select(F.array(*secret_scans.features(*(F.col(c) for c in ("word", "one", "two", "after", "path")))).alias("f")).cache()
    sql = F.expr(f"({' + '.join(f'({secret_scans.tree_sql(t)})' for t in trees)}) / {len(trees)}")
    both = x.select(secret_scans.score(trees, F.col("f")).alias("a"), sql.alias("b"))
    assert both.filter("a = b").count() == 500 and both.select("a").distinct().count() > 2
