"""Sweeps, containment and ignore files against plain computation."""

import random
import subprocess

import pytest

from quarry.operators import containment, spans
from quarry.sources import files


@pytest.mark.parametrize("innermost", [False, True])
def test_enclosing(spark, monkeypatch, innermost):
    monkeypatch.setattr(spans, "STRETCH", 40)
    r = random.Random(1)
    around = [(f, a, a + r.randint(0, 150), f"{f}{k}") for f in "ab" for k in range(60) for a in [r.randint(1, 300)]] + [("c", 5, 3, "turned"), (None, 1, 9, "none")]
    lines = [(f, n) for f in ("a", "b", "c", None) for n in range(1, 330)] + [("a", 7), ("a", None)]
    got = spans.enclosing(spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(around, "path string, start_line int, end_line int, name string"), innermost=innermost)
    want = []
    for f, n in lines:
        own = [(b - a if innermost else a - b, a, b) for g, a, b, _ in around if f is not None and n is not None and g == f and a <= n <= b]
        if own:
            want.append((f, n, min(own)[1], min(own)[2]))
    rows = got.collect()
    assert sorted((x.path, x.line, x.start_line, x.end_line) for x in rows) == sorted(want)
    assert all((x.path, x.start_line, x.end_line, x.name) in around for x in rows) and got.columns == ["path", "line", "start_line", "end_line", "name"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_file_of_many_lines(spark):
    """One file of a million lines, with spans in each other: no product of lines and spans."""
    lines = spark.range(1, 1_000_001).selectExpr("'f' AS path", "CAST(id AS INT) AS line")
    nested = spark.range(0, 1000).selectExpr("'f' AS path", "CAST(1000 * id + 1 AS INT) AS start_line", "CAST(1000 * id + 600 AS INT) AS end_line").union(spark.range(1).selectExpr("'f'", "1", "1000000"))
    got = spans.enclosing(lines, nested, innermost=True).groupBy((spans.F.col("end_line") - spans.F.col("start_line")).alias("size")).count()
    assert {r["size"]: r["count"] for r in got.collect()} == {599: 600_000, 999_999: 400_000}


def test_answering(spark):
    terms = ["a", "ab", "abc", "red_part", "RED", "zzz", "", " ", None, "Été", "x y", "abcabcabc", "aaaa", "part widget red"]
    symbols = ["abc", "Red widget", "red", "été blanc", "aaa", "y", "q", "abcab", "", None, "WIDGET_part", "zz", "a b"]
    got = containment.answering(spark.createDataFrame([(t,) for t in terms + ["a"]], "term string"), spark.createDataFrame([(s,) for s in symbols], "symbol string"))

    def words(x):
        return set(x.lower().replace("_", " ").split())

    want = {(t, s) for t in terms for s in symbols if t and s and t.strip() and s.strip() and (t.lower() in s.lower() or s.lower() in t.lower() or words(t) & words(s))}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


IGNORE = {"": "*.log\n!keep.log\n/build/\ndocs/*.md\n# note\n\ntmp\n", "src": "*.py\n!a.py\n/gen\n", "src/gen": "!*\n", "lib/deep": "*\n!ok.txt\n"}
PATHS = ["x.log", "keep.log", "src/keep.log", "build/a", "src/build/a", "docs/a.md", "docs/x/a.md", "tmp", "tmp/x/y", "a/tmp/z", "src/a.py", "src/b.py", "src/x/a.py", "src/x/b.py", "src/gen/a.py", "lib/gen/a.py", "lib/deep/ok.txt", "lib/deep/no.txt", "lib/deep/x/ok.txt", "lib/ok.txt", "build", "src/tmp/keep.log"]


def test_ignore_files_as_version_control_reads_them(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    for folder, text in IGNORE.items():
        (repo / folder).mkdir(parents=True, exist_ok=True)
        (repo / folder / ".gitignore").write_text(text)
    done = subprocess.run(["git", "-C", str(repo), "check-ignore", "--stdin", "--no-index"], input="\n".join(PATHS), capture_output=True, text=True)
    rules = [(folder, k, line) for folder, text in IGNORE.items() for k, line in enumerate(text.split("\n"))]
    got = files.ignored_by_files(spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string"), spark.createDataFrame(rules, "folder string, line int, rule string"))
    assert {r.path for r in got.collect() if r.ignored} == set(done.stdout.split())
    assert files.ignored_by_files(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([], "folder string, line int, rule string")).collect()[0].ignored is False


def test_counters_of_a_run(spark):
    from quarry.operators import sync

    files_, state = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "0"), ("z", "9")]))
    changed, seen = sync.observed_changes(sync.changes(files_, state))
    assert changed.count() == 4 and seen.get == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}


def test_runs_and_scans_again(spark, tmp_path):
    """A run that finds nothing new writes nothing but its stamp; a scan that knows all reads no source."""
    from quarry.operators import stored
    from quarry.sources import merge

    rows = [("a.py", "def a(): pass\n", "1", 1.0, "python"), ("b.js", "function b(x) { }\n", "2", 1.0, "javascript"), ("c.md", "# C\n", "3", 1.0, "markdown"), ("venv/d.py", "def d(): pass\n", "4", 1.0, "python"), ("e.py", None, "5", 1.0, "python")]
    schema = "path string, content string, hash string, mtime double, lang string"
    all_ = spark.createDataFrame(rows, schema)
    folder, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    assert stored.run(all_, folder, "one") == {"added": 5, "modified": 0, "deleted": 0, "unchanged": 0, "errors": 1}
    number = merge.Snapshot(spark, f"{folder}/state").number
    assert stored.run(all_, folder, "two") == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 5, "errors": 0}
    assert merge.Snapshot(spark, f"{folder}/state").number == number
    found, counts = stored.scan_tags(all_, cache)
    assert sorted((t.name, t.path) for t in found.collect()) == [("a", "a.py"), ("b", "b.js")] and counts == {"files_scanned": 3, "files_cached": 0}
    changed = spark.createDataFrame([("a.py", "def a2(): pass\n", "9", 2.0, "python"), *rows[1:]], schema)
    found, counts = stored.scan_tags(changed, cache)
    assert sorted(t.name for t in found.collect()) == ["a2", "b"] and counts == {"files_scanned": 3, "files_cached": 2}
    assert stored.scan_tags(changed, cache, "python")[1] == {"files_scanned": 3, "files_cached": 0}
    stored.save_context(spark.createDataFrame([("d.md", "s", "h")], "path string, summary string, content_hash string"), str(tmp_path / "context"), spans.F.lit("one"))
    stored.save_context(spark.createDataFrame([], "path string, summary string, content_hash string"), str(tmp_path / "context"), spans.F.lit("two"))
    from quarry.sources import sinks

    assert [tuple(r) for r in sinks.read(spark, str(tmp_path / "context")).collect()] == [("d.md", "s", "h", "", "two")]
