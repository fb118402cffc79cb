"""Files, configuration and version control, from folders made here."""

import subprocess

import pytest
from pyspark.sql import types as T

from quarry.operators import chunks
from quarry.sources import files as S
from quarry.sources import sinks


@pytest.fixture
def root(tmp_path):
    made = {"app/a.py": "def a(): pass\n", "app/b.php": "<?php class B {}\n", "node_modules/x.js": "no", "docs/d.md": "# D\n", "notes.txt": "n\n", "README.md": "# R\n", "bad.py": b"def f(): '\xff'\n"}
    for p, text in made.items():
        (tmp_path / "proj" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "proj" / p).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / "proj")


def test_scans(spark, root):
    every = S.read_files(spark, root)
    assert every.count() == 7 and "�" in every.filter("path = 'bad.py'").first().content
    some = S.read_files(spark, root, S.EXTENSIONS, S.EXCLUDES)
    assert {r.path for r in some.collect()} == {"app/a.py", "app/b.php", "bad.py"}
    assert {r.path for r in S.symbol_files(every).collect()} == {r.path for r in every.collect()} - {"node_modules/x.js"}
    assert {r.path for r in S.of_type(every, "md").collect()} == {"docs/d.md", "README.md"}
    assert {r.path for r in S.list_files(every, "*.py").collect()} == {"app/a.py", "bad.py"}
    assert {r.path for r in S.docs_of(every).collect()} == {"docs/d.md"}
    assert {r.file for r in chunks.chunk_folder(spark, root, (".py",), S.EXCLUDES).collect()} == {"app/a.py", "bad.py"}


def test_records(spark, tmp_path):
    schema = T.StructType().add("a", "long").add("b", "string")
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n')
    assert [tuple(r) for r in S.read_json_document(spark, str(tmp_path / "one.json"), schema).collect()] == [(1, "x")]
    assert S.read_json_document(spark, str(tmp_path / "none.json"), schema).count() == 0
    assert [(r.a, r.b) for r in S.read_json_lines(spark, str(tmp_path / "log.jsonl"), schema).orderBy("seq").collect()] == [(1, "x"), (2, None)]
    assert S.read_yaml(str(tmp_path / "none.yml")) == {}


def test_agreement_files(spark, tmp_path):
    folder = str(tmp_path / "agreements")
    made = spark.createDataFrame([("a_B.md", "---\nnl_term: a\n---\nérst"), ("c_D.md", None)], "file string, content string")
    assert sinks.write_files(made, folder) == 2 and sinks.write_files(made.filter("file = 'a_B.md'"), folder) == 1
    assert (tmp_path / "agreements/a_B.md").read_text() == "---\nnl_term: a\n---\nérst"
    sinks.clear(spark, folder + "/c_D.md")
    assert not (tmp_path / "agreements/c_D.md").exists()
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_files(made, folder, 1)


def test_branches(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "f").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "llm_task_s1_from_main")
    (tmp_path / "f").write_text("2")
    git("commit", "-qam", "two")
    git("branch", "llm_task_s2_from_gone")
    (tmp_path / "new").write_text("x")
    found = S.git_branches(spark, str(tmp_path))
    got = {r.branch: (r.session_id, r.base_branch, r.ahead, r.checked_out) for r in found.collect()}
    assert got == {"llm_task_s1_from_main": ("s1", "main", 1, True), "llm_task_s2_from_gone": ("s2", "gone", None, False)}
    assert [r.branch for r in S.stale_branches(found).collect()] == ["llm_task_s2_from_gone"]
    assert {(r.path, r.change_type, r.origin) for r in S.git_changes(spark, str(tmp_path), "main").collect()} == {("f", "modified", "committed"), ("new", "added", "untracked")}
