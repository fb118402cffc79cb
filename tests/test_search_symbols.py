"""Search, symbols, chunks and impact on small files."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunks, impact, search, symbols
from quarry.plans import router
from quarry.sources import files as S

PY = "import os\n\n\nclass Calc:\n    def add(self, a, b):\n        def inner():\n            return a\n        return inner() + b\n\n\ndef use(x: Calc):\n    return Calc().add(1, 2)\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("app/calc.py", PY, "python"), ("app/calc_test.py", "from app.calc import Calc\nCalc()\n", "python"), ("styles.css", ".menu { color: red; }\n#top { }\n", "css"), ("page.html", '<div class="menu wide" id="top">x</div>', "html"), ("docs/a.md", "# calc\nThe calc adds.\ncalc again\n", "unknown"), ("empty.py", "", "python"), ("null.py", None, "python")]
    return spark.createDataFrame(rows, "path string, content string, lang string")


def test_patterns_are_bounded(files):
    assert search.search(files, []).count() == 0
    assert {r.pattern for r in search.search(files, ["import", "Calc", "Calc"]).collect()} == {"import", "Calc"}
    with pytest.raises(ValueError, match="Maximum 5 patterns"):
        search.search(files, list("abcdef"))


def test_search_options(files):
    hits = search.search(files, "Calc", per_file=1, context=1).filter("path = 'app/calc.py'").collect()
    assert [(h.line_number, h.before, h.after) for h in hits] == [(4, [""], ["    def add(self, a, b):"])]
    assert search.search(files, "calc", literal=True, ignore_case=True).filter("path = 'docs/a.md'").count() == 3
    assert search.search(files, "a.d", literal=True).count() == 0
    subs = search.search(files, "[Cc]alc", with_submatches=True).filter("path = 'app/calc.py' and line_number = 11").first().submatches
    assert [(s.match, s.start, s.end) for s in subs] == [("Calc", 11, 15)]
    assert [r.n for r in search.counts(search.search(files, ["Calc", "zzz"]), ["Calc", "zzz"]).orderBy("n").collect()][0] == 0


def test_structure_and_references(files):
    nodes = symbols.structure(files)
    got = {(r.name, r.type, r.start_line, r.end_line) for r in nodes.filter("path = 'app/calc.py'").collect()}
    assert {("Calc", "class", 4, 8), ("add", "member", 5, 8), ("inner", "function", 6, 7), ("use", "function", 11, 12)} <= got
    tags = symbols.tags(nodes)
    assert {r.name for r in symbols.find_definitions(tags, "CAL").collect()} == {"Calc"}
    assert symbols.find_definitions(tags, "calc", exact=True).count() == 0
    refs = {(r.path, r.line) for r in symbols.find_references(files, tags, "Calc").collect()}
    assert ("app/calc.py", 4) not in refs and ("app/calc.py", 11) in refs and ("app/calc_test.py", 1) in refs
    s = symbols.structure_summary(files, nodes).filter("path = 'app/calc.py'").first()
    assert (s.functions, s.classes, s.imports, s.lines) == (3, 1, 1, 13)


def test_enclosing(spark, files):
    spans = symbols.structure(files).filter("category = 'functions'").select("path", "start_line", "end_line", "name")
    at = spark.createDataFrame([("app/calc.py", 7), ("app/calc.py", 1)], "path string, line int")
    assert [r.name for r in symbols.enclosing(at, spans).collect()] == ["add"]
    assert [r.name for r in symbols.enclosing(at, spans, innermost=True).collect()] == ["inner"]


def test_cache_is_by_path_content_and_language(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    was = spark.createDataFrame([("a", "1", None), ("b", "x", None), ("c", "3", "python")], "path string, hash string, language string")
    hits, misses = symbols.cached(now, was)
    assert [r.path for r in hits.collect()] == ["a"] and {r.path for r in misses.collect()} == {"b", "c"}


def test_chunks(spark, files):
    got = chunks.chunk(files).collect()
    ids = [r.id for r in got]
    assert len(ids) == len(set(ids))
    assert {r.name for r in got if r.file == "app/calc.py"} == {"module", "Calc", "add", "inner", "use"}
    assert {r.name for r in got if r.file == "styles.css"} >= {".menu", "#top"}
    assert not [r for r in got if r.file in ("empty.py", "null.py")]
    long = spark.createDataFrame([("x.txt", "\n".join(["a"] * 60 + [" "] * 50 + ["b"]), "unknown")], "path string, content string, lang string")
    assert [(r.line_start, r.line_end) for r in chunks.line_windows(long).orderBy("line_start").collect()] == [(1, 50), (51, 100), (101, 111)]


def test_framework_chunks():
    migration = "Schema::create('users', function (Blueprint $table) {\n $table->string('name');\n $table->foreign('team_id')->references('id')->on('teams');\n});"
    m = chunks.migration_chunks("m.php", migration, "migration")[0]
    assert m[1] == "migration:users" and '"name": "name"' in m[8]["columns"] and "teams" in m[8]["foreign_keys"]
    assert [r[1] for r in chunks.composer_chunks("composer.json", '{"require": {"php": "8"}, "autoload": {"psr-4": {"A": "a"}}}', "x")] == ["composer:require", "composer:autoload"]
    assert chunks.composer_chunks("composer.json", "{broken", "x") == []
    t = chunks.tailwind_chunks("t.js", "module.exports = { content: ['./a.html'], theme: { extend: { colors: { red: '#f00' } } }, plugins: [x] }", "x")
    assert [r[3] for r in t] == ["theme", "content", "plugins"]
    php = chunks.php_metadata("namespace App\\Models;\nuse App\\A;\nclass User {\n function __construct(private Repo $r, string $s) {}\n function posts() { return $this->hasMany(Post::class); }\n}")
    assert php["fqcn"] == "App\\Models\\User" and php["relations"] == [{"method": "posts", "type": "hasMany", "related": "Post"}] and php["dependencies"] == [{"class": "Repo", "variable": "r"}]
    b = chunks.blade_chunks("v.blade.php", "<x-nav-bar/> {{ route('home') }} @livewire('list')", "blade")[0]
    assert "NavBar" in b[8]["components"] and "home" in b[8]["routes"]


def test_impact(files):
    tags = symbols.tags(symbols.structure(files))
    r = impact.analyze(files, tags, ["styles.css"], "recolour")
    assert r["mode"] == "relaxed_markup" and [(x.source, x.path) for x in r["cross_references"].collect()] == [("styles.css", "page.html")]
    r = impact.analyze(files, tags, ["app/Calc.py"], 'Change "Calc"')
    need = {(x.path, x.need) for x in r["envelope"].collect()}
    assert ("app/calc.py", "must_verify") in need and ("docs/a.md", "should_verify") in need
    m = r["mentions"].first()
    assert m.path == "docs/a.md" and m.match_count == 3 and len(m.samples) == 3


def test_sources(spark, tmp_path):
    root = tmp_path / "proj"
    for p, t in (("src/a.py", "x = 1\n"), ("src/node_modules/b.js", "y"), ("docs/d.md", "---\nnl_term: cart\nsymbol: Cart: x\n---\nbody"), ("README.md", "r"), ("a.blade.php", "z")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    found = S.read_files(spark, str(root), excludes=S.EXCLUDES)
    assert {r.path for r in found.collect()} == {"src/a.py", "docs/d.md", "README.md", "a.blade.php"}
    assert {r.path for r in S.read_files(spark, str(root), extensions=(".php", ".blade.php")).collect()} == {"a.blade.php"}
    f = S.front_matter(found).first()
    assert f.meta == {"nl_term": "cart", "symbol": "Cart: x"} and f.body == "body"
    assert [r.path for r in S.docs_of(found).collect()] == ["docs/d.md"]
    assert [r.path for r in S.list_files(found, "*.py").collect()] == ["src/a.py"]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    from pyspark.sql import types as T

    assert [r.a for r in S.read_json_lines(spark, str(tmp_path / "log.jsonl"), T.StructType([T.StructField("a", T.LongType())])).orderBy("seq").collect()] == [1, 2]
    assert S.read_yaml(str(tmp_path / "none.yml")) == {}
    with pytest.raises(Exception, match="(?i)path"):
        S.read_files(spark, os.path.join(str(tmp_path), "nonexistent")).count()


def test_plan_and_execute(spark, files):
    frame = spark.createDataFrame([("", None, "slow", "", "WHAT", True)], "target_feature string, trigger_condition string, observed_issue string, desired_action string, intent string, first_query boolean")
    p = router.plan(frame).first()
    assert p.missing == ["target_feature", "trigger_condition", "desired_action"] and p.risk_level == "HIGH" and p.intent == "EXPLORE"
    assert p.tools == ["find_definitions", "search_text", "get_symbols", "find_references", "analyze_structure"] and [s.priority for s in p.steps] == [5, 4, 3, 2, 1]
    nodes = symbols.structure(files)
    out = router.execute(router.Corpus(files, nodes, symbols.tags(nodes)), p.tools, "Calc")
    assert {r.tool for r in out.collect()} == set(p.tools)
    assert out.filter("tool = 'search_text' and start_line = 0").count() == 0


def test_tool_stream(spark):
    lines = ['{"type":"begin","data":{}}', '{"type":"match","data":{"path":{"text":"a.py"},"line_number":3,"lines":{"text":"x = 1\\n"},"submatches":[{"match":{"text":"x"},"start":0,"end":1}]}}', "broken"]
    r = S.tool_matches(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(r) == 1 and r[0].file == "a.py" and r[0].submatches[0].match == "x"


def test_identifiers(spark):
    page = '<a class="btn main" id="x1">.go</a><i class=\'btn\'>'
    got = spark.range(1).select(X.css_identifiers(F.lit(page)).alias("x")).first().x
    assert got == ["go", "btn", "main", "x1"]


@pytest.mark.parametrize(
    "language,source,names",
    [
        ("rust", "fn wide<" + ", ".join(f"T{i}: Clone + Send" for i in range(15)) + ">(a: T0, b: Vec<T1>) -> Map<T0, T1> { a }\nfn f(x: u8) {}", [("wide", 2), ("f", 1)]),
        ("go", "func G[T any, U comparable](x T, y U) error { return nil }\nfunc (r *R[T]) M(a int) {}\nfunc H(a int) int { return func(b int) int { return b }(a) }", [("G", 2), ("M", 1), ("H", 1)]),
        ("typescript", "function g<T extends Map<string, {a: number}>>(x: T): T { return x }\nclass C { m<T>(x: T): Set<T> { if (a < b) { c() } return x }\n n(a, b) { } }", [("g", 1), ("m", 1), ("n", 2)]),
        ("typescript", "const f = async <T>(x: T, y: number): Promise<Map<string, Array<[number, T, string, boolean, null, undefined]>>> => { return x };\nconst h: (a: number) => Map<string, number> = (a) => new Map();\nconst z = 1 < 2;", [("f", 2), ("h", 1)]),
        ("javascript", "function* gen(a) { yield a }\nconst $a = (b, c) => b < c ? (1) : 2\nlet n = (3 + 4) * 2;", [("gen", 1), ("$a", 2)]),
        ("php", "<?php function &ref($a, array $b = [1, 2]) { return $a; } class K { public function go(): ?Map { } }", [("go", 0), ("ref", 2)]),
    ],
)
def test_functions_with_type_parameters(language, source, names):
    from quarry.operators import scan

    assert [(n[1], len(n[5])) for n in scan.nodes(source, language) if n[0] == "functions"] == names


def test_cross_references_by_either_way(spark, monkeypatch):
    """Few identifiers are tried on each file, many are laid against files' runs: the same rows."""
    r = ["a-b", "box", "x.y", "naïve", "zz", "q"]
    files = spark.createDataFrame([(f"p{i}.html", " ".join(r[(i * k) % 6] + str(i % 3) * (k % 2) for k in range(4))) for i in range(30)], "path string, content string")
    own = spark.createDataFrame([("p1.html", ["box", "a-b"]), ("s.css", ["x.y", "naïve", "nowhere"]), ("t.css", ["."]), ("u.css", [])], "path string, identifiers array<string>")
    found = []
    for few in (64, 0):
        monkeypatch.setattr(impact, "FEW", few)
        found.append(sorted(map(tuple, impact.cross_references(files, own.filter("path <> 't.css'"), (".html",), most=5).collect())))
    assert found[0] == found[1] and len(found[0]) >= 5


@pytest.mark.parametrize("few", [64, 0])
def test_common_identifiers_do_not_meet_all_their_sources(spark, monkeypatch, few):
    """An identifier of n sources in n files gives a few files for each of them, not n times n rows, and the rows of the plain way."""
    monkeypatch.setattr(impact, "FEW", few)
    names = {f"p{i:03}.html": ["box"] + (["rare"] if i % 50 == 7 else []) + (["x.y"] if i % 3 == 0 else []) for i in range(200)}
    files = spark.createDataFrame([(p, " ".join(n)) for p, n in names.items()], "path string, content string")
    own = spark.createDataFrame([(p, ["rare", "x.y", "box"]) for p in names], "path string, identifiers array<string>")
    seen = spark.sparkContext.accumulator(0)
    first = impact._first_files

    def counting(met, *rest):
        seen.add(met.count())
        return first(met, *rest)

    monkeypatch.setattr(impact, "_first_files", counting)
    found = sorted(map(tuple, impact.cross_references(files, own, (".html",), most=4).select("source", "path", "identifier").collect()))
    of = lambda p: next(n for n in ("rare", "x.y", "box") if n in names[p])
    assert found == sorted((s, p, of(p)) for s in names for p in [p for p in sorted(names) if p != s][:4])
    assert seen.value <= 3 * 5


def test_files_in_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(f"p{i}.py", f"def f{i}():\n    pass\n", "python") for i in range(40)], "path string, content string, lang string").coalesce(1)
    nodes = symbols.structure(files)
    assert nodes.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["name"] for r in nodes.collect()) == sorted(f"f{i}" for i in range(40))


def test_chunks_stay_in_their_files_row(spark, capsys):
    """Lists of chunks need no shuffle, and keep what a file has besides; a null content has none."""
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n", "python", "h", 1.0), ("b", "x\n" * 120, "text", None, None), ("c", None, "text", "i", 2.0), ("d", "", "text", "j", 3.0)], "path string, content string, lang string, hash string, mtime double").coalesce(1)
    lists = chunks.chunk_lists(files)
    lists.explain()
    assert "Exchange" not in capsys.readouterr().out
    found = {r["path"]: r for r in lists.collect()}
    assert {p: (r["hash"], r["mtime"], len(r["chunks"])) for p, r in found.items()} == {"a.py": ("h", 1.0, 2), "b": (None, None, 3), "c": ("i", 2.0, 0), "d": ("j", 3.0, 0)}
    assert sorted(tuple(map(str, c)) for r in found.values() for c in r["chunks"]) == sorted(tuple(map(str, c)) for c in chunks.chunk(files.select("path", "content", "lang")).collect())
