"""Queries over stated inputs, with the rows that are right for them.

Where an operator takes a kind of input that the test tables lack (sources in several
languages, rules files, slots, sessions), its query applies it to inputs written out
here, and its SQL is the rows that are expected, written out as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import agreements, chunks, gates, impact, logs, scan, search, sessions, symbols, sync, vectors
from quarry.plans import router
from quarry.sources import files as S
from quarry.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TYPES = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"


def case(columns: str, *rows: tuple):
    """A query whose result has these columns (name and type) and rows."""
    kinds = [c.split() for c in columns.split(", ")]

    def register(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(spark).select(*(F.col(n).cast(k).alias(n) for n, k in kinds))
        select = ", ".join(f"CAST({n} AS {TYPES[k]}) AS {n}" for n, k in kinds)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        ORACLE_SQL[f.__name__] = f"SELECT {select} FROM (VALUES {values}) AS t({', '.join(n for n, _ in kinds)})"
        return f

    return register


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def texts(spark: SparkSession, *values: str) -> DataFrame:
    """(k, x): numbered texts."""
    return rows(spark, "k long, x string", *enumerate(values))


def listed(c: str | Column) -> Column:
    return F.array_join(c, ",")


# --- functions of text ---


@case("k long, markup boolean", (0, True), (1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False), (9, False), (10, False))
def case_markup_only(spark: SparkSession) -> DataFrame:
    d = texts(spark, "styles.css", "page.html", "README.md", "a.css|b.html", "app.py", "script.js", "Component.tsx", "view.blade.php", "App.vue", "a.css|app.py", "")
    return d.select("k", X.markup_only(F.filter(F.split("x", r"\|", -1), lambda p: p != "")).alias("markup"))


@case("x string, base string", ("Product.php", "Product"), ("app/Models/Product.php", "Product"), ("user_service.py", "UserService"), ("cart_item_handler.php", "CartItemHandler"), ("welcome.blade.php", "welcome"), ("test.spec.ts", "test"), (".env", ".env"))
def case_base_name(spark: SparkSession) -> DataFrame:
    return texts(spark, "Product.php", "app/Models/Product.php", "user_service.py", "cart_item_handler.php", "welcome.blade.php", "test.spec.ts", ".env").select("x", X.base_name(F.col("x")).alias("base"))


@case("k long, hint boolean", *((k, k < 8) for k in range(10)))
def case_type_hint(spark: SparkSession) -> DataFrame:
    d = texts(spark, ": Product,", ": Product)", "-> Product", "List[Product]", "@param Product $item", "@return Product", "@var Product", "Collection<Product>", "$product = new Product()", "product.save()")
    return d.select("k", X.type_hint(F.col("x"), "Product").alias("hint"))


@case("k long, words string", (0, "auto_billing"), (1, "ProductPrice,show"), (2, "user_account,Product"), (3, "a b,CartItem"))
def case_keywords(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, x string, p array<string>", (0, 'Change "auto_billing" field type', []), (1, "show the ProductPrice", []), (2, "update user_account", ["app/Models/Product.php"]), (3, "fix 'a b' of it", ["cart_item.py"]))
    return d.select("k", listed(X.keywords(F.col("x"), F.col("p"))).alias("words"))


@case("x string, pattern string, gone boolean", ("docs/test.md", "docs/**", True), ("docs/test.md", "other/**", False), ("CHANGELOG.md", "CHANGELOG*", True), ("a/node_modules/b.js", "**/node_modules/**", True), ("src/a.py", "*.js", False), ("src/deep/a.js", "*.js", True))
def case_excluded(spark: SparkSession) -> DataFrame:
    d = rows(spark, "x string, pattern string", ("docs/test.md", "docs/**"), ("docs/test.md", "other/**"), ("CHANGELOG.md", "CHANGELOG*"), ("a/node_modules/b.js", "**/node_modules/**"), ("src/a.py", "*.js"), ("src/deep/a.js", "*.js"))
    out = F.coalesce(*(F.when(F.col("pattern") == g, X.excluded(F.col("x"), [g])) for g in ("docs/**", "other/**", "CHANGELOG*", "**/node_modules/**", "*.js")))
    return d.withColumn("gone", out)


@case("x string, gone boolean", ("build/a.py", True), ("src/build/a.py", True), ("src/a.log", True), ("keep.log", False), ("top/a.py", True), ("x/top/a.py", False), ("src/.hidden/a.py", True), ("src/a.py", False))
def case_ignored(spark: SparkSession) -> DataFrame:
    d = texts(spark, "build/a.py", "src/build/a.py", "src/a.log", "keep.log", "top/a.py", "x/top/a.py", "src/.hidden/a.py", "src/a.py")
    kept = S.searched(d.withColumnRenamed("x", "path"), ["# notes", "build/", "*.log", "!keep.log", "/top"]).select(F.col("path").alias("x"), F.lit(False).alias("kept"))
    return d.join(kept, "x", "left").select("x", F.coalesce("kept", F.lit(True)).alias("gone"))


@case("k long, names string", (0, "card,title"), (1, "intro,main"), (2, ""))
def case_file_identifiers(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, x string, css boolean", (0, ".card { } #title > p { color: red }", True), (1, '<div class="main"><p id="intro">.no</p></div>', False), (2, "<p>plain</p>", False))
    return d.select("k", listed(X.file_identifiers(F.col("x"), F.col("css"))).alias("names"))


@case("k long, said string", (0, "DO:|- test first|* keep it small||DON'T:|- no globals"), (1, "Rules:|- one|- two"), (2, ""), (3, "Rules:|" + "|".join(f"- r{k}" for k in range(20))), (4, "|DON'T:|- 使わない"))
def case_rules(spark: SparkSession) -> DataFrame:
    many = "\n".join(f"* r{k}" for k in range(25))
    d = texts(spark, "# DO\n- test first\n* keep it small\n\ntext\n## Don't\n- no globals\n", "intro\n- one\n- two\n", "nothing", many, "# 禁止\n- 使わない\n")
    return d.select("k", F.replace(X.rules(F.col("x")), F.lit("\n"), F.lit("|")).alias("said"))


@case("k long, summary string", (0, "# Title|First paragraph.|## Section|Section content."), (1, "# Code|After."), (2, "Only text."))
def case_doc_summary(spark: SparkSession) -> DataFrame:
    d = texts(spark, "# Title\n\nFirst paragraph.\n\n## Section\n\nSection content.", "# Code\n\n```\nx = 1\n```\n\nAfter.\n", "Only text.")
    return d.select("k", F.replace(X.doc_summary(F.col("x")), F.lit("\n"), F.lit("|")).alias("summary"))


@case("k long, valid boolean", (0, True), (1, False), (2, False), (3, False), (4, True))
def case_slot_valid(spark: SparkSession) -> DataFrame:
    q = "the login button fails on submit"
    d = rows(spark, "k long, v string, q string", (0, "login", "login button"), (1, "login", "logout button"), (2, "", "login"), (3, "zz", "on"), (4, "Login Button", "login button"))
    return d.select("k", X.slot_valid(F.lit(q), F.col("v"), F.col("q")).alias("valid"))


@case("k long, slots string, source string, quotes string", (0, '{"target_feature":"login button","observed_issue":"fails"}', '{"target_feature":"FACT","observed_issue":"FACT"}', '{"target_feature":"the login button","observed_issue":"fails on"}'), (1, "{}", "{}", "{}"))
def case_frames(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, query string, tv string, tq string, iv string, iq string", (0, "the login button fails on submit", "login button", "the login button", "fails", "fails on"), (1, "make it blue", "red", "make it red", None, "it"))
    frame = router.frame_of(F.col("query"), {"target_feature": (F.col("tv"), F.col("tq")), "observed_issue": (F.col("iv"), F.col("iq"))})
    return d.withColumn("f", frame).select("k", *(F.to_json(f"f.{c}").alias(c) for c in ("slots", "source", "quotes")))


@case("k long, n long, first string", (0, 2, "a"), (1, None, None), (2, 0, None), (3, None, None))
def case_json_arguments(spark: SparkSession) -> DataFrame:
    return texts(spark, '["a", "b,c"]', "a,b", "[]", "").select("k", F.size(X.string_list(F.col("x"))).alias("n"), F.get(X.string_list(F.col("x")), F.lit(0)).alias("first")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@case("k long, flag boolean, rel string, abs string", (0, True, "src/a.py", "/repo/src/a.py"), (1, False, "/other/b.py", "/other/b.py"), (2, None, "c.py", "/repo/c.py"))
def case_arguments(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, f string, p string", (0, "True", "/repo/src/a.py"), (1, "false", "/other/b.py"), (2, None, "c.py"))
    return d.select("k", X.flag(F.col("f")).alias("flag"), X.relative_path(F.col("p"), "/repo").alias("rel"), X.absolute_path(F.col("p"), "/repo/").alias("abs"))


@case("meta string", ('{"a":"1","b":"[\\"x\\", \\"y\\"]","d":"True"}',))
def case_metadata(spark: SparkSession) -> DataFrame:
    """Values of a chunk's metadata: nothing is left out, lists become JSON, all else text."""
    (*_, meta) = chunks._row("c", "k", "n", "f", "x", 1, 1, a=1, b=["x", "y"], c=None, d=True)
    return rows(spark, "m map<string,string>", ({**meta, "gone": None},)).select(F.to_json(X.clean_metadata(F.col("m"))).alias("meta"))


@case("id string, branch string, session string, base string", ("outcome_s1_2024-01-02T03:04:05", "llm_task_s1_from_feature__x", "s1", "feature/x"), ("outcome_s_2_old", "llm_task_s_2", "s_2", None))
def case_record_ids(spark: SparkSession) -> DataFrame:
    d = rows(spark, "s string, at string, b string", ("s1", "2024-01-02T03:04:05", "llm_task_s1_from_feature__x"), ("s_2", "old", "llm_task_s_2"))
    p = X.parse_task_branch(F.col("b"))
    return d.select(X.record_id("outcome", F.col("s"), F.col("at")).alias("id"), F.col("b").alias("branch"), p["session_id"].alias("session"), p["base_branch"].alias("base"))


@case("n long, length long, cut boolean", (100, 100, False), (2048, 2048, False), (4000, 2000 + len(X.TRUNCATED), True))
def case_head_tail(spark: SparkSession) -> DataFrame:
    short = X.head_tail(F.repeat(F.lit("x"), F.col("n")), 512, 1000)
    return rows(spark, "n int", (100,), (2048,), (4000,)).select("n", F.length(short).alias("length"), F.contains(short, F.lit("[truncated]")).alias("cut"))


# --- sources in several languages ---

PHP = """<?php
namespace App\\Models;
use App\\Support\\Money;
// class Not { function no() { }
final class Order extends Model {
    protected $translatable = ['title', "note"];
    public function __construct(private Money $money, string $name, ?Clock $clock = null) {}
    public function items() { return $this->hasMany(Item::class, 'order_id'); }
    public function owner() { return $this->morphTo(); }
    public function label(): string { return "} not the end {"; }
}
interface Payable { public function pay(int $sum); }
"""
TS = """import { a } from './a';
export class Cart {
  private items: Item[] = [];
  add(item: Item, n = 1) { if (n) { this.items.push(item); } return `}`; }
  get total() { return 1; }
}
export interface Shape { area: number }
const twice = async (x: number): number => { return 2 * x; };
function plain(a, b) { /* { */ return a; }
"""
GO = "package m\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Open(key string) error {\n\treturn nil\n}\n\nfunc Free() {}\n"
RUST = "use std::fmt;\npub struct P { x: i32 }\nimpl P {\n    pub fn new(x: i32) -> P { P { x } }\n}\nfn go<T>(t: T) {}\n"
PY = "import os\n\nLIMIT = 3\n\nclass A:\n    def m(self, x, *rest, key=1):\n        return x\n\n\nasync def run(n):\n    def inner():\n        return A\n    return inner\n"


def sources(spark: SparkSession) -> DataFrame:
    return rows(spark, "path string, content string, lang string", ("app/Order.php", PHP, "php"), ("src/cart.ts", TS, "typescript"), ("box.go", GO, "go"), ("p.rs", RUST, "rust"), ("a.py", PY, "python"), ("broken.py", "def (", "python"), ("none.py", None, "python"))


@case(
    "path string, category string, name string, type string, start_line long, end_line long, parameters string, scope string",
    ("app/Order.php", "imports", "", "import", 3, 3, "", ""), ("app/Order.php", "classes", "Order", "class", 5, 11, "", ""), ("app/Order.php", "functions", "__construct", "member", 7, 7, "private Money $money|string $name|?Clock $clock = null", "Order"),
    ("app/Order.php", "functions", "items", "member", 8, 8, "", "Order"), ("app/Order.php", "functions", "owner", "member", 9, 9, "", "Order"), ("app/Order.php", "functions", "label", "member", 10, 10, "", "Order"),
    ("app/Order.php", "classes", "Payable", "interface", 12, 12, "", ""), ("app/Order.php", "functions", "pay", "member", 12, 12, "int $sum", "Payable"),
    ("src/cart.ts", "imports", "", "import", 1, 1, "", ""), ("src/cart.ts", "exports", "", "export", 2, 2, "", ""), ("src/cart.ts", "classes", "Cart", "class", 2, 6, "", ""), ("src/cart.ts", "functions", "add", "member", 4, 4, "item: Item|n = 1", "Cart"), ("src/cart.ts", "functions", "total", "member", 5, 5, "", "Cart"),
    ("src/cart.ts", "exports", "", "export", 7, 7, "", ""), ("src/cart.ts", "classes", "Shape", "interface", 7, 7, "", ""), ("src/cart.ts", "functions", "twice", "function", 8, 8, "x: number", ""), ("src/cart.ts", "functions", "plain", "function", 9, 9, "a|b", ""),
    ("box.go", "classes", "Box", "struct", 3, 5, "", ""), ("box.go", "functions", "Open", "function", 7, 9, "key string", ""), ("box.go", "functions", "Free", "function", 11, 11, "", ""),
    ("p.rs", "imports", "", "import", 1, 1, "", ""), ("p.rs", "classes", "P", "struct", 2, 2, "", ""), ("p.rs", "functions", "new", "function", 4, 4, "x: i32", ""), ("p.rs", "functions", "go", "function", 6, 6, "t: T", ""),
    ("a.py", "imports", "os", "import", 1, 1, "", ""), ("a.py", "other", "LIMIT", "variable", 3, 3, "", ""), ("a.py", "classes", "A", "class", 5, 7, "", ""), ("a.py", "functions", "m", "member", 6, 7, "self|x|rest|key", "A"), ("a.py", "functions", "run", "function", 10, 13, "n", ""), ("a.py", "functions", "inner", "function", 11, 12, "", "run"),
)
def case_structure(spark: SparkSession) -> DataFrame:
    return symbols.structure(sources(spark)).withColumn("parameters", F.array_join("parameters", "|"))


@case("path string, lines long, functions long, classes long, imports long, exports long", ("app/Order.php", 13, 5, 2, 1, 0), ("src/cart.ts", 10, 4, 2, 1, 2), ("a.py", 14, 3, 1, 1, 0))
def case_structure_summary(spark: SparkSession) -> DataFrame:
    own = sources(spark).filter("path in ('app/Order.php', 'src/cart.ts', 'a.py')")
    return symbols.structure_summary(own, symbols.structure(own))


@case("name string, line long, kind string, scope string, signature string", ("LIMIT", 3, "variable", "", ""), ("A", 5, "class", "", ""), ("m", 6, "member", "A", "(self, x, rest, key)"), ("run", 10, "function", "", "(n)"), ("inner", 11, "function", "run", "()"))
def case_tags(spark: SparkSession) -> DataFrame:
    return symbols.tags(symbols.structure(sources(spark).filter("path = 'a.py'")))


@case(
    "id string, type string, line_start long, line_end long",
    ("app/Order.php:module:1", "module_summary", 1, 13), ("app/Order.php:Order:5", "class", 5, 11), ("app/Order.php:__construct:7", "member", 7, 7), ("app/Order.php:items:8", "member", 8, 8), ("app/Order.php:owner:9", "member", 9, 9), ("app/Order.php:label:10", "member", 10, 10), ("app/Order.php:Payable:12", "interface", 12, 12), ("app/Order.php:pay:12", "member", 12, 12),
    ("notes.txt:lines_1-2:1", "lines", 1, 2), ("s.css:module:1", "module_summary", 1, 3), ("s.css:.a, .b:1", "rule", 1, 1), ("s.css:p > a:2", "rule", 2, 2),
    ("p.html:module:1", "module_summary", 1, 4), ("p.html:main:1", "element", 1, 3), ("p.html:inner:2", "element", 2, 2), ("p.html:section:3", "element", 3, 3),
)
def case_chunks(spark: SparkSession) -> DataFrame:
    d = rows(spark, "path string, content string, lang string", ("app/Order.php", PHP, "php"), ("notes.txt", "one\ntwo", "unknown"), ("s.css", ".a, .b { x: '}' }\n@media print { p > a { y: 1 } /* q { } */ }\n", "css"), ("p.html", "<main>\n<div id=inner><div>x</div></div>\n<section>y</section></main>\n", "html"), ("none.txt", None, "unknown"))
    return chunks.chunk(d)


def meta(spark: SparkSession, path: str, content: str, lang: str) -> DataFrame:
    """(name, key, value) of the metadata of a source's chunks."""
    found = chunks.chunk(rows(spark, "path string, content string, lang string", (path, content, lang)))
    return found.filter("type <> 'module_summary'").select("name", F.explode("metadata").alias("key", "value"))


@case(
    "key string, value string", ("fqcn", "App\\Models\\Order"), ("uses", '["App\\\\Support\\\\Money"]'), ("translatable", '["title", "note"]'),
    ("relations", '[{"method": "items", "type": "hasMany", "related": "Item"}, {"method": "owner", "type": "morphTo", "related": "dynamic"}]'), ("dependencies", '[{"class": "Money", "variable": "money"}, {"class": "Clock", "variable": "clock"}]'),
)
def case_php_metadata(spark: SparkSession) -> DataFrame:
    return meta(spark, "app/Order.php", PHP, "php").filter("name = 'Payable'").select("key", "value")


@case(
    "name string, key string, value string", ("orders", "columns", '[{"name": "title", "type": "string"}, {"name": "owner_id", "type": "unsignedBigInteger"}]'), ("orders", "indexes", '["title"]'), ("orders", "foreign_keys", '[{"column": "owner_id", "references": "id", "on": "users"}]'), ("tags", "columns", '[{"name": "slug", "type": "string"}]'), ("tags", "indexes", '["slug"]'),
)
def case_migrations(spark: SparkSession) -> DataFrame:
    source = "<?php\nSchema::create('orders', function (Blueprint $table) {\n  $table->id();\n  $table->string('title')->default('});');\n  $table->unsignedBigInteger('owner_id');\n  $table->index('title');\n  $table->foreign('owner_id')->references('id')->on('users');\n});\nSchema::table('tags', function ($table) { $table->string('slug')->unique(); });\n"
    return meta(spark, "db/migrations/1.php", source, "migration")


@case("name string, key string, value string", ("body", "routes", '["orders.show"]'), ("body", "components", '["App\\\\View\\\\Components\\\\FormsTextInput"]'), ("body", "livewire", '["cart"]'))
def case_blade(spark: SparkSession) -> DataFrame:
    return meta(spark, "v/a.blade.php", "@extends('l')\n@section('body')\n{{-- route('no') --}}\n<a href=\"{{ route('orders.show', $o) }}\"><x-forms.text-input /></a>\n@livewire('cart')\n@endsection\n", "blade")


@case("name string, key string, value string", ("theme", "colors", '{"brand": "#fff", "ink-2": "black"}'), ("content", "paths", '["./a/**/*.html", "./b.js"]'))
def case_tailwind(spark: SparkSession) -> DataFrame:
    return meta(spark, "tailwind.config.js", "module.exports = { content: ['./a/**/*.html', \"./b.js\"], // x\n theme: { extend: { colors: { brand: '#fff', 'ink-2': \"black\" } } }, plugins: [] }", "tailwind_config")


@case(
    "name string, key string, value string", ("OrderResource", "fields", '[{"component": "TextInput", "name": "title"}, {"component": "DeleteAction", "name": "gone"}]'), ("OrderResource", "actions", '[{"type": "DeleteAction", "name": "gone"}, {"type": "EditAction", "name": "EditAction"}]'), ("OrderResource", "model", "Order"),
    ("form", "fields", '[{"component": "TextInput", "name": "title"}]'), ("form", "model", "Order"), ("getActions", "fields", '[{"component": "DeleteAction", "name": "gone"}]'), ("getActions", "actions", '[{"type": "DeleteAction", "name": "gone"}, {"type": "EditAction", "name": "EditAction"}]'), ("getActions", "model", "Order"),
)
def case_resources(spark: SparkSession) -> DataFrame:
    source = "<?php\nclass OrderResource extends Resource {\n  protected static $model = Order::class;\n  public static function form($f) { return [TextInput::make('title')]; }\n  public static function getActions() { return [DeleteAction::make('gone'), EditAction::make()]; }\n}\n"
    return meta(spark, "app/Resources/OrderResource.php", source, "filament_resource")


@case("name string, key string, value string", ("production_dependencies", "packages", '["php", "a/b"]'), ("psr4_autoload", "packages", '["App\\\\"]'))
def case_composer(spark: SparkSession) -> DataFrame:
    return meta(spark, "composer.json", json.dumps({"require": {"php": "8", "a/b": "1"}, "require-dev": {}, "autoload": {"psr-4": {"App\\": "app/"}}}), "composer_json")


# --- references and impact ---


def project(spark: SparkSession) -> DataFrame:
    return rows(
        spark, "path string, content string, lang string", ("app/cart.py", "class Cart:\n    def total(self): pass\n", "python"), ("app/shop.py", "from app.cart import Cart\n\ndef pay(cart: Cart):\n    return Cart()\n", "python"), ("tests/test_cart.py", "from app import cart\n", "python"),
        ("docs/a.md", "The Cart has a total.\nNothing.\nCart again\n", "unknown"), ("docs/b.md", "no match here\n", "unknown"), ("web/s.css", ".basket { }\n#top { }\n", "css"), ("web/p.html", '<div class="basket">x</div>\n', "html"), ("web/q.html", '<p id="top">y</p>\n', "html"), ("web/u.js", "document.querySelector('.basket')\n", "javascript"),
    )


@case("ref_type string, path string, line long", ("caller", "app/shop.py", 1), ("type_hint", "app/shop.py", 3), ("caller", "app/shop.py", 4), ("caller", "docs/a.md", 1), ("caller", "docs/a.md", 3))
def case_static_references(spark: SparkSession) -> DataFrame:
    files = project(spark)
    return impact.static_references(files, symbols.tags(symbols.structure(files)), ["Cart"])


@case("source string, path string, identifier string", ("web/s.css", "web/p.html", "basket"), ("web/s.css", "web/q.html", "top"), ("web/p.html", "web/s.css", "basket"), ("web/p.html", "web/u.js", "basket"))
def case_markup_references(spark: SparkSession) -> DataFrame:
    return impact.markup_references(project(spark), ["web/s.css", "web/p.html"])


@case("path string, need string", ("app/shop.py", "must_verify"), ("tests/test_cart.py", "must_verify"), ("docs/a.md", "should_verify"))
def case_analyze(spark: SparkSession) -> DataFrame:
    files = project(spark)
    return impact.analyze(files, symbols.tags(symbols.structure(files)), ["app/cart.py"], 'Change "Cart" total')["envelope"]


@case("mode string, n long", ("relaxed_markup", 2), ("standard", 0))
def case_analyze_mode(spark: SparkSession) -> DataFrame:
    files = project(spark)
    tags = symbols.tags(symbols.structure(files))
    a, b = impact.analyze(files, tags, ["web/s.css"], "x"), impact.analyze(files, tags, ["web/u.js"], "zzzz")
    return a["cross_references"].agg(F.count("*").alias("n")).select(F.lit(a["mode"]).alias("mode"), "n").unionByName(b["references"].agg(F.count("*").alias("n")).select(F.lit(b["mode"]).alias("mode"), "n"))


@case("path string, match_count long, samples string", ("docs/a.md", 3, "Cart@1: The Cart has a total.|Cart@3: Cart again|total@1: The Cart has a total."))
def case_doc_samples(spark: SparkSession) -> DataFrame:
    found = impact.doc_mentions(project(spark), ["Cart", "total"])
    return found.withColumn("samples", F.array_join(F.transform("samples", lambda s: F.concat(s["keyword"], F.lit("@"), s["line"], F.lit(": "), s["text"])), "|"))


@case("pattern string, path string, line_number long", ("Cart", "app/cart.py", 1), ("Cart", "app/shop.py", 1), ("Cart", "app/shop.py", 3), ("Cart", "app/shop.py", 4), ("def ", "app/cart.py", 2), ("def ", "app/shop.py", 3))
def case_search_language(spark: SparkSession) -> DataFrame:
    return search.search(project(spark), ["Cart", "def "], literal=True, languages=["python"])


@case("k long, n long", (0, 3), (1, 1), (2, 3), (3, 1))
def case_search_edges(spark: SparkSession) -> DataFrame:
    """Patterns that look around or ask for a line's ends find what they would find line by line."""
    d = rows(spark, "path string, content string", ("a", "foo\nbar foo\nfoo bar"))
    found = [search.search(d, p).agg(F.count("*").alias("n")).withColumn("k", F.lit(k)) for k, p in enumerate(["foo", r"^foo$", r"foo(?!\S)", r"foo\Z(?<=^foo)"])]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@case("error string", ("Maximum 5 patterns, not 6",))
def case_pattern_guard(spark: SparkSession) -> DataFrame:
    try:
        search.patterns_of([str(k) for k in range(6)])
        said = None
    except ValueError as e:
        said = str(e)
    return rows(spark, "error string", (said,))


@case("tool string, file string, start_line long, snippet string", ("search_text", "app/cart.py", 2, "    def total(self): pass"), ("search_text", "docs/a.md", 1, "The Cart has a total."), ("find_definitions", "app/cart.py", 2, "total"), ("find_references", "docs/a.md", 1, "The Cart has a total."))
def case_execute(spark: SparkSession) -> DataFrame:
    files = project(spark)
    nodes = symbols.structure(files)
    return router.execute(router.Corpus(files, nodes, symbols.tags(nodes)), ["search_text", "find_definitions", "find_references", "unknown"], "total")


@case("tool string, priority long", ("find_definitions", 5), ("search_text", 4), ("get_symbols", 3), ("find_references", 2), ("analyze_structure", 1))
def case_plan_steps(spark: SparkSession) -> DataFrame:
    d = rows(spark, "target_feature string, trigger_condition string, observed_issue string, desired_action string, intent string, first_query boolean", (None, "", None, None, "MODIFY", False))
    return router.plan(d).select(F.explode("steps").alias("s")).select("s.*")


# --- state ---


@case("path string", ("a",), ("new",))
def case_invalidated(spark: SparkSession) -> DataFrame:
    changed = rows(spark, "path string, change string", ("a", "unchanged"), ("b", "modified"), ("c", "deleted"))
    return sync.invalidated(rows(spark, "path string", ("a",), ("b",), ("c",), ("new",)), changed)


@case("path string, hit boolean", ("a", True), ("b", False), ("c", False))
def case_cache(spark: SparkSession) -> DataFrame:
    files = rows(spark, "path string, hash string", ("a", "1"), ("b", "2"), ("c", "3"))
    hits, misses = symbols.cached(files, rows(spark, "path string, hash string, language string", ("a", "1", None), ("b", "x", None), ("c", "3", "php")))
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


@case("k long, due boolean, rules string", (0, True, "new"), (1, False, None), (2, True, "modified"))
def case_due(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, last string, now string, h string, was string", (0, None, "2024-01-01 10:00:00", "x", ""), (1, "2024-01-01 09:30:00", "2024-01-01 10:00:00", "x", "x"), (2, "2024-01-01 08:00:00", "2024-01-01 10:00:00", "y", "x"))
    at = lambda c: F.to_timestamp(c)
    return d.select("k", sync.due(at("last"), at("now"), 1.0).alias("due"), sync.rules_change(F.col("h"), F.col("was")).alias("rules"))


@case("id string, seconds double", ("a", 1.5), ("b", None))
def case_call_durations(spark: SparkSession) -> DataFrame:
    d = rows(spark, "id string, started_at string, completed_at string", ("a", "2024-01-01 00:00:00", "2024-01-01 00:00:01.5"), ("b", "2024-01-01 00:00:00", None))
    return logs.call_durations(d).withColumnRenamed("duration_seconds", "seconds")


def synced(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run over a project of which one file is as it was, one has changed, one is new, one can't be read and one has gone."""
    files = rows(spark, "path string, content string, hash string, mtime long, lang string", ("a.py", "def a(): pass\n", "1", 1, "python"), ("b.py", "def b2(): pass\n\ndef b3(): pass\n", "2x", 2, "python"), ("c.txt", "one\ntwo", "3", 3, "unknown"), ("e.py", None, "5", 5, "python"))
    state = rows(spark, "path string, hash string, mtime long, indexed_at string, chunk_count long", ("a.py", "1", 1, "t0", 2), ("b.py", "2", 1, "t0", 2), ("d.py", "4", 1, "t0", 1))
    old = chunks.chunk(rows(spark, "path string, content string, lang string", ("a.py", "def a(): pass\n", "python"), ("b.py", "def b(): pass\n", "python"), ("d.py", "x = 1", "python")))
    return sync.run(files, state, old, F.lit("t1"))


@case("id string", ("a.py:module:1",), ("a.py:a:1",), ("b.py:module:1",), ("b.py:b2:1",), ("b.py:b3:3",), ("c.txt:lines_1-2:1",))
def case_sync_chunks(spark: SparkSession) -> DataFrame:
    return synced(spark)[0]


@case("path string, hash string, mtime long, indexed_at string, chunk_count long", ("a.py", "1", 1, "t0", 2), ("b.py", "2x", 2, "t1", 3), ("c.txt", "3", 3, "t1", 1), ("e.py", "5", 5, "t1", 0))
def case_sync_state(spark: SparkSession) -> DataFrame:
    return synced(spark)[1]


@case("added long, modified long, deleted long, unchanged long, total_processed long, has_changes boolean, errors long", (2, 1, 1, 1, 4, True, 1))
def case_sync_counts(spark: SparkSession) -> DataFrame:
    return synced(spark)[2]


@case("path string, chunk_count long", ("test0.py", 2), ("test1.py", 2), ("missing.py", 0))
def case_chunk_counts(spark: SparkSession) -> DataFrame:
    files = rows(spark, "path string, content string, lang string", *((f"test{i}.py", f"def func{i}(): pass\n", "python") for i in range(5)))
    return sync.chunk_counts(files, chunks.chunk(files), ["test0.py", "test1.py", "missing.py", "test0.py"])


@case("type string, path string, change string", ("design_docs", "docs/new.md", "new"), ("design_docs", "docs/arch.md", "modified"), ("project_rules", "CLAUDE.md", "modified"), ("project_rules", "RULES.md", "new"))
def case_context_updates(spark: SparkSession) -> DataFrame:
    docs = rows(spark, "path string, hash string", ("docs/new.md", "1"), ("docs/arch.md", "2"), ("docs/same.md", "3"), ("docs/empty.md", "4"))
    was = rows(spark, "path string, content_hash string", ("docs/arch.md", "old_hash_12345678"), ("docs/same.md", "3"), ("docs/empty.md", ""))
    ruled = rows(spark, "path string, hash string", ("CLAUDE.md", "n"), ("RULES.md", "n"), ("same.md", "n"))
    return sync.context_updates(docs, was, ruled, rows(spark, "path string, content_hash string", ("CLAUDE.md", "o"), ("RULES.md", ""), ("same.md", "n")))


@case("branch string, base_branch string, stale boolean", ("llm_task_s1_from_main", "main", True))
def case_branch_of(spark: SparkSession) -> DataFrame:
    d = rows(spark, "branch string, checked_out boolean", ("llm_task_s1_from_main", False), ("llm_task_s10_from_main", True), ("llm_task_s1_from_zeta", False))
    p = X.parse_task_branch(F.col("branch"))
    branches = d.select("branch", p["session_id"].alias("session_id"), p["base_branch"].alias("base_branch"), "checked_out")
    return S.branch_of(S.stale_branches(branches), "s1").withColumn("stale", ~F.col("checked_out"))


@case("name string, rank long", ("cartTotal", 1), ("cart_total", 2))
def case_symbol_ranking(spark: SparkSession) -> DataFrame:
    """Names are compared by their words; equal ones stay in the order given."""
    names = rows(spark, "pos long, name string", (0, "orderList"), (1, "cartTotal"), (2, "cart_total"), (3, "zebra"))
    asked = vectors.embed_symbols(rows(spark, "name string", ("cart total",)), dims=256).select(F.col("embedding").alias("q"))
    return vectors.rank_symbols(vectors.embed_symbols(names, dims=256).join(F.broadcast(asked)), F.col("q"), 2).select("name", "rank")


@case("k string", ("a",))
def case_deleted(spark: SparkSession) -> DataFrame:
    return sinks.without(rows(spark, "k string", ("a",), ("b",), ("b",)), rows(spark, "k string", ("b",), ("z",)), ["k"])


@case("id string", ("z",), ("a",))
def case_chunk_lookup(spark: SparkSession) -> DataFrame:
    return vectors.by_ids(rows(spark, "id string", ("a",), ("b",), ("z",)), ["z", "gone", "a", "z"])


@case("id string, content string, meta string", ("a", "new", '{"k":"v"}'), ("b", "old", "{}"), ("c", "more", '{"source":"agreement","doc_id":"c"}'))
def case_map_upsert(spark: SparkSession) -> DataFrame:
    schema = "id string, content string, metadata map<string,string>"
    found = agreements.map_upsert(rows(spark, schema, ("a", "was", {}), ("b", "old", {})), rows(spark, schema, ("a", "new", {"k": "v"}), ("c", "more", None)))
    return found.select("id", "content", F.to_json("metadata").alias("meta"))


@case("id string, content string, added long, errors long", ("x.y", "A", 2, 1), ("z", "B", 2, 1))
def case_map_sync(spark: SparkSession) -> DataFrame:
    old = rows(spark, "id string, content string, metadata map<string,string>", ("z", "was", {}))
    found, done = agreements.map_sync(old, rows(spark, "path string, content string", ("agreements/x.y.md", "A"), ("z.md", "B"), ("bad.md", None), ("no.txt", "C")))
    return found.join(F.broadcast(done))


@case(
    "file string, content string, symbols string",
    ("20240102_030405_cart_total.md", "---|doc_type: agreement|nl_term: cart total|symbols: [\"Cart\", \"total\"]|similarity: 0.86|session_id: s1|created_at: 2024-01-02T03:04:05|---||# cart total → Cart, total||## 根拠 (Code Evidence)||seen||## 関連シンボル||- `Cart`|- `total`|", '["Cart", "total"]'),
)
def case_agreement_added(spark: SparkSession) -> DataFrame:
    d = rows(spark, "nl_term string, symbols array<string>, code_evidence string, session_id string, similarity double, at string", ("cart total", ["Cart", "total"], "seen", "s1", 0.857, "2024-01-02 03:04:05"))
    found = agreements.added(d.withColumn("created_at", F.to_timestamp_ntz("at")))
    return found.select("file", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"), F.col("metadata")["symbols"].alias("symbols"))


@case("request_id long, symbol string, cached boolean, similarity double, rank long", (1, "A", True, 1.0, 1), (1, "B", False, 0.707, 2), (1, "D", True, -1.0, None))
def case_validated(spark: SparkSession) -> DataFrame:
    q = rows(spark, "request_id long, term string, query array<double>", (1, "cart", [1.0, 0.0]))
    s = rows(spark, "request_id long, symbol string, embedding array<double>", (1, "A", [2.0, 0.0]), (1, "B", [1.0, 1.0]), (1, "C", [0.0, 1.0]), (1, "D", [-1.0, 0.0]))
    return vectors.validated(q, s, rows(spark, "nl_term string, symbol string", ("cart", "A"), ("cart", "D"), ("cart", "D"), ("other", "C")), 2)


# --- sessions and gates ---


@case("session_id string, phase string, gate_level string, n_tools long, calls long", ("s1", "EXPLORATION", "high", len(gates.ALLOWED["EXPLORATION"]), 2), ("session_20240102_030405", "READY", "high", 2, 0), ("s3", "READY", "none", 2, 1))
def case_sessions(spark: SparkSession) -> DataFrame:
    d = rows(spark, "session_id string, intent string, query string, gate_level string, t string", ("s1", "MODIFY", "q", None, "2024-01-01 00:00:00"), (None, "QUESTION", "q", "high", "2024-01-02 03:04:05"), ("s3", "IMPLEMENT", "q", "none", "2024-01-01 00:00:00"))
    found = sessions.status(sessions.created(d.withColumn("at", F.to_timestamp_ntz("t"))), rows(spark, "session_id string", ("s1",), ("s1",), ("s3",)))
    return found.select("session_id", "phase", "gate_level", F.size("allowed_tools").alias("n_tools"), F.col("tool_calls_count").alias("calls"))


@case("k long, mode string, phase string, branch boolean", (0, "normal", "EXPLORATION", True), (1, "skip_branch", "EXPLORATION", False), (2, "skip_exploration", "READY", False), (3, "resume", "VERIFICATION", False), (4, "normal", "READY", True))
def case_begun(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, intent string, gate_level string, skip_branch boolean, skip_exploration boolean, resume string", (0, "MODIFY", "high", False, False, None), (1, "MODIFY", "high", True, False, None), (2, "MODIFY", "high", False, True, None), (3, "MODIFY", "high", False, False, "VERIFICATION"), (4, "QUESTION", "high", False, False, None))
    return sessions.begun(d)


@case("intent string, allowed boolean, next string", ("INVESTIGATE", False, "submit_for_review"), ("MODIFY", True, "submit_verification"))
def case_write_intent(spark: SparkSession) -> DataFrame:
    return rows(spark, "intent string, phase string", ("INVESTIGATE", "READY"), ("MODIFY", "VERIFICATION")).select("intent", sessions.write_error(F.col("intent")).isNull().alias("allowed"), sessions.next_instruction(F.col("phase")).alias("next"))


@case(
    "k long, next_phase string, confidence string, missing string",
    (0, "IMPACT_ANALYSIS", "high", ""),
    (1, "SEMANTIC", "low", "symbols_identified: 2/3; required_tools: missing find_references; consistency: duplicate symbols detected: 2 given, 1 unique; nl_symbol: 'order' not linked to any symbol; Slot 'target_feature' is still HYPOTHESIS."),
    (2, "READY", None, ""),
)
def case_submitted(spark: SparkSession) -> DataFrame:
    both = list(gates.REQUIRED_TOOLS)
    schema = "k long, phase string, intent string, risk string, symbols_identified array<string>, entry_points array<string>, files_analyzed array<string>, existing_patterns array<string>, tools array<string>, evidenced array<string>, terms array<string>, slot_source map<string,string>"
    d = rows(
        spark, schema, (0, "EXPLORATION", "MODIFY", "LOW", ["Cart", "Item", "Total"], ["Cart.add()"], ["a.py", "b.py"], ["p"], both, [], ["cart"], {"target_feature": "FACT"}),
        (1, "EXPLORATION", "MODIFY", "LOW", ["Cart", "Cart"], ["Cart.add()"], ["a.py", "b.py"], ["p"], both[:1], [], ["order", "cart"], {"target_feature": "HYPOTHESIS"}), (2, "READY", "MODIFY", "LOW", [], [], [], [], [], [], [], {}),
    )
    found = sessions.submitted(d.withColumn("mapped", F.array().cast("array<struct<name:string,source:string>>")))
    return found.select("k", "next_phase", F.col("evaluated_confidence").alias("confidence"), F.array_join("missing", "; ").alias("missing"))


@case("k long, explored string, blocked string", (0, "a,b,c", None), (1, "a", "Tool 'semantic_search' is not allowed in phase READY2"))
def case_explored(spark: SparkSession) -> DataFrame:
    d = rows(spark, "k long, old array<string>, new array<string>, phase string, tool string", (0, ["a", "b"], ["b", "c"], "SEMANTIC", "semantic_search"), (1, ["a"], ["a"], "READY2", "semantic_search"))
    return d.select("k", listed(gates.add_explored(F.col("old"), F.col("new"))).alias("explored"), gates.blocked_reason(F.col("phase"), F.col("tool")).alias("blocked"))


@case("path string, kind string", ("a", "verified"), ("c", "reviewed"))
def case_reasons_missing(spark: SparkSession) -> DataFrame:
    v = rows(spark, "path string, status string, reason string", ("a", "no_change_needed", " "), ("b", "will_modify", None), ("d", "not_affected", "because"))
    r = rows(spark, "path string, decision string, reason string", ("c", "discard", None), ("e", "keep", None), ("f", "discard", "junk"))
    return impact.reason_missing(v, F.col("status"), F.col("reason")).select("path", F.lit("verified").alias("kind")).unionByName(gates.discard_reasons_missing(r).select("path", F.lit("reviewed").alias("kind")))


@case("name string, n long", ("a", 3), ("b", 1))
def case_calls(spark: SparkSession) -> DataFrame:
    """Calls as the scanner sees them: strings, comments and nesting aside."""
    found = scan.Scan("a(1, b('x(', \"y)\"), /* c( */ [2]); a(); // d()\nif (a(1)) {}", "javascript").calls()
    return rows(spark, "name string", *((c.name,) for c in found if c.name in "abcd")).groupBy("name").agg(F.count("*").alias("n"))
