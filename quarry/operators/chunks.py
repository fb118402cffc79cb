"""Chunks of files: windows of lines, nodes of syntax, and strategies for frameworks."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.scan import Scan
from quarry.operators.symbols import nodes_of
from quarry.sources.files import read_files

if TYPE_CHECKING:
    import pandas as pd

SCHEMA = "id string, compat_id string, type string, name string, file string, content string, line_start int, line_end int, metadata map<string,string>"
COLUMNS = ["id", "compat_id", "type", "name", "file", "content", "line_start", "line_end", "metadata"]


def line_windows(files: DataFrame, size: int = 50, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line_start, line_end, content): windows of size lines, blank ones left out, the last one clipped. Nothing is shuffled."""
    rows = files.select(F.col(key), X.lines(F.col(content)).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(size))
    windows = F.transform(starts, lambda s: F.struct(s.alias("line_start"), F.least(s + size - 1, F.size("lines")).alias("line_end"), F.array_join(F.slice("lines", s, F.lit(size)), "\n").alias("content")))
    return rows.select(key, F.explode(F.filter(windows, lambda w: F.rlike(w["content"], F.lit(r"\S")))).alias("w")).select(key, "w.*")


def module_summary(files: DataFrame, chunks: DataFrame, first: int = 30) -> DataFrame:
    """(path, content, chunk_count, chunk_types): the first lines of each file that has chunks, and what they are."""
    by = chunks.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_set("type")).alias("chunk_types"))
    return files.select("path", F.array_join(F.slice(X.lines(F.col("content")), 1, first), "\n").alias("content")).join(by, "path")


def _text(v: object) -> str | None:
    """A metadata value as text: None goes, lists and maps are JSON."""
    return None if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


def _row(compat: str, kind: str, name: str, file: str, content: str, start: int, end: int, **metadata: object) -> tuple:
    meta = {k: t for k, v in metadata.items() if (t := _text(v)) is not None}
    return (f"{file}:{name}:{start}", compat, kind, name, file, content, start, end, meta)


# Kinds of relations between models, and types that are no dependencies.
RELATIONS = ("hasMany", "belongsTo", "belongsToMany", "hasOne", "morphMany", "morphTo", "morphOne", "hasManyThrough")
PLAIN_TYPES = ("string", "int", "float", "bool", "array", "mixed", "null", "callable")


def _target(kind: str, arguments: str) -> str:
    """The model that a relation leads to."""
    first = Scan(arguments, "php").tokens
    if kind == "morphTo":
        return "dynamic"
    return first[0].text.strip("\\'\"") if first else ""


def _dependencies(parameters: list[str]) -> list[dict[str, str]]:
    """Typed parameters whose types are classes."""
    out = []
    for p in parameters:
        words = [t.text for t in Scan(p, "php").tokens if t.kind == "word"]
        at = next((k for k, w in enumerate(words) if w.startswith("$")), 0)
        if at and words[at - 1].lower() not in (*PLAIN_TYPES, "private", "protected", "public", "readonly"):
            out.append({"class": words[at - 1], "variable": words[at][1:]})
    return out


def php_metadata(source: str) -> dict[str, object]:
    """What a PHP file declares: its class, uses, translatable fields, relations and constructor's dependencies."""
    scan = Scan(source, "php")
    tokens, space, name, uses, fields, relations, depends = scan.tokens, "", "", [], [], [], []
    for k, t in enumerate(tokens):
        if t.kind != "word":
            continue
        following = scan.text(k + 1)
        if t.text == "namespace" and not space:
            space = following
        elif t.text == "class" and not name and scan.text(k - 1) != "::":
            name = following
        elif t.text == "use" and scan.inside[k] < 0 and scan.text(k + 2) in (";", "as"):
            uses.append(following)
        elif t.text == "$translatable" and scan.text(k + 2) == "[":
            fields = [x.strip("'\"") for x in scan.parts(k + 2)]
        elif t.text == "function" and scan.text(k + 2) == "(":
            if following == "__construct":
                depends = _dependencies(scan.parts(k + 2))
            elif (b := scan.body(scan.closes[k + 2] + 1)) is not None:
                # Only what is returned at once.
                call = next((c for c in scan.calls(b, scan.closes[b]) if c.on == "$this" and c.name in RELATIONS), None)
                if call and scan.text(b + 1) == "return":
                    relations.append({"method": following, "type": call.name, "related": _target(call.name, call.arguments)})
    full = f"{space}\\{name}" if space and name else name
    return {"fqcn": full or None, "uses": uses or None, "translatable": fields or None, "relations": relations or None, "dependencies": depends or None}


def syntax_chunks(file: str, source: str, language: str) -> list[tuple]:
    lines = source.split("\n")
    whole = php_metadata(source) if language == "php" else {}
    out = []
    for category, name, kind, start, end, parameters, scope, _ in nodes_of(source, language):
        if category in ("functions", "classes"):
            body = "\n".join(lines[start - 1 : end])
            doc = None
            if language == "python" and (m := re.search(r':\s*\n\s*[rRuU]?("""|\'\'\')(.*?)\1', body, re.S)):
                doc = m[2].strip().split("\n")[0]
            out.append(_row(f"{file}:{name}", kind, name, file, body if len(body) <= 2048 else body[:1000] + X.TRUNCATED + body[-1000:], start, end, scope=scope or None, parameters=parameters or None, docstring=doc, **whole))
    return out


def composer_chunks(file: str, source: str, language: str) -> list[tuple]:
    try:
        d = json.loads(source)
    except ValueError:
        return []
    if not isinstance(d, dict):
        return []
    found = [("require", "dependencies", "production_dependencies", d.get("require")), ("require-dev", "dependencies", "dev_dependencies", d.get("require-dev")), ("autoload", "namespace_mapping", "psr4_autoload", (d.get("autoload") or {}).get("psr-4"))]
    return [_row(f"composer:{k}", kind, name, file, json.dumps(v, indent=2), 1, source.count("\n") + 1, packages=list(v)) for k, kind, name, v in found if isinstance(v, dict) and v]


def _setting(scan: Scan, name: str, opener: str, first: int = 0, last: int | None = None) -> int | None:
    """The bracket that follows `name:`."""
    for k in range(first, len(scan.tokens) if last is None else last):
        if scan.tokens[k].text.strip("'\"") == name and scan.text(k + 1) == ":" and scan.text(k + 2) == opener:
            return k + 2
    return None


def tailwind_chunks(file: str, source: str, language: str) -> list[tuple]:
    scan, end, out = Scan(source, "javascript"), source.count("\n") + 1, []
    if (theme := _setting(scan, "theme", "{")) is not None and scan.within(theme).strip():
        colours = {}
        if (o := _setting(scan, "colors", "{", theme, scan.closes[theme])) is not None:
            for k in range(o, scan.closes[o]):
                if scan.text(k + 1) == ":" and scan.tokens[k + 2].kind == "string" and scan.tokens[k].kind in ("word", "string"):
                    colours[scan.text(k).strip("'\"")] = scan.text(k + 2)[1:-1]
        out.append(_row("tailwind:theme", "theme", "theme", file, scan.within(theme).strip(), 1, end, colors=colours or None))
    if (content := _setting(scan, "content", "[")) is not None:
        out.append(_row("tailwind:content", "content", "content", file, scan.within(content).strip(), 1, end, paths=[p[1:-1] for p in scan.parts(content)]))
    if (plugins := _setting(scan, "plugins", "[")) is not None and scan.within(plugins).strip():
        out.append(_row("tailwind:plugins", "plugins", "plugins", file, scan.within(plugins).strip(), 1, end))
    return out


def migration_chunks(file: str, source: str, language: str) -> list[tuple]:
    """A chunk for each table that is made or changed, with what the calls on its blueprint declare."""
    out = []
    for made in Scan(source, "php").calls():
        if made.on != "Schema" or made.name not in ("create", "table") or not made.strings():
            continue
        columns, indexes, keys = [], [], []
        for call in Scan(made.arguments, "php").calls():
            named = call.strings()
            if call.name in ("index", "unique"):
                indexes += named or ([columns[-1]["name"]] if columns else [])
            elif call.name == "foreign" and named:
                keys.append({"column": named[0], "references": None, "on": None})
            elif call.name in ("references", "on") and keys and named:
                keys[-1][call.name] = named[0]
            elif call.on == "$table" and named:
                columns.append({"name": named[0], "type": call.name})
        table, start, end = made.strings()[0], source.count("\n", 0, made.start) + 1, source.count("\n", 0, made.end) + 1
        out.append(_row(f"migration:{table}", "table", table, file, source[made.start : made.end], start, end, columns=columns or None, indexes=indexes or None, foreign_keys=keys or None))
    return out


# Methods of a resource that are chunks of their own.
RESOURCE_METHODS = ("form", "table", "infolist", "getRelations", "getPages", "getActions", "getBulkActions", "getHeaderActions", "getTableActions", "getFormActions")


def resource_chunks(file: str, source: str, language: str) -> list[tuple]:
    """The class and its telling methods, with the components and actions that they make."""
    out, lines, model = [], source.split("\n"), None
    whole = Scan(source, "php")
    for k, t in enumerate(whole.tokens):
        if t.text == "$model" and whole.text(k + 1) == "=":
            model = whole.text(k + 2).lstrip("\\")
    for category, name, _, start, end, _, _, _ in nodes_of(source, "php"):
        if category == "classes" or name in RESOURCE_METHODS:
            body = "\n".join(lines[start - 1 : end])
            made = [c for c in Scan(body, "php").calls() if c.name == "make" and c.on]
            fields = [{"component": c.on, "name": c.strings()[0]} for c in made if c.strings()]
            actions = [{"type": c.on, "name": (c.strings() or [c.on])[0]} for c in made if c.on.endswith("Action")]
            out.append(_row(f"filament:{name}", "resource" if category == "classes" else "resource_method", name, file, body[:2000], start, end, fields=fields or None, actions=actions or None, model=model))
    return out


def blade_chunks(file: str, source: str, language: str) -> list[tuple]:
    """Sections of a template, or the template, with the routes, components and live components it names."""
    scan = Scan(source, "blade")
    calls, components, sections, open_ = scan.calls(), set(), [], []
    for k, t in enumerate(scan.tokens):
        if t.text == "<" and scan.text(k + 1) == "x" and scan.text(k + 2) == "-":
            name = source[scan.tokens[k + 3].start :].split(">", 1)[0].split() if k + 3 < len(scan.tokens) else []
            words = name[0].rstrip("/").replace(".", "-").split("-") if name else []
            components.add("App\\View\\Components\\" + "".join(w.capitalize() for w in words))
        elif t.text == "@section" and scan.text(k + 1) == "(" and len(scan.parts(k + 1)) == 1:
            open_.append((scan.parts(k + 1)[0].strip("'\""), t.start))
        elif t.text == "@endsection" and open_:
            sections.append((*open_.pop(), t.end))
    named = lambda name: [s for c in calls if c.name == name for s in c.strings()[:1]] or None
    found = {"routes": named("route"), "components": sorted(components) or None, "livewire": named("@livewire")}
    if sections:
        return [_row(f"{file}:{n}", "section", n, file, source[a:z], scan.line(a), scan.line(z), **found) for n, a, z in sorted(sections, key=lambda x: x[1])]
    return [_row(f"{file}:template", "template", "template", file, source, 1, source.count("\n") + 1, **found)] if any(found.values()) else []


def css_chunks(file: str, source: str, language: str) -> list[tuple]:
    """A chunk for each innermost rule, named by its selector."""
    scan, out = Scan(source, "css"), []
    for o, t in enumerate(scan.tokens):
        if t.text != "{" or any(scan.tokens[k].text == "{" for k in range(o + 1, scan.closes[o])):
            continue
        k = o
        while k and scan.text(k - 1) not in ("{", "}", ";"):
            k -= 1
        if k < o:
            first, last = scan.tokens[k].start, scan.tokens[scan.closes[o]].end
            name = source[first : t.start].strip()[:50]
            out.append(_row(f"{file}:{name}", "rule", name, file, source[first:last], scan.line(first), scan.line(last)))
    return out


# Elements that mean something.
SEMANTIC_TAGS = ("section", "article", "nav", "header", "footer", "main", "form", "aside")


class _Elements(HTMLParser):
    """Elements from their start to their own end; what is never closed ends with what holds it."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.size = len(source)
        self.open: list[tuple[str, str | None, int]] = []
        self.found: list[tuple[str, str | None, int, int]] = []
        self.depth: Counter[str] = Counter()
        self.feed(source)
        self.close()
        self.found += [(*e, self.size) for e in self.open]

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs).get("id")
        if own or tag in SEMANTIC_TAGS or tag == "div":
            self.open.append((tag, own, self.at()))
            self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        end = self.at() + len(tag) + 3
        while self.depth[tag]:
            name, own, start = self.open.pop()
            self.depth[name] -= 1
            self.found.append((name, own, start, end))
            if name == tag:
                break


def html_chunks(file: str, source: str, language: str) -> list[tuple]:
    """Elements that mean something: with an id, or sectioning ones."""
    page, out = _Elements(source), []
    for tag, own, start, end in sorted(page.found, key=lambda e: (e[2], -e[3])):
        if own or tag != "div":
            name = own or tag
            out.append(_row(f"{file}:{name}", "element", name, file, source[start:end][:2000], bisect_right(page.starts, start), bisect_right(page.starts, min(end, len(source))), tag=tag))
    return out


Strategy = Callable[[str, str, str], list[tuple]]
#: Strategies by language; more can be registered.
STRATEGIES: dict[str, Strategy] = {
    "python": syntax_chunks, "php": syntax_chunks, "javascript": syntax_chunks, "typescript": syntax_chunks, "vue": syntax_chunks,
    "composer_json": composer_chunks, "tailwind_config": tailwind_chunks, "migration": migration_chunks, "filament_resource": resource_chunks,
    "blade": blade_chunks, "css": css_chunks, "scss": css_chunks, "html": html_chunks,
}


def chunk_file(file: str, source: str, language: str, strategies: dict[str, Strategy], size: int = 50) -> list[tuple]:
    """The strategy's chunks, or windows of lines where it has none; a summary of the module first."""
    found = strategies[language](file, source, language) if language in strategies else []
    lines = source.split("\n")
    if not found:
        parts = [(k + 1, lines[k : k + size]) for k in range(0, len(lines), size)]
        return [_row(f"{file}:lines_{a}-{a + len(p) - 1}", "lines", f"lines_{a}-{a + len(p) - 1}", file, "\n".join(p), a, a + len(p) - 1) for a, p in parts if any(x.strip() for x in p)]
    head = _row(f"{file}:module", "module_summary", "module", file, "\n".join(lines[:30]), 1, min(30, len(lines)), chunk_count=len(found), chunk_types=sorted({r[2] for r in found}))
    return [head, *found]


#: Characters of files whose chunks a worker gathers before it hands them on.
GATHERED = 4 << 20


def _own(file: str, source: str | None, language: str, used: dict[str, Strategy], size: int) -> list[tuple]:
    """A file's chunks, of equal ids the first."""
    seen: dict[str, tuple] = {}
    for r in chunk_file(file, source, language, used, size) if source is not None else []:
        seen.setdefault(r[0], r)
    return list(seen.values())


def chunk(files: DataFrame, strategies: dict[str, Strategy] | None = None, size: int = 50) -> DataFrame:
    """Chunks of files(path, content, lang). A file that can't be chunked has none; the first of equal ids stays."""
    lists = chunk_lists(files.select("path", "content", "lang"), strategies, size)
    return lists.select(F.explode("chunks").alias("c")).select("c.*")


def chunk_lists(files: DataFrame, strategies: dict[str, Strategy] | None = None, size: int = 50) -> DataFrame:
    """files(path, content, lang, ...) with their chunks as a list in place of content and lang: chunks stay in their file's row, so nothing is gathered by file afterwards."""
    used = STRATEGIES if strategies is None else STRATEGIES | strategies
    kept = [c for c in files.columns if c not in ("content", "lang")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first, held, lists = 0, 0, []
            for at, (p, c, k) in enumerate(zip(b.path, b.content, b.lang, strict=True), 1):
                lists.append([dict(zip(COLUMNS, r, strict=True)) for r in _own(p, c, k, used, size)])
                held += len(c or "")
                if held > GATHERED or at == len(b):
                    yield b.iloc[first:at][kept].assign(chunks=lists)
                    first, held, lists = at, 0, []

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept)
    return files.mapInPandas(run, f"{rest}, chunks array<struct<{SCHEMA}>>")


def chunk_folder(spark: SparkSession, root: str, extensions: tuple[str, ...], excludes: list[str], size: int = 50) -> DataFrame:
    """Chunks of the files below a folder."""
    return chunk(read_files(spark, root, extensions, excludes), size=size)
