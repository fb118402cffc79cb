"""Symbols: extraction, definitions, references and what encloses a line."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import scan
from quarry.operators.search import search
from quarry.operators.spans import enclosing
from quarry.operators.sync import observed

if TYPE_CHECKING:
    import pandas as pd

NODES = "path string, category string, name string, type string, start_line int, end_line int, parameters array<string>, scope string, statement string"


def python_nodes(source: str) -> list[tuple]:
    """(category, name, type, start, end, parameters, scope, statement), in order of the text; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    # What is still to be seen, last first; so nesting of any depth is no recursion.
    left: list[tuple[ast.AST, str, bool]] = [(child, "", False) for child in reversed(tree.body)]
    while left:
        node, scope, in_class = left.pop()
        inner, within = scope, in_class
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            named = [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]
            out.append(("functions", node.name, "member" if in_class else "function", node.lineno, node.end_lineno, [x.arg for x in named], scope, None))
            inner, within = f"{scope}.{node.name}".strip("."), False
        elif isinstance(node, ast.ClassDef):
            out.append(("classes", node.name, "class", node.lineno, node.end_lineno, [], scope, None))
            inner, within = f"{scope}.{node.name}".strip("."), True
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append(("imports", node.names[0].name if node.names else "", "import", node.lineno, node.end_lineno, [], scope, ast.unparse(node)))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and not scope:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    out.append(("other", t.id, "variable", node.lineno, node.end_lineno, [], scope, None))
        left += [(child, inner, within) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def nodes_of(source: str, language: str) -> list[tuple]:
    """Nodes by Python's own parser, or by the scanner for languages with brackets."""
    return python_nodes(source) if language == "python" else scan.nodes(source, language)


def structure(files: DataFrame, path: str = "path", content: str = "content", lang: str = "lang") -> DataFrame:
    """A row for each function, class, import and export of each file. Python's own parser is needed, so files go to workers in batches.

    Parsing takes far longer than reading: files are dealt out first, so that a table in one file keeps all workers busy.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        columns = ["path", "category", "name", "type", "start_line", "end_line", "parameters", "scope", "statement"]
        for b in batches:
            rows = []
            for p, c, k in zip(b.path, b.content, b.lang, strict=True):
                # A file's nodes come from its row alone; of those alike the first stays.
                alike = {(n[0], n[1], n[2], n[3]): n for n in reversed(nodes_of(c, k))} if c is not None else {}
                rows += [(p, *n) for n in reversed(list(alike.values()))]
            yield pd.DataFrame(rows, columns=columns)

    dealt = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col(path).alias("path"), F.col(content).alias("content"), F.col(lang).alias("lang")).repartition(dealt, "path").mapInPandas(run, NODES)


def structure_summary(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, functions, classes, imports, exports, lines)."""
    by = nodes.groupBy("path").agg(*(F.count_if(F.col("category") == c).alias(c) for c in ("functions", "classes", "imports", "exports")))
    return files.select("path", X.line_count(F.col("content")).alias("lines")).join(by, "path", "left").na.fill(0)


def tags(nodes: DataFrame) -> DataFrame:
    """(name, path, line, kind, scope, signature) of what is defined."""
    signature = F.when(F.col("category") == "functions", F.concat(F.lit("("), F.array_join("parameters", ", "), F.lit(")"))).otherwise("")
    return nodes.filter(F.col("category").isin("functions", "classes", "other")).select("name", "path", F.col("start_line").alias("line"), F.col("type").alias("kind"), F.coalesce("scope", F.lit("")).alias("scope"), signature.alias("signature"))


def find_definitions(found: DataFrame, symbol: str, exact: bool = False, name: str = "name") -> DataFrame:
    return found.filter(F.col(name) == symbol if exact else F.contains(F.lower(F.col(name)), F.lit(symbol.lower())))


def of_kind(found: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    return found.filter(F.lower(F.col(column)) == kind.lower())


def find_references(files: DataFrame, found: DataFrame, symbol: str) -> DataFrame:
    """(path, line, content) of the lines that name the symbol as a word and don't define it."""
    lines = search(files, symbol, literal=True, word=True).select("path", F.col("line_number").alias("line"), F.col("line_content").alias("content"))
    return minus_definitions(lines, found.filter(F.col("name") == symbol))


def minus_definitions(references: DataFrame, definitions: DataFrame, keys: tuple[str, str] = ("path", "line")) -> DataFrame:
    return references.join(definitions.select(*keys), list(keys), "left_anti")


def cached(files: DataFrame, cache: DataFrame, language: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files(path, hash) in cache(path, hash, language, ...): a hit has the same path, content and language asked for."""
    asked = F.col("language").eqNullSafe(F.lit(language))
    hits = files.select("path", "hash").join(cache.filter(asked), ["path", "hash"])
    return hits, files.join(hits.select("path"), "path", "left_anti")


def looked_up(files: DataFrame, cache: DataFrame, language: str | None = None) -> tuple[DataFrame, Observation]:
    """files(path, hash) with hit, as cached() has them, and the numbers of hits and misses, which are known when the rows have been computed."""
    good = cache.filter(F.col("language").eqNullSafe(F.lit(language))).select("path", "hash").distinct().withColumn("_hit", F.lit(True))
    found = files.join(good, ["path", "hash"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return observed(found, hits=F.col("hit"), misses=~F.col("hit"))


def latest_tags(nodes: DataFrame, order: str = "line") -> DataFrame:
    """The first tag of each name in a file."""
    w = Window.partitionBy("path", "name").orderBy(order)
    return nodes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
