"""What a change touches: references, names by convention, markup that shares identifiers, documents that mention it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import symbols as S
from quarry.sources.files import DOCUMENT_EXTENSIONS
from quarry.sources.sinks import first_by

MOST_FILES, SAMPLES, MOST_KEYWORDS = 20, 3, 10
# Names that follow from a base name, by kind of file.
CONVENTIONS = {
    "test": ("**/*{}*Test.*", "**/*{}*test.*", "**/test_*{}*.*", "**/tests/**/*{}*.*"),
    "factory": ("**/*{}Factory.*", "**/*{}*factory.*", "**/factories/*{}*.*"),
    "seeder": ("**/*{}Seeder.*", "**/*{}*seeder.*", "**/seeders/*{}*.*"),
}


def naming_matches(files: DataFrame, bases: list[str]) -> DataFrame:
    """(base, kind, path): files whose path fits a convention for a base name; one pass over the paths for all."""
    found = [F.when(F.rlike("path", F.lit("|".join(X.glob_regex(g.format(b), across=False) for g in globs))), F.struct(F.lit(b).alias("base"), F.lit(kind).alias("kind"))) for b in bases for kind, globs in CONVENTIONS.items()]
    if not found:
        return files.select(F.lit("").alias("base"), F.lit("").alias("kind"), "path").limit(0)
    return files.select("path", F.explode(F.array_compact(F.array(*found))).alias("m")).select("m.base", "m.kind", "path").distinct()


def static_references(files: DataFrame, tags: DataFrame, symbols: list[str]) -> DataFrame:
    """(symbol, ref_type, path, line, content): type hints and callers, each place once."""
    each = [S.find_references(files, tags, s).withColumn("symbol", F.lit(s)).withColumn("ref_type", F.when(X.type_hint(F.col("content"), s), "type_hint").otherwise("caller")) for s in symbols]
    return first_by(reduce(DataFrame.unionByName, each), ["path", "line"], ["symbol"]).select("symbol", "ref_type", "path", "line", "content")


def _mentions(word: str) -> Column:
    """The lines (line, text, lower) that hold a word."""
    hit = F.filter("lines", lambda s: F.contains(s["lower"], F.lit(word.lower())))
    return F.transform(hit, lambda s: F.struct(F.lit(word).alias("keyword"), s["line"].alias("line"), s["text"].alias("text")))


def doc_mentions(files: DataFrame, words: list[str], key: str = "path", content: str = "content", documents_only: bool = True, most: int = MOST_FILES) -> DataFrame:
    """(key, match_count, keywords, samples): documents by how many pairs of keyword and line they have, case aside.

    Lines stay in their document's row: nothing is paired across rows and only the top is gathered.
    """
    words = list(dict.fromkeys(words))[:MOST_KEYWORDS]
    rows = files.filter(X.extension(F.col(key)).isin(*DOCUMENT_EXTENSIONS)) if documents_only else files
    numbered = F.transform(X.lines(F.col(content)), lambda x, i: F.struct((i + 1).alias("line"), F.substring(F.trim(x), 1, 80).alias("text"), F.lower(x).alias("lower")))
    each = [_mentions(w) for w in words]
    hits = rows.select(key, numbered.alias("lines")).select(key, (F.concat(*each) if each else F.array().cast("array<struct<keyword:string,line:int,text:string>>")).alias("hits")).filter(F.size("hits") > 0)
    return hits.select(key, F.size("hits").cast("long").alias("match_count"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["keyword"]))).alias("keywords"), F.slice("hits", 1, SAMPLES).alias("samples")).orderBy(F.col("match_count").desc(), key).limit(most)


#: Different identifiers that are looked for in each file at once, at most; with more, files' runs are laid against them.
FEW = 64
#: Runs of characters that names are made of.
RUN = r"(?U)[\w-]+"


def cross_references(files: DataFrame, sources: DataFrame, kinds: tuple[str, ...], identifiers: int = 5, most: int = 10, key: str = "path", content: str = "content", source_key: str = "path") -> DataFrame:
    """(source, key, identifier): files of the given kinds that contain an identifier of a source, the first one for each file.

    sources(source_key, identifiers) are the targets of a change. A target isn't its own
    reference; for each source the first files by name stay. All joins are on equal keys: an
    identifier is found by its longest run of name characters, which lies within a run of the
    file's; the pieces of so many characters of each different run are laid against it. What an
    identifier has besides is looked for in the content. One without such a run isn't looked for. Up to FEW different
    identifiers are tried on each file as it is read, which gives the same rows.
    """
    each = sources.select(F.col(source_key).alias("source"), F.posexplode(F.slice("identifiers", 1, identifiers)).alias("place", "identifier"))
    longest = F.array_max(F.transform(X.all_matches(F.col("identifier"), RUN), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    asked = each.withColumn("piece", longest).filter("piece is not null")
    rows = files.filter(X.extension(F.col(key)).isin(*kinds)) if kinds else files
    rows = rows.filter(F.col(key).isNotNull())
    few = [r["identifier"] for r in asked.select("identifier").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:  # looked for in each file as it is read
        named = F.filter(F.array(*(F.lit(x) for x in few)).cast("array<string>"), lambda i: F.contains(F.col(content), i))
        return _first_files(_firsts(rows.select(key, F.explode(named).alias("identifier")), "identifier", key, most), asked, key, most)
    runs = rows.select(key, F.explode(F.array_distinct(X.all_matches(F.col(content), RUN))).alias("run"))
    names = asked.select("piece", "identifier").distinct()

    def held_by(runs: DataFrame, names: DataFrame) -> DataFrame:
        """(key, identifier): the files whose runs hold the pieces of names."""
        sizes = F.broadcast(names.agg(F.array_sort(F.collect_set(F.length("piece"))).alias("sizes")))
        pieces = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("run")), lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n))))
        holding = runs.select("run").distinct().join(sizes).select("run", F.explode(F.array_distinct(pieces)).alias("piece")).join(names, "piece")
        return runs.join(holding.select("run", "identifier"), "run").select(key, "identifier")

    # The first files of an identifier that is a piece are the first files of a run with it, too.
    met = _firsts(held_by(_firsts(runs, "run", key, most), names.filter("piece = identifier")), "identifier", key, most)
    unsure = names.filter("piece <> identifier")
    if unsure.limit(1).count():
        checked = held_by(runs, unsure).distinct().join(rows.select(key, content), key).filter(F.contains(content, F.col("identifier")))
        met = met.unionByName(_firsts(checked.select(key, "identifier"), "identifier", key, most))
    return _first_files(met, asked, key, most)


def _firsts(found: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Of found(key, by) the first files by name of each: one more than a source can have, as a source isn't its own reference.

    A file that is among the first of a source is among these for each identifier of the source that it holds: else so
    many come before it. Tasks leave that many of each before anything is shuffled (a rank below a limit is pushed down),
    so no identifier's files meet its sources.
    """
    w = Window.partitionBy(by).orderBy(key)
    return found.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= most + 1).drop("_r").distinct()


def _first_files(met: DataFrame, asked: DataFrame, key: str, most: int) -> DataFrame:
    """(source, key, identifier): of the files met(key, identifier) the first identifier of each file, and of each source the first files by name."""
    pairs = asked.select("source", "place", "identifier").join(met, "identifier").filter(F.col(key).cast("string") != F.col("source").cast("string"))
    found = pairs.groupBy("source", key).agg(F.min_by("identifier", "place").alias("identifier"))
    w = Window.partitionBy("source").orderBy(key)
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def markup_references(files: DataFrame, targets: list[str]) -> DataFrame:
    """Style sheets to pages, and pages to style sheets and scripts, by shared identifiers."""
    is_css = X.extension(F.col("path")).isin(".css", ".scss", ".sass", ".less")
    own = files.filter(F.col("path").isin(*targets)).select("path", is_css.alias("css"), X.file_identifiers(F.col("content"), is_css).alias("identifiers"))
    pages = cross_references(files, own.filter("css"), (".html", ".htm"))
    return pages.unionByName(cross_references(files, own.filter("not css"), (".css", ".scss", ".sass", ".less", ".js")))


def envelope(references: DataFrame, names: DataFrame, mentions: DataFrame, targets: list[str]) -> DataFrame:
    """(path, need): must for files with references, should for conventions and documents; targets are left out."""
    must = references.select("path").distinct().withColumn("need", F.lit("must_verify"))
    should = names.select("path").unionByName(mentions.select("path")).distinct().join(must, "path", "left_anti").withColumn("need", F.lit("should_verify"))
    return must.unionByName(should).filter(~F.col("path").isin(*targets))


def analyze(files: DataFrame, tags: DataFrame, targets: list[str], description: str) -> dict[str, DataFrame | str]:
    """All of it. Where all targets are plain markup only shared identifiers are looked for (mode relaxed_markup)."""
    import os

    logic = (".blade.php", ".vue", ".jsx", ".tsx")
    if targets and all(t.lower().endswith(X.PLAIN_MARKUP) and not t.lower().endswith(logic) for t in targets):
        return {"mode": "relaxed_markup", "cross_references": markup_references(files, targets)}
    spark = files.sparkSession
    one = spark.range(1).select(F.lit(description).alias("d"), F.array(*(F.lit(t) for t in targets)).alias("t"))
    r = one.select(X.keywords(F.col("d"), F.col("t")).alias("k"), F.transform("t", X.base_name).alias("b")).first()
    bases = [b for b in dict.fromkeys(r["b"]) if b]
    references = static_references(files, tags, bases or [os.path.basename(targets[0])]).filter(~F.col("path").isin(*targets))
    names, mentions = naming_matches(files, bases), doc_mentions(files, r["k"])
    return {"mode": "standard", "references": references, "naming": names, "mentions": mentions, "envelope": envelope(references, names, mentions, targets)}


def unverified(must: DataFrame, verified: DataFrame, key: str = "path") -> DataFrame:
    """What must be verified and hasn't been."""
    return must.select(key).distinct().join(verified.select(key), key, "left_anti")


def reason_missing(verified: DataFrame, status: Column, reason: Column) -> DataFrame:
    """Verified files that need a reason and have none."""
    return verified.filter((status != "will_modify") & (F.length(F.trim(F.coalesce(reason, F.lit("")))) == 0))
