"""Sources: files, lines, JSON, front matter, configuration, version control."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X

# What an incremental scan takes, and what it leaves out.
EXTENSIONS = (".py", ".php", ".js", ".ts", ".tsx", ".jsx", ".blade.php", ".json")
EXCLUDES = ["**/node_modules/**", "**/__pycache__/**", "**/venv/**", "**/vendor/**", "**/.git/**"]
# What a search for definitions leaves out wherever it stands in a path.
SYMBOL_EXCLUDES = ("venv", ".venv", "node_modules", "__pycache__", ".git", ".svn", "dist", "build", ".tox", ".eggs")
# Extensions by name of a file type.
FILE_TYPES = {"py": (".py", ".pyi"), "js": (".js", ".jsx", ".mjs"), "ts": (".ts", ".tsx"), "php": (".php",), "html": (".html", ".htm"), "css": (".css", ".scss"), "md": (".md", ".markdown"), "json": (".json",)}
DOCUMENT_EXTENSIONS = (".md", ".markdown", ".rst", ".txt")


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(path, content, hash, ext, lang, mtime) of the files below root; content is decoded tolerantly.

    Paths are filtered before contents are read, and each file comes once.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    rel = F.regexp_replace(path, "^.*?" + X.re.escape(os.path.basename(root.rstrip("/"))) + "/", "")
    keep = ~X.excluded(rel, excludes or [])
    if extensions:
        keep = keep & F.rlike(rel, F.lit("(?i)(?:" + "|".join(map(X.re.escape, extensions)) + ")$"))
    return found.filter(keep).select(
        rel.alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        X.content_hash(F.col("content")).alias("hash"),
        X.extension(rel).alias("ext"),
        X.language_of(rel).alias("lang"),
        F.col("modificationTime").alias("mtime"),
    )


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out: the last that fits decides, ! takes back, a slash inside anchors, one at the end means folders."""
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
        body = X.glob_regex(rule.strip("/"), across=False)[1:-1]
        regex = f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"
        out = F.when(F.rlike(path, F.lit(regex)), F.lit(not back)).otherwise(out)
    return out


def ignore_regex(line: str | None) -> str | None:
    """What a rule of an ignore file means for paths as seen from its folder; null for blank lines and comments."""
    rule = (line or "").rstrip().removeprefix("!")
    if not rule or (line or "").startswith("#"):
        return None
    return f"^{'' if '/' in rule.rstrip('/') else '(?:.*/)?'}{X.glob_regex(rule.strip('/'), across=False)[1:-1]}$"


#: Rules that are sent to every worker at most.
MOST_RULES = 100_000


def ignored_by_files(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of paths(path), by rules(folder, line, rule): the lines of the ignore files found in any folder.

    Of the rules of all folders above that fit, the last line of the deepest folder decides; ! takes back. What is in an
    ignored folder is ignored, whatever else is said. The folder of the topmost ignore file is ''. Each different folder is
    judged once, for all files below it.
    """
    read = F.pandas_udf(lambda lines: lines.map(ignore_regex), "string", F.PandasUDFType.SCALAR)
    known = rules.withColumn("regex", read("rule")).filter("regex IS NOT NULL").select("folder", "line", "regex", F.startswith(F.col("rule"), F.lit("!")).alias("back"), F.endswith(F.rtrim("rule"), F.lit("/")).alias("folders"))
    known = F.broadcast(known) if known.limit(MOST_RULES + 1).count() <= MOST_RULES else known
    above = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.split(c, "/", -1)) - 1), lambda i: F.array_join(F.slice(F.split(c, "/", -1), 1, i), "/"))
    files = paths.select("path").filter("path IS NOT NULL").distinct()
    folders = files.select(F.explode(above(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    each = files.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    seen = each.select("path", "is_folder", F.explode(above(F.col("path"))).alias("folder")).join(known, "folder")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("folder") + 2, F.length("path")))
    fits = seen.filter((F.col("is_folder") | ~F.col("folders")) & F.rlike(rest, F.col("regex")))
    last = F.max_by(~F.col("back"), F.struct(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/", -1))), F.col("line")))
    judged = fits.groupBy("path", "is_folder").agg(last.alias("gone"))
    gone = judged.filter("gone")
    inside = files.select("path", F.explode(above(F.col("path"))).alias("folder")).join(gone.filter("is_folder").select(F.col("path").alias("folder")), "folder", "left_semi").select("path")
    out = gone.filter("NOT is_folder").select("path").unionByName(inside).distinct().withColumn("ignored", F.lit(True))
    return paths.select("path").join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def searched(files: DataFrame, rules: list[str]) -> DataFrame:
    """Files that a text search looks at: not ignored, and no hidden file or folder in the path."""
    return files.filter(~ignored(F.col("path"), rules) & ~F.rlike("path", F.lit(r"(?:^|/)\.[^/]")))


def of_type(files: DataFrame, file_type: str) -> DataFrame:
    return files.filter(X.extension(F.col("path")).isin(*FILE_TYPES.get(file_type, (f".{file_type}",))))


def list_files(files: DataFrame, pattern: str, file_type: str | None = None) -> DataFrame:
    """(path) of the files whose name or path a glob matches."""
    found = of_type(files, file_type) if file_type else files
    return found.filter(X.glob_match(F.col("path"), pattern) | X.glob_match(X.file_name(F.col("path")), pattern)).select("path")


def symbol_files(files: DataFrame) -> DataFrame:
    """Files that a search for definitions looks at."""
    keep = F.lit(True)
    for part in SYMBOL_EXCLUDES:
        keep = keep & ~F.contains(F.col("path"), F.lit(part))
    return files.filter(keep)


def lines_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line_number, line_content), line numbers from 1."""
    return files.select(F.col(key), F.posexplode(X.lines(F.col(content))).alias("n", "line_content")).select(key, (F.col("n") + 1).alias("line_number"), "line_content")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A whole-file document; a broken or missing one is empty."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a JSONL file with their order (seq); blank and broken lines are skipped."""
    raw = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    parsed = raw.select("seq", F.from_json("value", schema.add("_broken", "string") if "_broken" not in schema.names else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.filter("r is not null and r._broken is null").select("seq", *(F.col(f"r.{n}").alias(n) for n in schema.names if n != "_broken"))


def tool_matches(stream: DataFrame, column: str = "value") -> DataFrame:
    """(file, line_number, line_content, submatches) from a search tool's JSON lines: records of type match, broken ones skipped."""
    schema = "type string, data struct<path struct<text string>, line_number int, lines struct<text string>, submatches array<struct<match struct<text string>, start int, `end` int>>>"
    r = stream.select(F.from_json(column, schema).alias("r")).filter("r.type = 'match'")
    subs = F.transform("r.data.submatches", lambda s: F.struct(s["match"]["text"].alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    return r.select(F.col("r.data.path.text").alias("file"), F.col("r.data.line_number").alias("line_number"), F.rtrim(F.col("r.data.lines.text")).alias("line_content"), subs.alias("submatches"))


def front_matter(files: DataFrame) -> DataFrame:
    """(file, path, meta, body) of the Markdown files that begin with ---; meta is a map of `key: value` lines."""
    parts = F.split("content", "---", 3)
    pairs = F.filter(X.lines(parts[1]), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    # Of repeated keys the last holds.
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: entry(x)["k"])), lambda k: F.struct(k, F.element_at(F.filter(F.transform(pairs, entry), lambda e: e["k"] == k), -1)["v"])))
    rows = files.filter(X.extension(F.col("path")).isin(".md") & F.startswith(F.col("content"), F.lit("---")) & (F.size(parts) == 3))
    found = rows.select("path", meta.alias("meta"), F.btrim(parts[2], F.lit(" \n\r\t")).alias("body"))
    return found.select(F.coalesce(F.try_element_at("meta", F.lit("file")), X.file_name(F.col("path"))).alias("file"), F.coalesce(F.try_element_at("meta", F.lit("path")), F.col("path")).alias("path"), "meta", "body")


def read_yaml(path: str) -> dict:
    """A configuration; a missing or broken one is empty. Small, so it is read where the plan is made."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except (OSError, ValueError, ImportError):
        return {}
    except Exception as e:
        if type(e).__module__.startswith("yaml"):
            return {}
        raise


def docs_of(files: DataFrame) -> DataFrame:
    """The files that document a project: Markdown below docs/, else DESIGN*.md, else README.md."""
    path = F.col("path")
    rank = F.when(F.rlike(path, F.lit(r"(?:^|/)docs/.*\.md$")), 1).when(F.rlike(path, F.lit(r"(?:^|/)DESIGN[^/]*\.md$")), 2).when(F.rlike(path, F.lit(r"^README\.md$")), 3)
    ranked = files.withColumn("rank", rank).filter("rank is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("rank").alias("rank"))), "rank").drop("rank")


def git_changes(spark: SparkSession, repo: str, base: str) -> DataFrame:
    """(path, change_type, origin) from version control: committed since base, not committed, and untracked."""

    def lines(*args: str) -> list[str]:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
        return done.stdout.splitlines() if done.returncode == 0 else []

    kinds = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed"}
    rows = [(x.split("\t")[-1], kinds.get(x[0], "modified"), origin) for origin, args in (("committed", (f"{base}...HEAD",)), ("uncommitted", ("HEAD",))) for x in lines("diff", "--name-status", *args) if "\t" in x]
    rows += [(x, "added", "untracked") for x in lines("ls-files", "--others", "--exclude-standard")]
    return spark.createDataFrame(rows, "path string, change_type string, origin string")


def git_branches(spark: SparkSession, repo: str) -> DataFrame:
    """(branch, session_id, base_branch, ahead, checked_out) of task branches; ahead is null where the base is unknown or gone."""

    def git(*args: str) -> list[str]:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
        return done.stdout.split() if done.returncode == 0 else []

    names, here = git("branch", "--list", "llm_task_*", "--format=%(refname:short)"), git("rev-parse", "--abbrev-ref", "HEAD")
    rows = spark.createDataFrame([(x, [x] == here) for x in names], "branch string, checked_out boolean")
    parsed = rows.select("branch", "checked_out", X.parse_task_branch(F.col("branch")).alias("p")).select("branch", "p.session_id", "p.base_branch", "checked_out")
    counts = [(r.branch, int(n[0])) for r in parsed.collect() if r.base_branch and (n := git("rev-list", "--count", f"{r.base_branch}..{r.branch}"))]
    return parsed.join(spark.createDataFrame(counts, "branch string, ahead long"), "branch", "left").select("branch", "session_id", "base_branch", "ahead", "checked_out")


def branch_of(branches: DataFrame, session: str) -> DataFrame:
    """The task branch of a session; of several the first by name."""
    return branches.filter(F.col("session_id") == session).orderBy("branch").limit(1)


def stale_branches(branches: DataFrame) -> DataFrame:
    """Task branches that nobody has checked out."""
    return branches.filter(~F.col("checked_out"))
