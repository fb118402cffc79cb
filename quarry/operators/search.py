"""Text search. Lines stay inside their file's row until they match, so a search reads files once and shuffles nothing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

MAX_PATTERNS = 5


def patterns_of(pattern: str | list[str]) -> list[str]:
    """The different patterns, in order; an error above five."""
    found = list(dict.fromkeys([pattern] if isinstance(pattern, str) else pattern))
    if not isinstance(pattern, str) and len(pattern) > MAX_PATTERNS:
        raise ValueError(f"Maximum {MAX_PATTERNS} patterns, not {len(pattern)}")
    return found


def _regex(pattern: str, literal: bool, ignore_case: bool, word: bool) -> str:
    p = X.re.escape(pattern) if literal else pattern
    return f"{'(?i)' if ignore_case else ''}{rf'\b(?:{p})\b' if word else p}"


def submatches(line: Column, regex: str) -> Column:
    """array<struct<match, start, end>>: all matches with their places in characters."""
    found = F.regexp_extract_all(line, F.lit(f"({regex})" if not regex.startswith("(?i)") else f"(?i)({regex[4:]})"), F.lit(1))
    kind = "struct<at:int,out:array<struct<match:string,start:int,`end`:int>>>"

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.instr(F.substring(line, acc["at"] + 1, F.length(line)), m) - 1
        return F.struct((start + F.length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("match"), start.alias("start"), (start + F.length(m)).alias("end")))).alias("out")).cast(kind)

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,`end`:int>>").alias("out")).cast(kind), step, lambda a: a["out"])


def _may_match(content: Column, pattern: str, regex: str, literal: bool, plain: bool) -> Column:
    """Whether the content as a whole has what a matching line has; never false where a line matches.

    Where a pattern looks around, doesn't give back what it has taken, or asks for the ends of the input, a line's
    neighbours could hide a match; all lines are tried then. So they are where nothing can match, as an empty last line isn't
    a line for (?m).
    """
    if plain:
        return F.contains(content, F.lit(pattern))
    if not literal and (re.search(r"\\[AzZG]|[*+?}]\+", pattern) or "(?" in pattern or _takes_nothing(pattern)):
        return F.lit(True)
    flags = "(?im)" if regex.startswith("(?i)") else "(?m)"
    return F.rlike(content, F.lit(flags + regex.removeprefix("(?i)")))


def _takes_nothing(pattern: str) -> bool:
    """Whether an empty line may match; so it is said of what Python can't read."""
    try:
        return bool(re.match(pattern, ""))
    except re.error:
        return True


def _hits(pattern: str, regex: str, literal: bool, plain: bool, per_file: int | None, with_submatches: bool, may: Column) -> Column:
    """The lines of a file that one pattern matches; lines are numbered only where they do."""
    line = lambda i: F.get("lines", i)
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.contains(line(i), F.lit(pattern)) if plain else F.rlike(line(i), F.lit(regex)))
    places = F.slice(places, 1, per_file) if per_file else places
    some = F.when(may, places).otherwise(F.array().cast("array<int>"))
    more = (lambda s: [submatches(s, regex).alias("submatches")]) if with_submatches else (lambda s: [])
    return F.transform(some, lambda i: F.struct(F.lit(pattern).alias("pattern"), (i + 1).alias("line_number"), line(i).alias("line_content"), *more(line(i))))


def search(files: DataFrame, pattern: str | list[str], literal: bool = False, ignore_case: bool = False, word: bool = False, per_file: int | None = None, context: int = 0, key: str = "path", content: str = "content", with_submatches: bool = False, languages: list[str] | None = None) -> DataFrame:
    """(pattern, key, line_number, line_content) of each line of each file that a pattern matches.

    All patterns are tried in one pass. per_file: at most so many lines of a file for
    each pattern, the first ones. context: adds before and after, arrays of so many lines. languages: only files in these.
    """
    found = patterns_of(pattern)
    if languages:
        files = files.filter(X.language_of(F.col(key)).isin(*languages))
    if not found:
        return files.select(F.lit("").alias("pattern"), key, F.lit(0).alias("line_number"), F.lit("").alias("line_content")).limit(0)
    asked = [(p, _regex(p, literal, ignore_case, word), literal, literal and not ignore_case and not word) for p in found]
    # Each pattern is tried once on a file as a whole; lines are made of those files only that have one.
    flags = [f"_may{i}" for i in range(len(asked))]
    tried = files.select(key, F.col(content), *(_may_match(F.col(content), *a).alias(f) for f, a in zip(flags, asked, strict=True)))
    rows = tried.select(key, *flags, F.when(reduce(Column.__or__, map(F.col, flags)), X.lines(F.col(content))).alias("lines"))
    each = [_hits(*a, per_file, with_submatches, F.col(f)) for f, a in zip(flags, asked, strict=True)]
    hits = rows.select(key, *(["lines"] if context else []), F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("h"))
    out = [F.col("h.pattern"), F.col(key), F.col("h.line_number"), F.col("h.line_content")] + ([F.col("h.submatches")] if with_submatches else [])
    if context:
        n = F.col("h.line_number")
        out += [F.slice("lines", F.greatest(n - context, F.lit(1)), F.least(F.lit(context), n - 1)).alias("before"), F.slice("lines", n + 1, F.lit(context)).alias("after")]
    return hits.select(*out)


def counts(matches: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, n): how many lines each pattern has, those without any included."""
    spark = matches.sparkSession
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    n = matches.groupBy("pattern").agg(F.count("*").alias("n"))
    return asked.join(F.broadcast(n), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))
