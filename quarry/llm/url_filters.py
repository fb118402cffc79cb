"""URL filters by a temporal join with dated lists.

A list entry says what holds for a host, or a domain above it, from a date on:
`block`, `allow` or `drop` (the pattern leaves the list). The next entry for the
same pattern ends it, so entries become validity intervals. For each host the
intervals of its own name and of the domains above it are laid over each other, the
longest name that is listed winning; that gives each host one timeline without
overlaps. A capture then meets one interval at most, the one active when it was
fetched (an as-of join on host and time).

A host's case and dots at its end don't count, nor do case and outer dots of a pattern. A
pattern of one label (a top-level domain) holds for all below it; addresses have nothing
above them.

Hosts are grouped before anything is joined, so that a host with a third of all
captures is a row like any other. Its captures are shuffled only where the
timelines are too many to send to the workers (`most_sent`, counted); the join is
then one that Spark splits where it is skewed. Spark expressions only.

Defined cases: a null or malformed URL has no host and, like a host that is not
listed or a null fetch time, gets verdict `keep` with null pattern; entries with a
null pattern, date or action are ignored; of entries for one pattern and instant the
greatest action by name holds; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut


def host_of(url: Column) -> Column:
    """In lower case, without dots at the end; an IPv6 address in its brackets. Null if there is none."""
    found = F.regexp_extract(F.translate(url, UPPER, LOWER), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)(?=[:/?#]|$)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it; an address has none."""
    labels = F.split(host, r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.rlike(host, F.lit(r"^\[|^[0-9.]+$")), F.array(host)).otherwise(above)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) from (pattern, action, since); until is null while an entry holds."""
    named = entries.withColumn("pattern", F.nullif(F.trim(F.translate(F.col("pattern"), UPPER, LOWER), F.lit(".")), F.lit("")))
    clean = named.filter("pattern is not null and action is not null and since is not null").groupBy("pattern", "since").agg(F.max("action").alias("action"))
    return clean.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since")))


def timelines(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, since, until, action, pattern): what holds for each of hosts(host) and when; no two overlap."""
    valid = intervals(entries)
    named = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("pattern")).join(valid, "pattern").filter("action <> 'drop'")
    marks = named.select("host", F.explode(F.array("since", "until")).alias("since")).filter("since is not null").distinct()
    spans = marks.withColumn("until", F.lead("since").over(Window.partitionBy("host").orderBy("since")))
    over = spans.alias("s").join(named.alias("n"), (F.col("s.host") == F.col("n.host")) & (F.col("n.since") <= F.col("s.since")) & (F.col("n.until").isNull() | (F.col("s.since") < F.col("n.until"))))
    best = F.max_by(F.struct("n.action", "n.pattern"), F.struct(F.length("n.pattern"), F.col("n.pattern")))
    return over.groupBy("s.host", "s.since", "s.until").agg(best.alias("best")).select("host", "since", "until", "best.action", "best.pattern")


def url_filters(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", most_sent: int = 200_000) -> DataFrame:
    """page_id, host, verdict (`block`, `allow` or `keep`), pattern and since, for every capture."""
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(time_col).alias("fetched_at"))
    lines = cut(timelines(rows.filter("host is not null").select("host").distinct(), entries.select("pattern", "action", "since")))
    lines = F.broadcast(lines) if lines.limit(most_sent + 1).count() <= most_sent else lines
    r, t = rows.alias("r"), lines.alias("t")
    # Rows without a host meet nothing; a number of their own keeps them from meeting in one task.
    key = F.coalesce(F.col("r.host"), F.concat(F.lit(" "), F.col("r.page_id").cast("string")))
    active = (key == F.col("t.host")) & (F.col("t.since") <= F.col("r.fetched_at")) & (F.col("t.until").isNull() | (F.col("r.fetched_at") < F.col("t.until")))
    return r.join(t, active, "left").select("r.page_id", "r.host", F.coalesce("t.action", F.lit("keep")).alias("verdict"), "t.pattern", "t.since")
