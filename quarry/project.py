"""Queries over a project made of the given tables, by name, with their SQL.

Documents are its design documents (docs/d1.md), pages its markup (p1.html), parts its classes (a
file of each uses or tests one), events the log of its sessions. All rows are read; limits
are those of the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import agreements, chunks, containment, gates, impact, logs, search, sessions, stored, symbols, sync, vectors
from quarry.oracle import CHANGES, LINES, OUTCOMES, SNAPS
from quarry.oracle import ORACLE_SQL as KNOWN
from quarry.plans import router
from quarry.queries import ORDER, Query, documents, explorations, outcomes, snapshots, table
from quarry.sources import files as S
from quarry.sources import merge, sinks
from quarry.streaming import logs as streams

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def document_files(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.concat(F.lit("docs/d"), F.col("doc_id"), F.lit(".md")).alias("path"), "content")


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


def class_name() -> Column:
    return F.array_join(F.transform(F.split("p_name", " ", -1), X.capitalised), "")


CLASS = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '')"
#: A third of the parts' files use their class, the others are named after it as tests.
PARTS = f"P AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'app/use' || p_partkey || '.php' ELSE 'tests/unit/' || c || p_partkey || 'Test.php' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'use ' || c || ';' || chr(10) || 'function f(): ' || c || ' {{}}' ELSE '' END AS content FROM (SELECT *, {CLASS} AS c FROM part))".replace("{{", "{").replace("}}", "}")


def part_files(spark: SparkSession, d: str) -> DataFrame:
    uses = F.col("p_partkey") % 3 == 0
    path = F.when(uses, F.concat(F.lit("app/use"), F.col("p_partkey"), F.lit(".php"))).otherwise(F.concat(F.lit("tests/unit/"), class_name(), F.col("p_partkey"), F.lit("Test.php")))
    content = F.when(uses, F.concat(F.lit("use "), class_name(), F.lit(";\nfunction f(): "), class_name(), F.lit(" {}"))).otherwise("")
    return table(spark, d, "part").select(path.alias("path"), content.alias("content"), class_name().alias("name"), "p_partkey")


# --- spans, terms, ignore files ---


@query(
    f"WITH {LINES}, H AS (SELECT doc_id, line_number AS line FROM L WHERE contains(line_content, 'er')), N AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), "
    "W AS (SELECT doc_id, w * i + 1 AS start_line, least(w * i + w, n) AS end_line FROM (SELECT *, unnest(range(0, (n + w - 1) // w)) AS i FROM N, (VALUES (7), (20)) v(w))) "
    "SELECT doc_id, line, CAST(r.start_line AS INT) AS start_line, CAST(r.end_line AS INT) AS end_line FROM (SELECT H.doc_id, H.line, arg_min({'start_line': start_line, 'end_line': end_line}, (end_line - start_line, start_line)) AS r FROM H JOIN W ON H.doc_id = W.doc_id AND H.line BETWEEN start_line AND end_line GROUP BY ALL)"
)
def innermost_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines with `er`, with the smaller of the windows of 7 and of 20 lines around each."""
    docs = documents(spark, d)
    n = X.line_count(F.col("content"))
    window = lambda w: F.transform(F.sequence(F.lit(1), n, F.lit(w)), lambda s: F.struct(s.cast("int").alias("start_line"), F.least(s + w - 1, n).cast("int").alias("end_line")))
    windows = F.concat(window(7), window(20))
    spans = docs.filter("content IS NOT NULL").select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.*")
    hits = search.search(docs, "er", literal=True, key="doc_id").select("doc_id", F.col("line_number").alias("line"))
    return symbols.enclosing(hits, spans, file="doc_id", innermost=True)


@query(
    "WITH T AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS term FROM benchmark), S AS (SELECT DISTINCT p_name AS symbol FROM part) SELECT term, symbol FROM T, S WHERE trim(term) <> '' AND (contains(lower(symbol), lower(term)) OR contains(lower(term), lower(symbol)) "
    "OR list_has_any(list_filter(string_split_regex(replace(lower(term), '_', ' '), '\\s+'), lambda x: x <> ''), list_filter(string_split_regex(replace(lower(symbol), '_', ' '), '\\s+'), lambda x: x <> '')))"
)
def term_answers(spark: SparkSession, d: str) -> DataFrame:
    """All different words of the benchmark's texts, and the names of parts that answer to them."""
    terms = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+", -1)).alias("term"))
    return containment.answering(terms, table(spark, d, "part").select(F.col("p_name").alias("symbol")))


#: (folder, line, rule) of ignore files in three folders.
RULES = [("", 1, "*.html"), ("", 2, "# a comment"), ("", 3, "!*9.html"), ("es", 1, "*"), ("es", 2, "!*7"), ("de", 1, "/5*"), ("de", 2, "!/55"), ("fr", 1, "8*/"), ("", 4, "/fr/1*")]


@query(
    "WITH P AS (SELECT page_id, trim(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/') AS path FROM pages), N AS (SELECT *, split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS name FROM P) "
    "SELECT page_id, path, CASE WHEN dir = 'es' THEN NOT ends_with(name, '7') WHEN dir = 'de' AND name = '55' THEN false WHEN dir = 'de' AND starts_with(name, '5') THEN true "
    "WHEN dir = 'fr' AND starts_with(name, '1') THEN true WHEN ends_with(path, '.html') THEN NOT ends_with(path, '9.html') ELSE false END AS ignored FROM N"
)
def ignored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages' URLs that ignore files at two depths leave out."""
    path = F.btrim(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), F.lit("/"))
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    found = S.ignored_by_files(pages.select("path").distinct(), spark.createDataFrame(RULES, "folder string, line int, rule string"))
    return pages.join(found, "path").select("page_id", "path", "ignored")


# --- counters and incremental runs ---


@query(KNOWN["cdc_summary"])
def cdc_observed(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental run did, counted while its changes were written."""
    changed, seen = sync.observed_changes(sync.changes(*snapshots(spark, d)))
    changed.write.parquet(sinks.fresh_folder(spark, "changes"))
    one = spark.createDataFrame([tuple(seen.get[c] for c in ("added", "modified", "deleted", "unchanged"))], "added long, modified long, deleted long, unchanged long")
    return one.withColumn("total_processed", F.expr("added + modified + deleted")).withColumn("has_changes", F.col("total_processed") > 0)


@query(f"SELECT hits, n - hits AS misses FROM (SELECT count(*) AS hits FROM ({KNOWN['cache_hits']})), (SELECT count(*) AS n FROM documents)")
def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of the tag cache, counted while the lookup's rows were written."""
    now, was = snapshots(spark, d)
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("language"))
    found, seen = symbols.looked_up(now, was.join(lang, "path", "left"), "en")
    found.write.parquet(sinks.fresh_folder(spark, "lookup"))
    return spark.createDataFrame([(seen.get["hits"], seen.get["misses"])], "hits long, misses long")


def run_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An incremental run over all documents as Markdown, from the state of snapshots()."""
    now, was = snapshots(spark, d)
    files = now.join(documents(spark, d).withColumnRenamed("doc_id", "path"), "path").select(F.col("path").cast("string").alias("path"), "content", "hash", F.lit(1.0).alias("mtime"), F.lit("markdown").alias("lang"))
    state = was.select(F.col("path").cast("string").alias("path"), "hash", F.lit(0.0).alias("mtime"), F.lit("old").alias("indexed_at"), F.lit(1).cast("long").alias("chunk_count"))
    old = chunks.chunk(files.join(state.select("path"), "path").select("path", F.lit("# old\n\nText of before.").alias("content"), "lang"))
    return sync.run(files, state, old, F.lit("now"))


@query(f"SELECT *, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE text IS NULL AND (quality IS NULL OR quality = 0)) AS errors FROM ({KNOWN['cdc_summary']})")
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d)[2]


@query(
    f"WITH {SNAPS}, {CHANGES} SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(N.hash, S.hash) AS hash, CASE WHEN change = 'unchanged' THEN 'old' ELSE 'now' END AS indexed_at FROM C LEFT JOIN N USING (doc_id) LEFT JOIN S USING (doc_id) WHERE change <> 'deleted'"
)
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d)[1].select("path", "hash", "indexed_at")


@query(f"WITH {SNAPS}, {CHANGES} SELECT CAST(doc_id AS VARCHAR) AS file, change = 'unchanged' AS old FROM C LEFT JOIN documents d USING (doc_id) WHERE change = 'unchanged' OR (change IN ('added', 'modified') AND regexp_matches(text, '\\S'))")
def sync_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Files that have chunks after a run, and whether they are those of before."""
    return run_of(spark, d)[0].groupBy("file").agg(F.bool_or(F.contains("content", F.lit("Text of before."))).alias("old"))


@query(f"WITH {SNAPS}, {CHANGES} SELECT S.doc_id, S.hash FROM S JOIN C USING (doc_id) WHERE change = 'unchanged'")
def cache_invalidated(spark: SparkSession, d: str) -> DataFrame:
    """What of a cache of all stored files is still good after their changes."""
    now, was = snapshots(spark, d)
    return sync.invalidated(was, sync.changes(now, was)).select(F.col("path").alias("doc_id"), "hash")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def chunks_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Documents without those that a label calls toxic."""
    gone = table(spark, d, "labels").filter("toxic = 1")
    return sinks.without(table(spark, d, "documents").select("doc_id", "n_chars"), gone, ["doc_id"])


@query(
    "WITH N AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents), K AS (SELECT N.doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 0 THEN 'old' ELSE hash END AS was FROM N JOIN labels USING (doc_id)) "
    "SELECT 'design_docs' AS type, N.doc_id AS path, CASE WHEN was IS NULL THEN 'new' ELSE 'modified' END AS change FROM N LEFT JOIN K USING (doc_id) WHERE was IS NULL OR (was <> '' AND was <> hash) "
    "UNION ALL SELECT 'project_rules', N.doc_id, CASE WHEN coalesce(was, '') = '' THEN 'new' ELSE 'modified' END FROM N LEFT JOIN K USING (doc_id) WHERE N.doc_id % 3 = 0 AND (coalesce(was, '') = '' OR was <> hash)"
)
def context_updates(spark: SparkSession, d: str) -> DataFrame:
    """Design documents and rules files (every third document) that are new or changed."""
    now, _ = snapshots(spark, d)
    known = table(spark, d, "labels").join(now.withColumnRenamed("path", "doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.when(F.col("toxic") == 1, "").when(F.col("quality") == 0, "old").otherwise(F.col("hash")).alias("content_hash"))
    return sync.context_updates(now, known, now.filter("path % 3 = 0"), known)


# --- impact ---


@query(
    f"WITH {PARTS}, L AS (SELECT path, p_partkey, c, CAST(unnest(range(1, len(s) + 1)) AS INT) AS line, unnest(s) AS content FROM (SELECT *, string_split(content, chr(10)) AS s FROM P)) "
    "SELECT c AS symbol, CASE WHEN line = 2 THEN 'type_hint' ELSE 'caller' END AS ref_type, path, line FROM L WHERE c IN ('RedWidget', 'BlueWidget') AND content <> '' AND NOT (p_partkey % 2 = 0 AND line = 1)"
)
def static_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines of parts' files that name one of two classes; the first line of every second file counts as its definition."""
    files = part_files(spark, d)
    tags = files.filter("p_partkey % 2 = 0").select("name", "path", F.lit(1).alias("line"))
    return impact.static_references(files.select("path", "content"), tags, ["RedWidget", "BlueWidget"]).select("symbol", "ref_type", "path", "line")


@query(
    f"WITH {PARTS}, {LINES}, M AS (SELECT path FROM P WHERE c = 'RedWidget' AND content <> ''), D AS (SELECT 'docs/d' || doc_id || '.md' AS path, count(*) AS n FROM L, (VALUES ('token'), ('redwidget')) v(k) WHERE contains(lower(line_content), k) GROUP BY 1 ORDER BY n DESC, path LIMIT 20) "
    "SELECT path, 'must_verify' AS need FROM M UNION ALL SELECT path, 'should_verify' FROM (SELECT path FROM D UNION SELECT path FROM P WHERE c = 'RedWidget' AND content = '') WHERE path NOT IN (SELECT path FROM M)"
)
def impact_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What a change of a class touches: files that use it, files named after it, documents that mention its keywords."""
    files = part_files(spark, d).select("path", "content").unionByName(document_files(spark, d))
    tags = files.select(F.lit("").alias("name"), "path", F.lit(0).alias("line")).limit(0)
    return impact.analyze(files, tags, ["app/red_widget.php"], 'Change "token" type')["envelope"]


@query(
    "WITH C AS (SELECT page_id, 'p' || page_id || '.css' AS source FROM pages WHERE page_id % 100 = 0 AND contains(html, 'class=\"ad\"')) SELECT source, path, 'ad' AS identifier FROM (SELECT source, 'p' || p.page_id || '.html' AS path, row_number() OVER (PARTITION BY source ORDER BY 'p' || p.page_id || '.html') AS r FROM pages p, C WHERE contains(html, 'ad')) WHERE r <= 10"
)
def markup_references(spark: SparkSession, d: str) -> DataFrame:
    """Pages that share identifiers with style sheets made of every hundredth page's classes, ten a sheet: the limit is the feature."""
    pages = page_files(spark, d)
    sheets = table(spark, d, "pages").filter("page_id % 100 = 0").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".css")).alias("path"), F.array_join(F.transform(X.file_identifiers(F.col("html"), F.lit(False)), lambda i: F.concat(F.lit("."), i, F.lit(" { color: red }"))), "\n").alias("content"))
    # The targets of a change are named by whoever makes it.
    targets = [r["path"] for r in sheets.select("path").collect()]
    return impact.markup_references(pages.unionByName(sheets), targets).select("source", "path", "identifier")


@query("SELECT page_id, CASE WHEN contains(html, 'class=\"ad\"') THEN 'ad' ELSE '' END AS identifiers FROM pages")
def page_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Classes and ids of pages."""
    return table(spark, d, "pages").select("page_id", F.array_join(X.file_identifiers(F.col("html"), F.lit(False)), ",").alias("identifiers"))


@query(
    f"WITH {LINES}, H AS (SELECT doc_id, k, line_number, line_content FROM L, (VALUES ('password'), ('token')) v(k) WHERE contains(lower(line_content), k)), N AS (SELECT doc_id, count(*) AS match_count, list({{'k': k, 'n': line_number}} ORDER BY k, line_number)[1:3] AS s FROM H GROUP BY 1) "
    "SELECT 'docs/d' || doc_id || '.md' AS path, match_count, array_to_string(list_transform(s, lambda x: x.k || ':' || x.n), ',') AS samples FROM N ORDER BY match_count DESC, path LIMIT 20"
)
def mention_samples(spark: SparkSession, d: str) -> DataFrame:
    """The twenty documents that mention keywords most, with the places of three mentions each; files that aren't documents are left out."""
    files = document_files(spark, d).unionByName(page_files(spark, d))
    found = impact.doc_mentions(files, ["password", "token"])
    return found.select("path", "match_count", F.array_join(F.transform("samples", lambda s: F.concat(s["keyword"], F.lit(":"), s["line"].cast("string"))), ",").alias("samples"))


@query("SELECT page_id, line_number FROM (SELECT page_id, CAST(unnest(range(1, len(s) + 1)) AS INT) AS line_number, unnest(s) AS x FROM (SELECT page_id, string_split(html, chr(10)) AS s FROM pages)) WHERE contains(x, 'token')")
def search_language(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a word in files of one language only, of pages and documents."""
    files = page_files(spark, d).unionByName(document_files(spark, d))
    return search.search(files, "token", literal=True, languages=["html"]).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("page_id"), "line_number")


# --- the curated collection ---


@query(
    "WITH F AS (SELECT p_partkey, replace(p_brand, '#', '') || '_' || p_partkey AS id, CASE WHEN p_size <= 45 THEN p_name END AS content FROM part WHERE p_partkey % 4 <> 1), O AS (SELECT replace(p_brand, '#', '') || '_' || p_partkey AS id FROM part WHERE p_partkey % 4 < 2) "
    "SELECT id, content, 'agreement' AS source FROM F WHERE content IS NOT NULL UNION ALL SELECT id, 'before', 'stored' FROM O WHERE id NOT IN (SELECT id FROM F WHERE content IS NOT NULL)"
)
def map_synced(spark: SparkSession, d: str) -> DataFrame:
    """The curated collection after all agreement files have been read into it; files that can't be read leave it as it was."""
    return agreements.map_sync(*agreement_files(spark, d))[0].select("id", "content", F.col("metadata")["source"].alias("source"))


@query("SELECT count(*) FILTER (p_size <= 45) AS added, count(*) FILTER (p_size > 45) AS errors FROM part WHERE p_partkey % 4 <> 1")
def map_sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return agreements.map_sync(*agreement_files(spark, d))[1]


def agreement_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.col("p_partkey"))
    old = p.filter("p_partkey % 4 < 2").select(name.alias("id"), F.lit("before").alias("content"), F.create_map(F.lit("source"), F.lit("stored")).alias("metadata"))
    path = F.concat(F.lit("agreements/"), name, F.when(F.col("p_partkey") % 4 == 1, ".txt").otherwise(".md"))
    return old, p.select(path.alias("path"), F.when(F.col("p_size") <= 45, F.col("p_name")).alias("content"))


ADDED = """WITH A AS (SELECT p_name AS term, list(DISTINCT p_brand ORDER BY p_brand) AS s, max(p_size) / 50.0 AS m, min(p_type) AS e FROM part GROUP BY 1),
B AS (SELECT *, '20240102_030405_' || regexp_replace(replace(term, ' ', '_'), '[^a-zA-Z0-9_]', '', 'g') AS id, '["' || array_to_string(s, '", "') || '"]' AS j FROM A)
SELECT id, id || '.md' AS file, substr(sha256('---' || chr(10) || 'doc_type: agreement' || chr(10) || 'nl_term: ' || term || chr(10) || 'symbols: ' || j || chr(10) || 'similarity: ' || printf('%.2f', m) || chr(10) || 'session_id: s1' || chr(10) || 'created_at: 2024-01-02T03:04:05' || chr(10) || '---' || chr(10) || chr(10)
 || '# ' || term || ' → ' || array_to_string(s, ', ') || chr(10) || chr(10) || '## 根拠 (Code Evidence)' || chr(10) || chr(10) || e || chr(10) || chr(10) || '## 関連シンボル' || chr(10) || chr(10) || '- `' || array_to_string(s, '`' || chr(10) || '- `') || '`' || chr(10)), 1, 16) AS hash, j AS symbols FROM B"""


@query(ADDED)
def agreements_added(spark: SparkSession, d: str) -> DataFrame:
    """An agreement on all brands of each part name, as a file and an entry of the collection."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("nl_term")).agg(F.array_sort(F.collect_set("p_brand")).alias("symbols"), (F.max("p_size") / 50.0).alias("similarity"), F.min("p_type").alias("code_evidence"))
    rows = p.withColumns({"session_id": F.lit("s1"), "created_at": F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")})
    return agreements.added(rows).select("id", "file", X.content_hash(F.col("content")).alias("hash"), F.col("metadata")["symbols"].alias("symbols"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (7, 3, 1) ORDER BY CASE vec_id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END")
def vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Vectors looked up by their ids, one of which isn't there."""
    return vectors.by_ids(table(spark, d, "embeddings"), [7, 3, 1, -5], "vec_id").select("vec_id", "label")


# --- sessions and gates ---


@query(
    "WITH T AS (SELECT conv_id, turn, regexp_extract(text, '[A-Z][a-z]+ [a-z]+') AS quote, text FROM conversations), V AS (SELECT *, split_part(quote, ' ', 1) AS value FROM T) SELECT conv_id, turn, coalesce(quote <> '', false) AS valid, CASE WHEN quote <> '' THEN 'observed_issue=' || value ELSE '' END AS slots FROM V"
)
def slots_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Slots extracted from conversations' turns: valid where the value is quoted from the text."""
    quote = F.regexp_extract("text", "[A-Z][a-z]+ [a-z]+", 0)
    value = F.split_part(quote, F.lit(" "), F.lit(1))
    frame = router.frame_of(F.col("text"), {"observed_issue": (value, quote)})
    shown = F.array_join(F.transform(F.map_entries(frame["slots"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, d, "conversations").select("conv_id", "turn", X.slot_valid(F.col("text"), value, quote).alias("valid"), shown.alias("slots"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'resume' WHEN o_orderkey % 3 = 0 THEN 'skip_exploration' WHEN o_orderkey % 2 = 0 THEN 'skip_branch' ELSE 'normal' END AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'SEMANTIC' WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 OR o_orderpriority LIKE '1%' THEN 'READY' ELSE 'EXPLORATION' END AS phase, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AS branch FROM orders"
)
def sessions_begun(spark: SparkSession, d: str) -> DataFrame:
    """How tasks begin that stand for orders."""
    k = F.col("o_orderkey")
    starts = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "QUESTION").otherwise("MODIFY").alias("intent"), F.when(F.col("o_orderpriority").like("1%"), "none").otherwise("high").alias("gate_level"), (k % 2 == 0).alias("skip_branch"), (k % 3 == 0).alias("skip_exploration"), F.when(k % 5 == 0, "SEMANTIC").alias("resume"))
    return sessions.begun(starts).select("o_orderkey", "mode", "phase", "branch")


@query(
    f"WITH {OUTCOMES}, F AS (SELECT session_id, arg_min(intent, (ts, event_id)) AS intent, count(*) AS n FROM O GROUP BY 1) SELECT CASE WHEN session_id % 3 = 0 THEN 'session_20240102_030405' ELSE 's' || session_id END AS session_id, intent, CASE WHEN session_id % 4 = 0 THEN 'READY' ELSE 'EXPLORATION' END AS phase, CASE WHEN session_id % 3 = 0 THEN 0 ELSE n END AS tool_calls_count FROM F"
)
def session_registry(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users as they are registered, with the number of their calls; a third have no id of their own."""
    o = outcomes(spark, d)
    named = F.when(F.col("session_id") % 3 != 0, F.concat(F.lit("s"), F.col("session_id")))
    first = o.groupBy("session_id").agg(F.min_by("intent", F.struct(*ORDER)).alias("intent"))
    requests = first.select(named.alias("session_id"), "intent", F.lit("q").alias("query"), F.when(F.col("session_id") % 4 == 0, "none").alias("gate_level"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at"))
    return sessions.status(sessions.created(requests), o.select(named.alias("session_id"))).select("session_id", "intent", "phase", "tool_calls_count")


@query(
    f"WITH G AS ({KNOWN['gate_thresholds']}), {OUTCOMES.removeprefix('WITH ')}, E AS (SELECT session_id, count(*) FILTER (k < 6) AS s, count(*) FILTER (k = 7) AS e FROM O GROUP BY 1), "
    "U AS (SELECT session_id, len(list_filter(range(1, e + 1), lambda i: len(list_filter(range(1, s + 1), lambda j: contains(CAST(j AS VARCHAR), CAST(i AS VARCHAR)) OR contains(CAST(i AS VARCHAR), CAST(j AS VARCHAR)))) = 0)) AS loose FROM E), "
    "H AS (SELECT session_id, missing = '' AND loose = 0 AND session_id % 7 <> 0 AS good FROM G JOIN U USING (session_id)) SELECT session_id, session_id % 5 <> 0 AS success, CASE WHEN session_id % 5 <> 0 THEN CASE WHEN good THEN 'high' ELSE 'low' END END AS evaluated_confidence, CASE WHEN session_id % 5 = 0 THEN 'READY' WHEN good THEN 'IMPACT_ANALYSIS' ELSE 'SEMANTIC' END AS next_phase FROM H"
)
def explorations_submitted(spark: SparkSession, d: str) -> DataFrame:
    """What users' explorations lead to; a fifth of the sessions are past it, a seventh have a slot that is a hypothesis."""
    e = explorations(spark, d)
    slot = F.create_map(F.lit("target_feature"), F.when(F.col("session_id") % 7 == 0, "HYPOTHESIS").otherwise("FACT"))
    none = F.array().cast("array<struct<name:string,source:string>>")
    rows = e.withColumns({"phase": F.when(F.col("session_id") % 5 == 0, "READY").otherwise("EXPLORATION"), "tools": F.array(F.lit("find_definitions"), F.lit("find_references")), "evidenced": F.array(F.lit("target_feature")), "terms": F.array().cast("array<string>"), "slot_source": slot, "mapped": none})
    return sessions.submitted(rows).select("session_id", "success", "evaluated_confidence", "next_phase")


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct([c_mktsegment, 'a.py'] || CASE WHEN c_acctbal > 0 THEN ['b.py', 'a.py'] ELSE [c_mktsegment] END)), ',') AS files FROM customer")
def explored_files(spark: SparkSession, d: str) -> DataFrame:
    """Explored files after more have been added."""
    more = F.when(F.col("c_acctbal") > 0, F.array(F.lit("b.py"), F.lit("a.py"))).otherwise(F.array("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(gates.add_explored(F.array(F.col("c_mktsegment"), F.lit("a.py")), more)), ",").alias("files"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def discard_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Discarded files without a reason."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "discard").otherwise("keep").alias("decision"), F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")).otherwise(" ").alias("reason"))
    return gates.discard_reasons_missing(o).select("o_orderkey")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'en'")
def verify_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Verified documents that need a reason and have none."""
    v = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return impact.reason_missing(v, F.when(F.col("quality") == 1, "will_modify").otherwise("no_change"), F.when(F.col("lang") == "en", "seen")).select("doc_id")


@query(f"WITH {OUTCOMES} SELECT event_id, ['submit_exploration', 'submit_semantic', 'submit_verification', 'submit_impact_analysis', 'submit_for_review', 'finalize_changes', 'merge_to_base'][k % 7 + 1] AS instruction FROM O")
def next_instructions(spark: SparkSession, d: str) -> DataFrame:
    """What to do next in the phase of each event."""
    phase = F.element_at(F.array(*(F.lit(p) for p in sessions.INSTRUCTIONS)), F.col("k") % 7 + 1)
    return outcomes(spark, d).select("event_id", sessions.next_instruction(phase).alias("instruction"))


@query(
    f"SELECT c_custkey, t[i] AS tool, CAST(len(t) - i + 1 AS INT) AS priority FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT c_custkey, string_split(tools, ',') AS t FROM ({KNOWN['plan_route']}) WHERE tools <> ''))"
)
def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of plans of frames made from customers, the first with the highest priority."""
    k = F.col("c_custkey")
    frames = table(spark, d, "customer").select("c_custkey", *(F.when(k % (i + 2) != 0, F.col("c_name")).alias(s) for i, s in enumerate(router.SLOTS)), F.element_at(F.array(*(F.lit(x) for x in (*router.INTENTS, "QUESTION"))), (k % 5 + 1).cast("int")).alias("intent"), (k % 7 == 0).alias("first_query"))
    return router.plan(frames).select("c_custkey", F.explode("steps").alias("s")).select("c_custkey", "s.tool", "s.priority")


@query(
    f"WITH {LINES}, {PARTS} SELECT 'search_text' AS tool, 'docs/d' || doc_id || '.md' AS file, line_number AS start_line, substr(line_content, 1, 200) AS snippet FROM L WHERE contains(line_content, 'edWidge') "
    "UNION ALL SELECT 'search_text', path, CAST(n AS INT), x FROM (SELECT path, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS x FROM (SELECT path, string_split(content, chr(10)) AS s FROM P)) WHERE contains(x, 'edWidge') UNION ALL SELECT 'find_definitions', path, 1, c FROM P WHERE contains(lower(c), 'edwidge')"
)
def plan_executed(spark: SparkSession, d: str) -> DataFrame:
    """The results of two tools over all documents and parts' files, as one table."""
    own = part_files(spark, d)
    files = own.select("path", "content").unionByName(document_files(spark, d))
    tags = own.select("name", "path", F.lit(1).alias("line"), F.lit("class").alias("kind"))
    return router.execute(router.Corpus(files, tags, tags), ["search_text", "find_definitions", "nothing"], "edWidge")


@query(f"WITH {OUTCOMES} SELECT event_id, CASE WHEN k % 10 > 0 THEN CAST(k AS DOUBLE) END AS duration_seconds FROM O")
def call_durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of tool calls; a tenth never ended."""
    o = outcomes(spark, d).select("event_id", F.col("ts").alias("started_at"), F.when(F.col("k") % 10 > 0, F.timestamp_add("SECOND", F.col("k"), F.col("ts").cast("timestamp"))).alias("completed_at"))
    return logs.call_durations(o).select("event_id", "duration_seconds")


# --- text ---


@query("SELECT page_id, rel AS relative, '/srv/' || rel AS absolute FROM (SELECT page_id, CASE WHEN starts_with(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '/en/') THEN substr(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), 5) ELSE substr(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), 2) END AS rel FROM pages)")
def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages' paths below /en, or below the root, and as absolute ones."""
    path = F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1)
    rel = X.relative_path(X.relative_path(path, "/en"), "")
    return table(spark, d, "pages").select("page_id", rel.alias("relative"), X.absolute_path(rel, "/srv").alias("absolute"))


@query(f"WITH {OUTCOMES} SELECT event_id, event_type || CASE WHEN k % 2 = 0 THEN ',x' || k ELSE '' END AS items, k % 3 = 0 AS flag FROM O WHERE k % 7 <> 0 UNION ALL SELECT event_id, NULL, k % 3 = 0 FROM O WHERE k % 7 = 0")
def tool_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments that are JSON lists, or text that is none, and flags that are text."""
    k = F.col("k")
    listed = F.concat(F.lit(' ["'), F.col("event_type"), F.when(k % 2 == 0, F.concat(F.lit('", "x'), k)).otherwise(""), F.lit('"]'))
    return outcomes(spark, d).select("event_id", F.array_join(X.string_list(F.when(k % 7 != 0, listed).otherwise(F.col("event_type"))), ",").alias("items"), X.flag(F.when(k % 3 == 0, "True").otherwise("no")).alias("flag"))


@query("SELECT doc_id, CAST((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + 1 AS INT) AS n FROM documents")
def clean_metadata(spark: SparkSession, d: str) -> DataFrame:
    """How many entries documents' metadata have without the nulls."""
    m = X.clean_metadata(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("id"), F.col("doc_id").cast("string"), F.lit("gone"), F.lit(None).cast("string")))
    return table(spark, d, "documents").select("doc_id", F.size(m).alias("n"))


@query("SELECT event_id, 'dec_' || user_id || '_' || epoch_us(ts) AS id FROM events")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.record_id("dec", F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp"))).alias("id"))


@query(
    f"WITH {LINES}, B AS (SELECT doc_id, line_number, '- ' || regexp_replace(line_content, '^\\s+', '') AS b FROM L WHERE regexp_matches(line_content, '\\S')), N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS r FROM B) "
    "SELECT d.doc_id, coalesce('Rules:' || chr(10) || x, '') AS rules FROM documents d LEFT JOIN (SELECT doc_id, string_agg(b, chr(10) ORDER BY r) AS x FROM N WHERE r <= 20 GROUP BY 1) USING (doc_id) WHERE text IS NOT NULL"
)
def document_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty bullets of rules files whose bullets are documents' lines: the number is the feature."""
    text = F.concat(F.lit("- "), F.replace("content", F.lit("\n"), F.lit("\n- ")))
    return documents(spark, d).filter("content IS NOT NULL").select("doc_id", X.rules(text).alias("rules"))


@query("SELECT 'llm_task_s_5_from_feature__' || lower(c_mktsegment) AS branch FROM customer WHERE c_custkey = 5")
def session_branch(spark: SparkSession, d: str) -> DataFrame:
    """The task branch of a session, among those of all customers."""
    name = X.task_branch(F.concat(F.lit("s_"), F.col("c_custkey")), F.concat(F.lit("feature/"), F.lower("c_mktsegment")))
    parsed = table(spark, d, "customer").select(name.alias("branch"), X.parse_task_branch(name).alias("p"))
    return S.branch_of(parsed.select("branch", "p.session_id"), "s_5").select("branch")


# --- runs that keep what they know ---


def sources(spark: SparkSession, d: str, changed: Column) -> DataFrame:
    """Small Python sources made from parts, some with a function more."""
    name = F.regexp_replace("p_name", "[^a-zA-Z0-9]+", "_")
    source = F.concat(F.lit("class C_"), name, F.lit(":\n    def m_"), name, F.lit("(self, a):\n        return a\n\n\ndef f(*args):\n    return 1\n"), F.when(changed, "\n\ndef more():\n    pass\n").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/p"), F.col("p_partkey"), F.when(F.col("p_partkey") % 10 == 7, ".txt").otherwise(".py")).alias("path"), source.alias("content"), X.content_hash(source).alias("hash"), F.lit("python").alias("lang"))


@query("SELECT count(*) AS files_scanned, count(*) FILTER (p_partkey % 4 <> 1 AND p_partkey % 3 <> 0) AS files_cached, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END) AS BIGINT) AS tags FROM part WHERE p_partkey % 10 <> 7")
def tag_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan for tags after an earlier one of some of the files, a third of which have changed since."""
    cache = sinks.fresh_folder(spark, "tags")
    stored.scan_tags(sources(spark, d, F.lit(False)).filter("p_partkey % 4 <> 1"), cache)
    found, counts = stored.scan_tags(sources(spark, d, F.col("p_partkey") % 3 == 0), cache)
    return found.agg(F.count("*").alias("tags")).select(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()), "tags")


def two_runs(spark: SparkSession, d: str) -> str:
    """Tables after a run over all documents, the poor ones with other texts, and one over those as they are, some of them gone."""
    folder = sinks.fresh_folder(spark, "index")
    poor = table(spark, d, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    docs = documents(spark, d).join(poor, "doc_id", "left")
    rows = lambda text, keep: docs.filter(keep).select(F.col("doc_id").cast("string").alias("path"), text.alias("content"), X.content_hash(text).alias("hash"), F.lit(1.0).alias("mtime"), F.lit("text").alias("lang"))
    stored.run(rows(F.when(F.col("poor"), F.concat(F.lit("# x\n"), F.col("content"))).otherwise(F.col("content")), "true"), folder, "one")
    stored.run(rows(F.col("content"), "doc_id % 11 <> 5"), folder, "two")
    return folder


@query("SELECT CAST(doc_id AS VARCHAR) AS path, substr(sha256(text), 1, 16) AS hash, CASE WHEN quality = 0 THEN 'two' ELSE 'one' END AS indexed_at FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 11 <> 5")
def stored_state(spark: SparkSession, d: str) -> DataFrame:
    """The stored state after two incremental runs."""
    return merge.Snapshot(spark, f"{two_runs(spark, d)}/state").read().select("path", "hash", "indexed_at")


@query(
    "WITH D AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 11 = 5) AS gone, count(*) FILTER (quality = 0 AND doc_id % 11 <> 5) AS poor, count(*) FILTER (text IS NULL) AS broken, count(*) FILTER (text IS NULL AND quality = 0 AND doc_id % 11 <> 5) AS again FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT CAST(1 AS BIGINT) AS run, 'one' AS ran_at, n AS added, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS unchanged, broken AS errors FROM D UNION ALL SELECT 2, 'two', 0, poor, gone, n - poor - gone, again FROM D"
)
def stored_runs(spark: SparkSession, d: str) -> DataFrame:
    """The stamps of two incremental runs."""
    return merge.Snapshot(spark, f"{two_runs(spark, d)}/runs").read()


@query("SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE doc_id % 11 <> 5 AND regexp_matches(text, '\\S')")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files that have chunks after two incremental runs, none of which are of before."""
    found = stored.chunks(spark, two_runs(spark, d))
    return found.groupBy("file").agg(F.bool_or(F.startswith("content", F.lit("# x\n"))).alias("old")).filter("NOT old").select("file")


@query(f"WITH {SNAPS} SELECT doc_id, 'now' AS summary, hash AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'note ' || quality ELSE '' END AS extra_notes, 'two' AS last_synced FROM N JOIN labels USING (doc_id)")
def context_written(spark: SparkSession, d: str) -> DataFrame:
    """The context after its summaries have been written anew over stored ones, half of which had notes."""
    folder = sinks.fresh_folder(spark, "context")
    now, _ = snapshots(spark, d)
    own = now.join(table(spark, d, "labels").withColumnRenamed("doc_id", "path"), "path")
    before = own.filter("path % 2 = 0").select("path", F.lit("before").alias("summary"), F.lit("old").alias("content_hash"), F.concat(F.lit("note "), "quality").alias("extra_notes"), F.lit("one").alias("last_synced"))
    sinks.swap(before, folder)
    stored.save_context(own.select("path", F.lit("now").alias("summary"), F.col("hash").alias("content_hash")), folder, F.lit("two"))
    return sinks.read(spark, folder).withColumnRenamed("path", "doc_id")


@query(
    f"WITH {OUTCOMES} SELECT event_id, CASE WHEN k % 2 = 0 THEN CASE k % 5 WHEN 0 THEN 'Execute SEMANTIC phase: Use semantic_search to gather additional information, then call submit_semantic.' WHEN 1 THEN 'Execute VERIFICATION phase: Verify hypotheses using code-intel tools, then call submit_verification.' "
    "WHEN 2 THEN 'Execute IMPACT_ANALYSIS phase: Analyze impact range using analyze_impact, then call submit_impact_analysis.' ELSE 'Proceed to next step.' END ELSE CASE k % 5 WHEN 0 THEN 'SEMANTIC skipped. Now check VERIFICATION necessity using check_phase_necessity(phase=''VERIFICATION'', assessment={...}).' "
    "WHEN 1 THEN 'VERIFICATION skipped. Now check IMPACT_ANALYSIS necessity using check_phase_necessity(phase=''IMPACT_ANALYSIS'', assessment={...}).' WHEN 2 THEN 'IMPACT_ANALYSIS skipped. Proceed to READY phase for implementation.' ELSE 'Proceed to next step.' END END AS instruction FROM O"
)
def check_instructions(spark: SparkSession, d: str) -> DataFrame:
    """What to do after checks of whether phases are needed."""
    of = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), F.col("k") % 5 + 1)
    return outcomes(spark, d).select("event_id", gates.instruction(of("SEMANTIC", "VERIFICATION", "IMPACT_ANALYSIS", "READY", "EXPLORATION"), F.col("k") % 2 == 0, of("Q2_CHECK", "Q3_CHECK", "READY", "SEMANTIC", "")).alias("instruction"))


@query("SELECT c_custkey, c_nationkey % 3 = 0 AND c_acctbal > 0 AS success, CASE WHEN c_nationkey % 3 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'PRE_COMMIT' ELSE 'READY' END ELSE 'SEMANTIC' END AS next_phase FROM customer")
def reviews_begun(spark: SparkSession, d: str) -> DataFrame:
    """Customers' sessions that go to review: those that are ready and have a branch."""
    s = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "READY").otherwise("SEMANTIC").alias("phase"), (F.col("c_acctbal") > 0).alias("branch"))
    return gates.submitted_for_review(s).select("c_custkey", "success", "next_phase")


@query(
    "WITH F AS (SELECT o_custkey, o_orderkey, 'f' || o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'discard' WHEN o_orderstatus = 'O' THEN 'keep' END AS decision, CASE WHEN o_orderkey % 5 > 0 THEN 'r' ELSE '' END AS reason FROM orders), "
    "B AS (SELECT o_custkey, count(*) FILTER (decision IS DISTINCT FROM 'discard') AS k, count(*) FILTER (decision = 'discard') AS d, arg_min(path, o_orderkey) FILTER (decision = 'discard' AND reason = '') AS bad FROM F GROUP BY 1), "
    "S AS (SELECT c_custkey AS o_custkey, c_nationkey % 4 <> 0 AS here FROM customer) SELECT CAST(S.o_custkey AS BIGINT) AS session_id, here AND bad IS NULL AS success, CASE WHEN here AND bad IS NULL THEN coalesce(k, 0) ELSE 0 END AS n_kept, CASE WHEN here AND bad IS NULL THEN coalesce(d, 0) ELSE 0 END AS n_discarded, "
    "CASE WHEN NOT here THEN 'Cannot submit review in phase READY. Must be in PRE_COMMIT phase.' WHEN bad IS NOT NULL THEN 'Discarding ''' || bad || ''' requires a reason.' ELSE 'Review complete. ' || coalesce(k, 0) || ' files to keep, ' || coalesce(d, 0) || ' files to discard.' END AS message FROM S LEFT JOIN B USING (o_custkey)"
)
def reviews_done(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of orders' files by customers' sessions."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") % 4 == 0, "READY").otherwise("PRE_COMMIT").alias("phase"))
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "discard").when(F.col("o_orderstatus") == "O", "keep").alias("decision"), F.when(F.col("o_orderkey") % 5 > 0, "r").otherwise("").alias("reason"))
    r = gates.reviewed(s, files)
    return r.select("session_id", "success", F.size("kept").cast("long").alias("n_kept"), F.size("discarded").cast("long").alias("n_discarded"), "message")


# --- streams ---


def event_files(spark: SparkSession, d: str, rows: DataFrame, name: str) -> str:
    """Events as a log that came in as three files."""
    folder = sinks.fresh_folder(spark, name)
    streams.in_files(rows, folder, "ts", 3)
    return folder


def counted_events(spark: SparkSession, d: str) -> DataFrame:
    """All events through the stream of failures and reverts, in two runs."""
    # What the counts ask for, and nothing else, goes through the workers.
    o = outcomes(spark, d).select("session_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "outcome", "event_type")
    folder, out, at = (sinks.fresh_folder(spark, name) for name in ("events", "counted", "checkpoint"))
    stream = streams.files_as_stream(spark, folder, o.schema, streams.in_files(o, folder, "ts", 3, "session_id"))
    streams.to_files(streams.counted(stream, F.col("outcome") == "failure", F.col("event_type") == "signup", F.col("outcome") == "partial", ORDER), out, at).awaitTermination()
    return spark.read.parquet(out)


@query(KNOWN["failure_runs"])
def failure_stream(spark: SparkSession, d: str) -> DataFrame:
    """As failure_runs, by a stream with state."""
    return counted_events(spark, d).select("event_id", "failure_count", "near", "intervene", "interventions", "escalate")


@query(KNOWN["revert_cap"])
def revert_stream(spark: SparkSession, d: str) -> DataFrame:
    """As revert_cap, by a stream with state."""
    return counted_events(spark, d).select("event_id", "reverts", "forced")


@query("SELECT o.event_id, d.event_id AS decision_id FROM events o LEFT JOIN events d ON d.event_type = 'click' AND d.user_id = o.user_id AND d.ts BETWEEN o.ts - INTERVAL 1 HOUR AND o.ts WHERE o.event_type = 'error'")
def decision_stream(spark: SparkSession, d: str) -> DataFrame:
    """Failures with the decisions of the hour before, by a join of two streams."""
    e = outcomes(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("session_id", "ts", "event_id", "event_type")
    ends = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(e.schema["session_id"].dataType).alias("session_id"), F.timestamp_add("DAY", F.lit(900), F.col("ts")).alias("ts"), F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), F.lit("").alias("event_type"))
    sides = []
    for kind in ("error", "click"):
        folder = event_files(spark, d, e.filter(F.col("event_type") == kind), kind)
        ends.coalesce(1).write.mode("append").parquet(folder)  # time goes on
        sides.append(streams.files_as_stream(spark, folder, e.schema).drop("event_type"))
    out, at = sinks.fresh_folder(spark, "joined"), sinks.fresh_folder(spark, "checkpoint")
    streams.to_files(streams.with_decisions(*sides, late="400 days"), out, at).awaitTermination()
    return spark.read.parquet(out).filter("session_id >= 0").select("event_id", "decision_id")
