"""The engine's queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

LINES = "L AS (SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS INT) AS line_number, unnest(s) AS line_content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
HASH = "substr(sha256({}), 1, 16)"
WINDOWS = "W AS (SELECT doc_id, 50 * ((line_number - 1) // 50) + 1 AS line_start, max(line_number) AS line_end, string_agg(line_content, chr(10) ORDER BY line_number) AS content FROM L GROUP BY doc_id, (line_number - 1) // 50 HAVING bool_or(regexp_matches(line_content, '\\S')))"
OUTCOMES = """O AS (SELECT user_id AS session_id, event_id, ts, event_type, value, k,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'partial' ELSE 'unknown' END AS outcome,
  ['HIGH', 'MEDIUM', 'LOW'][k % 3 + 1] AS risk_level, ['IMPLEMENT', 'MODIFY', 'DELETE', 'EXPLORE'][k % 4 + 1] AS intent,
  CASE WHEN k % 5 > 0 THEN 'point' || (k % 5) END AS failure_point
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""
DECISIONS = """D AS (SELECT session_id, ts, event_id, risk_level, intent, list_distinct_in_order AS tools FROM (
  SELECT *, list_filter(['find_definitions', 'search_text', 'get_symbols', 'find_references', 'analyze_structure'],
    lambda t: (k % 2 = 0 AND t IN ('find_definitions', 'search_text', 'get_symbols')) OR (k % 3 = 0 AND t IN ('find_references', 'search_text')) OR (k % 4 = 0 AND t IN ('search_text', 'analyze_structure'))) AS list_distinct_in_order
  FROM O WHERE event_type = 'click'))"""
LAST = "LD AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM D) WHERE r = 1)"
COUNTS = "count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failure') AS failure, count(*) FILTER (outcome = 'partial') AS partial"
SF = "count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failure') AS failure"
SNAPS = f"N AS (SELECT doc_id, {HASH.format('text')} AS hash FROM documents), S AS (SELECT doc_id, CASE WHEN quality = 0 THEN substr(sha256(hash), 1, 16) ELSE hash END AS hash FROM N JOIN labels USING (doc_id) UNION ALL SELECT -1 - page_id, {HASH.format('html')} FROM pages)"
CHANGES = "C AS (SELECT coalesce(N.doc_id, S.doc_id) AS doc_id, CASE WHEN S.hash IS NULL THEN 'added' WHEN N.hash IS NULL THEN 'deleted' WHEN N.hash <> S.hash THEN 'modified' ELSE 'unchanged' END AS change FROM N FULL JOIN S ON N.doc_id = S.doc_id)"
NEAR = """P AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS distance
  FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"""
COS = "C AS (SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS c FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
CAP = "array_to_string(list_transform(string_split({}, '{}'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '')"
ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
STOP = "'the','a','an','is','are','was','were','be','been','to','of','in','for','on','with','at','by','from','this','that','these','those','it','its','and','or','but','if','then','else','add','remove','change','update','modify','fix','delete','file','files','code','field','type','value','name'"
ORDERED = "list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda v: v IS NOT NULL)"
IDENTS = "list_filter(regexp_extract_all({t}, '[.#]([a-zA-Z_][a-zA-Z0-9_-]*)', 1) || flatten(list_transform(regexp_extract_all({t}, '(?i)class\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: regexp_split_to_array(trim(x), '\\s+'))) || regexp_extract_all({t}, '(?i)id\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) || regexp_extract_all({t}, '[\"'']([a-zA-Z_][a-zA-Z0-9_-]+)[\"'']', 1), lambda x: length(x) >= 2)"


def _search(where: str) -> str:
    return f"WITH {LINES} SELECT doc_id, line_number, line_content FROM L WHERE {where}"


def _multi(patterns: list[str]) -> str:
    return f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id, line_number FROM L WHERE regexp_matches(line_content, '{p}')" for p in patterns)


ORACLE_SQL: dict[str, str] = {
    "search_single": _search("regexp_matches(line_content, 'tion[a-z]*')"),
    "search_multi": _multi(["token", "[0-9]{3}", "^The", "th[ae]n", "\\|"]),
    "search_indexed_single": _search("regexp_matches(line_content, 'tion[a-z]*')"),
    "search_indexed_multi": _multi(["token", "^The", "th[ae]n", "(pass|key)word"]),
    "search_indexed_rare": f"WITH {LINES} SELECT doc_id, line_number FROM L WHERE regexp_matches(line_content, '(?i)(licen[cs]e|copyright).*(granted|reserved)')",
    "search_literal": _search("contains(line_content, 'the.')"),
    "search_icase": _search("regexp_matches(line_content, '(?i)^the')"),
    "search_capped": f"WITH {LINES} SELECT doc_id, line_number, line_content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS r FROM L WHERE contains(line_content, 'er')) WHERE r <= 2",
    "search_word": _search("regexp_matches(line_content, '\\btoken\\b')"),
    "search_submatches": f"WITH {LINES}, M AS (SELECT doc_id, line_number, regexp_extract_all(line_content, '[0-9a-f]{{18,}}') AS m FROM L) SELECT doc_id, line_number, CAST(n - 1 AS INT) AS n, m[n] AS match, CAST(length(m[n]) AS INT) AS chars FROM (SELECT doc_id, line_number, m, unnest(range(1, len(m) + 1)) AS n FROM M)",
    "search_counts": f"WITH {LINES} SELECT p AS pattern, (SELECT count(*) FROM L WHERE contains(line_content, p)) AS n FROM (VALUES ('token'), ('password'), ('no such line anywhere')) v(p)",
    "search_context": f"WITH {LINES} SELECT * EXCLUDE (line_content) FROM (SELECT doc_id, line_number, line_content, lag(line_content) OVER w AS before, lead(line_content) OVER w AS after FROM L WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) WHERE contains(line_content, 'token')",
    "line_scan": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line_content) = '') AS n_blank FROM L GROUP BY doc_id",
    "files_glob": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/en/.*\\.html$') OR regexp_matches(regexp_extract(url, '[^/]*$'), '^.*/en/.*\\.html$')",
    "files_exclude": "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(source, '^src1.*$') AND NOT regexp_matches(source, '^src[2-3]$')",
    "file_types": "SELECT ext, CASE ext WHEN '.html' THEN 'html' WHEN '.css' THEN 'css' WHEN '.js' THEN 'javascript' WHEN '.php' THEN 'php' ELSE 'unknown' END AS lang, count(*) AS n FROM (SELECT lower(CASE WHEN regexp_matches(f, '.\\.[^.]*$') THEN regexp_extract(f, '\\.[^.]*$') ELSE '' END) AS ext FROM (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS f FROM pages)) GROUP BY 1, 2",
    "symbol_exact": "SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget'",
    "symbol_fuzzy": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')",
    "symbols_kind": "SELECT p_partkey, p_type FROM part WHERE lower(p_type) = 'economy'",
    "refs_minus_defs": f"WITH {LINES}, H AS (SELECT doc_id AS path, line_number AS line FROM L WHERE regexp_matches(line_content, '\\bthe\\b')) SELECT path, line FROM H WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, min(line) AS line FROM H GROUP BY path) f WHERE f.path = H.path AND f.line = H.line)",
    "func_at_line": f"WITH {LINES}, {WINDOWS} SELECT L.doc_id, L.line_number AS line, CAST(line_start AS INT) AS start_line, line_end AS end_line FROM L JOIN W ON L.doc_id = W.doc_id AND L.line_number BETWEEN line_start AND line_end WHERE contains(line_content, 'token')",
    "line_chunks": f"WITH {LINES}, {WINDOWS} SELECT doc_id, CAST(line_start AS INT) AS line_start, line_end, {HASH.format('content')} AS hash FROM W",
    "module_summary": f"WITH {LINES}, {WINDOWS}, T AS (SELECT doc_id, count(*) AS chunk_count, string_agg(DISTINCT CASE WHEN line_end - line_start < 49 THEN 'part' ELSE 'full' END, ',' ORDER BY CASE WHEN line_end - line_start < 49 THEN 'part' ELSE 'full' END) AS chunk_types FROM W GROUP BY doc_id), H AS (SELECT doc_id, string_agg(line_content, chr(10) ORDER BY line_number) AS c FROM L WHERE line_number <= 30 GROUP BY doc_id) SELECT doc_id, {HASH.format('c')} AS hash, chunk_count, chunk_types FROM T JOIN H USING (doc_id)",
    "truncate": f"SELECT doc_id, length(t) AS chars, {HASH.format('t')} AS hash FROM (SELECT doc_id, CASE WHEN length(text) > 2048 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '... [truncated] ...' || chr(10) || chr(10) || right(text, 1000) ELSE text END AS t FROM documents)",
    "fingerprint": f"SELECT doc_id, {HASH.format('text')} AS hash, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents",
    "cdc_diff": f"WITH {SNAPS}, {CHANGES} SELECT * FROM C",
    "cdc_summary": f"WITH {SNAPS}, {CHANGES} SELECT *, added + modified + deleted AS total_processed, added + modified + deleted > 0 AS has_changes FROM (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM C)",
    "dup_ids": f"SELECT min(doc_id) AS doc_id, hash FROM (SELECT doc_id, {HASH.format('text')} AS hash FROM documents) GROUP BY hash",
    "chunk_upsert": "SELECT d.doc_id AS path, CASE WHEN quality = 0 THEN n_chars ELSE 0 END AS size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "cache_hits": f"WITH {SNAPS} SELECT N.doc_id, N.hash FROM N JOIN S ON N.doc_id = S.doc_id AND N.hash = S.hash JOIN documents d ON d.doc_id = N.doc_id WHERE d.lang = 'en'",
    "index_stats": "SELECT count(*) AS files, CAST(sum(event_id % 9) AS BIGINT) AS chunks, max(ts) AS last_sync FROM events",
    "ttl_due": "SELECT user_id, epoch_us(n) - epoch_us(max(ts)) > 24 * 3600000000 AS due FROM events, (SELECT max(ts) AS n FROM events) GROUP BY user_id, n",
    "change_merge": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'deleted' WHEN c_acctbal > 3000 THEN 'modified' ELSE 'added' END AS change_type, CASE WHEN c_mktsegment = 'BUILDING' THEN 'uncommitted' WHEN c_acctbal > 3000 THEN 'committed' ELSE 'untracked' END AS origin FROM customer WHERE c_acctbal > 3000 OR c_mktsegment = 'BUILDING' OR c_nationkey < 9",
    "keep_discard": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'keep' ELSE 'discard' END AS action FROM customer",
    "structure_nodes": """WITH P AS (SELECT 'p' || p_partkey || '.py' AS path, regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g') AS n FROM part)
SELECT path, category, replace(name, '?', n) AS name, type, start_line, end_line, parameters, replace(scope, '?', n) AS scope FROM P, (VALUES ('imports', 'os', 'import', 1, 1, '', ''), ('classes', 'C_?', 'class', 4, 8, '', ''), ('functions', 'm_?', 'member', 5, 8, 'self,a,b', 'C_?'), ('functions', 'inner', 'function', 6, 7, '', 'C_?.m_?'), ('functions', 'f_?', 'function', 11, 12, 'args', '')) v(category, name, type, start_line, end_line, parameters, scope)""",
    "page_chunks": """WITH L AS (SELECT page_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM (SELECT page_id, string_split(html, chr(10)) AS s FROM pages)),
T AS (SELECT DISTINCT page_id, i, unnest(regexp_extract_all(x, '<(section|article|nav|header|footer|main|form|aside)\\b', 1)) AS tag FROM L)
SELECT 'p' || page_id || '.html' AS file, 'element' AS type, count(*) AS n FROM T GROUP BY page_id UNION ALL SELECT DISTINCT 'p' || page_id || '.html', 'module_summary', CAST(1 AS BIGINT) FROM T""",
    "knn_topk": f"WITH {NEAR} SELECT query_id, id AS vec_id, CAST(rank AS INT) AS rank, round(round(distance, 6), 4) AS distance, round(round(1 / (1 + distance), 6), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM P) WHERE rank <= 10",
    "knn_shortcircuit": f"WITH {NEAR}, R AS (SELECT *, label = 0 AS m, row_number() OVER (PARTITION BY query_id, label = 0 ORDER BY distance, id) AS rank FROM P), T AS (SELECT query_id, coalesce(max(round(1 / (1 + distance), 6)) FILTER (m), 0) >= 0.7 AS short FROM R GROUP BY query_id) SELECT query_id, CASE WHEN short THEN 'map' ELSE 'forest' END AS source, id AS vec_id, CAST(rank AS INT) AS rank, CASE WHEN short THEN 'high' ELSE 'medium' END AS confidence FROM R JOIN T USING (query_id) WHERE (short AND m AND rank <= 5) OR (NOT short AND NOT m AND rank <= 10)",
    "similarity_rank": f"WITH {COS} SELECT vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT vec_id, round(c, 3) AS similarity, row_number() OVER (ORDER BY round(c, 3) DESC, vec_id) AS rank FROM C) WHERE rank <= 5",
    "verdict_tiers": f"WITH {COS} SELECT vec_id, s AS similarity, CASE WHEN s >= 0.3 THEN 'FACT' ELSE 'REJECTED' END AS status, CASE WHEN s >= 0.3 AND s <= 0.6 THEN 'HIGH' END AS risk FROM (SELECT vec_id, round(c, 4) AS s FROM C)",
    "confirm_symbols": "SELECT r.symbol, coalesce(score, 0.7) AS confidence, m.symbol IS NOT NULL AS found FROM (SELECT DISTINCT p_name AS symbol FROM part WHERE p_type = 'ECONOMY') r LEFT JOIN (SELECT p_name AS symbol, CAST(max(p_size) AS DOUBLE) / 100 AS score FROM part WHERE p_size > 45 GROUP BY 1) s USING (symbol) LEFT JOIN (SELECT DISTINCT p_name AS symbol FROM part WHERE p_brand = 'Brand#2') m ON m.symbol = r.symbol",
    "camel_split": f"SELECT p_partkey, regexp_replace(regexp_replace({CAP.format('p_name', ' ')} || 'HTTPServer', '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS words FROM part",
    "base_name": f"SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN {CAP.format('p_name', ' ')} ELSE p_name END AS base FROM part",
    "css_idents": f"SELECT page_id, array_to_string(({ORDERED.format(x='a')})[1:10], ',') AS identifiers FROM (SELECT page_id, {IDENTS.format(t='html')} AS a FROM pages)",
    "keywords": f"""SELECT item_id, array_to_string(({ORDERED.format(x='a')})[1:10], ',') AS keywords FROM (SELECT item_id, list_filter(regexp_extract_all(d, '"([^"]+)"', 1), lambda x: length(x) >= 2) || regexp_extract_all(d, '[A-Z][a-z]+(?:[A-Z][a-z]+)+') || regexp_extract_all(d, '[a-z]+(?:_[a-z]+)+') || list_filter(regexp_extract_all(d, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) >= 4 AND lower(w) NOT IN ({STOP})) || ['CartItem' || item_id] AS a
  FROM (SELECT item_id, 'Change "item_' || item_id || '" of user_account in ' || text AS d FROM benchmark))""",
    "type_hints": "SELECT p_partkey, p_partkey % 3 <> 2 AS hint FROM part",
    "slot_overlap": """WITH T AS (SELECT conv_id, turn, lower(text) AS a FROM conversations), U AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM T),
V AS (SELECT *, list_distinct(string_split(a, '')) AS ca, list_distinct(string_split(b, '')) AS cb FROM U WHERE b IS NOT NULL)
SELECT conv_id, turn, contains(b, a) OR contains(a, b) OR list_has_any(list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> ''), list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) OR (least(len(ca), len(cb)) > 0 AND 2 * len(list_intersect(ca, cb)) >= least(len(ca), len(cb))) AS agrees FROM V""",
    "branch_names": "SELECT c_custkey, 'llm_task_s_' || c_custkey || '_from_feature__' || lower(c_mktsegment) AS branch, 's_' || c_custkey AS session_id, 'feature/' || lower(c_mktsegment) AS base_branch FROM customer",
    "safe_names": "SELECT p_partkey, p_type || '_' || p_partkey AS file_name, p_type || '____' || p_partkey AS term FROM part",
    "doc_mentions": f"WITH {LINES} SELECT doc_id, count(*) AS match_count, string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM L, (VALUES ('token'), ('password'), ('email'), ('license')) v(k) WHERE contains(lower(line_content), k) GROUP BY doc_id ORDER BY match_count DESC, doc_id LIMIT 20",
    "cross_refs": f"WITH I AS (SELECT page_id, ({ORDERED.format(x='a')})[1:10] AS ids FROM (SELECT page_id, {IDENTS.format(t='html')} AS a FROM pages WHERE page_id % 100 = 0)), H AS (SELECT I.page_id AS source, p.page_id, list_filter(ids[1:5], lambda i: contains(html, i))[1] AS identifier FROM pages p JOIN I ON p.page_id <> I.page_id) SELECT source, page_id, identifier FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id) AS r FROM H WHERE identifier IS NOT NULL) WHERE r <= 10",
    "naming_matches": f"""WITH F AS (SELECT DISTINCT replace(['tests/unit/{{}}Test.php', 'db/factories/{{}}.php', 'app/{{}}Seeder.php', 'app/{{}}.php'][p_partkey % 4 + 1], '{{}}', {CAP.format('p_name', ' ')}) AS path FROM part), B AS (SELECT b FROM (VALUES ('Red'), ('Blue')) v(b))
SELECT b AS base, kind, path FROM (SELECT b, path, 'test' AS kind FROM F, B WHERE regexp_matches(path, '(^|/)[^/]*' || b || '[^/]*Test\\.[^/]*$') OR regexp_matches(path, '(^|.*/)tests/.*' || b || '[^/]*\\.[^/]*$')
UNION SELECT b, path, 'factory' FROM F, B WHERE regexp_matches(path, '(^|/)factories/[^/]*' || b || '[^/]*\\.[^/]*$') UNION SELECT b, path, 'seeder' FROM F, B WHERE regexp_matches(path, '(^|/)[^/]*' || b || 'Seeder\\.[^/]*$'))""",
    "impact_envelope": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN contains(text, 'token') THEN 'must_verify' ELSE 'should_verify' END AS need FROM documents WHERE (contains(text, 'token') OR contains(text, 'password')) AND doc_id NOT IN (1, 2)",
    "outcome_stats": f"WITH {OUTCOMES} SELECT count(*) AS total, {COUNTS} FROM (SELECT * FROM O ORDER BY ts DESC, event_id DESC LIMIT 1000)",
    "by_intent": f"WITH {OUTCOMES} SELECT coalesce(intent, 'unknown') AS intent, {COUNTS} FROM O GROUP BY 1",
    "by_phase": f"WITH {OUTCOMES} SELECT coalesce(failure_point, 'unknown') AS failure_point, {COUNTS} FROM O GROUP BY 1",
    "correlations": f"WITH {OUTCOMES} SELECT CASE WHEN k % 2 = 0 THEN 'semantic' ELSE 'plain' END AS key, {SF} FROM O WHERE outcome IN ('success', 'failure') GROUP BY 1 UNION ALL SELECT CASE WHEN k > 49 THEN 'high' ELSE 'low' END, {SF} FROM O WHERE outcome IN ('success', 'failure') GROUP BY 1",
    "insights_tools": f"WITH {OUTCOMES}, {DECISIONS}, {LAST} SELECT tool, count(*) AS failures FROM (SELECT unnest(tools) AS tool FROM O JOIN LD USING (session_id) WHERE O.outcome = 'failure') GROUP BY tool",
    "insights_risk": f"WITH {OUTCOMES}, {DECISIONS}, {LAST} SELECT LD.risk_level, {SF} FROM O JOIN LD USING (session_id) WHERE outcome IN ('success', 'failure') GROUP BY 1",
    "matched_sessions": f"WITH {OUTCOMES}, {DECISIONS} SELECT count(*) AS matched FROM O WHERE session_id IN (SELECT session_id FROM D)",
    "failure_points": f"WITH {OUTCOMES} SELECT failure_point, count(*) AS n FROM O WHERE outcome = 'failure' AND failure_point IS NOT NULL GROUP BY 1",
    "session_final": f"WITH {OUTCOMES} SELECT session_id, bool_or(event_type = 'click') AS has_decision, count(*) AS n_outcomes, arg_max(outcome, (ts, event_id)) AS final_outcome, arg_max_null(failure_point, (ts, event_id)) AS failure_point FROM O GROUP BY 1",
    "first_decision": f"WITH {OUTCOMES} SELECT session_id, event_id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM O WHERE event_type = 'click') WHERE r = 1",
    "last_decision": f"WITH {OUTCOMES} SELECT session_id, event_id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM O WHERE event_type = 'click') WHERE r = 1",
    "last_n": f"WITH {OUTCOMES} SELECT event_id, outcome FROM O ORDER BY ts DESC, event_id DESC LIMIT 20",
    "phase_durations": "SELECT user_id AS session_id, event_id, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 3) AS duration_seconds FROM events",
    "failure_runs": f"WITH {OUTCOMES}, E AS (SELECT *, CAST(sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY session_id ORDER BY ts, event_id {ROWS}) AS BIGINT) AS interventions FROM O), F AS (SELECT *, CAST(sum(CAST(outcome = 'failure' AS INT)) OVER (PARTITION BY session_id, interventions ORDER BY ts, event_id {ROWS}) AS BIGINT) AS failure_count FROM E) SELECT event_id, failure_count, failure_count >= 2 AS near, failure_count >= 3 AS intervene, interventions, interventions >= 2 AS escalate FROM F",
    "revert_cap": f"SELECT event_id, reverts, reverts > 3 AS forced FROM (SELECT event_id, CAST(sum(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id {ROWS}) AS BIGINT) AS reverts FROM events)",
    "outcome_cube": f"WITH {OUTCOMES} SELECT intent, outcome, count(*) AS n FROM O GROUP BY CUBE (intent, outcome)",
    "pair_upsert": "SELECT nl_term, symbol, event_id, round(value, 6) AS similarity FROM (SELECT *, event_type AS nl_term, 'sym' || (user_id % 40) AS symbol, row_number() OVER (PARTITION BY event_type, user_id % 40 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "pair_match": "SELECT event_id, 'sym' || (user_id % 40) AS symbol FROM events WHERE event_type = 'click' AND user_id % 40 IN (1, 3, 5)",
    "pair_expiry": "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY",
    "pair_stats": "SELECT count(*) AS total, count(DISTINCT event_type) AS terms, count(DISTINCT user_id % 40) AS symbols FROM events",
    "term_symbols": "SELECT t AS nl_term, p_partkey FROM part, (VALUES ('red_part'), ('BLUE'), ('zzz')) v(t) WHERE contains(lower(p_name), lower(t)) OR contains(lower(t), lower(p_name)) OR list_has_any(string_split(replace(lower(t), '_', ' '), ' '), string_split(replace(lower(p_name), '_', ' '), ' '))",
    "gate_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "gate_required_tools": f"WITH {OUTCOMES} SELECT session_id, array_to_string(list_filter(['find_definitions', 'find_references'], lambda t: CASE t WHEN 'find_definitions' THEN NOT d ELSE NOT r END), ',') AS missing FROM (SELECT session_id, bool_or(k = 0) AS d, bool_or(k = 1) AS r FROM O GROUP BY 1)",
    "gate_thresholds": f"""WITH {OUTCOMES}, E AS (SELECT session_id, count(*) FILTER (k < 6) AS s, count(*) FILTER (k = 7) AS e, count(*) FILTER (k = 8) AS f, count(*) FILTER (k = 9) AS p, arg_max(intent, (ts, event_id)) AS intent, arg_max(risk_level, (ts, event_id)) AS risk FROM O GROUP BY 1),
N AS (SELECT *, CASE WHEN intent NOT IN ('IMPLEMENT', 'MODIFY') THEN [1, 0, 1, 0] WHEN risk = 'HIGH' THEN [5, 2, 4, 2] ELSE [3, 1, 2, 1] END AS q FROM E),
M AS (SELECT session_id, list_filter([CASE WHEN s < q[1] THEN 'symbols_identified: ' || s || '/' || q[1] END, CASE WHEN e < q[2] THEN 'entry_points: ' || e || '/' || q[2] END, CASE WHEN f < q[3] THEN 'files_analyzed: ' || f || '/' || q[3] END, CASE WHEN p < q[4] THEN 'existing_patterns: ' || p || '/' || q[4] END, CASE WHEN intent IN ('IMPLEMENT', 'MODIFY') AND risk = 'HIGH' THEN 'slot_evidence: observed_issue not evidenced' END], lambda x: x IS NOT NULL) AS m FROM N)
SELECT session_id, array_to_string(m, '; ') AS missing, CASE WHEN len(m) = 0 THEN 'high' ELSE 'low' END AS confidence FROM M""",
    "gate_tools": f"""WITH {OUTCOMES}, C AS (SELECT event_id, ['EXPLORATION', 'SEMANTIC', 'VERIFICATION', 'IMPACT_ANALYSIS', 'READY', 'PRE_COMMIT', 'QUALITY_REVIEW'][k % 7 + 1] AS phase, ['query', 'semantic_search', 'submit_verification', 'merge_to_base'][event_id % 4 + 1] AS tool FROM O)
SELECT * FROM C WHERE NOT (phase = 'READY' OR (tool = 'query' AND phase IN ('EXPLORATION', 'VERIFICATION', 'IMPACT_ANALYSIS')) OR (tool = 'semantic_search' AND phase = 'SEMANTIC') OR (tool = 'submit_verification' AND phase = 'VERIFICATION') OR (tool = 'merge_to_base' AND phase = 'PRE_COMMIT'))""",
    "gate_reasons": f"""WITH {OUTCOMES}, C AS (SELECT event_id, k % 5 AS m, event_id % 4 AS r FROM O)
SELECT event_id, r = 3 OR (r = 0 AND m IN (0, 1)) OR (r = 1 AND m = 1) OR (r = 2 AND m = 2) AS allowed FROM C""",
    "gate_write": """WITH O AS (SELECT *, 'd' || (o_orderkey % 5) AS dir, 'f' || (o_orderkey % 11) AS name FROM orders), E AS (SELECT o_custkey, dir, name FROM O WHERE o_orderstatus = 'F')
SELECT t.o_orderkey, NOT EXISTS (SELECT 1 FROM E WHERE E.o_custkey = t.o_custkey) OR EXISTS (SELECT 1 FROM E WHERE E.o_custkey = t.o_custkey AND (E.name = t.name OR (t.o_orderkey % 2 = 0 AND E.dir = t.dir))) AS allowed FROM O t WHERE t.o_orderstatus = 'O'""",
    "verification": "SELECT source AS session_id, bool_and(toxic <> 1) AS all_confirmed, count(*) FILTER (toxic = 1) AS n_rejected FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "plan_route": """WITH F AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 4 THEN 'EXPLORE' ELSE ['IMPLEMENT', 'MODIFY', 'DELETE', 'EXPLORE'][c_custkey % 5 + 1] END AS intent FROM customer),
M AS (SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN 'target_feature' END, CASE WHEN k % 3 = 0 THEN 'trigger_condition' END, CASE WHEN k % 4 = 0 THEN 'observed_issue' END, CASE WHEN k % 5 = 0 THEN 'desired_action' END], lambda x: x IS NOT NULL) AS m FROM F),
T AS (SELECT *, list_filter(CASE WHEN k % 2 = 0 THEN ['find_definitions', 'search_text', 'get_symbols', 'find_references', 'analyze_structure'] ELSE ['find_references', 'search_text', 'analyze_structure'] END,
  lambda t: (k % 2 = 0 AND t IN ('find_definitions', 'search_text', 'get_symbols')) OR (k % 3 = 0 AND t IN ('find_references', 'search_text')) OR (k % 4 = 0 AND t IN ('search_text', 'analyze_structure')) OR (intent = 'EXPLORE' AND t = 'analyze_structure')) AS t FROM M)
SELECT k AS c_custkey, intent, array_to_string(m, ',') AS missing, array_to_string(t, ',') AS tools, CASE WHEN len(m) >= 3 THEN 'HIGH' WHEN len(m) = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, intent <> 'EXPLORE' OR k % 7 = 0 AS needs_bootstrap, CAST(CASE WHEN intent = 'EXPLORE' THEN 1 ELSE 3 END AS BIGINT) AS n_phases FROM T""",
    "risk_level": "SELECT c_custkey, CASE WHEN b AND NOT i THEN 'HIGH' WHEN m = 1 AND NOT t THEN 'HIGH' WHEN m = 0 AND NOT t AND NOT i AND NOT b THEN 'HIGH' WHEN i AND short THEN 'MEDIUM' WHEN c_mktsegment = 'MACHINERY' THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT *, c_nationkey % 3 AS m, c_acctbal > 2000 AS t, c_acctbal > 0 AS i, c_mktsegment = 'BUILDING' AS short, c_nationkey > 18 AS b FROM customer)",
    "session_windows": f"WITH G AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), H AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts {ROWS}) AS g FROM G) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM H GROUP BY user_id, g",
    "tumbling_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "front_matter": "SELECT 'agreements/' || p_partkey || '.md' AS path, 'a: b' AS file, p_name AS nl_term, 'P' || p_partkey AS symbol, 'body ' || p_type AS body FROM part",
    "agreements": f"SELECT p_partkey, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') || '.md' AS file, {HASH.format('m')} AS hash FROM (SELECT p_partkey, p_name, p_brand, '---' || chr(10) || 'doc_type: agreement' || chr(10) || 'nl_term: ' || p_name || chr(10) || 'symbol: ' || p_brand || chr(10) || 'symbol_normalized: ' || p_brand || chr(10) || 'similarity: ' || printf('%.3f', p_size / 50.0) || chr(10) || 'session_id: s1' || chr(10) || 'intent: MODIFY' || chr(10) || 'learned_at: 2024-01-01T00:00:00' || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || ' → ' || p_brand || chr(10) || chr(10) || '**シンボル（分解）**: ' || p_brand || chr(10) || chr(10) || '## 根拠 (Code Evidence)' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## 関連ファイル' || chr(10) || chr(10) || '- `a.py`' || chr(10) || '- `b.py`' || chr(10) || chr(10) || '## QueryFrame' || chr(10) || chr(10) || '- **target_feature**: ' || p_name || chr(10) AS m FROM part)",
    "tool_stream": "SELECT 'u' || user_id AS file, CAST(event_id AS INT) AS line_number, 'x' AS line_content FROM events WHERE event_type = 'click'",
    "outcome_fan_out": f"WITH {OUTCOMES}, R AS (SELECT session_id, event_type AS nl_term, p || (k % 3) AS symbol, value, 'e' || (k % 4) AS evidence FROM O, (VALUES ('A'), ('B')) v(p) WHERE outcome = 'success') SELECT session_id, nl_term, symbol, round(max(value), 6) AS similarity, string_agg(DISTINCT evidence, '; ' ORDER BY evidence) AS code_evidence FROM R GROUP BY 1, 2, 3",
    "missing_slots": """WITH M AS (SELECT c_custkey, c_nationkey < 5 AS x, list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'target_feature' END, CASE WHEN c_nationkey <= 12 THEN 'trigger_condition' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'observed_issue' END, 'desired_action'], lambda s: s IS NOT NULL) AS m FROM customer)
SELECT c_custkey, array_to_string(m, ',') AS missing,
  array_to_string(CASE WHEN m[1] = 'target_feature' THEN ['query', 'get_symbols', 'analyze_structure'] || CASE WHEN len(m) > 2 OR m[2] <> 'desired_action' THEN ['search_text'] ELSE [] END || CASE WHEN list_contains(m, 'trigger_condition') THEN ['find_definitions'] ELSE [] END || ['find_references']
    WHEN m[1] = 'trigger_condition' THEN ['search_text', 'find_definitions'] || CASE WHEN list_contains(m, 'observed_issue') THEN ['query'] ELSE [] END || ['find_references', 'analyze_structure']
    WHEN m[1] = 'observed_issue' THEN ['search_text', 'query', 'find_references', 'analyze_structure'] ELSE ['find_references', 'analyze_structure'] END, ',') AS guidance,
  array_to_string(list_filter(CASE WHEN x THEN ['target_feature', 'trigger_condition', 'observed_issue', 'desired_action'] ELSE ['target_feature', 'observed_issue', 'trigger_condition', 'desired_action'] END, lambda s: list_contains(m, s)), ',') AS priority FROM M""",
    "doc_summaries": "SELECT p_partkey, '# ' || p_name || chr(10) || 'First ' || p_type || '.' || chr(10) || '## Size' || chr(10) || p_size AS summary FROM part",
    "project_rules": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'DO:' || chr(10) || '- use ' || p_name || chr(10) || chr(10) || 'DON''T:' || chr(10) || '- use ' || p_brand ELSE 'Rules:' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_type END AS rules FROM part",
    "document_changes": f"WITH {SNAPS} SELECT N.doc_id, CASE WHEN quality IS NULL THEN 'new' ELSE 'modified' END AS change FROM N LEFT JOIN labels l ON l.doc_id = N.doc_id WHERE quality IS NULL OR (toxic <> 1 AND quality = 0)",
    "summaries_merged": f"WITH {SNAPS} SELECT N.doc_id, hash AS content_hash, coalesce('note ' || quality, '') AS extra_notes FROM N LEFT JOIN labels l ON l.doc_id = N.doc_id",
    "languages": "SELECT p_partkey, ['python', 'composer_json', 'blade', 'filament_resource', 'migration', 'scss', 'unknown', 'tailwind_config'][p_size % 8 + 1] AS lang, p_size % 8 = 5 AS markup_only FROM part",
    "verdicts_together": "WITH P AS (SELECT p_brand AS brand, p_name AS symbol, max(p_size) / 50.0 AS s FROM part GROUP BY 1, 2) SELECT brand, count(*) FILTER (s >= 0.3) AS n_approved, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (s < 0.3), '') AS rejected, CASE WHEN coalesce(bool_or(s >= 0.3 AND s <= 0.6), false) THEN 'HIGH' ELSE 'LOW' END AS risk FROM P GROUP BY 1",
    "evidence_gate": "SELECT o_orderkey, o_orderstatus = 'O' AND o_totalprice <= 100000 AS valid, length(trim(o_orderpriority)) >= 10 AS assessed FROM orders",
    "phase_steps": f"WITH {OUTCOMES}, P AS (SELECT *, ['EXPLORATION', 'SEMANTIC', 'VERIFICATION', 'IMPACT_ANALYSIS', 'READY', 'PRE_COMMIT', 'QUALITY_REVIEW'] AS ps FROM O) SELECT event_id, CASE WHEN k % 4 = 0 OR k > 90 THEN 'READY' ELSE 'EXPLORATION' END AS start, CASE WHEN k > 50 OR outcome = 'success' THEN ps[k % 7 + 1] WHEN k % 7 = 6 THEN 'READY' ELSE ps[k % 7 + 2] END AS next FROM P",
    "exploration_consistency": "SELECT p_partkey, CAST(2 AS BIGINT) AS n FROM part",
    "ready_check": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '' ELSE 'Slot ''target_feature'' is still HYPOTHESIS.' END || CASE WHEN NOT c_acctbal > 0 AND c_nationkey <= 12 THEN ' ' ELSE '' END || CASE WHEN c_nationkey > 12 THEN '' ELSE 'Symbols ' || c_name || ' are still HYPOTHESIS.' END AS errors FROM customer",
    "symbol_folds": f"""WITH {OUTCOMES}, U AS (SELECT session_id, event_type AS name, value, k < 5 AS fact, row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts, event_id) AS i FROM O),
F AS (SELECT *, max(CASE WHEN fact THEN i ELSE 0 END) OVER (PARTITION BY session_id, name) AS last FROM U)
SELECT session_id, name, CASE WHEN max(last) = 0 OR arg_max(i, (value, -i)) > max(last) THEN 'HYPOTHESIS' ELSE 'FACT' END AS source, round(max(value), 6) AS confidence FROM F WHERE i >= last GROUP BY 1, 2""",
    "cache_sizes": f"WITH {LINES} SELECT count(DISTINCT doc_id) AS files, count(*) AS tags FROM L",
    "next_state": f"WITH {SNAPS}, {CHANGES}, {LINES}, {WINDOWS}, K AS (SELECT doc_id, count(*) AS n FROM W GROUP BY 1) SELECT C.doc_id, N.hash, CASE WHEN change = 'unchanged' THEN 'old' ELSE 'now' END AS indexed_at, CASE WHEN change = 'unchanged' THEN 1 ELSE coalesce(K.n, 0) END AS chunk_count FROM C JOIN N ON N.doc_id = C.doc_id LEFT JOIN K ON K.doc_id = C.doc_id",
    "sliding_windows": "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2",
}
# The same rows by another way.
ORACLE_SQL |= {
    "knn_cells": ORACLE_SQL["knn_topk"],
    "knn_recall": "SELECT count(*) AS n_queries, count(*) * least(10, (SELECT count(*) FROM embeddings)) AS n_right, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "cdc_digest": ORACLE_SQL["cdc_diff"],
    "merged_pairs": ORACLE_SQL["pair_upsert"],
    "merged_chunks": "SELECT doc_id AS path, CASE WHEN quality = 0 THEN n_chars ELSE 0 END AS size, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT DISTINCT FROM 0 OR (doc_id % 7 <> 3 AND toxic IS DISTINCT FROM 1)",
}
