"""SQL that restates the registered queries for DuckDB."""

from __future__ import annotations

_CLASS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
_WS = _CLASS + "+"
_PAGE = "'\n------- PAGE END -------\n'"


def _tokens(text: str, lower: bool = True) -> str:
    return f"list_filter(regexp_split_to_array({f'lower({text})' if lower else text}, '{_WS}'), lambda x: x <> '')"


def _has(term: str) -> str:
    return f"contains(lower(text), '{term}')"


def _exact(term: str) -> str:
    return f"list_contains({_tokens('text')}, '{term}')"


def _where(condition: str) -> str:
    return f"SELECT doc_id, source FROM documents WHERE {condition}"


_FLAG = f"({_has('the')} OR {_has('elle')}) AND {_has('ment')}"


def _first(term: str, where: str, more: str = "") -> str:
    n = len(term)
    return f"""SELECT doc_id, {more} CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, e - b) || CASE WHEN e <= length(text) THEN '...' ELSE '' END AS snippet
FROM (SELECT *, greatest(p - 50, 1) AS b, least(p + {n} + 50, length(text) + 1) AS e FROM (SELECT *, instr(lower(text), '{term}') AS p FROM documents WHERE {where}))"""


_SNIPPETS = f"""
WITH RECURSIVE base AS (SELECT doc_id, source, text, lower(text) AS lc FROM documents WHERE {_FLAG}),
st(doc_id, ti, pos, used, sn) AS (
  SELECT doc_id, 1, 0, CAST([] AS STRUCT(a BIGINT, z BIGINT)[]), CAST([] AS VARCHAR[]) FROM base
  UNION ALL
  SELECT doc_id,
    CASE WHEN k = 0 OR (NOT hit AND len(sn) >= 2) THEN ti + 1 ELSE ti END,
    CASE WHEN k = 0 OR (NOT hit AND len(sn) >= 2) THEN 0 ELSE p + n END,
    CASE WHEN k > 0 AND NOT hit THEN list_append(used, {{'a': a, 'z': z}}) ELSE used END,
    CASE WHEN k > 0 AND NOT hit THEN list_append(sn, CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, z - a) || CASE WHEN z < length(text) THEN '...' ELSE '' END) ELSE sn END
  FROM (SELECT *, len(list_filter(used, lambda u: (p >= u.a AND p <= u.z) OR (p + n >= u.a AND p + n <= u.z))) > 0 AS hit FROM (
    SELECT *, greatest(0, p - 50) AS a, least(length(text), p + n + 50) AS z FROM (
      SELECT *, pos + k - 1 AS p FROM (
        SELECT st.*, text, length(t) AS n, instr(substr(lc, pos + 1), t) AS k
        FROM (SELECT *, CAST(['the', 'elle', 'ment'] AS VARCHAR[])[ti] AS t FROM st WHERE ti <= 3) st JOIN base USING (doc_id))))))
"""
_SNIPPET_OF = "CASE WHEN len(sn) = 0 THEN CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END ELSE array_to_string(sn, ' | ') END AS snippet"

_PAGED = f"(SELECT doc_id, replace(text, '\n', {_PAGE}) AS text FROM documents)"
_LABELLED = "(SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_STEPS = "(SELECT event_id, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent, user_id, event_type, ts, value FROM events)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


def _bm25(lower: bool, okapi: bool, queries: str) -> str:
    raw = "ln((n - df + 0.5) / (df + 0.5))"
    idf = f"CASE WHEN {raw} < 0 THEN 0.25 * avg({raw}) OVER () ELSE {raw} END" if okapi else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return f"""
WITH d AS (SELECT doc_id, {_tokens('text', lower)} AS ws FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS avgdl FROM d),
tf AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS t FROM d) GROUP BY doc_id, t),
df AS (SELECT t, {idf} AS idf FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), st),
q AS (SELECT qid, unnest(string_split(q, ' ')) AS t FROM (VALUES {queries}) v(qid, q)),
s AS (SELECT CAST(qid AS BIGINT) AS qid, doc_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM q JOIN df USING (t) JOIN tf USING (t), st GROUP BY qid, doc_id),
r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
"""


_KEYWORDS = "(1, 'the of and'), (2, 'elle de la'), (3, 'thing that')"
_BM25_END = "SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 4"
_NTOK = f"CAST(len({_tokens('text', False)}) AS BIGINT)"

ORACLE_SQL: dict[str, str] = {
    "flagship": _first("ment", _FLAG, "source,"),
    "bool_term": _where(_has("the")),
    "bool_and": _where(f"{_has('elle')} AND {_has('ment')}"),
    "bool_or": _where(f"{_has('elle')} OR {_has('ment')}"),
    "bool_nested": _where(_FLAG),
    "bool_deep": _where(f"(({_has('the')} AND {_has('of')}) OR ({_has('elle')} AND {_has('une')})) AND (({_has('ment')} OR {_has('thing')}) OR {_has('der')})"),
    "bool_leftassoc": _where(f"({_has('elle')} OR {_has('the')}) AND {_has('thing')}"),
    "bool_adjacent": _where(_has("elle")),
    "bool_dangling": _where(f"{_has('elle')} AND {_has('ment')}"),
    "bool_unbalanced": _where(_has("elle")),
    "bool_empty": _where("false"),
    "bool_wildcards": _where(f"{_has('100%')} OR {_has('_')}"),
    "exact_term": _where(_exact("the")),
    "exact_and_or": _where(f"({_exact('the')} AND {_exact('of')}) OR {_exact('elle')}"),
    "exact_by_postings": f"SELECT doc_id FROM documents WHERE ({_exact('the')} AND {_exact('of')}) OR {_exact('elle')}",
    "exact_vs_substring": f"SELECT count(*) FILTER (WHERE {_has('thing')}) AS n_substring, count(*) FILTER (WHERE {_exact('thing')}) AS n_exact FROM documents",
    "search_count": f"SELECT count(*) AS n FROM documents WHERE {_FLAG}",
    "snippet_first": _first("elle", _has("elle")),
    "snippet_multi": f"{_SNIPPETS} SELECT doc_id, {_SNIPPET_OF} FROM st JOIN base USING (doc_id) WHERE ti = 4",
    "snippet_fallback": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents",
    "doc_key": "SELECT doc_id, coalesce(source, 'None') || '-doc-' || doc_id AS doc_key FROM documents",
    "clean_metadata": f"SELECT doc_id, coalesce(source, 'Unknown') AS source, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality, coalesce(CAST(toxic AS VARCHAR), 'Unknown') AS toxic FROM {_LABELLED}",
    "metadata_diff": f"SELECT doc_id, name, CAST(NULL AS VARCHAR) AS before, 'Unknown' AS after FROM (SELECT doc_id, unnest(['source', 'quality', 'toxic']) AS name, unnest([source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS v FROM {_LABELLED}) WHERE v IS NULL",
    "kb_upsert": """
SELECT doc_key, CASE WHEN first.b = 0 THEN first.o ELSE first.o + (SELECT max(doc_id) FROM documents WHERE doc_id % 2 = 0) + 1 - (SELECT min(doc_id) FROM documents WHERE doc_id % 2 = 1) END AS position, last.n_chars AS n_chars FROM (
  SELECT source || '-' || lang AS doc_key, min({'b': doc_id % 2, 'o': doc_id}) AS first, max({'b': doc_id % 2, 'o': doc_id, 'n_chars': n_chars}) AS last
  FROM documents GROUP BY 1)""",
    "kb_stored": """
SELECT row_number() OVER (ORDER BY first) AS place, last.source AS source, last.title AS title, sha256(last.text) AS content FROM (
  SELECT min({'b': doc_id % 2, 'o': doc_id}) AS first, max({'b': doc_id % 2, 'o': doc_id, 'source': source, 'title': 't' || doc_id % 700, 'text': text}) AS last
  FROM documents GROUP BY source || '-t' || doc_id % 700)""",
    "mmr": f"""
WITH RECURSIVE q AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) + 0.5 * CAST(x[2] AS DOUBLE)) AS embedding FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1),
c AS (SELECT e.vec_id, e.embedding, {_dot('e.embedding', 'q.embedding')} AS s FROM embeddings e, q ORDER BY s DESC, e.vec_id LIMIT 20),
l AS (SELECT c.vec_id, c.s / (sqrt({_dot('c.embedding', 'c.embedding')}) * sqrt({_dot('q.embedding', 'q.embedding')})) AS near FROM c, q),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_dot('a.embedding', 'b.embedding')} / (sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')})) AS s FROM c a, c b),
walk AS (
  SELECT 1 AS step, [arg_max(vec_id, near)] AS picked FROM l
  UNION ALL
  SELECT step + 1, list_append(picked, arg_max(vec_id, score)) FROM (
    SELECT w.step, w.picked, l.vec_id, 0.5 * l.near - 0.5 * max(p.s) AS score
    FROM walk w JOIN l ON NOT list_contains(w.picked, l.vec_id) JOIN p ON p.a = l.vec_id AND list_contains(w.picked, p.b)
    WHERE w.step < 5 GROUP BY w.step, w.picked, l.vec_id, l.near) GROUP BY step, picked)
SELECT i::BIGINT AS rank, picked[i] AS vec_id FROM walk, range(1, 6) t(i) WHERE step = 5""",
    "vector_insert_only": "SELECT doc_id AS doc_key, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "dedup_first": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "filter_existing": "SELECT page_id, url AS path FROM pages WHERE list_last(string_split(url, '/')) NOT IN (SELECT doc_id || '?page=2&ref=x' FROM documents)",
    "line_numbers": "SELECT doc_id, array_to_string(list_transform(string_split(text, '\n'), lambda x, i: i || '. ' || x), '\n') AS text FROM documents",
    "article_slice": "SELECT doc_id, array_to_string(string_split(text, '\n')[2:3], '\n') AS text FROM documents",
    "page_split": f"SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS page, unnest(p) AS body FROM (SELECT doc_id, string_split(text, {_PAGE}) AS p FROM {_PAGED})",
    "articles_of_pages": """
SELECT doc_id || '.txt' AS source, CASE WHEN trim(body, ' ') = '' THEN 'Untitled' ELSE trim(body, ' ') END AS title, page + 1 AS start_page, 2 * page AS start_line, 2 * page + 1 AS end_line, body AS page_content
FROM (SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS page, unnest(p) AS body FROM (SELECT doc_id, string_split(text, '\n') AS p FROM documents))""",
    "collapse_blank": f"SELECT doc_id, regexp_replace(replace(text, '\n', '\n \t\n'), '\\n{_CLASS}*\\n', '\n\n', 'g') AS text FROM documents",
    "token_filter": f"SELECT doc_id, n AS n_tokens FROM (SELECT doc_id, {_NTOK} AS n FROM documents) WHERE n < 200",
    "filename_canonical": """
SELECT doc_id, path, CASE WHEN m BETWEEN 1 AND 12 THEN '/in/Issue-' || y || '-' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][m] || '.pdf' END AS new_path
FROM (SELECT doc_id, 1990 + doc_id % 30 AS y, doc_id % 14 AS m, '/in/sunbeam ' || (1990 + doc_id % 30) || ' ' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '.pdf' AS path FROM documents)""",
    "filename_date": "SELECT doc_id, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][doc_id % 12 + 1] AS month, CAST(1990 + doc_id % 30 AS VARCHAR) AS year FROM documents",
    "token_overlap": f"SELECT doc_id, len(list_intersect({_tokens('text')}, ['the', 'thing', 'of', 'other'])) / 4.0 * 100 AS overlap FROM documents",
    "content_tokens": f"SELECT doc_id, CAST(len(list_distinct({_tokens('text')})) AS BIGINT) AS n_distinct FROM documents",
    "knn_dot": f"SELECT vec_id, round({_dot('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 20",
    "knn_cosine": f"SELECT vec_id, round({_dot('e.embedding', 'q.embedding')} / (sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('q.embedding', 'q.embedding')})), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 20",
    "knn_batch": f"SELECT qid, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS vec_id, round({_dot('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 8) q)) WHERE rank <= 5",
    "bm25_topk": _bm25(False, True, _KEYWORDS) + _BM25_END,
    "bm25_lucene": _bm25(True, False, _KEYWORDS) + _BM25_END,
    "bm25_stats": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens('text', False)})) AS token FROM documents) GROUP BY token",
    "bm25_lengths": f"SELECT count(*) AS n, round(avg(len({_tokens('text', False)})), 6) AS avgdl FROM documents",
    "hybrid_union": f"""
WITH a AS (SELECT doc_id, 0 AS leg, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE {_exact('the')} AND {_exact('thing')}),
v AS (SELECT vec_id AS doc_id, 1 AS leg, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, round({_dot('e.embedding', 'q.embedding')}, 6) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 5)
SELECT CAST(0 AS BIGINT) AS qid, doc_id, CAST(leg AS BIGINT) AS leg, row_number() OVER (ORDER BY leg, rank, doc_id) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM v)""",
    "multi_query_topk": _bm25(True, False, _KEYWORDS) + "SELECT doc_id, min(qid) AS qid FROM r WHERE rank <= 4 GROUP BY doc_id",
    "format_docs": f"""
SELECT string_agg((k - 1) || '. doc-' || doc_id || '\n Metadata:\n{{"title":"doc-' || doc_id || '","source":"' || source || '"}}\nContent:\n' || text || '\n' || repeat('-', 100), '\n' ORDER BY k) AS formatted
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE {_exact('elle')} AND {_exact('une')}) WHERE k <= 5""",
    "final_answer": "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text || '\nend' ELSE text END AS answer FROM conversations",
    "citations": f"SELECT row_number() OVER (ORDER BY doc_id) AS n, 'doc-' || doc_id AS title, source FROM documents WHERE {_exact('elle')} AND {_exact('une')}",
    "chat_resume": "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', 'You answer from the archive.' FROM conversations",
    "whitelist_semi": "SELECT doc_id, source AS identifier FROM documents WHERE source IN (SELECT unnest(string_split(replace('src1, src3,src 5,nobody', ' ', ''), ',')))",
    "corpus_count": f"SELECT count(*) AS n, max({_NTOK}) AS most_tokens FROM documents",
    "token_counts": f"SELECT doc_id, {_NTOK} AS n_tokens FROM documents",
    "token_quantiles": f"SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS DOUBLE) AS q, round(unnest(quantile_cont({_NTOK}, [0.1, 0.25, 0.5, 0.75, 0.9])), 6) AS value FROM documents",
    "token_histogram": f"""
SELECT CAST(least(floor((n - lo) * 100.0 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 99) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT CAST({_NTOK} AS DOUBLE) AS n FROM documents), (SELECT min({_NTOK}) AS lo, max({_NTOK}) AS hi FROM documents) GROUP BY 1""",
    "long_docs": f"SELECT doc_id, n AS n_tokens FROM (SELECT doc_id, {_NTOK} AS n FROM documents) WHERE n > 1000",
    "metadata_maxlen": """SELECT max(length('{"source": "' || coalesce(source, 'Unknown') || '", "lang": "' || coalesce(lang, 'Unknown') || '", "n_chars": ' || n_chars || '}')) AS most FROM documents""",
    "llm_cost": "SELECT round(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) * 3e-6 + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) * 15e-6, 9) AS cost FROM conversations",
    "fetch_by_ids": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "step_tree": f"WITH RECURSIVE t(id, root, depth) AS (SELECT event_id, event_id, 0 FROM {_STEPS} WHERE parent IS NULL UNION ALL SELECT s.event_id, t.root, t.depth + 1 FROM {_STEPS} s JOIN t ON s.parent = t.id) SELECT CAST(root AS VARCHAR) AS root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM t GROUP BY 1, 2",
    "thread_timeline": "SELECT user_id AS \"threadId\", event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events",
    "step_counts": "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1",
    "feedback_agg": "SELECT event_type AS type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    "soft_deleted": "SELECT event_id FROM events WHERE event_type <> 'click'",
    "tagged_threads": "SELECT DISTINCT user_id FROM events WHERE event_type = 'click'",
    "cascade_delete": f"""
WITH RECURSIVE dead(id) AS (SELECT event_id FROM events WHERE user_id % 10 = 0 UNION SELECT s.event_id FROM {_STEPS} s JOIN dead ON s.parent = dead.id),
n AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE event_id NOT IN (SELECT id FROM dead)) AS n_left FROM events)
SELECT 'Thread' AS name, count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS n_linked FROM events WHERE user_id % 10 <> 0
UNION ALL SELECT 'Step', n_left, n_left FROM n UNION ALL SELECT 'Element', n_left, n_left FROM n UNION ALL SELECT 'Feedback', n_all, n_left FROM n""",
}
ORACLE_SQL["search_results"] = f"{_SNIPPETS} SELECT row_number() OVER (ORDER BY doc_id) AS rank, 'doc-' || doc_id AS title, coalesce(source, 'Unknown') AS source, {_SNIPPET_OF} FROM st JOIN base USING (doc_id) WHERE ti = 4"
