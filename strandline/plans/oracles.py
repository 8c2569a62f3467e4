"""DuckDB SQL for the bundled queries."""

from __future__ import annotations

from strandline.sources.tables import EXECUTIONS_SQL, NOW_MS

_E = f"e AS ({EXECUTIONS_SQL.format(millis='epoch_ns(ts) // 1000000')})"
_C = f"""c AS (SELECT text, min(id) AS id, min(coalesce(started_at, {NOW_MS})) AS first_seen, max(coalesce(started_at, {NOW_MS})) AS last_seen,
  count(*) AS run_count, arg_min(redacted, id) AS redacted FROM e GROUP BY text)"""
_L = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY started_at DESC NULLS LAST, id DESC) AS rn FROM e) WHERE rn = 1)"
_V = f"v AS (SELECT vec_id AS command_id, CASE WHEN label = 0 THEN 'm0' ELSE 'm1' END AS model_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings)"

_BM25 = r"""t AS (SELECT doc_id, lang, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS w FROM documents),
f AS (SELECT doc_id, lang, len(w) AS l, len(list_filter(w, lambda x: starts_with(x, 'the'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'thi'))) AS f1 FROM t),
s AS (SELECT count(*) AS n, sum(l) / count(*) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM f),
i AS (SELECT a, CASE WHEN n - d0 > d0 THEN ln((n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS i0,
  CASE WHEN n - d1 > d1 THEN ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS i1 FROM s),
b AS (SELECT doc_id, lang, f0, f1, -(i0 * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))
  + i1 * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))) AS bm25 FROM f, i WHERE f0 + f1 > 0)"""


def _bm25(where: str) -> str:
    return f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE {where} ORDER BY b.bm25, doc_id LIMIT 10"


def _nearest(query: int, where: str, k: int) -> str:
    return f"SELECT e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE {where} ORDER BY score DESC, vec_id LIMIT {k}"


_FUSED = f"""{_BM25}, kw AS (SELECT doc_id AS id, row_number() OVER (ORDER BY bm25, doc_id) AS r FROM (SELECT * FROM b ORDER BY bm25, doc_id LIMIT 50)),
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_nearest(3, "TRUE", 50)})),
u AS (SELECT id, 0.5::DOUBLE / (r + 60) AS s, TRUE AS k FROM kw UNION ALL SELECT id, 1.0::DOUBLE / (r + 60), FALSE FROM sem),
fused AS (SELECT id, sum(s) AS score, bool_or(k) AS keyword FROM u GROUP BY id)"""

_TRUTH = """d AS (SELECT source AS query_id, doc_id AS id, n_chars, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1) AS fits FROM documents),
x1 AS (SELECT * FROM (SELECT query_id, id, fits, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM d) WHERE rank <= 50),
x2 AS (SELECT * FROM (SELECT query_id, id, fits, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM d) WHERE rank <= 50)"""

_WHOLE = "h AS (SELECT path, turn * 4294967296 + generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM t)"

_SPACE = r"[\s\x0B\p{Z}]+"

_TIMED = r"(?s)^: (-?[0-9]+):(-?[0-9]+);(.*)$"

_AGO = f"""CASE WHEN started_at IS NULL THEN NULL ELSE coalesce((SELECT min_by(concat(s // size, ' ', unit, CASE WHEN s // size = 1 THEN '' ELSE 's' END, ' ago'), -size)
  FROM (VALUES (31536000, 'year'), (2592000, 'month'), (604800, 'week'), (86400, 'day'), (3600, 'hour'), (60, 'minute')) AS u(size, unit), (SELECT ({NOW_MS} - started_at) // 1000 AS s) WHERE s >= size), 'just now') END"""

_RUNS = "CASE WHEN run_count = 1 THEN '1 run' ELSE concat(run_count, ' runs') END"

_SCORED = "coalesce(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 0) AS top1, avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5, avg(coalesce(1.0::DOUBLE / r, 0)) AS mrr"

ORACLE_SQL = {
    "upsert_commands": f"WITH {_E}, {_C} SELECT * FROM c",
    "stream_upsert": f"WITH {_E}, {_C} SELECT * FROM c",
    "latest_execution": f"WITH {_E}, {_L} SELECT text, id, started_at, exit_code FROM l",
    "filter_dir": f"WITH {_E}, {_C} SELECT text, run_count FROM c WHERE EXISTS (SELECT 1 FROM e WHERE e.text = c.text AND (cwd = '/srv/u1' OR git_root = '/srv/g3'))",
    "filter_session": f"WITH {_E}, {_C} SELECT text, run_count FROM c WHERE EXISTS (SELECT 1 FROM e WHERE e.text = c.text AND session_id = '7')",
    "filter_failed": f"WITH {_E}, {_C}, {_L} SELECT c.text, c.run_count FROM c JOIN l USING (text) WHERE coalesce(exit_code, 0) <> 0",
    "recent_commands": f"WITH {_E}, {_C} SELECT id, text, last_seen FROM c ORDER BY last_seen DESC, id DESC LIMIT 20",
    "hydrate_results": f"""WITH {_E}, {_C}, {_L}, top AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, id DESC) AS pos FROM c)
        SELECT CAST(pos AS INTEGER) AS pos, text, run_count, l.cwd, l.exit_code, l.started_at AS last_run FROM top JOIN l USING (text) WHERE pos <= 20""",
    "find_substring": "SELECT doc_id FROM documents WHERE instr(text, 'ing th') > 0",
    "stats_by_source": f"""WITH {_E}, {_C} SELECT (SELECT count(*) FROM c) AS commands, (SELECT CAST(coalesce(sum(redacted), 0) AS BIGINT) FROM c) AS redactions,
        count_if(source = 'live')::BIGINT AS live, count_if(source = 'import')::BIGINT AS imported, count_if(source NOT IN ('live', 'import'))::BIGINT AS other FROM e""",
    "last_live_run": f"WITH {_E} SELECT max(started_at) AS last_live FROM e WHERE source = 'live'",
    "pending_embeddings": f"WITH {_V} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT command_id FROM v WHERE model_id = 'm1')",
    "pending_count": f"WITH {_V} SELECT count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT command_id FROM v WHERE model_id = 'm1')",
    "save_embeddings": f"WITH {_V} SELECT command_id, CASE WHEN model_id = 'm0' THEN 'm2' ELSE model_id END AS model_id, dims FROM v WHERE command_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "embedding_matrix": f"WITH {_V} SELECT count(*) AS n, CAST(max(dims) AS BIGINT) AS dims FROM v WHERE model_id = 'm1'",
    "forget_cascade": f"WITH {_E} SELECT id, text FROM e WHERE NOT regexp_matches(text, ' --user [1-9]$')",
    "forgotten_runs": f"WITH {_E} SELECT count(*) AS runs FROM e WHERE regexp_matches(text, ' --user [1-9]$')",
    "keyword_and": _bm25("f0 > 0 AND f1 > 0"),
    "keyword_or": _bm25("TRUE"),
    "keyword_filtered": _bm25("lang = 'fr'"),
    "keyword_index": _bm25("TRUE"),
    "keyword_index_filtered": _bm25("lang = 'fr'"),
    "vector_topk": f"SELECT vec_id, round(score, 6) AS score FROM ({_nearest(0, 'TRUE', 10)})",
    "vector_topk_filtered": f"SELECT vec_id, round(score, 6) AS score FROM ({_nearest(0, 'label = 1', 10)})",
    "normalised_vectors": """SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm,
        round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS cosine FROM embeddings""",
    "rrf_fuse": f"WITH {_FUSED} SELECT id, round(score, 9) AS score, keyword FROM fused ORDER BY fused.score DESC, id LIMIT 20",
    "hybrid_search": f"""WITH {_FUSED}, top AS (SELECT id, keyword, row_number() OVER (ORDER BY score DESC, id) AS pos FROM fused ORDER BY pos LIMIT 12),
        own AS (SELECT text, keyword, pos FROM top JOIN documents ON doc_id = id),
        lib AS (SELECT b.text, row_number() OVER (ORDER BY n.score DESC, n.vec_id) AS pos FROM ({_nearest(3, "vec_id IN (SELECT item_id FROM benchmark)", 17)}) n JOIN benchmark b ON b.item_id = n.vec_id),
        fresh AS (SELECT text, row_number() OVER (ORDER BY pos) AS nr FROM lib WHERE text NOT IN (SELECT text FROM own)),
        woven AS (SELECT 0 AS block, pos AS nr, 0 AS src, text FROM own WHERE keyword
          UNION ALL SELECT 1, row_number() OVER (ORDER BY pos), 0, text FROM own WHERE NOT keyword
          UNION ALL SELECT 1, nr, 1, text FROM fresh WHERE nr <= 5)
        SELECT CAST(row_number() OVER (ORDER BY block, nr, src) AS INTEGER) AS pos, text, src = 1 AS library FROM woven ORDER BY pos LIMIT 12""",
    "library_dedup": "SELECT item_id FROM benchmark WHERE text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)",
    "eval_metrics": f"""WITH {_TRUTH}, m AS (SELECT query_id, min(rank) FILTER (WHERE fits AND rank <= 10) AS r FROM x1 GROUP BY query_id)
        SELECT round(top1, 9) AS top1, round(top5, 9) AS top5, round(mrr, 9) AS mrr, n_queries FROM (SELECT {_SCORED}, count(*) AS n_queries FROM m)""",
    "eval_grid": f"""WITH {_TRUTH}, u AS (SELECT query_id, id, fits, 1.0::DOUBLE / (60 + rank) AS s FROM x1 UNION ALL SELECT query_id, id, fits, 0.5::DOUBLE / (60 + rank) FROM x2),
        g AS (SELECT query_id, id, any_value(fits) AS fits, round(sum(s), 12) AS s FROM u GROUP BY query_id, id),
        x3 AS (SELECT query_id, id, fits, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM g),
        x AS (SELECT *, 'longest' AS ranker FROM x1 UNION ALL SELECT *, 'oldest' FROM x2 UNION ALL SELECT *, 'fused' FROM x3),
        m AS (SELECT ranker, query_id, min(rank) FILTER (WHERE fits AND rank <= 10) AS r FROM x GROUP BY ranker, query_id)
        SELECT ranker, round(top1, 9) AS top1, round(top5, 9) AS top5, round(mrr, 9) AS mrr FROM (SELECT ranker, {_SCORED} FROM m GROUP BY ranker)""",
    "parse_history": rf"""WITH t AS (SELECT conv_id AS path, turn, list_concat(CASE WHEN turn % 3 = 1 THEN [concat('#17000000', lpad(CAST(turn AS VARCHAR), 2, '0'))] ELSE [] END, string_split(coalesce(text, ''), chr(10))) AS lines FROM conversations),
        {_WHOLE}, s AS (SELECT *, CASE WHEN regexp_full_match(line, '#[0-9]+') THEN TRY_CAST(substr(line, 2) AS BIGINT) END AS stamp FROM h),
        g AS (SELECT *, count(stamp) OVER (PARTITION BY path ORDER BY line_no) AS entry FROM s),
        timed AS (SELECT path, min(line_no) AS seq, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stamp IS NULL) AS body, max(stamp) AS stamp FROM g WHERE entry > 0 GROUP BY path, entry)
        SELECT path, line_no AS seq, line AS command, CAST(NULL AS BIGINT) AS started_at FROM g WHERE entry = 0 AND regexp_replace(line, '{_SPACE}', '', 'g') <> ''
        UNION ALL SELECT path, seq, regexp_replace(body, '^([ \t\r\f]*\n)+', '') AS command, stamp * 1000 FROM timed WHERE regexp_replace(coalesce(body, ''), '{_SPACE}', '', 'g') <> ''""",
    "parse_zsh_history": rf"""WITH c AS (SELECT conv_id AS path, turn, coalesce(text, '') AS text FROM conversations),
        t AS (SELECT path, turn, string_split(concat(CASE WHEN turn % 2 = 0 THEN concat(': 1700000000:', turn, ';', replace(text, chr(10), '\' || chr(10))) ELSE text END, CASE WHEN turn % 4 = 2 THEN '\' ELSE '' END), chr(10)) AS lines FROM c),
        {_WHOLE}, g AS (SELECT *, sum(CASE WHEN coalesce(prev, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS entry FROM (SELECT *, lag(suffix(line, '\')) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM h)),
        j AS (SELECT path, min(line_no) AS seq, string_agg(CASE WHEN suffix(line, '\') THEN concat(line[:-2], chr(10)) ELSE line END, '' ORDER BY line_no) AS text FROM g GROUP BY path, entry),
        m AS (SELECT *, TRY_CAST(regexp_extract(text, '{_TIMED}', 1) AS BIGINT) AS s, TRY_CAST(regexp_extract(text, '{_TIMED}', 2) AS BIGINT) AS e FROM j)
        SELECT * FROM (SELECT path, seq, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN regexp_extract(text, '{_TIMED}', 3) ELSE text END AS command,
          CASE WHEN e IS NOT NULL THEN s * 1000 END AS started_at, CASE WHEN s IS NOT NULL THEN e * 1000 END AS duration_ms FROM m) WHERE regexp_replace(command, '{_SPACE}', '', 'g') <> ''""",
    "scrub_env": "SELECT event_id, 'export API_TOKEN=<REDACTED:secret-env> && ./run' AS text, CAST(1 AS INTEGER) AS redactions FROM events",
    "class_entropy": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}')) AS token, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), 1) - 1 AS pos FROM documents),
        k AS (SELECT doc_id, pos, c, count(*) AS n, any_value(length(token)) AS m FROM (SELECT doc_id, pos, token, unnest(string_split(token, '')) AS c FROM t) GROUP BY doc_id, pos, c)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(-sum(n / m * log2(n / m)), 6) AS bits FROM k GROUP BY doc_id, pos""",
    "relative_time": f"WITH {_E} SELECT id, {_AGO} AS ago FROM e",
    "details_line": f"""WITH {_E}, {_C}, {_L} SELECT l.text, concat_ws(' · ', replace(cwd, '/srv/', '~/'), coalesce({_AGO}, 'imported'), 'exit ' || exit_code, {_RUNS}) AS line FROM l JOIN c ON c.text = l.text""",
    "panel_rows": f"""WITH {_E}, {_C}, {_L} SELECT l.text, concat(l.text, '  ', concat_ws(' · ', replace(cwd, '/srv/', '~/'), coalesce({_AGO}, 'imported'), CASE WHEN run_count > 1 THEN run_count || '×' END),
        CASE WHEN exit_code IS NULL THEN '' WHEN exit_code = 0 THEN ' ✓' ELSE ' ✗' END) AS line FROM l JOIN c ON c.text = l.text""",
    "epoch_times": """SELECT *, CASE WHEN end_ms >= start_ms THEN end_ms - start_ms END AS duration_ms FROM (SELECT event_id, (1700000000 + event_id) * 1000 + CASE WHEN event_id % 2 = 0 THEN 250 ELSE 500 END AS start_ms,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE (1700000002 + event_id - event_id % 4) * 1000 + 750 END AS end_ms FROM events)""",
    "git_roots": f"WITH {_E} SELECT id, CASE cwd WHEN '/srv/u1' THEN '/srv/u1' WHEN '/srv/u2' THEN '/srv/u2/src' ELSE '/srv' END AS git_root FROM e",
    "installed_tools": "SELECT item_id FROM benchmark WHERE CASE WHEN item_id % 3 = 0 THEN 'git' ELSE string_split(text, ' ')[1] END IN (SELECT string_split(text, ' ')[1] FROM documents UNION ALL SELECT 'git')",
    "toy_ranker": """SELECT id, score FROM (SELECT item_id AS id, CAST(CASE WHEN contains(lower(text), 'and the') THEN 100 ELSE 0 END + len(list_intersect(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w[:5])), ['and', 'the'])) AS INTEGER) AS score
        FROM benchmark) ORDER BY score DESC, id LIMIT 10""",
}
