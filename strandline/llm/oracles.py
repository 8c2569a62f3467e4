"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from strandline.llm.quality import RULES, STOP_WORDS

GAP = r"[\x20\x09-\x0D]+"
#: Words of a text column as a list; blank and null texts have none.
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda x: x <> '')"


def _rules() -> str:
    broken = [f"(n_words >= {r.from_words} AND ({' OR '.join([f'{r.metric} < {r.low}'] * (r.low is not None) + [f'{r.metric} > {r.high}'] * (r.high is not None))}))" for r in RULES]
    return " OR ".join(broken)


_STOPS = ", ".join(f"'{form}'" for form in sorted({form for x in STOP_WORDS.split() for form in (x, x.capitalize(), x.upper())}))

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM d, unnest(generate_series(1, len(w) - 4)) AS u(i) WHERE len(w) >= 5),
repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, unnest(generate_series(0, 4)) AS u(k) GROUP BY r),
figures AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣][\x20\x09-\x0D]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN covered USING (r)),
ratios AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
    coalesce(n_exclaim / nullif(n_words, 0), 0) AS exclaim_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_bullet_lines / nullif(n_lines, 0), 0) AS bullet_line_ratio,
    coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) AS ellipsis_line_ratio
  FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_rules()}) AS kept
FROM ratios
"""

_REST = r"(s>|/s>|INST\]|/INST\]|TURN\]|<SYS>>|</SYS>>)"
#: The windows of op8 with its default budget: 512 tokens, 128 of them for history, two turns repeated, 4 a turn on top.
CHAT_FORMAT = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS x),
r AS (
  SELECT *, row_number() OVER w AS idx, len({WORDS}) + 4 AS tokens
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, idx = 1 AND role = 'system' AS sys, greatest(1, 384 - first(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx)) AS room FROM r),
b AS (
  SELECT *, coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
n AS (SELECT *, CASE WHEN before // room <> lag(before // room) OVER (PARTITION BY conv_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM b),
v AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY idx) AS win FROM n),
a AS (
  SELECT *, max(win) OVER (PARTITION BY conv_id) + 1 AS wins,
    list({{'w': win, 'b': before}}) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS nexts FROM v),
k AS (
  SELECT *, CASE WHEN sys THEN wins ELSE 1 + len(list_distinct(list_transform(list_filter(coalesce(nexts, []), lambda x: x.w <> win AND x.b - before <= 128), lambda x: x.w))) END AS copies,
    6 + length(url_encode(role)) + 1 + length(regexp_replace(text, '(<|\[)(\\*){_REST}', '\1\\\2\3', 'g')) + 4 AS chars FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(copies * chars) + 3 * max(wins) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) AS u(i) WHERE len(w) >= 50),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + k AS p FROM m, unnest(generate_series(0, 49)) AS u(k)),
t AS (SELECT r, w[p] AS word, p FROM d, unnest(generate_series(1, len(w))) AS u(p)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM t ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
