"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from ledgerlint.llm.url_filter import MIN_SOFT, RULES, SOFT_TERMS, STRICT_TERMS

WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT o.doc_id, count(*) AS n, sum(CASE WHEN g.p IS NOT NULL THEN 1 ELSE 0 END) AS r,
                string_agg(CASE WHEN g.p IS NULL THEN o.word END, ' ' ORDER BY o.p) AS t
         FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.p = g.p GROUP BY o.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

NORMAL = "array_to_string({}, ' ')".format(WORDS.format(
    "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"))

LINE_FREQUENCY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
line AS (SELECT doc_id, source, {NORMAL} AS norm FROM (SELECT doc_id, source, unnest(lines) AS line FROM d)),
often AS (SELECT source, norm FROM line GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
cut AS (SELECT doc_id, sum(len(string_split(l.norm, ' '))) AS n FROM line l JOIN often o
        ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(cut.n, 0)::BIGINT AS n_frequent_words
      FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id LEFT JOIN cut ON d.doc_id = cut.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * n_frequent_words > 50 * n_words AS kept
FROM f
"""


def _jaccard() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
           FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
many AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, k FROM g SEMI JOIN many USING (k)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM m a JOIN m b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
         WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, x FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, coalesce(low.b, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id
"""


def _url_filter() -> str:
    def hits(terms):
        one = "(CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN 1 ELSE 0 END)"
        return " + ".join(one.format(t) for t in terms)

    def case(value):
        longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'"
            for v, h, p in longest) + " END"

    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
             translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM r),
c AS (SELECT page_id, host, path, ({hits(STRICT_TERMS)})::INTEGER AS n_strict, ({hits(SOFT_TERMS)})::INTEGER AS n_soft FROM p)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, n_strict, n_soft,
       coalesce({case(lambda r: r[0])}, CASE WHEN n_strict >= 1 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_DEDUP,
        "op2_line_frequency": LINE_FREQUENCY,
        "op4_jaccard_join": _jaccard(),
        "op5_url_filter": _url_filter(),
    }
