"""DuckDB SQL for the text queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from ledgerlift.llm.urls import RULES

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(coalesce({0}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def spaced(text: str) -> str:
    return _SPACED.format(text)


OP1 = rf"""
WITH d AS (SELECT doc_id, {_PLAIN.format(_LOW)} AS ws FROM documents),
b AS (SELECT item_id, {_PLAIN.format(_LOW)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[p:p + m - 1], ' ') AS k FROM (
  SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM (SELECT *, least(13, len(ws)) AS m FROM b) WHERE m > 0)),
dw AS (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS k FROM (SELECT d.*, l.m, unnest(range(1, len(ws) - l.m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) l)),
h AS (SELECT doc_id, p, dw.m, item_id FROM dw JOIN bw USING (m, k)),
hw AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {spaced('text')} AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS k FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS p FROM d)),
g AS (SELECT doc_id, unnest(range(p, p + 35)) AS i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
r AS (SELECT DISTINCT doc_id, i FROM g),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP3 = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS j, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
w AS (SELECT *, {spaced('line')} AS ws FROM l),
s AS (SELECT doc_id, j, list_sort(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END)) AS s FROM w WHERE len(ws) > 0),
c AS (SELECT s, min((doc_id, j)) AS f, row_number() OVER () AS c FROM s GROUP BY s),
t AS (SELECT c, f, len(s) AS n, unnest(s) AS t FROM c),
p AS (SELECT y.c FROM t x JOIN t y ON x.t = y.t AND x.f < y.f GROUP BY y.c, x.c, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
g AS (SELECT s.doc_id, s.j FROM s JOIN c USING (s) WHERE (s.doc_id, s.j) <> c.f OR c.c IN (SELECT c FROM p)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY j) AS kept FROM l ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {spaced(_LOW)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id AND least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 9
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP8 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _LONGEST)} ELSE 'allow' END AS verdict FROM h"""


def _covered(n: int) -> str:
    """Places inside n-word windows that stand twice or more in their text."""
    return f"""w{n} AS (SELECT doc_id, p, array_to_string(ws[p:p + {n - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - {n} + 2)) AS p FROM d)),
m{n} AS (SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS i FROM w{n} JOIN (SELECT doc_id, k FROM w{n} GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k)),
c{n} AS (SELECT doc_id, count(*) AS n{n}, sum(len(word)) AS chars{n} FROM m{n} JOIN x USING (doc_id, i) GROUP BY doc_id)"""


_LENGTHS = range(5, 11)
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {spaced('text')} AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
{", ".join(_covered(n) for n in _LENGTHS)},
l AS (SELECT doc_id, generate_subscripts(y, 1) AS j, unnest(y) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS y FROM d)),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS nth FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q AS (SELECT doc_id, count(*) AS n, sum(len(array_to_string({spaced('line')}, ''))) AS chars FROM r WHERE nth > 1 GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(q.n, 0) AS n_dup_lines, coalesce(n5, 0) AS n_repeat_words, coalesce(q.chars, 0) AS line_chars, {", ".join(f"coalesce(chars{n}, 0) AS chars{n}" for n in _LENGTHS)}
  FROM d LEFT JOIN q USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _LENGTHS)}),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * line_chars > 50 * word_chars {" ".join(f"OR 100 * chars{n} > 20 * word_chars" for n in _LENGTHS)}) AS kept FROM g"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_PLAIN.format(_LOW)} AS ws FROM documents) WHERE len(ws) > 0),
a AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_PLAIN.format(_LOW)}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), a GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50"""

ORACLES = {"op1_decontaminate": OP1, "op2_repeats": OP2, "op3_line_dedup": OP3, "op4_ngram_join": OP4, "op8_url_filter": OP8, "op9_quality": OP9, "op12_ranked_search": OP12}
