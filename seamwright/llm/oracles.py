"""The same results in DuckDB's SQL, for the queries that one statement can express on small tables."""

from __future__ import annotations

import functools

from .line_dedup import LEAST
from .spelling import LETTERS, RATIO, SLIP, TIMES
from .url_rules import MIN_CONFIDENCE, MIN_ODDS, MIN_SUPPORT, PATH_RULES

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links between all pairs that share a shingle, and the smallest document that links reach.
NGRAM_JACCARD = f"""
WITH RECURSIVE
d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
r AS (SELECT doc_id, len(w) AS words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, words, p, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS gram FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
u AS (SELECT DISTINCT doc_id, md5_number_lower(gram) AS token FROM g WHERE p <= greatest(words - 3, 1)),
s AS (SELECT d.doc_id, count(token) AS n FROM d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY d.doc_id),
t AS (SELECT doc_id, n, token FROM s JOIN u USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
         GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, n AS n_shingles, least.component_id FROM s JOIN least ON s.doc_id = least.a
"""

#: Every window of 35 words is counted; words under one that is found twice go.
SUBSTRING_DEDUP = f"""
WITH
d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, n, p AS i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM words QUALIFY p <= n - 34),
twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN twice USING (h)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _path_rule(verdict: str, rule: str) -> str:
    own, slash, tail = rule.partition("/")
    return f"CASE WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{tail}') THEN {{'size': {len(rule)}, 'rule': '{rule}', 'verdict': '{verdict}'}} END"


#: Token sets of labelled urls are counted by all their subsets, in place of mining.
URL_RULES = rf"""
WITH
cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
named AS (SELECT *, list_sort(list_distinct(
    list_transform(regexp_extract_all(host, '[a-z][a-z0-9_]*'), lambda x: 'h:' || x)
    || list_transform(regexp_extract_all({LOWER.format("path")}, '[a-z][a-z0-9_]*'), lambda x: 'p:' || x)
    || list_transform(regexp_extract_all(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x))) AS tokens,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[A-Za-z]+)?/?$', 1), '') AS BIGINT) AS number FROM split),
label AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels
          WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
basket AS (SELECT tokens, bad FROM named JOIN label ON number = doc_id WHERE bad OR len(tokens) > 0),
total AS (SELECT count(*) AS n, count(*) FILTER (bad) AS bad FROM basket),
kind AS (SELECT tokens, count(*) AS n, count(*) FILTER (bad) AS bad FROM basket GROUP BY tokens),
part AS (SELECT n, bad, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS tokens FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS m FROM kind)),
found AS (SELECT part.tokens, sum(part.bad) / sum(part.n) AS confidence FROM part, total GROUP BY part.tokens, total.n, total.bad
          HAVING sum(part.bad) >= ceil({MIN_SUPPORT} * total.n) AND sum(part.bad) >= {MIN_CONFIDENCE} * sum(part.n) AND total.n > sum(part.n)
          AND sum(part.bad) * (total.n - sum(part.n) - total.bad + sum(part.bad)) >= {MIN_ODDS} * (sum(part.n) - sum(part.bad)) * (total.bad - sum(part.bad))
          AND sum(part.bad) * (total.n - sum(part.n) - total.bad + sum(part.bad)) > 0),
sets AS (SELECT DISTINCT tokens FROM named),
hit AS (SELECT sets.tokens, max(found.confidence) AS confidence FROM sets JOIN found ON list_has_all(sets.tokens, found.tokens) GROUP BY sets.tokens),
chosen AS (SELECT *, list_max(list_filter([{", ".join(_path_rule(*r) for r in PATH_RULES)}], lambda x: x IS NOT NULL)) AS c FROM named)
SELECT page_id, host, path, c.rule AS rule, coalesce(c.verdict, CASE WHEN hit.confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.confidence AS confidence
FROM chosen LEFT JOIN hit ON chosen.tokens = hit.tokens
"""

#: Documents of every line key; lines of keys in ten or more go.
LINE_DEDUP = f"""
WITH
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
k AS (SELECT doc_id, line, p, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM k ANTI JOIN common USING (key) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_CRC = [functools.reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(8), k) for k in range(256)]
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(ch) - 64 AS BIGINT)] END))"
_CRC32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: xor((CAST({_CRC} AS BIGINT[]))[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"

#: Near words by their texts without one letter: the same rest at the same place, or a rest that is a word.
SPELLING = f"""
WITH RECURSIVE
r AS (SELECT doc_id, {LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {LETTERS} GROUP BY ALL),
h AS (SELECT w, n, {_CRC32.format("(doc_id || ':' || w)")} AS h FROM g),
s AS (SELECT n, CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {TIMES}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
more AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON cut.rest = words.word),
near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b FROM more UNION ALL SELECT b, a FROM more),
ranked AS (SELECT near.a, near.b, words.n, count(*) OVER (PARTITION BY near.a) AS n_near, row_number() OVER (PARTITION BY near.a ORDER BY words.n DESC, near.b) AS k FROM near JOIN words ON words.word = near.b),
form AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= {RATIO} * words.n THEN b END AS form, CASE WHEN ranked.n >= {RATIO} * words.n THEN ranked.n END AS form_n
         FROM words LEFT JOIN ranked ON ranked.a = words.word AND k = 1),
walk AS (SELECT word, word AS here, 0 AS k FROM form UNION ALL SELECT walk.word, form.form, k + 1 FROM walk JOIN form ON form.word = walk.here WHERE form.form IS NOT NULL),
root AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT form.word, form, root, n, n_near, form_n FROM form JOIN root ON root.word = form.word
"""

ORACLES = {"op2_url_association_rules": URL_RULES, "op5_ngram_jaccard": NGRAM_JACCARD, "op10_substring_dedup": SUBSTRING_DEDUP, "op11_spelling_variants": SPELLING, "op13_line_dedup": LINE_DEDUP}
