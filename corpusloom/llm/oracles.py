"""DuckDB SQL for the rows of the queries in queries.py that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from .linerules import BOILERPLATE, MIN_KEPT, NAVIGATION, PROSE, REPEAT_SHARE, REPEAT_WORDS, SYMBOLS, TERMINAL
from .queries import URL_RULES

#: The words of a text, by ASCII whitespace.
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MIX_SOURCES = """
WITH rows AS (
  SELECT doc_id, coalesce(source, '(none)') AS src, coalesce(CASE WHEN n_chars >= 0 THEN n_chars END, length(text), 0) AS len, text FROM documents
), massed AS (SELECT *, CAST(round(sqrt(1.0::DOUBLE + len) * 1e6::DOUBLE) AS BIGINT) AS m FROM rows),
sources AS (
  SELECT src, count(*) AS n, CAST(sum(m) AS BIGINT) AS mass, CAST(round(sqrt(count(*)::DOUBLE) * 1e6::DOUBLE) AS DECIMAL(30, 0)) AS share FROM massed GROUP BY src
), ideal AS (
  SELECT *, sum(n) OVER () AS total, (sum(n) OVER ())::DOUBLE * share::DOUBLE / (sum(share) OVER ())::DOUBLE AS ideal FROM sources
), based AS (SELECT *, floor(ideal) AS base FROM ideal),
quotas AS (
  SELECT src, mass, CAST(base AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY ideal - base DESC, src) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM based
), expected AS (
  SELECT massed.*, quota, quota::DOUBLE * m::DOUBLE / mass::DOUBLE AS lam,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM massed JOIN quotas USING (src)
), parts AS (SELECT *, CAST(floor(lam) AS BIGINT) AS certain, lam - floor(lam) AS inclusion FROM expected),
ranked AS (
  SELECT *, quota - sum(certain) OVER (PARTITION BY src) AS need,
    row_number() OVER (PARTITION BY src ORDER BY CASE WHEN inclusion > 0 THEN u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - inclusion) / inclusion) END NULLS LAST, doc_id NULLS FIRST, len) AS turn
  FROM parts
)
SELECT doc_id, src AS source, certain, inclusion, certain + CASE WHEN inclusion > 0 AND turn <= need THEN 1 ELSE 0 END AS copies
FROM ranked WHERE certain + CASE WHEN inclusion > 0 AND turn <= need THEN 1 ELSE 0 END > 0
"""


def _discounts(name: str, counts: str) -> str:
    """A one-row table d1, d2, d3 of the discounts for the counts c of a table."""
    y = "(n1 / (n1 + 2 * n2))"
    given = {1: "0.5", 2: "1.0", 3: "1.5"}
    cut = lambda k, x: f"CASE WHEN n1 * n2 * n3 * n4 = 0 THEN {given[k]}::DOUBLE ELSE least(greatest({x}, 0), {k}) END AS d{k}"
    tally = ", ".join(f"(count(*) FILTER (c = {k}))::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
    return (
        f"{name} AS (SELECT {cut(1, f'1 - 2 * {y} * n2 / n1')}, {cut(2, f'2 - 3 * {y} * n3 / n2')}, {cut(3, f'3 - 4 * {y} * n4 / n3')} FROM (SELECT {tally} FROM {counts}))"
    )


def _share(count: str, profile: str, d: str, lower: str) -> str:
    """Discounted share of a count in its context, plus what was discounted there times the lower order."""
    off = f"CASE {count} WHEN 0 THEN 0 WHEN 1 THEN {d}.d1 WHEN 2 THEN {d}.d2 ELSE {d}.d3 END"
    return f"(greatest({count} - {off}, 0) / {profile}.total + ({profile}.n1 * {d}.d1 + {profile}.n2 * {d}.d2 + {profile}.n3 * {d}.d3) / {profile}.total * {lower})"


_PROFILE = "sum(c)::DOUBLE AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3"

KNESER_NEY = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS words FROM documents),
spread AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
words AS (SELECT rid, CASE WHEN i > 2 THEN words[i - 2] ELSE ' ' END AS u, CASE WHEN i > 1 THEN words[i - 1] ELSE ' ' END AS v, words[i] AS w FROM spread),
triples AS (SELECT u, v, w, count(*) AS c FROM words GROUP BY ALL),
pairs AS (SELECT v, w, count(*) AS c FROM triples GROUP BY ALL),
ones AS (SELECT w, count(*) AS c FROM pairs GROUP BY ALL),
contexts AS (SELECT u, v, {_PROFILE} FROM triples GROUP BY ALL),
heads AS (SELECT v, {_PROFILE} FROM pairs GROUP BY ALL),
every AS (SELECT {_PROFILE}, count(*) AS kinds FROM ones),
{_discounts("k3", "triples")}, {_discounts("k2", "pairs")}, {_discounts("k1", "ones")},
scored AS (
  SELECT t.u, t.v, t.w, ln({_share("t.c", "x", "k3", _share("p.c", "h", "k2", _share("o.c", "every", "k1", "(1.0::DOUBLE / (every.kinds + 1))")))}) AS lp
  FROM triples t JOIN contexts x USING (u, v) JOIN pairs p USING (v, w) JOIN heads h USING (v) JOIN ones o USING (w), every, k3, k2, k1
), summed AS (SELECT rid, sum(lp) AS total FROM words JOIN scored USING (u, v, w) GROUP BY rid)
SELECT doc_id, len(words) AS n_tokens, round(coalesce(total, 0), 4) + 0.0 AS log_prob, CASE WHEN len(words) > 0 THEN round(exp(-total / len(words)), 4) END AS perplexity
FROM docs LEFT JOIN summed USING (rid)
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM docs
), sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
shared AS (SELECT rid, g FROM grams SEMI JOIN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1) USING (g)),
pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM shared a JOIN shared b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE k >= 0.5 * (x.n + y.n - k)
), reached AS (SELECT a AS rid, a AS other FROM links UNION SELECT r.rid, l.b FROM reached r JOIN links l ON l.a = r.other),
classes AS (SELECT reached.rid, min(doc_id) AS class_id FROM reached JOIN docs d ON d.rid = reached.other GROUP BY reached.rid)
SELECT d.doc_id, c.class_id, l.n_links, l.best
FROM (SELECT a AS rid, count(*) AS n_links, round(max(jaccard), 6) AS best FROM links GROUP BY a) l JOIN docs d USING (rid) JOIN classes c USING (rid)
"""


def _key(url: str) -> str:
    """surt() in SQL."""
    bare = f"regexp_replace(regexp_replace(trim({url}), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '#.*$', '')"
    authority = f"regexp_extract({bare}, '^([^/?]*)', 1)"
    host = f"regexp_replace(regexp_replace(lower(regexp_replace({authority}, '^.*@', '')), ':[0-9]*$', ''), '\\.+$', '')"
    path = f"substr({bare}, length({authority}) + 1)"
    whole = f"CASE WHEN {path} = '' THEN '/' WHEN {path}[1] = '?' THEN '/' || {path} ELSE {path} END"
    return f"CASE WHEN length(trim({url})) > 0 THEN array_to_string(list_reverse(string_split({host}, '.')), ',') || ',)' || {whole} END"


URL_RULES_SQL = f"""
WITH rules AS (
  SELECT rule_id, action, CASE WHEN regexp_replace(trim(pattern), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') LIKE '%/%' THEN {_key("pattern")} ELSE regexp_replace({_key("pattern")}, '\\)/$', '') END AS prefix
  FROM (VALUES {", ".join(f"('r{i:03d}', {_quoted(p)}, {_quoted(a)})" for i, p, a in URL_RULES)}) AS r(rule_id, pattern, action)
), keyed AS (SELECT row_number() OVER () AS rid, page_id, url, {_key("url")} AS key FROM pages),
held AS (
  SELECT rid, rule_id, action, count(*) OVER (PARTITION BY rid) AS depth, row_number() OVER (PARTITION BY rid ORDER BY length(prefix) DESC, rule_id DESC) AS turn
  FROM keyed JOIN rules ON starts_with(key, prefix)
)
SELECT page_id, url, rule_id, coalesce(action, 'keep') AS action, coalesce(depth, 0) AS depth FROM keyed LEFT JOIN (FROM held WHERE turn = 1) USING (rid)
"""

_T = "trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
_FAILS = f"""(len(string_split({_T}, ' ')) >= {REPEAT_WORDS} AND len(list_distinct(string_split({_T}, ' '))) < len(string_split({_T}, ' ')) * {REPEAT_SHARE}::DOUBLE)
    OR regexp_matches(lower({_T}), {_quoted(BOILERPLATE)}) OR regexp_matches({_T}, {_quoted(NAVIGATION)}) OR regexp_matches({_T}, {_quoted(SYMBOLS)})
    OR (NOT regexp_matches({_T}, {_quoted(TERMINAL)}) AND NOT regexp_matches({_T}, {_quoted(PROSE)}))"""
CLEAN_LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
judged AS (SELECT doc_id, lines, list_filter(lines, lambda x: {_T} = '' OR NOT ({_FAILS})) AS kept FROM split),
sized AS (SELECT *, coalesce(list_sum(list_transform(lines, lambda x: length({_T}))), 0) AS n, coalesce(list_sum(list_transform(kept, lambda x: length({_T}))), 0) AS k FROM judged),
shared AS (SELECT *, CASE WHEN n > 0 THEN k::DOUBLE / n::DOUBLE ELSE 0.0::DOUBLE END AS kept_share FROM sized)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines) AS n_lines, len(lines) - len(kept) AS removed, kept_share, kept_share >= {MIN_KEPT} AS keep FROM shared
"""

EXACT_TOP_K = """
WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (
  SELECT q.vec_id, x.vec_id AS neighbor_id, round(list_distance(q.v, x.v), 9) AS d FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM near)
SELECT vec_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX_SOURCES,
    "op3_kneser_ney": KNESER_NEY,
    "op5_ngram_jaccard": NGRAM_JACCARD,
    "op6_url_rules": URL_RULES_SQL,
    "op7_clean_lines": CLEAN_LINES,
    "op9_exact_top_k": EXACT_TOP_K,
}
