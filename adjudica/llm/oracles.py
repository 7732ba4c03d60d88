"""DuckDB SQL of the numbered queries that SQL can express over whole tables. Patterns and rules are written out here, from
what is asked, and not taken from the operators that they check."""

from __future__ import annotations

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX, _CANDIDATE = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]{20,}"
_RULES = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 2 * n_dup_lines > n_words OR n_upper > n_lower"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPACE = r"[^\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _kind(k: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT n, doc_id, owner, {k} AS k, regexp_extract_all(t, '{quoted}') AS x, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', {2 if k == 0 else 0}) AS v FROM d WHERE regexp_matches(t, '{quoted}')"


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind(k, p) for k, p in enumerate((_ASSIGN, _ACCESS, _HEX, _CANDIDATE)))}),
e AS (SELECT n, doc_id, owner, k, x, g, unnest(x) AS m, unnest(v) AS val, generate_subscripts(x, 1) AS j FROM f),
s AS (SELECT n, doc_id, owner, k, val, CAST(list_sum([length(y) FOR y IN g[1:j]]) + coalesce(list_sum([length(y) FOR y IN x[1:j-1]]), 0) AS BIGINT) AS a, length(m) AS len FROM e),
z AS (SELECT *, a + len AS b FROM s),
base AS (SELECT * FROM z WHERE (k = 0 AND length(val) >= 6) OR (k = 1 AND len >= 20) OR (k = 2 AND len >= 24)),
cand AS (SELECT * FROM z c WHERE k = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = c.n AND b.a < c.b AND c.a < b.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
live AS (SELECT val FROM every GROUP BY val HAVING count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, doc_id)) <= 8),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM cand WHERE val IN (SELECT val FROM live)),
name AS (SELECT n, a, k, list_extract(['assign', 'access', 'hex', 'live'], CAST(k + 1 AS INT)) || ':' || a || ':' || b AS w FROM spans),
told AS (SELECT n, coalesce(string_agg(w, ',' ORDER BY a, k) FILTER (k < 3), '') AS bw, string_agg(w, ',' ORDER BY a, k) AS sw, count(*) FILTER (k = 0) AS c0, count(*) FILTER (k = 1) AS c1, count(*) FILTER (k = 2) AS c2 FROM name GROUP BY 1),
seen AS (SELECT n, count(*) FILTER (val IN (SELECT val FROM live)) AS l, count(*) AS c FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(c0, 0) AS n_assign, coalesce(c1, 0) AS n_access, coalesce(c2, 0) AS n_hex, sha256(coalesce(bw, '')) AS base_sha256, coalesce(sw, '') AS spans, coalesce(l, 0) AS n_live, coalesce(c - l, 0) AS n_shared
FROM d LEFT JOIN told ON told.n = d.n LEFT JOIN seen ON seen.n = d.n"""

LINES = f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
y AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
k AS (SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT y.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM y LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE}+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_SPACE}')] AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+7], ' ')) AS n FROM p),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY 1),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
 FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT ({_RULES}) AS kept FROM c"""

DECONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM benchmark),
w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
bi AS (SELECT item, least(10, len(ws)) AS n, ws, unnest(range(1, CAST(len(ws) - least(10, len(ws)) + 2 AS BIGINT))) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS g FROM bi),
di AS (SELECT doc_id, s.n, ws, unnest(range(1, CAST(len(ws) - s.n + 2 AS BIGINT))) AS i FROM w, (SELECT DISTINCT n FROM win) s WHERE len(ws) >= s.n),
h AS (SELECT doc_id, i, x.n, item FROM (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS g FROM di) x JOIN win USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""

INFILL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ks FROM d),
r AS (SELECT *, CAST(len(ks) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS hs FROM k),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(ks[:a], '') AS pre, array_to_string(ks[a + 1 : b], '') AS mid, array_to_string(ks[b + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

TRIE = """WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT *, sha256(length(role) || ':' || role || text) AS u FROM t),
o AS (SELECT c, list({'u': u, 'n': length(text)} ORDER BY turn NULLS FIRST, role, left(text, 32), u) AS own FROM u GROUP BY c),
bits AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))),
h AS (SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]), lambda a, x: xor(a // 256, tab[CAST(xor(a, x) % 256 + 1 AS INT)]))) % 6 AS h FROM o, bits),
b AS (SELECT h.c, list_concat(CASE WHEN h.h > 0 THEN coalesce(f.own[:h.h], []) ELSE [] END, h.own[h.h + 1:]) AS seq FROM h LEFT JOIN o f ON f.c = h.c - h.c % 100),
p AS (SELECT c, seq, unnest(range(0, CAST(len(seq) + 1 AS BIGINT))) AS d FROM b),
n AS (SELECT c, d, len(seq) AS l, 'r' || array_to_string([x.u FOR x IN seq[1:d]], '') AS k, CASE WHEN d > 0 THEN seq[d].n ELSE 0 END AS chars, CASE WHEN d > 0 THEN 'r' || array_to_string([x.u FOR x IN seq[1:d-1]], '') END AS pk FROM p),
g AS (SELECT k, any_value(pk) AS pk, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '') AS ends FROM n GROUP BY k, d),
kids AS (SELECT pk AS k, count(*) AS n_children FROM g WHERE pk IS NOT NULL GROUP BY 1),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (k)),
s AS (SELECT a.k, CAST(sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((w.n_convs - 1) * w.chars) AS BIGINT) AS saved_tokens FROM w JOIN n a ON a.c = w.conv_id AND a.d <= w.d GROUP BY 1)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256 FROM w JOIN s USING (k) LEFT JOIN g up ON up.k = w.pk"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT *, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS top, row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS i FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN n < 1000 OR i = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 1000 AND i > 1 THEN top END AS refers_to FROM k"""
