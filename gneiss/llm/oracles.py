"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHUNK = "('0x' || substr(h, {a}, 5))::INT"
_BASE32 = " || ".join(f"substr('{_DIGITS}', (({_CHUNK.format(a=5 * i + 1)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, {_BASE32} AS digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS latest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < latest THEN latest END AS refers_to FROM l"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) ELSE [ws] END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM documents"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  coalesce(1.1::DOUBLE - length(regexp_replace(text, '[\p{{L}} ]', '', 'g')) / greatest(length(text), 1), 0.1::DOUBLE) AS q,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS wl
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(lft / wl, cap / weight) FILTER (cap >= lft / wl * weight) AS level FROM v),
t AS (SELECT source, source_size, round(coalesce(least(cap, level * weight), cap), 6) AS target FROM v, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
k AS (SELECT doc_id, size, source_size, target, epochs, rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM k"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5"""

_RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1) / 50, 1)",
}
_LONG = " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS rule, ({rule})::DOUBLE AS value FROM j" for name, rule in _RULES.items())

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
r AS (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 5)) AS pos FROM g JOIN r ON g.doc_id = r.doc_id AND g.win = r.win) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d JOIN ln USING (doc_id) LEFT JOIN c USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS ({_LONG}),
h AS (SELECT v.*, quality = 1 AS good FROM v JOIN labels USING (doc_id) JOIN j USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
chains AS (SELECT lang, rule, count(*) FILTER (good) AS n, count(*) OVER () AS chains FROM h GROUP BY lang, rule),
t AS (SELECT x.lang, x.rule, cut, any_value(n) AS n, any_value(chains) AS chains, count(*) FILTER (good AND ceil(value * 100) - 1 >= cut) AS k, count(*) FILTER (NOT good AND ceil(value * 100) - 1 >= cut) AS hits
  FROM chains x JOIN h ON h.lang IS NOT DISTINCT FROM x.lang AND h.rule = x.rule, (SELECT unnest(range(1, 100)) AS cut) GROUP BY ALL),
safe AS (SELECT * FROM t WHERE CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) END <= 0.05 / chains),
best AS (SELECT lang, rule, cut / 100 AS cutoff FROM safe WHERE hits - 5 * k > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY hits - 5 * k DESC, cut DESC) = 1),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN best b ON b.lang IS NOT DISTINCT FROM v.lang AND b.rule = v.rule AND v.value > b.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM j"""

_LOW = "abcdefghijklmnopqrstuvwxyz"
VARIANTS = f"""
WITH RECURSIVE step AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step),
runs AS (SELECT doc_id, translate(run, '{_LOW.upper()}', '{_LOW}') AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, k, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs),
crc AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM crc) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
shorter AS (SELECT DISTINCT d.word AS a, d.n AS na, w.word AS b, w.n AS nb FROM d JOIN w ON d.rest = w.word),
pairs AS (SELECT x.word AS word, y.word AS v, y.n AS nv FROM d x JOIN d y ON x.p = y.p AND x.rest = y.rest AND x.word <> y.word UNION SELECT a, b, nb FROM shorter UNION SELECT b, a, na FROM shorter),
best AS (SELECT word, v, nv, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY nv DESC, v) = 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nv >= 10 * n THEN v END AS form, CASE WHEN nv >= 10 * n THEN nv END AS form_n FROM w LEFT JOIN best USING (word)),
chase(word, last) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chase c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.last FROM chase c JOIN f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(last, f.word) AS root FROM f LEFT JOIN ends USING (word)"""

ORACLES = {
    "op1_warc": WARC,
    "op2_ngram_jaccard_join": NEAR,
    "op3_mixing": MIX,
    "op4_exact_top_k": TOP_K,
    "op7_quality_rules": QUALITY,
    "op11_spelling_variants": VARIANTS,
}
