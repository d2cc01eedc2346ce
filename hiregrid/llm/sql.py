"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from .lines import STRETCHES, LineRules
from .quality import QualityRules

_RULES = QualityRules()

QUALITY = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, length(w) AS c FROM w),
x AS (SELECT *, CASE WHEN lead(i, 1) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o END AS g2,
 CASE WHEN lead(i, 2) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o END AS g3 FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)),
y AS (SELECT *, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN g3 || ' ' || lead(g2, 3) OVER o END AS g5 FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
z AS (SELECT *, CASE WHEN lead(i, 6) OVER o IS NOT NULL THEN g5 || ' ' || lead(g2, 5) OVER o END AS g7, CASE WHEN lead(i, 9) OVER o IS NOT NULL THEN g5 || ' ' || lead(g5, 5) OVER o END AS g10 FROM y WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, c, g2 IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g2) > 1 AS r2, g3 IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g3) > 1 AS r3, g5 IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g5) > 1 AS r5,
 g7 IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g7) > 1 AS r7, g10 IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g10) > 1 AS r10 FROM z),
k AS (SELECT rid, c, bool_or(r2) OVER (PARTITION BY rid ORDER BY i ROWS 1 PRECEDING) AS c2, bool_or(r3) OVER (PARTITION BY rid ORDER BY i ROWS 2 PRECEDING) AS c3, bool_or(r5) OVER (PARTITION BY rid ORDER BY i ROWS 4 PRECEDING) AS c5,
 bool_or(r7) OVER (PARTITION BY rid ORDER BY i ROWS 6 PRECEDING) AS c7, bool_or(r10) OVER (PARTITION BY rid ORDER BY i ROWS 9 PRECEDING) AS c10 FROM r),
s AS (SELECT rid, COUNT(*) AS n_words, CAST(SUM(c) AS BIGINT) AS word_chars, COUNT(*) FILTER (c3) AS n_repeat_words, SUM(c) FILTER (c2) AS s2, SUM(c) FILTER (c3) AS s3, SUM(c) FILTER (c5) AS s5, SUM(c) FILTER (c7) AS s7, SUM(c) FILTER (c10) AS s10 FROM k GROUP BY 1),
l AS (SELECT rid, l, row_number() OVER (PARTITION BY rid, l) AS n, list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda q: length(q))) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
m AS (SELECT rid, COUNT(*) AS lines, COUNT(*) FILTER (n > 1) AS n_dup_lines, SUM(c) FILTER (n > 1) AS dup_chars FROM l GROUP BY 1),
v AS (SELECT rid, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[!-/:-@\[-`{{-~]+') AS vs FROM d)),
v3 AS (SELECT rid, i, length(v) AS c, CASE WHEN lead(i, 2) OVER o IS NOT NULL THEN v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o END AS g FROM v WINDOW o AS (PARTITION BY rid ORDER BY i)),
vr AS (SELECT rid, i, c, g IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g) > 1 AS r FROM v3),
vk AS (SELECT rid, SUM(c) FILTER (r) AS mark_chars FROM (SELECT rid, c, bool_or(r) OVER (PARTITION BY rid ORDER BY i ROWS 2 PRECEDING) AS r FROM vr) GROUP BY 1),
a AS (SELECT d.doc_id, COALESCE(n_words, 0) AS n_words, CAST({free_words} AS DOUBLE) / greatest(n_words, 1) AS free, COALESCE(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words,
 COALESCE(dup_chars, 0) / greatest(word_chars, 1) AS dup_line_chars, COALESCE(n_dup_lines, 0) / greatest(lines, 1) AS dup_lines, COALESCE(mark_chars, 0) / greatest(word_chars, 1) AS dup_mark_chars,
 COALESCE(s2, 0) / greatest(word_chars, 1) AS f2, COALESCE(s3, 0) / greatest(word_chars, 1) AS f3, COALESCE(s5, 0) / greatest(word_chars, 1) AS f5, COALESCE(s7, 0) / greatest(word_chars, 1) AS f7, COALESCE(s10, 0) / greatest(word_chars, 1) AS f10 FROM d LEFT JOIN s USING (rid) LEFT JOIN m USING (rid) LEFT JOIN vk USING (rid)),
b AS (SELECT *, CASE WHEN n_words < {min_words} THEN 'few_words' WHEN 100 * n_repeat_words > {max_repeat_percent} * n_words THEN 'repeated_words' WHEN f2 > {g2} + free THEN 'repeated_2_grams' WHEN f3 > {g3} + free THEN 'repeated_3_grams' WHEN f5 > {g5} + free THEN 'repeated_5_grams'
 WHEN f7 > {g7} + free THEN 'repeated_7_grams' WHEN f10 > {g10} + free THEN 'repeated_10_grams' WHEN dup_line_chars > {max_duplicate_line_chars} + free / 2 OR dup_lines > {max_duplicate_lines} THEN 'repeated_lines' END AS reason FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed, reason IS NULL AS kept, dup_line_chars, greatest(f2, f3, f5, f7, f10) AS dup_gram_chars, dup_mark_chars, reason FROM b""".format(**{f"g{n}": limit for n, limit in _RULES.gram_limits.items()}, **{k: v for k, v in vars(_RULES).items() if k != "gram_limits"})

CHAT = r"""WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + COALESCE(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS shown FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(SUM(4 + length(role) + 2 + shown + 8) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

DECONTAMINATION = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM i), p AS (SELECT rid, k, p, array_to_string(ws[p:p + k - 1], ' ') AS win FROM d, ks, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS p) WHERE len(ws) >= k),
m AS (SELECT rid, p, p.k, item_id FROM p JOIN i ON p.win = i.win AND p.k = i.k), h AS (SELECT DISTINCT rid, unnest(range(p, p + k)) AS at FROM m), n AS (SELECT rid, COUNT(*) AS n_hit FROM h GROUP BY 1),
t AS (SELECT rid, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""

_LINES = LineRules()
_CUT = f"{_LINES.leading} + (n - {_LINES.leading}) * {{}} // {STRETCHES}"

LINE_DEDUP = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
copies AS (SELECT text, row_number() OVER () AS tid, COUNT(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
raw AS (SELECT tid, copies, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM (SELECT tid, copies, string_split(text, chr(10)) AS ls FROM copies)),
norm AS (SELECT tid, copies, raw, pos, regexp_replace(trim(regexp_replace(raw, '[ \t\r\x0B\f]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS l FROM raw),
own AS (SELECT DISTINCT tid, copies, l, string_split(l, ' ') AS toks, len(string_split(l, ' ')) AS n FROM norm WHERE trim(replace(l, '<*>', '')) <> ''),
parts AS (SELECT tid, copies, l, n || '|' || array_to_string(toks[1:{_LINES.leading}], ' ') || '|' || j || '|' || array_to_string(toks[b + 1:e], ' ') AS part
 FROM (SELECT *, {_CUT.format("j")} AS b, {_CUT.format("(j + 1)")} AS e FROM own, range({STRETCHES}) AS r(j) WHERE n > {_LINES.leading + 1}) WHERE e > b),
often AS (SELECT part FROM parts GROUP BY part HAVING SUM(copies) >= {_LINES.min_docs}),
tokens AS (SELECT tid, copies, l, n, masked, j, n || '|' || lead || '|' || j || '|' || token AS token FROM (SELECT tid, copies, l, n, len(list_filter(toks, lambda t: contains(t, '<*>'))) AS masked, array_to_string(toks[1:{_LINES.leading}], ' ') AS lead,
 unnest(toks) AS token, generate_subscripts(toks, 1) AS j FROM own SEMI JOIN (SELECT tid, l FROM parts SEMI JOIN often USING (part)) USING (tid, l)) WHERE j > {_LINES.leading}),
times AS (SELECT token, SUM(copies) AS times FROM tokens GROUP BY 1 HAVING SUM(copies) >= {_LINES.min_docs}),
counts AS (SELECT *, row_number() OVER (PARTITION BY tid, l ORDER BY times DESC) AS place,
 greatest(CAST(ceil(CAST(CASE WHEN n < {_LINES.short} THEN {_LINES.min_constant_short} ELSE {_LINES.min_constant} END AS DOUBLE) * n) AS BIGINT) - {_LINES.leading} + masked, 1) AS needed FROM tokens JOIN times USING (token)),
support AS (SELECT tid, l, times AS support FROM counts WHERE place = needed),
general AS (SELECT tid, l, any_value(n) AS n, string_agg(token, chr(10) ORDER BY j) AS template FROM counts JOIN support USING (tid, l) WHERE 2 * times >= support GROUP BY 1, 2),
keys AS (SELECT tid, l, n, '=' || l AS key, FALSE AS general FROM own UNION ALL SELECT tid, l, n, '*' || template, TRUE FROM general),
alike AS (SELECT key FROM keys GROUP BY key HAVING COUNT(DISTINCT tid) > 1),
shared AS (SELECT * FROM keys JOIN alike USING (key)),
hosts AS (SELECT tid FROM (SELECT tid, SUM(n) AS total FROM own GROUP BY 1) JOIN (SELECT tid, SUM(n) AS words FROM (SELECT DISTINCT tid, l, n FROM shared) GROUP BY 1) USING (tid) WHERE total - words >= {_LINES.min_own} * total),
boiler AS (SELECT key FROM shared JOIN hosts USING (tid) GROUP BY key, general HAVING COUNT(DISTINCT tid) >= CASE WHEN general AND MIN(n) < {_LINES.short} THEN {_LINES.min_docs_short} ELSE {_LINES.min_docs} END),
gone AS (SELECT DISTINCT tid, l FROM shared JOIN boiler USING (key)),
kept AS (SELECT t.tid, string_agg(raw, chr(10) ORDER BY pos) FILTER (g.l IS NULL) AS text, COUNT(g.l) AS n_dropped FROM norm t LEFT JOIN gone g ON t.tid = g.tid AND t.l = g.l GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(kept.text, '') END AS text, COALESCE(n_dropped, 0) AS n_dropped FROM d LEFT JOIN copies ON d.text = copies.text LEFT JOIN kept USING (tid)"""


def _vector_codes() -> str:
    """Lloyd's rounds one after another; part vectors as doubles, which hold these integers exactly."""
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k, range(4) AS r(part))",
        "b0 AS MATERIALIZED (SELECT part, CAST(e - 1 AS BIGINT) AS entry, x FROM (SELECT rid, row_number() OVER (ORDER BY vec_id, v) AS e FROM k QUALIFY e <= 256) JOIN p USING (rid))",
    ]
    for i in range(1, 6):
        near = f"SELECT rid, p.part, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), entry)) AS m FROM p JOIN b{i - 1} b ON p.part = b.part GROUP BY 1, 2"
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, part, m[1] AS d, m[2] AS entry FROM ({near}))")
        if i < 5:
            parts = f"SELECT part, entry, j, floor(SUM(c) / COUNT(*)) AS c FROM (SELECT a.part, a.entry, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM a{i} a JOIN p USING (rid, part)) GROUP BY 1, 2, 3"
            steps.append(f"b{i} AS MATERIALIZED (SELECT part, entry, COALESCE(n.x, o.x) AS x FROM b{i - 1} o LEFT JOIN (SELECT part, entry, list(c ORDER BY j) AS x FROM ({parts}) GROUP BY 1, 2) n USING (part, entry))")
    steps += [
        "s AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)",
        "c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(d) AS BIGINT) AS error FROM a5 GROUP BY 1)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), s"


VECTOR_CODES = _vector_codes()
