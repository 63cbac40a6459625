"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, quality



def _escaped(column: str) -> str:
    return f"regexp_replace({column}, '{chat.MARK}', '<\\\\\\1|', 'g')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL
),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
shared AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
m AS (SELECT b.*, shared.bare IS NOT NULL AS gone FROM b LEFT JOIN shared ON b.bare = shared.bare),
f AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM m GROUP BY rid
),
r AS (
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_gone > 0 THEN n_gone ELSE 0 END AS n_removed,
         CASE WHEN n_gone > 0 THEN rest ELSE coalesce(text, '') END AS t
  FROM d LEFT JOIN f USING (rid)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM r
"""

# Exact similarity of every window that shares a shingle with an item, by counting.
OP3 = f"""
WITH words AS (
  SELECT id, is_item, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id AS id, text, false AS is_item FROM documents UNION ALL SELECT DISTINCT item_id, text, true FROM benchmark)
),
items AS (SELECT id AS item_id, least(len(w), {decontaminate.SHINGLE}) AS size, len(w) - least(len(w), {decontaminate.SHINGLE}) + 1 AS n, w FROM words WHERE is_item AND len(w) > 0),
item_sh AS (SELECT item_id, size, n, h, count(*) AS m FROM (SELECT item_id, size, n, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS h FROM items) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS rid, id AS doc_id, w FROM words WHERE NOT is_item),
sh AS (
  SELECT rid, doc_id, size, len(w) - size + 1 AS len, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS h, unnest(range(0, len(w) - size + 1)) AS p
  FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size
),
hit AS (SELECT rid, doc_id, item_id, n, len, p, h, m FROM sh JOIN item_sh USING (size, h)),
enough AS (SELECT rid, item_id FROM hit GROUP BY ALL HAVING 100 * count(*) >= {decontaminate.SIMILARITY} * any_value(n)),
near AS (SELECT hit.*, unnest(range(greatest(p - n + 1, 0), p + 1)) AS s FROM hit SEMI JOIN enough USING (rid, item_id)),
shared AS (
  SELECT rid, doc_id, item_id, n, s, sum(least(c, m)) AS shared, least(n, any_value(len) - s) + n - sum(least(c, m)) AS total
  FROM (SELECT rid, doc_id, item_id, n, s, h, m, any_value(len) AS len, count(*) AS c FROM near GROUP BY rid, doc_id, item_id, n, s, h, m) GROUP BY rid, doc_id, item_id, n, s
),
best AS (
  SELECT doc_id, item_id, s, n, round(shared / total, 6) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(shared / total, 6) DESC, s, n) AS k
  FROM shared WHERE 100 * shared >= {decontaminate.SIMILARITY} * total
)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS n_shingles, similarity FROM best WHERE k = 1
"""

OP6 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, '{chat.NAMELESS}') AS speaker, coalesce(text, '') AS text FROM conversations),
e AS (SELECT *, {_escaped('text')} AS body, {_escaped('speaker')} AS shown FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{chat.SYSTEM}'),
o AS (
  SELECT t.*, perspective,
         CASE WHEN speaker = '{chat.SYSTEM}' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM e AS t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
h AS (SELECT *, CASE WHEN role = 'user' THEN '<|user|>' || shown ELSE '<|' || role || '|>' END || chr(10) AS head FROM o),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM h),
w AS (
  SELECT *, row_number() OVER x - 1 AS position, sum(length(segment)) OVER x AS e
  FROM s WINDOW x AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text, rid)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, role, CASE WHEN role = 'user' THEN speaker END AS name, segment,
       CAST(e - length(segment) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
       CAST(CASE WHEN role = 'assistant' THEN e - length(segment) + length(head) END AS BIGINT) AS loss_start,
       CAST(CASE WHEN role = 'assistant' THEN e END AS BIGINT) AS loss_end
FROM w
"""


def _op7() -> str:
    rules = list(quality.RULES)
    n, most = len(rules), quality.MOST
    quoted = {k: v.replace("'", "''") for k, v in {"symbols": quality.SYMBOLS, "plain": quality.PLAIN, "sentence": quality.SENTENCE, "capitals": quality.CAPITALS}.items()}
    white = r"\x20\x09-\x0D"
    clamp = lambda x: f"least({most}, greatest(1 - {most}, {x}))"
    prior = f"({quality.PRIOR} * total + 1)"
    rate = lambda x, sign: clamp(
        f"(coalesce(list_sum(list_transform(ps, lambda p: CASE WHEN p.v[j] = {sign} THEN p.{x} ELSE 0 END)), 0) + {quality.ACCURACY} * {prior})"
        f" / (coalesce(list_sum(list_transform(ps, lambda p: CASE WHEN p.v[j] <> 0 THEN p.{x} ELSE 0 END)), 0) + {prior})"
    )
    log_odds = (
        "ln(share / (1 - share)) + list_sum(list_transform(range(1, %d), lambda j: CASE %s[j] WHEN 1 THEN ln(on_good[j] / (1 - on_bad[j])) WHEN -1 THEN ln((1 - on_good[j]) / on_bad[j]) ELSE 0 END))"
    )
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(list_filter(string_split_regex(t, '[{white}]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(t, '[{white}]+'), lambda x: x <> ''), 1) AS p FROM d),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE regexp_matches(w, '{quoted["plain"]}')) AS n_plain FROM w GROUP BY rid),
g AS (SELECT a.rid, a.p, a.w || ' ' || b.w || ' ' || c.w AS g FROM w a JOIN w b ON a.rid = b.rid AND b.p = a.p + 1 JOIN w c ON a.rid = c.rid AND c.p = a.p + 2),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT p + i) AS n_repeat_words FROM again, range(0, 3) AS r(i) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^{white}]') GROUP BY rid),
m AS MATERIALIZED (
  SELECT doc_id, rid, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, coalesce(n_plain, 0) AS n_plain,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines,
         len(regexp_extract_all(t, '{quoted["symbols"]}')) AS n_symbols, len(string_split(t, chr(10))) AS n_lines,
         len(regexp_extract_all(t, '{quoted["capitals"]}')) AS n_upper_runs, len(regexp_extract_all(t, '{quoted["sentence"]}')) AS n_sentences,
         length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN dl USING (rid)
),
v AS MATERIALIZED (SELECT *, [{", ".join(quality.vote_sql(r) for r in rules)}] AS v FROM m),
pat AS MATERIALIZED (SELECT list(struct_pack(v := v, n := n) ORDER BY v) AS ps, sum(n) AS total FROM (SELECT v, count(*) AS n FROM v GROUP BY v)),
em AS (
  SELECT 0 AS i, CAST({quality.GOOD_SHARE} AS DOUBLE) AS share,
         list_transform(range(1, {n + 1}), lambda j: CAST({quality.ACCURACY} AS DOUBLE)) AS on_good, list_transform(range(1, {n + 1}), lambda j: CAST({quality.ACCURACY} AS DOUBLE)) AS on_bad
  UNION ALL
  SELECT i + 1, (list_sum(list_transform(ps, lambda p: p.good)) + 10 * {quality.GOOD_SHARE}) / (total + 10),
         list_transform(range(1, {n + 1}), lambda j: {rate("good", 1)}), list_transform(range(1, {n + 1}), lambda j: {rate("bad", -1)})
  FROM (
    SELECT i, total, list_transform(qs, lambda p: struct_pack(v := p.v, good := p.n * p.q, bad := p.n - p.n * p.q)) AS ps
    FROM (SELECT i, total, list_transform(ps, lambda p: struct_pack(v := p.v, n := p.n, q := 1 / (1 + exp(-({log_odds % (n + 1, "p.v")}))))) AS qs FROM em, pat WHERE i < {quality.ROUNDS})
  )
),
r AS (
  SELECT v.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({log_odds % (n + 1, "v.v")}))) AS q
  FROM v, em WHERE em.i = {quality.ROUNDS}
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND q >= {quality.THRESHOLD} AS kept, round(q, 4) AS quality
FROM r
"""


OP7 = _op7()

# Exact sets; pairs of distinct sets by shingles in common; the smallest id along links, round by round.
OP8 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM d
),
c AS MATERIALIZED (SELECT row_number() OVER () AS node, min(doc_id) AS rep, len(any_value(s)) AS n, any_value(s) AS s FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY md5(array_to_string(s, chr(1)))),
x AS MATERIALIZED (SELECT node, n, unnest(s) AS h FROM c),
y AS (SELECT x.*, row_number() OVER (PARTITION BY node ORDER BY f, h) AS at FROM x JOIN (SELECT h, count(*) AS f FROM x GROUP BY h) USING (h)),
-- sets that share 0.8 have one of their rarest fifth, and one more, in common
near AS (SELECT DISTINCT a.node AS a, b.node AS b FROM y a JOIN y b ON a.h = b.h AND a.node < b.node WHERE a.at <= a.n - ceil(0.8 * a.n) + 1 AND b.at <= b.n - ceil(0.8 * b.n) + 1 AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, p.n + q.n AS t, len(list_intersect(p.s, q.s)) AS k FROM near JOIN c p ON p.node = a JOIN c q ON q.node = b) WHERE 100 * k >= 80 * (t - k)
),
e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(v, l) USING KEY (v) AS (SELECT node, rep FROM c UNION (SELECT e.b, min(r.l) FROM r JOIN e ON e.a = r.v JOIN recurring.r o ON o.v = e.b WHERE r.l < o.l GROUP BY e.b)),
k AS (SELECT md5(array_to_string(c.s, chr(1))) AS h, r.l FROM r JOIN c ON c.node = r.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN coalesce(k.l, s.doc_id) END AS component_id, coalesce(s.doc_id = coalesce(k.l, s.doc_id), true) AS kept
FROM s LEFT JOIN k ON len(s.s) > 0 AND k.h = md5(array_to_string(s.s, chr(1))) AND s.doc_id IS NOT NULL
"""
