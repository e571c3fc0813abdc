"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import BASE, CONDITIONS, ROUNDS, RULES, START

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(replace(coalesce(role, ''), '<|', '< |'), ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
heads AS (
  SELECT s.conv_id, perspective, turn, speaker, content, speaker = perspective AS trained,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
rendered AS (SELECT *, head || content || '<|end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, row_number() OVER o - 1 AS seq,
         CAST(coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
  FROM rendered WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, md5(content)))
SELECT conv_id, perspective, turn, speaker, segment, trained, seq, char_start,
       CASE WHEN trained THEN char_start + length(head) END AS mask_start,
       CASE WHEN trained THEN char_start + length(segment) - 1 END AS mask_end
FROM placed
"""

_SHINGLES = """
  SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id} AS id, {words} AS w FROM {table})"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(id="doc_id", table="documents", words=_WORDS.format(_ASCII_LOWER))})),
b AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(id="item_id", table="benchmark", words=_WORDS.format(_ASCII_LOWER))})),
n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM d JOIN b USING (s) JOIN n ON n.id = b.id
GROUP BY d.id, b.id
HAVING 5 * count(*) >= 4 * any_value(n_shingles)
"""

LINE_DEDUP_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT doc_id, i, len({_WORDS.format("lines[i]")}) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split))),
v AS (SELECT *, upto - n AS before FROM l WHERE n > 0),
fwd AS (SELECT q.doc_id, q.i AS a, min(t.i) AS z FROM v q JOIN v t ON q.doc_id = t.doc_id AND t.i >= q.i AND t.upto >= q.before + 50 GROUP BY ALL),
bwd AS (SELECT q.doc_id, max(t.i) AS a, q.i AS z FROM v q JOIN v t ON q.doc_id = t.doc_id AND t.i <= q.i AND q.upto >= t.before + 50 GROUP BY ALL),
w AS (
  SELECT doc_id, a, z, array_to_string(lines[a:z], chr(10)) AS body
  FROM (SELECT doc_id, a, z FROM fwd UNION SELECT doc_id, a, z FROM bwd) JOIN split USING (doc_id)),
later AS (
  SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS place FROM w) WHERE place > 1),
told AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later),
flags AS (SELECT l.doc_id, l.i, CASE WHEN n > 0 THEN told.i IS NOT NULL END AS g FROM l LEFT JOIN told ON l.doc_id = told.doc_id AND l.i = told.i),
gone AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, last_value(g IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
           first_value(g IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down
    FROM flags WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE up AND down),
dropped AS (SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(lines[l.i], chr(10) ORDER BY l.i) AS body
  FROM l JOIN dropped USING (doc_id) JOIN split USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN n_dropped IS NULL THEN text ELSE coalesce(body, '') END AS text, lang, source,
       CASE WHEN n_dropped IS NULL THEN n_chars ELSE length(coalesce(body, '')) END AS n_chars,
       CAST(coalesce(len(string_split(text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped
FROM documents LEFT JOIN dropped USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, row_number() OVER () AS k
  FROM documents),
g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER o AS place, first_value(doc_id) OVER o AS keep_id
  FROM t WINDOW o AS (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST, k))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""

PREFIX_TRIE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS of_byte),
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda j: ascii((conv_id::VARCHAR)[j])::BIGINT)),
                         lambda x, y: xor(x >> 8, of_byte[(xor(x, y) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, list({'role': role, 'text': text}) OVER (o ROWS UNBOUNDED PRECEDING) AS seq, length(text) AS size
  FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, i)),
every AS (SELECT conv_id, depth, seq, size FROM p UNION ALL SELECT conv_id, 0, [], 0 FROM c),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS here FROM every),
nodes AS (
  SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE here), '')) AS ends_sha256
  FROM ended GROUP BY seq, depth),
kids AS (SELECT seq[1:depth - 1] AS seq, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.seq = k.seq),
subtrees AS (
  SELECT a.seq, a.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND (a.depth = 0 OR b.seq[1] = a.seq[1]) AND b.seq[1:a.depth] = a.seq GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s ON n.depth = s.depth AND n.seq = s.seq
LEFT JOIN full_nodes up ON up.depth = n.depth - 1 AND up.seq = n.seq[1:n.depth - 1]
"""

_TERMS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (
  SELECT k, doc_id, n, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // length))) AS x
  FROM tf JOIN df USING (term), s),
scored AS (SELECT item, item_id, k, doc_id, n, CAST(sum(times * x) AS BIGINT) AS score FROM part JOIN q USING (term) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, n, k) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""


def quality_rules_sql() -> str:
    """The counts, the votes, and every round of expectation-maximisation as one step of a chain."""
    names = [f"v_{r}" for r in RULES]
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, (bad, good) in CONDITIONS.items())
    odds = "prior + " + " + ".join(f"CASE {c} WHEN 1 THEN {c}_p WHEN -1 THEN {c}_m ELSE 0 END" for c in names)
    first = [f"ln({START['prior']}) AS prior"] + [f"ln({START[v]}) AS {c}_{k}" for c in names for v, k in ((1, "p"), (-1, "m"))]
    weights = ["ln((g + 1) / (b + 1)) AS prior"]
    sums = ["coalesce(sum(n * good), 0) AS g", "coalesce(sum(n * (1 - good)), 0) AS b"]
    for c in names:
        for v, k in ((1, "p"), (-1, "m")):
            sums += [f"coalesce(sum(CASE WHEN {c} = {v} THEN n * good END), 0) AS g_{c}_{k}", f"coalesce(sum(CASE WHEN {c} = {v} THEN n * (1 - good) END), 0) AS b_{c}_{k}"]
            weights.append(f"ln((g_{c}_{k} + 1) / (g_{c}_p + g_{c}_m + 2)) - ln((b_{c}_{k} + 1) / (b_{c}_p + b_{c}_m + 2)) AS {c}_{k}")
    steps = [f"m0 AS (SELECT {', '.join(first)})"]
    for i in range(1, ROUNDS + 1):
        good = f"CAST(1 / (1 + exp(-({odds}))) AS DOUBLE)"
        steps.append(f"m{i} AS MATERIALIZED (SELECT {', '.join(weights)} FROM (SELECT {', '.join(sums)} FROM (SELECT patterns.*, {good} AS good FROM patterns CROSS JOIN m{i - 1})))")
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, k, t, {_WORDS.format("t")} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM s)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, sum(x) AS n FROM (SELECT k, least(5, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 5)) AS x FROM dup) GROUP BY k),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs,
    length(t) - length(regexp_replace(t, '[.?:;]', '', 'g')) AS n_stops, len(list_distinct(words)) AS n_distinct
  FROM s LEFT JOIN rep USING (k)),
voted AS MATERIALIZED (SELECT *, {BASE} AS base_failed, {votes} FROM c),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted CROSS JOIN m{ROUNDS}
"""
