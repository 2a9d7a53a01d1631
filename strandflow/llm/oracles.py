"""SQL (DuckDB) for the corpus queries that SQL can state."""

from __future__ import annotations

from strandflow.llm import quality

_SEPARATORS = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEPARATORS}'), lambda x: x <> '')"
_TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _symbols(text: str) -> str:
    return f"(length({text}) - length(translate({text}, {_quoted(quality.SYMBOLS)}, '')))"


_FAILS = f"""((len(regexp_split_to_array(x, '{_SEPARATORS}')) < {quality.LEAST_LINE_WORDS} AND NOT regexp_matches(x, {_quoted(quality.TERMINAL_PATTERN)}))
  OR {_symbols("x")} * 100 > length(x) * {quality.MOST_SYMBOL_PERCENT} OR regexp_matches(x, {_quoted(quality.NAVIGATION_PATTERN)}) OR regexp_matches(x, {_quoted(quality.BOILERPLATE_PATTERN)}))"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: {_TRIMMED.format("x")} <> '') AS lines FROM d),
trimmed AS (SELECT doc_id, len(lines) - len(list_distinct(lines)) AS n_dup_lines, list_transform(lines, lambda x: {_TRIMMED.format("x")}) AS lines FROM lines),
judged AS (SELECT doc_id, n_dup_lines, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS chars,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: {_FAILS}), lambda x: length(x))), 0) AS lost FROM trimmed),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(5) r(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST({_symbols("t")} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, lost, chars
  FROM d JOIN judged USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost * 100 <= chars * {quality.MOST_LOST_PERCENT} AS kept FROM m
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
wins AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d)),
late AS (SELECT doc_id, s FROM wins QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM late, range(20) r(j)),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS text, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d) w
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""



def _round(n: int) -> str:
    """Assignment to the codebook of round n, and the codebook of round n + 1."""
    return f"""
a{n} AS MATERIALIZED (SELECT vec_id, part, min(16 * d + entry) AS m FROM (SELECT p.vec_id, p.part, entry,
    list_sum(list_transform(range(1, len(p.z) + 1), lambda i: (p.z[i] - b.z[i]) * (p.z[i] - b.z[i]))) AS d FROM p JOIN b{n} b USING (part)) GROUP BY ALL),
s{n} AS (SELECT part, m % 16 AS entry, i, sum(z[i]) AS s, count(*) AS n FROM (SELECT p.part, m, z, unnest(range(1, len(z) + 1)) AS i FROM p JOIN a{n} USING (vec_id, part)) GROUP BY ALL),
m{n} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM s{n} GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.z, b.z) AS z FROM b{n} b LEFT JOIN m{n} m USING (part, entry))"""


VECTOR_CODES = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS z FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, part, z[part * (len(z) // 8) + 1:(part + 1) * (len(z) // 8)] AS z FROM v, range(8) r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, z FROM p QUALIFY entry < 16),
{",".join(map(_round, range(6)))},
{_round(6).partition("s6 AS")[0].strip().rstrip(",")},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256 FROM c JOIN v USING (vec_id)
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s FROM d),
classes AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1),
grams AS (SELECT k, len(s) AS n, unnest(s) AS g FROM classes),
common AS (SELECT a.k AS a, b.k AS b, a.n + b.n AS n, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (n - c)),
reach(a, b) AS (SELECT k, k FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS k, min(least) AS component_id FROM reach JOIN classes ON classes.k = reach.b GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN least ON len(s) > 0 AND least.k = md5(array_to_string(list_sort(s), chr(10)))
"""

# CRC-32 of the decimal id, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS o FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT a.conv_id, list_concat(coalesce(b.o, a.o[1:0])[1:h], a.o[h + 1:]) AS p FROM (SELECT *, {_CRC32} % 4 AS h FROM own) a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
pre AS (SELECT conv_id, len(p) AS size, d, md5(CAST(p[1:d] AS VARCHAR) || d) AS k, md5(CAST(p[1:d - 1] AS VARCHAR) || (d - 1)) AS up, p[d].text AS text, p FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM r)),
node AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS c, count(*) AS n, any_value(text) AS text, any_value(p[1:d]) AS p,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
each AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len({_WORDS}) END AS own FROM node LEFT JOIN kids USING (k, d)),
sums AS (SELECT a AS d, md5(CAST(p[1:a] AS VARCHAR) || a) AS k, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM each) GROUP BY ALL)
SELECT e.c AS conv_id, CAST(e.d AS BIGINT) AS depth, q.c AS parent_conv_id, e.n AS n_convs, e.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
FROM each e JOIN sums s ON s.k = e.k AND s.d = e.d LEFT JOIN node q ON q.k = e.up AND q.d = e.d - 1
"""

ORACLE_SQL = {"op9_quality": QUALITY.strip(), "op10_substring": SUBSTRING.strip(), "op11_minhash": MINHASH.strip(), "op12_conversation_trie": CONVERSATION_TRIE.strip(), "op13_vector_codes": VECTOR_CODES.strip()}
