"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from ebbflow.llm.quality import PHRASES, LineRules

WORDS = r"'[^\x20\x09-\x0D]+'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql(rules: LineRules = LineRules()) -> str:
    ends = ", ".join(_text(c) for c in ".!?:;)\"'…”’»。！？")
    seps = ", ".join(_text(c) for c in "|>/\\~")
    phrases = " OR ".join(f"contains(lower(line), {_text(p.decode())})" for p in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {WORDS}) AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(w) - 6)) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, sum(coalesce(least(8, nxt - i), 8)) AS n
            FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, n, line, regexp_extract_all(line, {WORDS}) AS lw
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM d)),
m AS (SELECT doc_id, n, line, len(lw) AS words,
             right(lw[-1], 1) IN ({ends}) AS ends_well,
             length(regexp_replace(line, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS marks,
             length(regexp_replace(line, '[^.,!?;:]', '', 'g')) AS stops,
             len(list_filter(lw, lambda x: x IN ({seps}))) AS seps,
             len(list_filter(range(2, len(lw) + 1), lambda k: lw[k] = lw[k - 1])) AS same,
             len(lw) <= {rules.boilerplate_words} AND ({phrases}) AS boilerplate
      FROM l WHERE len(lw) > 0),
j AS (SELECT *, stops * {rules.words_per_stop} < words AS few,
             row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS dup FROM m),
v AS (SELECT *, (NOT ends_well AND (few OR words < {rules.open_words})) OR (few AND words > {rules.words_per_stop})
             OR (words >= {rules.marks_from_words} AND (same > {rules.max_stutter} * words OR marks > {rules.max_marks_per_word} * words))
             OR seps >= {rules.min_separators} OR boilerplate AS failed FROM j),
s AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup, count(*) FILTER (failed) AS n_failed,
             coalesce(sum(words) FILTER (failed), 0) AS lost FROM v GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(s.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(s.n_failed, 0) AS BIGINT) AS n_lines_removed,
             CAST(coalesce(s.lost, 0) AS BIGINT) AS lost
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= {rules.max_loss} * n_words AS kept, n_lines, n_lines_removed, n_words - lost AS n_words_kept
FROM b"""


def dedup_sql(length: int = 100) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * length})) AS s FROM d, unnest(range(0, length(h) // 2 - {length} + 1)) t(p)),
dup AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS new FROM dup),
runs AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS e
         FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cut) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e, e - a AS gone, e AS upto FROM runs),
kept AS (SELECT p.doc_id, string_agg(substr(d.h, 2 * p.a + 1, 2 * (p.e - p.a)), '' ORDER BY p.a) AS h, sum(p.gone) AS n, count(*) AS k,
                max(p.upto) AS last FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(kept.k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN d.h ELSE kept.h || substr(d.h, 2 * kept.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def jaccard_sql(words: int = 5) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= {words}
                     THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY ALL HAVING 5 * count(*) >= 4 * (max(a.n) + max(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT g.doc_id, c.class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, CAST(len(g.g) AS BIGINT) AS n_shingles
FROM g JOIN c ON c.a = g.doc_id LEFT JOIN k ON k.a = g.doc_id"""


def phrases_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = "\nUNION ALL ".join(
        f"SELECT lang, list_slice(w, i, i + {m - 1}) AS g, count(*) AS f FROM p, unnest(range(1, len(w) - {m - 2})) t(i) GROUP BY ALL HAVING count(*) >= 30" for m in (1, 2, 3, 4))
    return f"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                 FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED ({grams}),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
k AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
      JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k)
      JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, len(c.g))),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS longer
      FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM c)) GROUP BY ALL),
o AS (SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM s LEFT JOIN x ON x.lang = s.lang AND x.g = s.g
      WHERE x.longer IS NULL OR 100 * x.longer < 80 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
      FROM o JOIN n ON n.lang = o.lang) WHERE rank <= 2000"""


def near_vectors_sql(least: float = 0.95) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v
      WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= {least}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN k ON k.a = c.a"""


def hard_negatives_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * c.v[k])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""
