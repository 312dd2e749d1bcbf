"""DuckDB SQL with the rows of the queries that SQL can express."""

from .licenses import KNOWN, SPELLINGS, WHOLE

QUALITY_RULES = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), gaps AS (
  SELECT doc_id, least(5, i - lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM twice
), reps AS (
  SELECT doc_id, sum(g) AS n_repeat_words FROM gaps GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN reps USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS failed
  FROM counts
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM judged GROUP BY host
), totals AS (
  SELECT sum(k) / sum(n) AS m, count(*) AS hosts, sum(n) AS total_n, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS spread FROM hosts
), prior AS (
  SELECT m, greatest(1.0, least(1e4, m * (1 - m) / greatest(spread - m * (1 - m) * hosts / total_n, 1e-6) - 1)) AS strength FROM totals
), verdicts AS (
  SELECT host, (k + strength * m) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate < 0.5 AS kept, round(rate, 6) AS host_rate
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""

REMOVED_REPEATS = r"""
WITH t AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), windows AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), judged AS (
  SELECT doc_id, pos, word, n = 13 AND doc_id > min(doc_id) FILTER (n = 13) OVER (PARTITION BY win) AS bad FROM windows
), covered AS (
  SELECT doc_id, pos, word, max(CAST(bad AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

NGRAM_CLASSES = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n_words
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)
), runs AS (
  SELECT doc_id, pos, n_words, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), shingles AS (
  SELECT DISTINCT doc_id, run FROM runs WHERE n = 4 OR n_words < 4 AND pos = 1
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes u ON u.doc_id = b WHERE 100 * c >= 85 * (s.n + u.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelt(column: str) -> str:
    """``column``, words apart by two blanks, with each listed spelling replaced."""
    for a, b in {**SPELLINGS, "all rights reserved": ""}.items():
        column = f"replace({column}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return column


LICENSES = rf"""
WITH given(license_id, text) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)}),
texts AS (
  SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS name, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'line', CAST(doc_id AS VARCHAR), unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) FROM documents
  UNION ALL SELECT 'known', license_id, text FROM given
), plain AS (
  SELECT kind, name, trim(regexp_replace(array_to_string(list_transform(string_split(lower(text), chr(10)), lambda x:
    CASE WHEN regexp_matches(x, '^[^\p{{L}}\p{{N}}]*(\(c\)|©)')
           OR (regexp_matches(x, '^[^\p{{L}}\p{{N}}]*copyright([^\p{{L}}\p{{N}}]|$)') AND NOT regexp_matches(x, '^[^\p{{L}}\p{{N}}]*copyright (holder|owner|notice)'))
         THEN ' ' ELSE x END), chr(10)), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') AS form
  FROM texts
), forms AS (
  SELECT kind, name, CASE WHEN regexp_matches(form, '(^| )({"|".join([*SPELLINGS, "all rights reserved"])})( |$)')
    THEN trim(regexp_replace({_spelt("concat(' ', replace(form, ' ', '  '), ' ')")}, ' +', ' ', 'g'), ' ') ELSE form END AS form
  FROM plain
), digests AS (
  SELECT kind, name, sha256(form) AS digest FROM forms WHERE form <> '' OR kind = 'doc'
), known AS (
  SELECT digest, min(name) AS license_id FROM (
    SELECT digest, name FROM digests WHERE kind = 'known'
    UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{i}')" for i, d in WHOLE)})) GROUP BY digest
), found AS (
  SELECT name, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM digests JOIN known USING (digest) WHERE kind = 'line' GROUP BY name
)
SELECT CAST(d.name AS BIGINT) AS doc_id, d.digest AS canon_sha256, license_id, coalesce(notices, '') AS notices
FROM digests d LEFT JOIN known ON known.digest = d.digest AND d.digest <> sha256('') LEFT JOIN found ON found.name = d.name WHERE d.kind = 'doc'
"""

FILTER_AUDIT = r"""
WITH letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, (SELECT bit FROM letters WHERE letter = filter_order[i]) AS own,
         (SELECT CAST(coalesce(sum(bit), 0) AS INTEGER) FROM letters WHERE contains(left(filter_order, i - 1), letter)) AS earlier
  FROM orders, range(1, 6) r(i)
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), low AS (
  SELECT text, min(doc_id) AS first_id FROM t GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > first_id THEN 16 ELSE 0 END AS failed
  FROM t LEFT JOIN low ON low.text = t.text LEFT JOIN marks ON marks.doc_id = t.doc_id
), masks AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY part, failed
), at_step AS (
  SELECT part, filter_order, step, n, n_good, n_toxic, failed = own AS only_own, failed & own <> 0 AS fails, failed & earlier <> 0 AS gone, bit_count(failed) AS m
  FROM masks, steps
)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (only_own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n_good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(m, 0)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM at_step GROUP BY part, filter_order, step
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, words FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces) WHERE len(words) > 0
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) t(k))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1 AND f >= 100
), inner_parts AS (
  SELECT lang, array_to_string(words[i:j], ' ') AS phrase, max(a) AS most
  FROM candidates, range(1, 5) x(i), range(2, 6) y(j) WHERE i < j AND j <= k AND j - i + 1 < k GROUP BY ALL
), free AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.most IS NULL OR 100 * p.most < 100 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, u.c AS cut, l.f AS l, r.f AS r, n, 1000::HUGEINT * c.a * n // (l.f::HUGEINT * r.f) AS score
  FROM free c, range(1, 5) u(c) JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:u.c], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[u.c + 1:], ' ') JOIN totals t ON t.lang = c.lang WHERE u.c < c.k
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest QUALIFY rank <= 2000
"""
