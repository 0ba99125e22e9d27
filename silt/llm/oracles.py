"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from silt.llm.quality import BOILERPLATE

_SPACES = r"\x20\x09-\x0D"

#: Words of op7, with the windows' texts compared as they are.
SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
    unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS s FROM d WHERE len(w) >= 13),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN first USING (s), range(13) r(k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN x END, ' ' ORDER BY i) AS t
    FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Bytes of op10 as pairs of hex digits.
SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS i FROM d),
str AS (SELECT win.doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM win JOIN d USING (doc_id)),
first AS (SELECT s, min((doc_id, i)) AS least FROM str GROUP BY s HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM str JOIN first USING (s) WHERE least < (doc_id, i)),
run AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS new FROM later),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run)
    GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, b, lead(a) OVER w AS next, row_number() OVER w AS k FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(CASE WHEN k = 1 THEN substring(h, 1, 2 * a) ELSE '' END || substring(h, 2 * b + 1, 2 * (coalesce(next, len(h) // 2) - b)), '' ORDER BY k) AS t
    FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_W = rf"regexp_extract_all(l, '[^{_SPACES}]+')"
_STOCK = "(?i)" + "|".join(phrase.replace("'", "''") for _, phrase in BOILERPLATE)

#: Lines of op6 and their rules, in the order in which they are tried.
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS w FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
worded AS (SELECT doc_id, l, {_W} AS w FROM line WHERE regexp_matches(l, '[^{_SPACES}]')),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, l, count(*) AS n FROM worded GROUP BY doc_id, l) GROUP BY doc_id),
fault AS (SELECT doc_id, w, (len(w) >= 2 AND 5 * len(list_filter(regexp_split_to_array(l, '[ \t]'), lambda x: x IN ('|', '»', '›', '>', '•', '·'))) >= len(w))
    OR 3 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]{{2,}}$'))) >= len(w)
    OR (len(w) >= 5 AND NOT regexp_matches(w[-1], '[.!?:;…。！？"''”’»)\]]$'))
    OR (len(w) >= 5 AND 10 * len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) >= 7 * len(w))
    OR (len(w) >= 5 AND 2 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) >= len(w))
    OR regexp_matches(l, '{_STOCK}') AS bad FROM worded),
lost AS (SELECT doc_id, count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(len(w)) FILTER (WHERE bad), 0) AS n_words_removed FROM fault GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS s
    FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY doc_id),
figures AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
    CAST(coalesce(n_words_removed, 0) AS BIGINT) AS n_words_removed
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_words_removed <= 50 * n_words AS kept, n_lines_removed, n_words_removed
FROM figures
"""

#: Lines of op9: own is a line's words, v the words left when the k-th goes.
LINES = rf"""
WITH line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
word AS (SELECT doc_id, i, regexp_extract_all(l, '[^{_SPACES}]+') AS w FROM line WHERE regexp_matches(l, '[^{_SPACES}]')),
own AS (SELECT (doc_id, i) AS p, w, len(w) AS n, array_to_string(w, ' ') AS s FROM word),
var AS (SELECT p, unnest(range(1, n + 1)) AS k, unnest(list_transform(range(1, n + 1), lambda k: array_to_string(list_concat(w[1:k - 1], w[k + 1:]), ' '))) AS v, n
    FROM own WHERE n >= 5),
same AS (SELECT s, min(p) AS least FROM own GROUP BY s),
spot AS (SELECT v, k, min(p) AS least FROM var GROUP BY v, k HAVING count(*) > 1),
any_v AS (SELECT v, min(p) AS least FROM var GROUP BY v),
gone AS (SELECT p FROM own JOIN same USING (s) WHERE least < p
    UNION SELECT p FROM var JOIN spot USING (v, k) WHERE least < p
    UNION SELECT p FROM var JOIN same ON v = s WHERE least < p
    UNION SELECT p FROM own JOIN any_v ON s = v WHERE least < p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(l, '[^{_SPACES}]')) AS n_lines, count(gone.p) AS n_removed,
    string_agg(CASE WHEN gone.p IS NULL THEN l END, chr(10) ORDER BY i) AS t FROM line LEFT JOIN gone ON gone.p = (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

#: Shingle sets of op2 as texts; similar sets are found through the shingles that they share, classes by reachability.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
whole AS (SELECT doc_id, count(*) AS n, md5(array_to_string(list_sort(list(s)), chr(10))) AS k FROM gram GROUP BY doc_id),
node AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM whole GROUP BY k),
own AS (SELECT rep, s FROM gram JOIN node ON doc_id = rep),
pair AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM own a JOIN own b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
near AS (SELECT x, y FROM pair JOIN node p ON p.rep = x JOIN node q ON q.rep = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
edge AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
links AS (SELECT x AS rep, count(*) AS n_links FROM edge GROUP BY x),
reach(rep, other) AS (SELECT rep, rep FROM node UNION SELECT reach.rep, edge.y FROM reach JOIN edge ON reach.other = edge.x),
class AS (SELECT rep, min(other) AS class_id FROM reach GROUP BY rep)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(node.rep, d.doc_id) AS rep_id, CAST(coalesce(copies, 1) AS BIGINT) AS n_copies,
    CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(whole.n, 0) AS BIGINT) AS n_grams
FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN node USING (k) LEFT JOIN links USING (rep) LEFT JOIN class USING (rep)
"""
