"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = """
WITH hexed AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, h, len(h) // 2 AS n FROM hexed),
starts AS MATERIALIZED (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM bytes WHERE n >= 100)),
ranked AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM starts) WHERE r > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 100 THEN 0 ELSE 1 END AS new FROM ranked WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, a AS to_ FROM spans
  UNION ALL SELECT doc_id, max(b), max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, string_agg(CASE WHEN to_ IS NULL THEN substr(h, 2 * from_ + 1) ELSE substr(h, 2 * from_ + 1, 2 * (to_ - from_)) END, '' ORDER BY a, to_ NULLS LAST) AS h
  FROM gaps g JOIN bytes b ON b.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN sums s ON s.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
"""

CONTAMINATION = f"""
WITH doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
item AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, w[k : k + n - 1] AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM item WHERE len(w) > 0)),
places AS MATERIALIZED (
  SELECT doc_id, n, p, w[p : p + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, item_id, p, places.n FROM places JOIN windows ON windows.n = places.n AND windows.g = places.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
placed AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM doc),
lists AS MATERIALIZED (SELECT doc_id, word, list(pos) AS ps FROM placed GROUP BY doc_id, word),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS wid, item_id, n, g FROM windows),
wanted AS MATERIALIZED (SELECT wid, n, unnest(range(0, n)) AS j, unnest(g) AS word FROM numbered),
rare AS (SELECT wid, n, arg_min(j, f) AS j, arg_min(word, f) AS word FROM wanted JOIN (SELECT word, count(*) AS f FROM placed GROUP BY word) USING (word) GROUP BY wid, n HAVING count(*) = n),
tried AS (
  SELECT DISTINCT wid, doc_id, pos - j + d AS p FROM rare JOIN placed USING (word), (VALUES (-2), (-1), (0), (1), (2)) s(d)
  WHERE pos - j + d >= 0 AND pos - j + d + n <= n_words),
close AS (
  SELECT wid, t.doc_id, p FROM tried t JOIN wanted USING (wid) JOIN lists l ON l.doc_id = t.doc_id AND l.word = wanted.word
  WHERE len(list_filter(ps, lambda q: q BETWEEN p + j - 2 AND p + j + 2)) > 0 GROUP BY wid, t.doc_id, p, n HAVING count(*) = n),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN numbered USING (wid) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc d LEFT JOIN near ON near.doc_id = d.doc_id LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""

SIMILAR = rf"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[k : k + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 90 * (s.n + t.n - c)),
reach(doc_id, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b),
least_ AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(g.n, 0) AS n_similar, least(d.doc_id, coalesce(l.root, d.doc_id)) AS component_id
FROM doc d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN degree g ON g.doc_id = d.doc_id LEFT JOIN least_ l ON l.doc_id = d.doc_id
"""

_TEXT = "coalesce(text, '')"
_PLACES = "list_filter(range(1, len(w) - {n} + 2), lambda p: w[p : p + {n} - 1] = {words})"
_PHRASES = {"apache-2": ["apache", "license", "version", "2"], "cc-by-nc": ["cc", "by", "nc"], "mit": ["under", "the", "mit", "license"]}
_FOUND = ", ".join(f"{_PLACES.format(n=len(x), words=x)} AS p{i}" for i, x in enumerate(_PHRASES.values()))
_NAMES = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{x}' END" for i, x in enumerate(_PHRASES))

LICENSES = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, '{_WORD}') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, {_FOUND} FROM doc),
flat AS (SELECT doc_id, n_words, flatten([p0, p1, p2]) AS p, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS base_labels FROM found)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, base_labels FROM flat
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""((?:{_KEYS})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)"""
_VALUE = rf"""^(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    """(doc_id, kind, a, b) of the matches of a pattern: they are put between two marks, and lengths summed."""
    return f"""
  SELECT doc_id, {kind} AS kind, b - length(m) AS a, b FROM (
    SELECT doc_id, m, i, (sum(length(part) - 1) OVER (PARTITION BY doc_id ORDER BY i) - (length(part) - 1 - length(m)))::BIGINT AS b FROM (
      SELECT doc_id, i, part, CASE WHEN i = 1 THEN '' ELSE split_part(part, chr(2), 1) END AS m FROM (
        SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, CASE WHEN unnest(range(1, len(x) + 1)) = 1 THEN unnest(x) || chr(2) ELSE unnest(x) END AS part
        FROM (SELECT doc_id, string_split(regexp_replace({_TEXT}, '{pattern}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS x FROM documents))))
  WHERE i > 1 AND {keep}"""


SECRETS = f"""
WITH spans AS ({_spans(0, _ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6")} UNION ALL {_spans(1, "(AKIA[A-Z0-9]+)", "length(m) >= 20")} UNION ALL {_spans(2, "([0-9a-f]+)", "length(m) >= 24")}),
sums AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

QUALITY = rf"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[^ 	-]+') AS w,
    list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM doc WHERE len(w) >= 3),
twice AS (SELECT doc_id, unnest(ps) AS p FROM (SELECT doc_id, list(p) AS ps FROM grams GROUP BY doc_id, w[p : p + 2] HAVING count(*) > 1)),
again AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM doc d LEFT JOIN again ON again.doc_id = d.doc_id
"""
