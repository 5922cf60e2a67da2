"""DuckDB SQL with the results of the registered queries.

RE2 has no look-ahead: a control character put before the last white space of every longer run ends
the match there instead.  Merging is a recursive query over distinct chunks.  Both hold for texts
whose white space is ASCII and that don't contain U+0001.
"""

from __future__ import annotations

from sparkloom.queries import END, MULTI, RANKS, START, STOP

_BREAK = r"[\r\n]"
_BREAKS = rf"\s*{_BREAK}+"
_CONTRACTION = "'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"
_S = r"\x01"
_EITHER = r"\p{Lo}\p{M}\p{Lm}"
_UPPER, _LOWER = rf"[{_EITHER}\p{{Lt}}\p{{Lu}}]", rf"[{_EITHER}\p{{Ll}}]"
#: name: (white space run to cut, pattern)
_GRAMMARS = {
    "word": (r"(\s+)(\s\S)", rf"'(?:ll|re|ve|[dmst])| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}{_S}]+|\s+"),
    "generic": (
        r"([^\S\r\n]+)([^\S\r\n]\S)",
        rf"{_CONTRACTION}|[^\r\n\p{{L}}\p{{N}}{_S}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^\s\p{{L}}\p{{N}}{_S}]+{_BREAK}*|{_BREAKS}|\s+",
    ),
    "marks": (
        r"([^\S\r\n]+)([^\S\r\n]\S)",
        rf"{_CONTRACTION}|[^\r\n\p{{L}}\p{{N}}{_S}]?[\p{{L}}\p{{M}}]+|\p{{N}}| ?[^\s\p{{L}}\p{{M}}\p{{N}}{_S}]+{_BREAK}*|{_BREAKS}|\s+",
    ),
    "camel": (
        r"([^\S\r\n]+)([^\S\r\n]\S)",
        "|".join(
            [
                rf"[^\r\n\p{{L}}\p{{N}}{_S}]?{a}(?:{_CONTRACTION})?"
                for a in (f"{_UPPER}*{_LOWER}+", f"{_UPPER}+{_LOWER}*")
            ]
            + [rf"\p{{N}}{{1,3}}| ?[^\s\p{{L}}\p{{N}}{_S}]+[\r\n/]*|{_BREAKS}|\s+"]
        ),
    ),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chunks(text: str, grammar: str = "word") -> str:
    run, pattern = _GRAMMARS[grammar]
    cut = f"regexp_replace({text}, {_quoted(run)}, '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_extract_all({cut}, {_quoted(pattern)})"


def _pretok(pieces: str) -> str:
    return f"SELECT doc_id, len(p) AS n_chunks, md5(array_to_string(p, chr(2))) AS chunks_md5 FROM (SELECT doc_id, {pieces} AS p FROM documents)"


def _encoded(source: str, grammar: str = "word", ranks: str = RANKS) -> str:
    """WITH clause: enc(k, ids) for a query of (k, text)."""
    return f"""
WITH RECURSIVE src AS MATERIALIZED ({source}),
ranks AS MATERIALIZED (
  SELECT hex(from_base64(column0)) AS tok, column1::BIGINT AS rank
  FROM read_csv({_quoted(ranks)}, delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'BIGINT'}})),
pieces AS MATERIALIZED (SELECT k, i, c[i] AS chunk FROM (SELECT k, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT k, {_chunks('text', grammar)} AS c FROM src))),
seeds AS MATERIALIZED (
  SELECT chunk, [h[2 * j - 1 : 2 * j] FOR j IN range(1, len(h) // 2 + 1)] AS toks
  FROM (SELECT chunk, hex(encode(chunk)) AS h FROM (SELECT DISTINCT chunk FROM pieces))),
bpe(chunk, toks, step) AS (
  SELECT chunk, toks, 0 FROM seeds
  UNION ALL
  SELECT chunk, list_concat(list_concat(toks[1 : p - 1], [toks[p] || toks[p + 1]]), toks[p + 2 :]), step + 1
  FROM (
    SELECT b.chunk, any_value(b.toks) AS toks, any_value(b.step) AS step, arg_min(b.p, r.rank * 1000000 + b.p) AS p
    FROM (SELECT chunk, toks, step, unnest(range(1, len(toks))) AS p FROM bpe) b JOIN ranks r ON r.tok = b.toks[b.p] || b.toks[b.p + 1]
    GROUP BY b.chunk)),
merged AS MATERIALIZED (SELECT chunk, arg_max(toks, step) AS toks FROM bpe GROUP BY chunk),
coded AS MATERIALIZED (
  SELECT chunk, list(rank ORDER BY q) AS ids
  FROM (SELECT chunk, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS q FROM merged) JOIN ranks USING (tok) GROUP BY chunk),
enc AS MATERIALIZED (
  SELECT src.k, coalesce(any_value(e.ids), []::BIGINT[]) AS ids
  FROM src LEFT JOIN (SELECT k, flatten(list(ids ORDER BY i)) AS ids FROM pieces JOIN coded USING (chunk) GROUP BY k) e ON e.k = src.k GROUP BY src.k)
"""


_DOCS = "SELECT doc_id AS k, text FROM documents"
_TALK = f"""SELECT conv_id, string_agg('{START}' || role || chr(10) || coalesce(text, '') || '{STOP}' || chr(10), '' ORDER BY turn) || '{START}assistant' || chr(10) AS prompt
FROM conversations GROUP BY conv_id"""


def _special(source: str) -> str:
    """WITH clause: spl(k, ids) for a query of (k, text) with the added tokens in the text."""
    split = f"""
SELECT k, i, part FROM (
  SELECT k, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part
  FROM (SELECT k, regexp_extract_all(text, '<\\|(?:endoftext|im_start|im_end)\\|>|(?:[^<]|<[^|])+') AS parts FROM ({source})))"""
    head = _encoded(f"SELECT DISTINCT part AS k, part AS text FROM ({split}) WHERE part NOT IN ('{END}', '{START}', '{STOP}')")
    return f"""{head}, spl AS (
  SELECT k, flatten(list(ids ORDER BY i)) AS ids FROM (
    SELECT s.k, s.i, CASE s.part WHEN '{END}' THEN [50256] WHEN '{START}' THEN [50257] WHEN '{STOP}' THEN [50258] ELSE e.ids END AS ids
    FROM ({split}) s LEFT JOIN enc e ON e.k = s.part) GROUP BY k)
"""


_IDS = "array_to_string(ids, ' ')"
_ROUND = "SELECT doc_id, text FROM documents"

ORACLE: dict[str, str] = {
    "pretok_word": _pretok(_chunks("text", "word")),
    "pretok_generic": _pretok(_chunks("text", "generic")),
    "pretok_marks": _pretok(_chunks("text", "marks")),
    "pretok_camel": _pretok(_chunks("text", "camel")),
    "pretok_metaspace": _pretok("regexp_extract_all(CASE WHEN text = '' THEN '' WHEN starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁*[^▁]+|▁+')"),
    "chunk_frequency_topk": f"SELECT chunk, count(*) AS n FROM (SELECT unnest({_chunks('text')}) AS chunk FROM documents) GROUP BY chunk ORDER BY n DESC, encode(chunk) LIMIT 100",
    "count_tokens": f"{_encoded(_DOCS)} SELECT k AS doc_id, len(ids) AS n_tokens FROM enc",
    "stream_count_tokens": f"{_encoded(_DOCS)} SELECT k AS doc_id, len(ids) AS n_tokens FROM enc",
    "encode_word": f"{_encoded(_DOCS)} SELECT k AS doc_id, {_IDS} AS ids FROM enc",
    "encode_tokenizer_json": f"{_encoded(_DOCS)} SELECT k AS doc_id, {_IDS} AS ids FROM enc",
    "encode_generic_multi": f"{_encoded(_DOCS, 'generic', MULTI)} SELECT k AS doc_id, {_IDS} AS ids FROM enc",
    "encode_camel": f"{_encoded(_DOCS, 'camel')} SELECT k AS doc_id, {_IDS} AS ids FROM enc",
    "tokens_by_lang": f"{_encoded(_DOCS)} SELECT lang, count(*) AS n_docs, sum(len(ids))::BIGINT AS n_tokens, sum(strlen(text)) / sum(len(ids)) AS bytes_per_token FROM enc JOIN documents ON doc_id = k GROUP BY lang",
    "tokens_per_source": f"{_encoded(_DOCS)} SELECT source, sum(len(ids))::BIGINT AS n_tokens, max(len(ids)) AS longest FROM enc JOIN documents ON doc_id = k GROUP BY source",
    "token_frequency": f"{_encoded(_DOCS)} SELECT id::INTEGER AS id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM enc) GROUP BY id",
    "distinct_tokens": f"{_encoded(_DOCS)} SELECT lang, count(DISTINCT id) AS n_distinct FROM (SELECT lang, unnest(ids) AS id FROM enc JOIN documents ON doc_id = k) GROUP BY lang",
    "encode_packed": f"{_encoded(_DOCS)} SELECT k AS doc_id, 4 * len(ids) AS n_bytes, md5(array_to_string([printf('%02x%02x0000', x % 256, x // 256) FOR x IN ids], '')) AS hex_md5 FROM enc",
    "encode_offsets": f"""{_encoded(_DOCS)}, lens AS (SELECT rank, len(tok) // 2 AS n FROM ranks),
placed AS (SELECT k, i, sum(n) OVER (PARTITION BY k ORDER BY i) AS e, n FROM (SELECT k, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM enc) JOIN lens ON rank = id)
SELECT enc.k AS doc_id, len(ids) AS n_tokens, md5(coalesce(s, '')) AS spans_md5
FROM enc LEFT JOIN (SELECT k, string_agg((e - n)::BIGINT || ':' || e::BIGINT, ' ' ORDER BY i) AS s FROM placed GROUP BY k) p ON p.k = enc.k""",
    "encode_padded": f"""{_encoded(_DOCS)} SELECT k AS doc_id, array_to_string(list_resize(ids[1:512], 512, 50256), ' ') AS input_ids, least(len(ids), 512) AS n_real FROM enc""",
    "encode_padded_longest": f"""{_encoded(_DOCS)} SELECT doc_id, max(len(ids)) OVER (PARTITION BY source) AS width,
CASE WHEN len(ids) < max(len(ids)) OVER (PARTITION BY source) THEN len(ids) + 1 ELSE 0 END AS first_padding FROM enc JOIN documents ON doc_id = k""",
    "encode_left": f"""{_encoded(_DOCS)}, cut AS (SELECT k, list_concat(list_concat([50256], ids[greatest(len(ids) - 253, 1):]), [50256]) AS ids FROM enc)
SELECT k AS doc_id, array_to_string(list_concat(list_resize([]::BIGINT[], 256 - len(ids), 50256), ids), ' ') AS input_ids,
array_to_string(list_concat(list_resize([]::BIGINT[], 256 - len(ids), 0), list_resize([]::BIGINT[], len(ids), 1)), ' ') AS attention_mask FROM cut""",
    "decode_roundtrip": _ROUND,
    "decode_packed": _ROUND,
    "skip_special_decode": _ROUND,
    "chat_render": _TALK,
    "chat_encode": f"{_special(f'SELECT conv_id AS k, prompt AS text FROM ({_TALK})')} SELECT k AS conv_id, len(ids) AS n_tokens, {_IDS} AS ids FROM spl",
    "special_split": f"""{_special(f"SELECT conv_id * 1000 + turn AS k, '{START}' || role || '{STOP}' || text || '{END}' AS text FROM conversations")} SELECT k // 1000 AS conv_id, k % 1000 AS turn, {_IDS} AS ids FROM spl""",
    "vocab_lookup": f"""SELECT column1::INTEGER AS id, hex(from_base64(column0)) AS hex, octet_length(from_base64(column0))::INTEGER AS n_bytes
FROM read_csv({_quoted(RANKS)}, delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'BIGINT'}})""",
    "vocab_special_ids": f"SELECT * FROM (VALUES (50256, '{END}'), (50257, '{START}'), (50258, '{STOP}')) t(id, token)",
    "nfc_normalize": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "events_json_tokens": f"{_encoded('SELECT event_id AS k, props AS text FROM events')} SELECT event_type, count(*) AS n_events, sum(len(ids))::BIGINT AS n_tokens FROM enc JOIN events ON event_id = k GROUP BY event_type",
    "encode_pair": f"""{_encoded("SELECT doc_id || 'a' AS k, text FROM documents UNION ALL SELECT doc_id || 'b', source FROM documents")},
two AS (SELECT d.doc_id, a.ids AS a, b.ids AS b, len(a.ids) AS la, len(b.ids) AS lb, greatest(len(a.ids) + len(b.ids) - 123, 0) AS r
  FROM documents d JOIN enc a ON a.k = d.doc_id || 'a' JOIN enc b ON b.k = d.doc_id || 'b'),
cut AS (SELECT doc_id, a[1 : CASE WHEN r = 0 THEN la WHEN r <= abs(la - lb) THEN CASE WHEN la >= lb THEN la - r ELSE la END ELSE 61 END] AS a,
  b[1 : CASE WHEN r = 0 THEN lb WHEN r <= abs(la - lb) THEN CASE WHEN la >= lb THEN lb ELSE lb - r END ELSE 62 END] AS b FROM two)
SELECT doc_id, array_to_string(flatten([[50257], a, [50258, 50256], b, [50258, 50256]]), ' ') AS input_ids,
array_to_string(list_concat(list_resize([]::INT[], len(a) + 3, 0), list_resize([]::INT[], len(b) + 2, 1)), ' ') AS token_type_ids FROM cut""",
}
