"""DuckDB SQL for ``more_queries``."""

from __future__ import annotations

from sparkloom.more_queries import HAN, LATIN, OTHERS, SMALL_MERGES, small_spec
from sparkloom.oracles import _DOCS, _GRAMMARS, _IDS, _ROUND, _chunks, _encoded, _pretok, _quoted, _special
from sparkloom.plans.spec import byte_alphabet
from sparkloom.queries import END, MODEL, MULTI, RANKS, START, STOP

_MIXED = f"translate(text, '{LATIN}', '{OTHERS}')"
# Marks and digits by threes.
_GRAMMARS["marks3"] = (_GRAMMARS["marks"][0], _GRAMMARS["marks"][1].replace(r"|\p{N}|", r"|\p{N}{1,3}|"))
# RE2 takes the first alternative that matches; a gap is what no alternative begins at.
_THREES = rf"\p{{N}}{{1,3}}|[^\p{{N}}]+"
_HANS = f"{HAN}|{HAN.replace('[', '[^')}"
_ENC = f"{_encoded(_DOCS)} SELECT k AS doc_id, {_IDS} AS ids FROM enc"


def _nested(text: str, *patterns: str, last: str) -> str:
    """Pieces by several splits; the last is a grammar."""
    pieces = f"[{text}]"
    for p in patterns:
        pieces = f"flatten(list_transform({pieces}, lambda p: regexp_extract_all(p, {_quoted(p)})))"
    return f"flatten(list_transform({pieces}, lambda p: {_chunks('p', last)}))"


def _values(rows: list[tuple], columns: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else _quoted(x)

    body = ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _marked(prefix: str) -> str:
    """Pieces of the text with space marks; ``prefix`` is what stands in front of a text that isn't empty."""
    return f"regexp_extract_all(CASE WHEN text = '' THEN '' ELSE {prefix} || replace(text, ' ', '▁') END, '▁*[^▁]+|▁+')"


_JSON_MERGES = f"""WITH model AS MATERIALIZED (SELECT model FROM read_json({_quoted(MODEL)}, maximum_object_size = 200000000, columns = {{'model': 'JSON'}})),
vocab AS MATERIALIZED (SELECT key AS tok, value::BIGINT AS id FROM (SELECT unnest(json_keys(model->'vocab')) AS key, unnest(json_extract(model->'vocab', '$.*')) AS value FROM model)),
pairs AS (SELECT unnest(from_json(model->'merges', '[["VARCHAR"]]')) AS m, unnest(range(0, json_array_length(model->'merges')::BIGINT)) AS rank FROM model),
merges AS (SELECT rank, a.id AS l, b.id AS r, c.id AS t FROM pairs JOIN vocab a ON a.tok = m[1] JOIN vocab b ON b.tok = m[2] JOIN vocab c ON c.tok = m[1] || m[2]),
made AS (SELECT t AS id, max(rank) AS made FROM merges GROUP BY t),
used AS (SELECT id, min(rank) AS used FROM (SELECT l AS id, rank FROM merges UNION ALL SELECT r, rank FROM merges) GROUP BY id)
SELECT count(*) AS n_inversions FROM made JOIN used USING (id) WHERE made >= used"""

_MERGES_OF_RANKS = f"""WITH RECURSIVE ranks AS MATERIALIZED (
  SELECT hex(from_base64(column0)) AS tok, column1::BIGINT AS rank
  FROM read_csv({_quoted(RANKS)}, delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'BIGINT'}})),
bpe(rank, toks) AS (
  SELECT rank, [tok[2 * j - 1 : 2 * j] FOR j IN range(1, len(tok) // 2 + 1)] FROM ranks WHERE len(tok) > 2
  UNION ALL
  SELECT rank, list_concat(list_concat(toks[1 : p - 1], [toks[p] || toks[p + 1]]), toks[p + 2 :])
  FROM (
    SELECT b.rank, any_value(b.toks) AS toks, arg_min(b.p, r.rank * 1000 + b.p) AS p
    FROM (SELECT rank, toks, unnest(range(1, len(toks))) AS p FROM bpe WHERE len(toks) > 2) b JOIN ranks r ON r.tok = b.toks[b.p] || b.toks[b.p + 1] AND r.rank <> b.rank
    GROUP BY b.rank))
SELECT rank::INTEGER AS rank, toks[1] AS left_hex, toks[2] AS right_hex FROM bpe WHERE len(toks) = 2"""

_SURFACE = ", ".join(f"('{b:02X}', {_quoted(c)})" for b, c in byte_alphabet().items())
_TOKENS = f"""{_encoded(_DOCS)}, letters(hex, c) AS (VALUES {_SURFACE}),
names AS MATERIALIZED (
  SELECT rank, string_agg(c, '' ORDER BY i) AS name
  FROM (SELECT rank, unnest(range(1, len(tok) // 2 + 1)) AS i, tok FROM ranks) JOIN letters ON hex = tok[2 * i - 1 : 2 * i] GROUP BY rank),
said AS (SELECT k, string_agg(name, ' ' ORDER BY i) AS tokens FROM (SELECT k, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM enc) JOIN names ON rank = id GROUP BY k)
SELECT enc.k AS doc_id, coalesce(tokens, '') AS tokens FROM enc LEFT JOIN said ON said.k = enc.k"""

_STRIPPED = f"regexp_replace(regexp_replace(t, '[ \\t\\n\\r\\x0b\\x0c]*<\\|im_start\\|>', '{START}', 'g'), '<\\|im_end\\|>[ \\t\\n\\r\\x0b\\x0c]*', '{STOP}', 'g')"
_STRIP_SOURCE = f"SELECT conv_id * 1000 + turn AS k, {_STRIPPED} AS text FROM (SELECT conv_id, turn, text || ' ' || chr(10) || '{START} ' || role || ' {STOP}' || chr(9) || ' ' || text || ' {END} x' AS t FROM conversations)"

_RESET = f"""{_encoded(f"SELECT conv_id * 10000 + turn * 10 AS k, role AS text FROM conversations UNION ALL SELECT conv_id * 10000 + turn * 10 + 1, text || '{END}' FROM conversations")}
SELECT a.k // 10000 AS conv_id, a.k % 10000 // 10 AS turn, array_to_string(flatten([[60000], a.ids, [60001, 60000], b.ids]), ' ') AS ids
FROM enc a JOIN enc b ON b.k = a.k + 1 WHERE a.k % 10 = 0"""

_PAIRS = _encoded("SELECT doc_id || 'a' AS k, text FROM documents UNION ALL SELECT doc_id || 'b', source FROM documents")
_TWO = "documents d JOIN enc a ON a.k = d.doc_id || 'a' JOIN enc b ON b.k = d.doc_id || 'b'"

_PAIR_LENGTHS = f"""{_encoded("SELECT doc_id || 'a' AS k, text FROM documents UNION ALL SELECT doc_id || 'b', translate(text, 'aeiou', '') FROM documents")},
two AS (SELECT d.doc_id, len(a.ids) AS la, len(b.ids) AS lb, greatest(len(a.ids) + len(b.ids) - 301, 0) AS r FROM {_TWO})
SELECT doc_id, la AS n_a, lb AS n_b,
CASE WHEN r = 0 THEN la WHEN r <= abs(la - lb) THEN CASE WHEN la >= lb THEN la - r ELSE la END ELSE 150 END AS cut_a,
CASE WHEN r = 0 THEN lb WHEN r <= abs(la - lb) THEN CASE WHEN la >= lb THEN lb ELSE lb - r END ELSE 151 END AS cut_b FROM two"""

_OWN_PROMPT = f"""SELECT conv_id, '{START}' || string_agg('[' || i || '/' || n || '] ' || upper(role) || ': ' || trim(CASE WHEN coalesce(text, '') = '' THEN 'none' ELSE text END, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
  || CASE WHEN i = n THEN '{STOP}' ELSE '' END || chr(10), '' ORDER BY i) || 'answer ' || any_value(n) || ' >' AS prompt
FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id"""


def _fallback() -> str:
    spec = small_spec()
    vocab = ", ".join(f"({_quoted(t)}, {i})" for t, i in spec.vocab.items())
    singles = ", ".join(_quoted(t) for t in spec.vocab if len(t) == 1)
    pairs = [m.split(" ") for m in SMALL_MERGES.split("|")]
    merges = ", ".join(f"({_quoted(a)}, {_quoted(b)}, {r})" for r, (a, b) in enumerate(pairs))
    return f"""
WITH RECURSIVE vocab(tok, id) AS MATERIALIZED (SELECT * FROM (VALUES {vocab}) t(a, b)),
merges(l, r, rank) AS MATERIALIZED (SELECT * FROM (VALUES {merges}) t(a, b, c)),
src AS MATERIALIZED (
  SELECT doc_id AS k, kind, regexp_extract_all(CASE WHEN text = '' THEN '' ELSE lead || replace(text, ' ', '▁') END, '▁*[^▁]+|▁+') AS c
  FROM documents, (VALUES ('led', '▁'), ('bare', '')) t(kind, lead)),
pieces AS MATERIALIZED (SELECT k, kind, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS chunk FROM src),
seeds AS MATERIALIZED (
  SELECT chunk, flatten(list_transform(string_split(chunk, ''), lambda c: CASE WHEN list_contains([{singles}], c) THEN [c]
    ELSE list_transform(range(1, len(hex(encode(c))) // 2 + 1), lambda j: '<0x' || hex(encode(c))[2 * j - 1 : 2 * j] || '>') END)) AS toks
  FROM (SELECT DISTINCT chunk FROM pieces)),
bpe(chunk, toks, step) AS (
  SELECT chunk, toks, 0 FROM seeds
  UNION ALL
  SELECT chunk, list_concat(list_concat(toks[1 : p - 1], [toks[p] || toks[p + 1]]), toks[p + 2 :]), step + 1
  FROM (
    SELECT b.chunk, any_value(b.toks) AS toks, any_value(b.step) AS step, arg_min(b.p, m.rank * 1000000 + b.p) AS p
    FROM (SELECT chunk, toks, step, unnest(range(1, len(toks))) AS p FROM bpe) b JOIN merges m ON m.l = b.toks[b.p] AND m.r = b.toks[b.p + 1]
    GROUP BY b.chunk)),
merged AS MATERIALIZED (SELECT chunk, arg_max(toks, step) AS toks FROM bpe GROUP BY chunk),
coded AS MATERIALIZED (
  SELECT chunk, list(id ORDER BY q) AS ids
  FROM (SELECT chunk, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS q FROM merged) JOIN vocab USING (tok) GROUP BY chunk),
enc AS MATERIALIZED (SELECT k, kind, array_to_string(flatten(list(ids ORDER BY i)), ' ') AS ids FROM pieces JOIN coded USING (chunk) GROUP BY k, kind)
SELECT d.doc_id, coalesce(a.ids, '') AS ids, coalesce(b.ids, '') AS bare, d.text
FROM documents d LEFT JOIN enc a ON a.k = d.doc_id AND a.kind = 'led' LEFT JOIN enc b ON b.k = d.doc_id AND b.kind = 'bare'"""


_RANKS_CSV = "(SELECT hex(from_base64(column0)) AS hex, column1::INTEGER AS id FROM read_csv({}, delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'BIGINT'}}))"

_RULES = [
    ("byte level", True, "", 1, 0, "none", False, False), ("no pre-tokenizer",), ("no model",), ("list vocabulary",), ("word level",), ("dropout",), ("word ends",),
    ("unknown token",), ("normal form", True, "NFKC", 1, 0, "none", False, False), ("two forms", True, "NFD NFC", 1, 0, "none", False, False), ("lower case",),
    ("bare level",), ("digits one by one", True, "", 2, 0, "none", False, False), ("digit runs", True, "", 2, 0, "none", False, False),
    ("split", True, "", 1, 0, "none", False, False), ("two splits", True, "", 2, 0, "none", False, False), ("three splits", True, "", 3, 0, "none", False, False),
    ("split and pattern",), ("removing split",), ("anchored split",), ("split without level",), ("broken split",), ("white space",),
    ("fallback", True, "", 0, 0, "none", True, False), ("fallback, replace", True, "", 0, 1, "none", True, False),
    ("fallback, prepend", True, "", 0, 2, "always", True, False), ("fallback, metaspace", True, "", 0, 3, "first", True, False), ("fallback, never",),
    ("fallback, punctuation",), ("strip", True, "", 0, 0, "none", True, True),
]
_SIZES = {"gpt2": (50257, 1), "r50k_base": (50257, 1), "p50k_base": (50281, 1), "p50k_edit": (50284, 4), "cl100k_base": (100277, 5), "o200k_base": (200019, 2)}
_MODELS = {
    "gpt2": "gpt2", "ada": "r50k_base", "babbage": "r50k_base", "curie": "r50k_base", "davinci": "r50k_base", "text-ada-001": "r50k_base",
    "text-babbage-001": "r50k_base", "text-curie-001": "r50k_base", "text-davinci-001": "r50k_base", "code-cushman-001": "p50k_base",
    "code-davinci-002": "p50k_base", "text-davinci-002": "p50k_base", "text-davinci-003": "p50k_base", "code-davinci-edit-001": "p50k_edit",
    "text-davinci-edit-001": "p50k_edit", "gpt-3.5": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "gpt-4": "cl100k_base", "gpt-4-32k": "cl100k_base",
    "gpt-4-turbo": "cl100k_base", "text-embedding-3-large": "cl100k_base", "text-embedding-3-small": "cl100k_base", "text-embedding-ada-002": "cl100k_base",
    "gpt-4o": "o200k_base", "gpt-4o-mini": "o200k_base", "o1": "o200k_base", "o1-mini": "o200k_base", "o1-preview": "o200k_base", "o3": "o200k_base", "o3-mini": "o200k_base",
}

ORACLE: dict[str, str] = {
    "merge_monotonic_check": _JSON_MERGES,
    "pair_lengths": _PAIR_LENGTHS,
    "pretok_digits": _pretok(_nested("text", r"\p{N}|[^\p{N}]+", last="word")),
    "pretok_cjk": _pretok(_nested(_MIXED, _THREES, _HANS, last="marks3")),
    "pretok_multi": _pretok(_nested("text", "[,.;|]+|[^,.;|]+", r"\p{N}+|[^\p{N}]+", last="generic")),
    "pretok_whole": _pretok("CASE WHEN text = '' THEN [] ELSE [text] END"),
    "pretok_prepend": _pretok(_marked("'▁'")),
    "pretok_no_prefix": _pretok(_marked("''")),
    **dict.fromkeys(("encode_heap", "encode_loop", "encode_named", "encode_rank_file", "encode_auto_file", "encode_folder", "encode_auto_folder", "encode_cached_json", "sql_encode"), _ENC),
    "merges_of_ranks": _MERGES_OF_RANKS,
    "model_encodings": _values([(m, e, *_SIZES[e]) for m, e in _MODELS.items()], "model, encoding, size, n_specials"),
    "config_rules": _values([(*r, False, "", 0, 0, "", False, False)[:8] if len(r) == 1 else r for r in _RULES], "name, ok, forms, n_stages, marks, prefix, fallback, strip"),
    "recovered_patterns": _values([("plain", "ab"), ("joined", "x|yz"), ("field", "q"), ("computed", None), ("broken", None), ("absent", None)], "name, pattern"),
    "config_specials": _values([(END, 50256), ("<x>", 50300), ("bos", 50300), ("eos", 50256), ("unk", None), ("pad", 50256)], "name, id"),
    "token_properties": _values(
        [("length", "50257"), ("n_vocab", "50257"), ("vocab_size", "50257"), ("vocabulary", "50257"), ("limit", "1024"), ("no limit", None), ("padding", "left"),
         ("truncation", "right"), ("eos", END), ("pad", END), ("sep", None), ("special ids", "[50256]"), ("special tokens", f"['{END}']"), ("repr", "SparkAutoTokenizer(n_vocab=50257)")],
        "name, value",
    ),
    "special_strip": f"{_special(_STRIP_SOURCE)} SELECT k // 1000 AS conv_id, k % 1000 AS turn, {_IDS} AS ids FROM spl",
    "special_none": f"""{_encoded(f"SELECT doc_id AS k, '{START}' || text || '{END}' AS text FROM documents")} SELECT k AS doc_id, {_IDS} AS ids FROM enc""",
    "special_reset": _RESET,
    "encode_bert": f"""{_PAIRS} SELECT d.doc_id, array_to_string(flatten([[60000], a.ids, [60001], b.ids, [60001]]), ' ') AS ids,
array_to_string(list_concat(list_resize([]::INT[], len(a.ids) + 2, 0), list_resize([]::INT[], len(b.ids) + 1, 1)), ' ') AS types FROM {_TWO}""",
    "encode_flags": f"""{_PAIRS} SELECT d.doc_id, array_to_string(flatten([[50257], a.ids, [50258]]), ' ') AS ids, array_to_string(list_concat(a.ids, b.ids), ' ') AS pair FROM {_TWO}""",
    "encode_first_processor": f"{_encoded(_DOCS)} SELECT k AS doc_id, array_to_string(list_concat([50257], ids), ' ') AS ids FROM enc",
    "truncate_single": f"{_encoded(_DOCS)} SELECT k AS doc_id, array_to_string(flatten([[50256], ids[1:18], [50256]]), ' ') AS ids, '50256 50256' AS bare FROM enc",
    "tokens_of_ids": _TOKENS,
    "auto_tokenize": _TOKENS,
    "ids_of_tokens": f"{_encoded(_DOCS)} SELECT k AS doc_id, array_to_string(list_concat(ids, [-1, 50256]), ' ') AS ids FROM enc",
    "sql_count": f"{_encoded(_DOCS)} SELECT k AS doc_id, len(ids) AS n_tokens FROM enc",
    "sql_decode": _ROUND,
    "sql_explode": f"""{_encoded(_DOCS)}, lens AS (SELECT rank, len(tok) // 2 AS n FROM ranks),
placed AS (SELECT k, i, id, n, sum(n) OVER (PARTITION BY k ORDER BY i) AS e FROM (SELECT k, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM enc) JOIN lens ON rank = id)
SELECT k AS doc_id, count(*) AS n, sum(id * i)::BIGINT AS weighted, max(e)::INTEGER AS n_bytes, max(e - n)::INTEGER AS last_start FROM placed GROUP BY k""",
    "vocab_diff": f"SELECT hex, a.id AS id_a, b.id AS id_b FROM {_RANKS_CSV.format(_quoted(RANKS))} a FULL JOIN {_RANKS_CSV.format(_quoted(MULTI))} b USING (hex) WHERE a.id IS DISTINCT FROM b.id",
    "packed_sequences": f"""{_encoded(_DOCS)}, placed AS (SELECT k, len(ids) AS n, coalesce(sum(len(ids)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM enc)
SELECT k AS doc_id, n AS n_tokens, s // 2048 AS first_sequence, s % 2048 AS "offset", CASE WHEN n > 0 THEN (s + n - 1) // 2048 END AS last_sequence FROM placed""",
    "tensor_sums": f"""{_encoded(_DOCS)} SELECT 256::BIGINT AS width, count(*) AS n_rows, sum(list_sum(list_resize(ids[1:256], 256, 50256)))::BIGINT AS total, sum(coalesce(list_sum(ids[1:256]), 0))::BIGINT AS real_total FROM enc""",
    "chat_header": """SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(coalesce(text, '')) || '<|eot_id|>', '' ORDER BY turn)
|| '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM conversations GROUP BY conv_id""",
    "chat_own_template": f"""SELECT conv_id, prompt, '[{{"name": "é"}}]' AS with_tools FROM ({_OWN_PROMPT})""",
    "chat_own_encode": f"{_special(f'SELECT conv_id AS k, prompt AS text FROM ({_OWN_PROMPT})')} SELECT k AS conv_id, {_IDS} AS ids, len(ids) AS n_mask FROM spl",
    "chat_choice": _values(
        [("one", "S"), ("default", "D"), ("tools", "T"), ("first", "X"), ("none", "error"), ("empty", "error"), ("unclosed", "error"), ("unknown", "error"), ("open", "error")],
        "name, template",
    ),
    "encode_fallback": _fallback(),
}
ORACLE["sql_offsets"] = f"""{_encoded(_DOCS)}, lens AS (SELECT rank, len(tok) // 2 AS n FROM ranks),
placed AS (SELECT k, i, sum(n) OVER (PARTITION BY k ORDER BY i) AS e, n FROM (SELECT k, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM enc) JOIN lens ON rank = id)
SELECT enc.k AS doc_id, len(ids) AS n_tokens, md5(coalesce(s, '')) AS spans_md5
FROM enc LEFT JOIN (SELECT k, string_agg((e - n)::BIGINT || ':' || e::BIGINT, ' ' ORDER BY i) AS s FROM placed GROUP BY k) p ON p.k = enc.k"""
