"""DuckDB oracle SQL for the registered queries (same names, same columns).

Fixtures are rebuilt from the driver tables in SQL, and the constants the
queries use are stated here once more: nothing is imported from the code that is
checked. Regex differences: DuckDB's RE2 has no look-around, so the number
pattern uses the equivalent alternation (long digit runs first).
"""

from __future__ import annotations

# Language markers, patterns, histogram bounds.
ID_TOKENS = (' yang ', ' tidak ', ' kamu ', ' saya ', ' untuk ', ' dengan ')
EN_TOKENS = (' the ', ' and ', ' with ', ' from ', ' this ', ' that ')
ID_CHARS = 'khsyaiu'
EN_CHARS = 'thearoin'
DATE_RE = r"(\d{1,2})[\-/](\d{1,2})[\-/](\d{2,4})"
CURRENCY_RE = r"(?i)(?:rp|idr)\s*(\d+[\d.,]*)"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_RE = r"https?://\S+"
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
NUMBER_RE_RE2 = r"\d{4,}|\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?"
NL = "chr(10)"
NUMBER_TOKEN = r"^[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
MARK_TOKEN = r"^[!-/:-@\[-`{-~]$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def heuristic(col: str) -> str:
    s = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"

    def cnt(t):
        return f"((length({s}) - length(replace({s}, {q(t)}, ''))) // {len(t)})"

    def chars(cs):
        return f"(length({s}) - length(translate({s}, {q(cs)}, '')))"
    ids = f"(5 * ({' + '.join(cnt(t) for t in ID_TOKENS)}) + {chars(ID_CHARS)})"
    ens = f"(5 * ({' + '.join(cnt(t) for t in EN_TOKENS)}) + {chars(EN_CHARS)})"
    return (f"(CASE WHEN {col} IS NULL OR {s} = '' THEN 'mix' WHEN {ids} = 0 AND {ens} = 0 THEN 'mix' "
            f"WHEN abs({ids} - {ens}) <= 2 THEN 'mix' WHEN {ids} > {ens} THEN 'id' ELSE 'en' END)")


def callback(s: str, pattern: str, fn) -> str:
    pat = q(pattern)
    return (f"array_to_string(list_transform(list_zip(regexp_split_to_array({s}, {pat}), "
            f"regexp_extract_all({s}, {pat})), lambda p: p[1] || coalesce({fn('p[2]')}, '')), '')")


def t1(s):
    return callback(s, DATE_RE, lambda m: (
        f"lpad(regexp_extract({m}, {q(DATE_RE)}, 1), 2, '0') || '-' || lpad(regexp_extract({m}, {q(DATE_RE)}, 2), 2, '0')"
        f" || '-' || lpad(regexp_extract({m}, {q(DATE_RE)}, 3), 4, '0')"))


def t2(s):
    return callback(s, NUMBER_RE_RE2, lambda m: f"replace(replace({m}, '.', ''), ',', '.')")


def t3(s):
    return callback(s, CURRENCY_RE, lambda m: (
        f"'IDR ' || replace(replace(regexp_extract({m}, {q(CURRENCY_RE)}, 1), '.', ''), ',', '.')"))


def lower_each(s, found):
    return f"list_reduce({found}, lambda acc, x: replace(acc, x, lower(x)), {s})"


def emails(s):
    return f"regexp_extract_all({s}, {q(EMAIL_RE)})"


def urls(s):
    return f"regexp_extract_all({s}, {q(URL_RE)})"


def joined_lower(lst):
    return f"array_to_string(list_transform({lst}, lambda x: lower(x)), ',')"


def t6_select(src: str, key: str, col: str = "text", extra: str = "") -> str:
    """T6 as nested selects: stage3, then e-mails/URLs found on stage3."""
    return (f"SELECT {key}, {lower_each(lower_each('s3', 'em'), 'ur')} AS text, {joined_lower('em')} AS emails, "
            f"{joined_lower('ur')} AS urls{extra} FROM (SELECT *, {emails('s3')} AS em, {urls('s3')} AS ur FROM "
            f"(SELECT *, {t3(t2(t1(col)))} AS s3 FROM {src}))")


# ------------------------------------------------------------------ fixture CTEs
FX = {
    "fx_lines": f"""fx_lines AS (SELECT doc_id, line, t AS text,
        ((doc_id * 7919 + line * 104729) % 1000)::DOUBLE / 1000.0 AS score
      FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS t
            FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM documents)))""",
    "fxl": """fxl AS (SELECT doc_id, line, text, doc_id % 6 AS shape,
        CASE WHEN doc_id % 6 IN (0, 3, 4, 5) AND (doc_id // 6) % 6 <> 5 AND score = 0 THEN 1.0 ELSE score END AS eff,
        CASE WHEN doc_id % 6 = 0 THEN 0 ELSE line // 4 END AS page
      FROM fx_lines WHERE doc_id % 97 <> 96)""",
    "surv": """surv AS (SELECT * FROM fxl WHERE eff >= 0.3 AND text <> '')""",
    "numbered": """numbered AS (SELECT doc_id, text, eff,
        CASE WHEN shape = 5 THEN row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 ELSE page END AS block_id,
        CASE WHEN shape = 5 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 END
          AS line_id, line, shape
      FROM surv)""",
    "assembled": f"""assembled AS (SELECT d.doc_id, coalesce(a.text, '') AS text, coalesce(a.n_blocks, 0) AS n_blocks,
        CASE WHEN d.doc_id % 97 = 96 THEN 'invalid payload' END AS reject, coalesce(a.joined, '') AS joined
      FROM documents d LEFT JOIN (SELECT doc_id, string_agg(text, {NL} ORDER BY block_id, line_id) AS text,
        string_agg(text, '|' ORDER BY block_id, line_id) AS joined, count(*) AS n_blocks FROM numbered GROUP BY doc_id) a USING (doc_id))""",
    "fx_receipts": """fx_receipts AS (SELECT o_orderkey AS doc_id, 'tanggal ' || strftime(o_orderdate, '%-d/%-m/%Y')
        || ' harga rp ' || regexp_replace(floor(o_totalprice)::BIGINT::VARCHAR, '(\\d)(\\d\\d\\d)$', '\\1.\\2')
        || ',56 bayar ke A' || o_custkey::VARCHAR || '@Mail.COM lihat https://X.com/' || o_orderkey::VARCHAR AS text
      FROM orders)""",
    "fx_lang": """fx_lang AS (SELECT o_orderkey AS k, CASE o_orderkey % 5
        WHEN 0 THEN 'Halo apa kabar kamu sedang di mana ' || o_orderpriority
        WHEN 1 THEN 'Please pay this invoice within seven days ' || o_orderpriority
        WHEN 2 THEN '   ' WHEN 3 THEN '12345' ELSE 'ku the ' || o_orderpriority END AS text FROM orders)""",
    "fx_langs": """fx_langs AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['auto'] WHEN 1 THEN ['id', 'en']
        WHEN 2 THEN ['ru'] WHEN 3 THEN ['ru', 'en'] ELSE []::VARCHAR[] END AS languages FROM documents)""",
    "fx_votes": """fx_votes AS (SELECT doc_id, r AS rank,
        ['en', 'id', 'ms', 'jv', 'fr'][((doc_id * 3 + r) % 5) + 1] AS code,
        ((doc_id * 37 + r * 11) % 100)::DOUBLE / 100.0 AS prob FROM documents, range(3) t(r))""",
    "inputs": """inputs AS (SELECT doc_id, text, sha256(text) AS key FROM documents)""",
    "fx_cache": """fx_cache AS (SELECT sha256(d.text) AS key, d.text, d.lang AS language,
        CASE WHEN l.quality = 0 THEN 'dummy' ELSE 'paddle' END AS engine_name,
        TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + d.doc_id * 60) AS created_at, d.doc_id AS origin_doc
      FROM documents d JOIN labels l USING (doc_id))""",
    "valid": """valid AS (SELECT key, arg_max(text, created_at) AS text, arg_max(language, created_at) AS language,
        arg_max(engine_name, created_at) AS engine_name FROM fx_cache
      WHERE NOT (engine_name = 'dummy' OR text = 'dummy-ocr-output') GROUP BY key)""",
    "fx_pages": """fx_pages AS (SELECT conv_id AS pdf, turn AS page_index,
        CASE WHEN role = 'user' THEN text ELSE '' END AS embedded_text,
        CASE WHEN role = 'system' OR turn = 2 THEN '' ELSE text END AS ocr_text FROM conversations)""",
    "fx_wer": """fx_wer AS (SELECT conv_id * 1000 + turn AS doc_id, ref, array_to_string(list_transform(list_filter(a, lambda t, i: i % 7 <> 0),
        lambda t: CASE WHEN length(t) > 6 THEN translate(t, 'oil', '011') ELSE t END), ' ') AS hyp
      FROM (SELECT conv_id, turn, ref, list_filter(regexp_split_to_array(ref, '\\s+'), lambda t: t <> '') AS a
        FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS ref FROM conversations)))""",
    "rates": """rates AS (SELECT doc_id, levenshtein(ref, hyp) / greatest(1, length(ref)) AS cer, e.r[len(e.r)] / greatest(1, len(e.a)) AS wer
      FROM fx_wer JOIN (WITH RECURSIVE dp AS (
          SELECT doc_id, a, b, 0 AS i, range(len(b) + 1) AS r
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(ref, '\\s+'), lambda t: t <> '') AS a,
            list_filter(regexp_split_to_array(hyp, '\\s+'), lambda t: t <> '') AS b FROM fx_wer)
          UNION ALL
          SELECT doc_id, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1,
            r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)), [i + 1::BIGINT])
          FROM dp WHERE i < len(a))
        SELECT doc_id, a, r FROM dp WHERE i = len(a)) e USING (doc_id))""",
    "fx_cer": """fx_cer AS (SELECT doc_id, ref, translate(ref, 'oil', '011') AS hyp
      FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS ref FROM documents))""",
    "fx_requests": """fx_requests AS (SELECT event_type AS endpoint, value / 100.0 AS seconds FROM events)""",
    "fx_attempts": """fx_attempts AS (SELECT doc_id, o AS ord,
        CASE WHEN (doc_id * 31 + o * 17) % 5 = 0 THEN text ELSE '' END AS text,
        ((doc_id + o) % 50)::DOUBLE AS ms FROM documents, range(4) t(o))""",
    "fx_boxes": """fx_boxes AS (SELECT l_orderkey AS image_id, l_linenumber AS box_no, l_linenumber * 10 AS x,
        l_partkey % 100 AS y, trunc(l_quantity)::INTEGER AS w, l_suppkey % 50 + 1 AS h FROM lineitem)""",
    "kept_boxes": """kept_boxes AS (SELECT image_id, box_no, x AS x1, y AS y1, x + w AS x2, y + h AS y2
      FROM fx_boxes WHERE w * h >= 500)""",
    "fx_dims": """fx_dims AS (SELECT p_partkey AS image_id, CASE WHEN p_size <= 45 THEN p_size * 10 END AS h,
        CASE WHEN p_size <= 45 THEN p_size * 7 END AS w FROM part)""",
    "sizes": """sizes AS (SELECT image_id, CASE WHEN w IS NOT NULL AND h IS NOT NULL AND w >= 0 AND h >= 0 THEN w ELSE 0 END
        AS width, CASE WHEN w IS NOT NULL AND h IS NOT NULL AND w >= 0 AND h >= 0 THEN h ELSE 0 END AS height
      FROM fx_dims)""",
    "fx_params": """fx_params AS (SELECT n_nationkey AS id,
        CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey * 10)::DOUBLE END AS det_limit_side_len,
        CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100.0 END AS det_db_thresh,
        CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey / 50.0 END AS text_det_db_thresh,
        CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey / 20.0 END AS text_det_thresh,
        CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) END AS rec_model_name,
        CASE WHEN n_nationkey % 7 = 0 THEN (n_nationkey * 5)::DOUBLE END AS text_det_limit_side_len FROM nation)""",
    "fx_sources": """fx_sources AS (SELECT doc_id AS id,
        CASE WHEN doc_id % 3 = 0 THEN 'https://files.example/' || source END AS source,
        CASE WHEN doc_id % 3 = 1 THEN '/in/' || source || '/' || doc_id::VARCHAR END AS path FROM documents)""",
    "fx_raster": """fx_raster AS (SELECT vec_id AS image_id, (p - 1) // 8 AS y, (p - 1) % 8 AS x,
        floor((e::DOUBLE + 1) * 127)::INTEGER AS v
      FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))""",
    "fx_rgb": """fx_rgb AS (SELECT image_id, (p - 1) // 12 AS y, ((p - 1) // 3) % 4 AS x, (p - 1) % 3 AS c,
        floor((e::DOUBLE + 1) * 127)::INTEGER AS v
      FROM (SELECT vec_id AS image_id, unnest(w) AS e, generate_subscripts(w, 1) AS p FROM (SELECT vec_id,
        list_concat(embedding, list_transform(range((3 - len(embedding) % 3) % 3), lambda i: (-1.0)::FLOAT)) AS w FROM embeddings)))""",
    "fx_theta": """fx_theta AS (SELECT vec_id AS image_id, p - 1 AS rank, (e::DOUBLE + 1) * 1.5 AS theta
      FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))""",
    "fx_paths": """fx_paths AS (SELECT '/in/' || source || '/' || doc_id::VARCHAR
        || ['.png', '.JPG', '.tif', '.pdf', '.txt', ''][doc_id % 6 + 1] AS path, n_chars * 1024 AS length FROM documents)""",
    "suffixed": """suffixed AS (SELECT path, length, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS sfx FROM fx_paths)""",
    "words": """words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)""",
    "lexwords": """lexwords AS (SELECT 'en' AS lang, word FROM words UNION ALL SELECT 'id', word FROM words WHERE item_id % 2 = 0
      UNION ALL SELECT 'id', word || word FROM words WHERE item_id % 2 = 0)""",
    "lexicon": """lexicon AS (SELECT word, count(*) AS freq FROM lexwords GROUP BY word)""",
    "fx_words": """fx_words AS (SELECT word, substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4)
        || 'x' AS tok FROM (SELECT DISTINCT word FROM lexwords))""",
}

# dependencies between fixture CTEs
DEPS = {
    "fxl": ["fx_lines"], "surv": ["fxl"], "numbered": ["surv"], "assembled": ["numbered"], "rates": ["fx_wer"],
    "lexwords": ["words"], "lexicon": ["lexwords"],
    "valid": ["fx_cache"], "kept_boxes": ["fx_boxes"], "sizes": ["fx_dims"], "fx_words": ["lexwords"], "suffixed": ["fx_paths"],
}


def with_fx(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(FX[n] for n in order) + "\n"


def dist2(a: str, b: str) -> str:
    """Edit class 0/1/2 of token ``a`` to lexicon word ``b`` (ASCII letters).

    DuckDB's ``damerau_levenshtein`` counts bytes; a non-ASCII character of
    the token can never equal a character of an ASCII word, so mapping each
    one to a single byte absent from words keeps the character distance."""
    m = f"regexp_replace({a}, '[^\\x00-\\x7F]', chr(1), 'g')"
    return (f"CASE WHEN {a} = {b} THEN 0 WHEN damerau_levenshtein({m}, {b}) <= 1 THEN 1 "
            f"WHEN damerau_levenshtein({m}, {b}) <= 2 THEN 2 END")


def spelled(src: str, key: str) -> str:
    """CTE list after ``lexicon``: ``spelled(key, text)`` of the rows (key, text) of ``src``."""
    return f""", toks AS (SELECT {key}, generate_subscripts(p, 1) AS pos, unnest(p) AS t FROM (SELECT {key},
        list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS p FROM {src})),
      unknown AS (SELECT DISTINCT lower(t) AS tok FROM toks WHERE NOT regexp_matches(lower(t), {q(NUMBER_TOKEN)})
        AND NOT regexp_matches(lower(t), {q(MARK_TOKEN)}) AND lower(t) NOT IN (SELECT word FROM lexicon)),
      cand AS (SELECT d.tok, l.word, l.freq, {dist2('d.tok', 'l.word')} AS dist
        FROM unknown d JOIN lexicon l ON abs(length(d.tok) - length(l.word)) <= 2),
      best AS (SELECT tok, arg_min(word, (dist, -freq, word)) AS fix FROM cand WHERE dist IS NOT NULL GROUP BY tok),
      fixed AS (SELECT {key}, string_agg(coalesce(b.fix, t), ' ' ORDER BY pos) AS text
        FROM toks LEFT JOIN best b ON b.tok = lower(t) GROUP BY {key}),
      spelled AS (SELECT s.* EXCLUDE (text), coalesce(f.text, '') AS text FROM {src} s LEFT JOIN fixed f USING ({key}))"""


BUCKETS_VALUES = ", ".join(f"({q(str(b))}, {b}::DOUBLE)" for b in DEFAULT_BUCKETS) + ", ('+Inf', NULL)"

METRICS_SQL = with_fx("fx_requests") + f""", b AS (SELECT * FROM (VALUES {BUCKETS_VALUES}) t(le, bound)),
tot AS (SELECT endpoint, count(*) AS n, sum(seconds) AS total FROM fx_requests GROUP BY endpoint),
cnt AS (SELECT r.endpoint, b.le, count(*) FILTER (WHERE b.bound IS NULL OR r.seconds <= b.bound) AS c
        FROM fx_requests r CROSS JOIN b GROUP BY r.endpoint, b.le)
SELECT endpoint, n::BIGINT AS count, round(total, 6) AS sum, le, c::BIGINT AS bucket_count
FROM cnt JOIN tot USING (endpoint)"""

GET_OR_SET = with_fx("inputs", "valid") + f"""
SELECT i.doc_id::BIGINT AS doc_id, i.key, coalesce(v.language, 'mix') AS language, length(i.text)::BIGINT AS text_chars, true AS from_cache
FROM inputs i JOIN valid v USING (key)
UNION ALL
SELECT i.doc_id::BIGINT, i.key, {heuristic('i.text')}, length(i.text)::BIGINT, false FROM inputs i ANTI JOIN valid v USING (key)"""

# the flagship chain: assembled text -> spelling -> language -> normalisation
RESPONSES = (with_fx("assembled", "lexicon") + spelled("assembled", "doc_id") + f""", lang AS (SELECT *, {heuristic('text')} AS language FROM spelled),
    done AS (""" + t6_select("lang", "doc_id, language, n_blocks, reject, joined") + ") ")

PIX = "image_id::BIGINT AS image_id, y::BIGINT AS y, x::BIGINT AS x"

ORACLE_SQL: dict[str, str] = {
    # ---------------------------------------------------------------- sources
    "scan_images": with_fx("suffixed") + """SELECT path, length::BIGINT AS length FROM suffixed
        WHERE sfx IN ('.jpg', '.jpeg', '.png', '.tiff', '.tif', '.webp')""",
    "scan_batch": with_fx("suffixed") + """SELECT path, length::BIGINT AS length FROM suffixed
        WHERE sfx IN ('.png', '.jpg', '.jpeg', '.tiff', '.webp') ORDER BY path LIMIT 100""",
    "scan_any": with_fx("fx_paths") + "SELECT path, length::BIGINT AS length FROM fx_paths ORDER BY path LIMIT 100",
    "size_guard": with_fx("fx_paths") + """SELECT path, length::BIGINT AS length, length <= 20 * 1024 * 1024 AS accepted,
        CASE WHEN length > 20 * 1024 * 1024 THEN 'File too large' END AS reason FROM fx_paths""",
    "page_table": with_fx("fx_pages") + """SELECT pdf::BIGINT AS pdf, page_index::BIGINT AS page_index, embedded_text
        FROM fx_pages""",
    "route_paths": with_fx("suffixed") + "SELECT path, CASE WHEN sfx = '.pdf' THEN 'pdf' ELSE 'image' END AS route FROM suffixed",
    "read_lexicon": with_fx("lexwords") + "SELECT lang, word, count(*)::BIGINT AS freq FROM lexwords GROUP BY lang, word",
    "read_eval_sets": with_fx("fx_wer") + "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_id, ref, hyp FROM fx_wer",
    "payload_rejects": "SELECT doc_id::BIGINT AS doc_id, 'invalid payload' AS reason FROM documents WHERE doc_id % 97 = 96",
    "scan_batch_all": with_fx("suffixed") + """SELECT path, length::BIGINT AS length FROM suffixed
        WHERE sfx IN ('.png', '.jpg', '.jpeg', '.tiff', '.webp')""",
    "read_engine_json": """SELECT doc_id::BIGINT AS doc_id,
        CASE WHEN doc_id % 97 = 96 THEN 'invalid' WHEN doc_id % 6 IN (0, 5) AND doc_id % 13 <> 5 THEN 'object' ELSE 'array' END AS top_kind
        FROM documents""",
    "source_label": with_fx("fx_sources") + "SELECT id::BIGINT AS id, coalesce(source, path, 'bytes') AS label FROM fx_sources",
    # ---------------------------------------------------------------- sinks / flagship
    "write_results": RESPONSES + "SELECT '/in/' || doc_id::VARCHAR AS path, text, language, n_blocks::BIGINT AS blocks_n, "
    "md5(joined) AS blocks_md5, 'replay' AS engine FROM done",
    "response_struct": RESPONSES + "SELECT doc_id::BIGINT AS doc_id, text, language, n_blocks::BIGINT AS blocks_n, emails, urls, "
    "'/in/' || doc_id::VARCHAR AS meta_path, reject FROM done",
    # ---------------------------------------------------------------- row level
    "min_confidence": with_fx("surv") + "SELECT doc_id::BIGINT AS doc_id, text, round(eff, 6) AS confidence FROM surv",
    "box_filter": with_fx("kept_boxes") + """SELECT image_id::BIGINT AS image_id, box_no::BIGINT AS box_no,
        x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM kept_boxes""",
    "image_size": with_fx("sizes") + """SELECT image_id::BIGINT AS image_id, width::BIGINT AS width,
        height::BIGINT AS height FROM sizes""",
    "alias_columns": with_fx("fx_params") + """SELECT id::BIGINT AS id,
        round(coalesce(text_det_limit_side_len, det_limit_side_len), 6) AS text_det_limit_side_len,
        round(coalesce(text_det_thresh, det_db_thresh, text_det_db_thresh), 6) AS text_det_thresh,
        rec_model_name AS text_recognition_model_name FROM fx_params""",
    "attach_meta": with_fx("fx_sources") + """SELECT id::BIGINT AS id, coalesce(source, path, 'bytes') AS label,
        'Handwriting recognition is experimental. Results may vary.' AS warnings, 'PP-OCRv5' AS ocr_version,
        CASE WHEN id % 4 <> 0 THEN (id % 1000)::VARCHAR || 'x' || (id % 1000 + 1)::VARCHAR ELSE '0x0' END AS image_size FROM fx_sources""",
    "text_stats": with_fx("assembled") + """SELECT doc_id::BIGINT AS doc_id, length(text)::BIGINT AS text_chars,
        n_blocks::BIGINT AS blocks, regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' AS empty_text FROM assembled""",
    "bgr_channels": """WITH px AS (SELECT vec_id AS image_id, [1, 3, 4, 2][vec_id % 4 + 1] AS nc, p - 1 AS p,
        floor((e::DOUBLE + 1) * 127)::INTEGER AS v
      FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))
    SELECT image_id::BIGINT AS image_id, 'ok' AS status,
        sum(CASE WHEN nc = 1 THEN 3 WHEN p % nc < 3 THEN 1 ELSE 0 END)::BIGINT AS n_values,
        sum(CASE WHEN nc = 1 THEN 3 * v WHEN p % nc < 3 THEN v ELSE 0 END)::BIGINT AS sum_v
    FROM px WHERE nc IN (1, 3, 4) GROUP BY image_id
    UNION ALL
    SELECT DISTINCT image_id::BIGINT, 'Unsupported channel count: ' || nc::VARCHAR, 0::BIGINT, 0::BIGINT
    FROM px WHERE nc NOT IN (1, 3, 4)""",
    # ---------------------------------------------------------------- flattening
    "normalise_pages": with_fx("fxl") + """SELECT doc_id::BIGINT AS doc_id, count(DISTINCT page)::BIGINT AS n_pages,
        count(*)::BIGINT AS n_entries FROM fxl WHERE shape <> 5 GROUP BY doc_id""",
    "parse_entry": with_fx("fxl") + """SELECT doc_id::BIGINT AS doc_id, page::BIGINT AS block,
        (CASE WHEN shape = 0 THEN line ELSE line % 4 END)::BIGINT AS pos, text, round(eff, 6) AS score
        FROM fxl WHERE shape <> 5""",
    "flatten_bbox": with_fx("numbered") + """SELECT doc_id::BIGINT AS doc_id, block_id::BIGINT AS block_id,
        line_id::BIGINT AS line_id, '0,' || line::VARCHAR || ',10,' || line::VARCHAR AS bbox FROM numbered""",
    "number_lines": with_fx("numbered") + """SELECT doc_id::BIGINT AS doc_id, block_id::BIGINT AS block_id,
        line_id::BIGINT AS line_id, text FROM numbered""",
    "collect_fallback": with_fx("numbered") + """SELECT doc_id::BIGINT AS doc_id, block_id::BIGINT AS block_id,
        line_id::BIGINT AS line_id, text FROM numbered WHERE shape = 5""",
    "assemble_text": with_fx("assembled") + "SELECT doc_id::BIGINT AS doc_id, text, n_blocks::BIGINT AS n_blocks, reject FROM assembled",
    # ---------------------------------------------------------------- joins
    "cache_hits": with_fx("inputs", "valid") + """SELECT i.doc_id::BIGINT AS doc_id, i.key,
        coalesce(v.language, 'mix') AS language, length(v.text)::BIGINT AS cached_chars FROM inputs i JOIN valid v USING (key)""",
    "cache_misses": with_fx("inputs", "valid") + """SELECT i.doc_id::BIGINT AS doc_id, i.key
        FROM inputs i ANTI JOIN valid v USING (key)""",
    "merge_page_text": with_fx("fx_pages") + f"""SELECT pdf::VARCHAR || '.pdf' AS source_pdf, page_index::BIGINT AS page_index, text,
        {heuristic('text')} AS language FROM (SELECT *, CASE WHEN embedded_text <> '' THEN embedded_text || {NL} || '--- OCR ---' || {NL}
        || ocr_text ELSE ocr_text END AS text FROM fx_pages)""",
    "merge_text_safe": with_fx("fx_pages") + f"""SELECT pdf::BIGINT AS pdf, page_index::BIGINT AS page_index,
        CASE WHEN embedded_text = '' THEN ocr_text WHEN ocr_text = '' THEN embedded_text
        ELSE embedded_text || {NL} || '--- OCR ---' || {NL} || ocr_text END AS text FROM fx_pages""",
    "pair_eval": with_fx("fx_cer") + """SELECT doc_id::BIGINT AS row_id, md5(ref) AS ref_md5, md5(hyp) AS hyp_md5 FROM fx_cer""",
    "wer": with_fx("rates") + "SELECT doc_id::BIGINT AS doc_id, round(wer, 6) AS wer FROM rates",
    "mean_cer_wer": with_fx("rates") + """SELECT round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer, count(*)::BIGINT AS n
        FROM rates""",
    "spell_candidates": with_fx("lexicon", "fx_words") + f"""SELECT tok, word, freq::BIGINT AS freq, dist::BIGINT AS dist FROM (
        SELECT t.tok, l.word, l.freq, {dist2('t.tok', 'l.word')} AS dist
        FROM (SELECT DISTINCT tok FROM fx_words) t JOIN lexicon l ON abs(length(t.tok) - length(l.word)) <= 2)
        WHERE dist IS NOT NULL""",
    # ---------------------------------------------------------------- aggregations
    "latency_report": with_fx("fx_requests") + """, s AS (SELECT endpoint, count(*) AS n, sum(seconds) AS total,
        list_sort(list(seconds)) AS a FROM fx_requests GROUP BY endpoint),
      j AS (SELECT *, least(greatest((19 * (n + 1)) // 20, 1), n - 1) AS j FROM s)
    SELECT endpoint, n::BIGINT AS count, round((a[(n + 1) // 2] + a[(n + 2) // 2]) / 2, 6) AS p50,
        round(CASE WHEN n = 1 THEN a[1] ELSE (a[j] * (20 - (19 * (n + 1) - 20 * j)) + a[j + 1] * (19 * (n + 1) - 20 * j)) / 20 END, 6)
        AS p95, round(n / total, 6) AS throughput FROM j""",
    "request_metrics": METRICS_SQL,
    "language_votes": with_fx("fx_votes") + f""", mapped AS (SELECT doc_id, rank, CASE code WHEN 'en' THEN 'en'
        WHEN 'eng' THEN 'en' WHEN 'id' THEN 'id' WHEN 'ind' THEN 'id' WHEN 'ms' THEN 'id' WHEN 'msa' THEN 'id'
        WHEN 'jv' THEN 'id' WHEN 'jw' THEN 'id' END AS m, prob FROM fx_votes),
      g AS (SELECT doc_id, CASE WHEN count(DISTINCT m) FILTER (WHERE prob >= 0.25) > 1 THEN 'mix'
        WHEN arg_min(prob, rank) >= 0.4 THEN arg_min(m, rank) ELSE 'mix' END AS voted
        FROM mapped WHERE m IS NOT NULL GROUP BY doc_id)
    SELECT d.doc_id::BIGINT AS doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'mix' ELSE coalesce(g.voted, {heuristic('d.text')}) END AS language,
        g.voted IS NOT NULL AND d.doc_id % 11 <> 0 AS from_detector FROM documents d LEFT JOIN g USING (doc_id)""",
    "table_summary": with_fx("kept_boxes") + """, c AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS cells FROM kept_boxes)
    SELECT image_id::BIGINT AS image_id, string_agg(x1::VARCHAR || ',' || y1::VARCHAR || ',' || x2::VARCHAR || ',' || y2::VARCHAR
        || '/' || cells::VARCHAR, ';' ORDER BY box_no, x1, y1, x2, y2) AS tables FROM c GROUP BY image_id""",
    "word_freq": with_fx("lexwords") + "SELECT lang, word, count(*)::BIGINT AS freq FROM lexwords GROUP BY lang, word",
    "skew_angle": with_fx("fx_theta") + """, a AS (SELECT image_id, theta * (180.0 / pi()) AS a FROM fx_theta WHERE rank < 20),
      m AS (SELECT image_id, quantile_cont(a - 90, 0.5) AS angle FROM a
            WHERE NOT ((a > 80 AND a < 100) OR (a > 260 AND a < 280)) GROUP BY image_id)
    SELECT i.image_id::BIGINT AS image_id, round(coalesce(m.angle, 0.0), 6) AS angle,
        abs(coalesce(m.angle, 0.0)) >= 0.1 AS rotate
    FROM (SELECT DISTINCT image_id FROM fx_theta) i LEFT JOIN m USING (image_id)""",
    "raster_stats": with_fx("fx_raster") + """SELECT image_id::BIGINT AS image_id, (max(y) + 1)::BIGINT AS height,
        (max(x) + 1)::BIGINT AS width, round(avg(v), 6) AS mean_v FROM fx_raster GROUP BY image_id""",
    "projection_score": with_fx("fx_raster") + """, r AS (SELECT image_id, y, sum(v) AS s FROM fx_raster GROUP BY image_id, y),
      p AS (SELECT image_id, count(*) AS n, sum(s) AS sx, sum(s * s) AS sxx FROM r GROUP BY image_id)
    SELECT image_id::BIGINT AS image_id, n::BIGINT AS rows, (n * sxx - sx * sx)::BIGINT AS score_n2,
        round((n * sxx - sx * sx)::DOUBLE / (n * n), 6) AS score FROM p""",
    # ---------------------------------------------------------------- windows / ordered selection
    "first_success": with_fx("fx_attempts") + """, g AS (SELECT doc_id, min(ord) FILTER (WHERE text <> '') AS w,
        max(ms) FILTER (WHERE ord = 0) AS ms0, max(text) FILTER (WHERE ord = 0) AS t0 FROM fx_attempts GROUP BY doc_id)
    SELECT g.doc_id::BIGINT AS doc_id, coalesce(g.w, 0)::BIGINT AS winner,
        length(coalesce(a.text, g.t0))::BIGINT AS text_chars,
        round(g.ms0 + CASE WHEN g.w IS NOT NULL AND g.w <> 0 THEN a.ms ELSE 0 END, 6) AS duration_ms
    FROM g LEFT JOIN fx_attempts a ON a.doc_id = g.doc_id AND a.ord = g.w""",
    "contrast_stretch": with_fx("fx_raster") + f""", st AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM fx_raster GROUP BY image_id)
    SELECT {PIX}, (CASE WHEN (hi - lo) < 1e-3 THEN v
        ELSE least(greatest(floor((v - lo)::DOUBLE / (hi - lo) * 255.0), 0), 255) END)::BIGINT AS v
    FROM fx_raster JOIN st USING (image_id)""",
    "mean_threshold": with_fx("fx_raster") + f""", st AS (SELECT image_id, avg(v) AS m FROM fx_raster GROUP BY image_id)
    SELECT {PIX}, (CASE WHEN v > m THEN 255 ELSE 0 END)::BIGINT AS v FROM fx_raster JOIN st USING (image_id)""",
    "best_rotation": with_fx("fx_raster") + """, r AS (SELECT image_id, y, sum(v)::HUGEINT AS s FROM fx_raster GROUP BY image_id, y),
      c AS (SELECT image_id, x, sum(v)::HUGEINT AS s FROM fx_raster GROUP BY image_id, x),
      pr AS (SELECT image_id, count(*)::HUGEINT AS n, sum(s) AS sx, sum(s * s) AS sxx FROM r GROUP BY image_id),
      pc AS (SELECT image_id, count(*)::HUGEINT AS n, sum(s) AS sx, sum(s * s) AS sxx FROM c GROUP BY image_id)
    SELECT pr.image_id::BIGINT AS image_id,
        (CASE WHEN (pr.n * pr.sxx - pr.sx * pr.sx) * pc.n * pc.n >= (pc.n * pc.sxx - pc.sx * pc.sx) * pr.n * pr.n
         THEN 0 ELSE 90 END)::BIGINT AS angle FROM pr JOIN pc USING (image_id)""",
    "upsert_union": with_fx("inputs", "valid") + """, old AS (SELECT key, arg_max(engine_name, created_at) AS engine_name, arg_max(origin_doc, created_at) AS doc_id FROM fx_cache
        WHERE NOT (engine_name = 'dummy' OR text = 'dummy-ocr-output') GROUP BY key),
      new AS (SELECT key, 'paddle' AS engine_name, min(doc_id) AS doc_id FROM inputs ANTI JOIN valid USING (key) GROUP BY key)
    SELECT key, engine_name, doc_id::BIGINT AS doc_id FROM old ANTI JOIN new USING (key)
    UNION ALL SELECT key, engine_name, doc_id::BIGINT FROM new""",
    "dedupe_content": with_fx("inputs") + """SELECT key, min(doc_id)::BIGINT AS first_doc, length(any_value(text))::BIGINT AS text_chars
        FROM inputs GROUP BY key""",
    # ---------------------------------------------------------------- scalar functions
    "norm_dates": with_fx("fx_receipts") + f"SELECT doc_id::BIGINT AS doc_id, {t1('text')} AS text FROM fx_receipts",
    "norm_numbers": with_fx("fx_receipts") + f"SELECT doc_id::BIGINT AS doc_id, {t2('text')} AS text FROM fx_receipts",
    "norm_currency": with_fx("fx_receipts") + f"SELECT doc_id::BIGINT AS doc_id, {t3('text')} AS text FROM fx_receipts",
    "extract_emails": with_fx("fx_receipts") + f"""SELECT doc_id::BIGINT AS doc_id, {joined_lower(emails('text'))} AS emails,
        {lower_each('text', emails('text'))} AS text FROM fx_receipts""",
    "extract_urls": with_fx("fx_receipts") + f"""SELECT doc_id::BIGINT AS doc_id, {joined_lower(urls('text'))} AS urls,
        {lower_each('text', urls('text'))} AS text FROM fx_receipts""",
    "normalize_text": with_fx("fx_receipts") + "SELECT doc_id::BIGINT AS doc_id, text, emails, urls FROM ("
    + t6_select("fx_receipts", "doc_id") + ")",
    "spell_correct": with_fx("lexicon") + ", conv AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
    + spelled("conv", "doc_id") + " SELECT doc_id::BIGINT AS doc_id, text FROM spelled",
    "language_heuristic": with_fx("fx_lang") + f"SELECT k::BIGINT AS k, {heuristic('text')} AS language FROM fx_lang",
    "resolve_engine_language": with_fx("fx_langs") + """, n AS (SELECT doc_id, languages,
        list_filter(list_transform(list_filter(languages, lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(lower(x))),
          lambda x: x NOT IN ('auto', 'detect', 'auto-detect', 'auto_detect')) AS f FROM fx_langs)
    SELECT doc_id::BIGINT AS doc_id, CASE WHEN languages IS NULL OR len(f) = 0 THEN 'en'
        WHEN len(list_distinct(f)) > 1 THEN CASE WHEN len(list_filter(list_distinct(f), lambda x: x NOT IN
          ('en', 'english', 'id', 'indonesian', 'latin', 'latin-script', 'mix'))) = 0 THEN 'en' ELSE 'multilingual' END
        ELSE CASE f[1] WHEN 'en' THEN 'en' WHEN 'english' THEN 'en' WHEN 'latin' THEN 'en' WHEN 'latin-script' THEN 'en'
          WHEN 'mix' THEN 'en' WHEN 'id' THEN 'en' WHEN 'indonesian' THEN 'en' WHEN 'multi' THEN 'multilingual'
          WHEN 'multilingual' THEN 'multilingual' WHEN 'ar' THEN 'arabic' WHEN 'arabic' THEN 'arabic'
          WHEN 'ru' THEN 'cyrillic' WHEN 'russian' THEN 'cyrillic' ELSE f[1] END END AS engine_language FROM n""",
    "primary_language": with_fx("fx_langs") + """SELECT doc_id::BIGINT AS doc_id, coalesce(languages[1], 'en') AS primary_language,
        array_to_string(languages, ',') AS languages_str FROM fx_langs""",
    "cer": with_fx("fx_cer") + """SELECT doc_id::BIGINT AS doc_id,
        round(levenshtein(ref, hyp) / greatest(1, length(ref)), 6) AS cer FROM fx_cer""",
    "content_key": "SELECT doc_id::BIGINT AS doc_id, sha256(text) AS key FROM documents",
    "grayscale": with_fx("fx_rgb") + f""", w AS (SELECT image_id, y, x, max(v) FILTER (WHERE c = 0) AS c0,
        max(v) FILTER (WHERE c = 1) AS c1, max(v) FILTER (WHERE c = 2) AS c2 FROM fx_rgb GROUP BY image_id, y, x)
    SELECT {PIX}, least(greatest(floor(0.0::FLOAT + c0::FLOAT * 0.114::FLOAT + c1::FLOAT * 0.587::FLOAT
        + c2::FLOAT * 0.299::FLOAT), 0), 255)::BIGINT AS v FROM w""",
    "invert": with_fx("fx_raster") + f"SELECT {PIX}, (255 - v)::BIGINT AS v FROM fx_raster",
    # ---------------------------------------------------------------- cache
    "cache_get_or_set": GET_OR_SET,
    "cache_upsert": with_fx("inputs", "fx_cache") + f""", fresh AS (SELECT key, min(text) AS text,
        min({heuristic('text')}) AS language, 'paddle' AS engine_name, TIMESTAMP '2030-01-01 00:00:00' AS created_at
        FROM inputs WHERE key NOT IN (SELECT key FROM fx_cache WHERE NOT (engine_name = 'dummy' OR text = 'dummy-ocr-output'))
        GROUP BY key),
      allrows AS (SELECT key, text, language, engine_name, created_at FROM fx_cache UNION ALL SELECT * FROM fresh)
    SELECT key, arg_max(language, created_at) AS language, arg_max(engine_name, created_at) AS engine_name,
        strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM allrows
    WHERE NOT (engine_name = 'dummy' OR text = 'dummy-ocr-output') GROUP BY key""",
    "cache_evict_dummy": with_fx("fx_cache") + """SELECT key, origin_doc::BIGINT AS origin_doc, engine_name FROM fx_cache
        WHERE NOT (engine_name = 'dummy' OR text = 'dummy-ocr-output')""",
    "warm_cache": with_fx("inputs", "valid") + """SELECT key, CASE WHEN e IS NULL THEN 'ok' ELSE 'failed' END AS status, e AS error FROM (
        SELECT DISTINCT i.key, CASE WHEN v.key IS NULL AND length(i.text) % 50 = 0 THEN 'unreadable' END AS e
        FROM inputs i LEFT JOIN valid v USING (key))""",
    "process_batch": "SELECT doc_id, key, language FROM (" + GET_OR_SET + ")",
    # ---------------------------------------------------------------- streaming
    "stream_ingest": "SELECT key, language, text FROM (" + t6_select(
        f"(SELECT DISTINCT sha256(text) AS key, {heuristic('text')} AS language, text AS t0 FROM documents)",
        "key, language", col="t0") + ")",
    "stream_metrics": METRICS_SQL,
    "windowed_metrics": """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS endpoint,
        count(*)::BIGINT AS count, round(sum(value / 100.0), 6) AS sum FROM events GROUP BY ALL""",
    "stream_windows": """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS endpoint,
        count(*)::BIGINT AS count, round(sum(value / 100.0), 6) AS sum FROM events
      WHERE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY ALL""",
    # ---------------------------------------------------------------- engines
    "run_engine": with_fx("fx_lines") + f"""SELECT d.doc_id::VARCHAR AS key, 'replay' AS engine_name,
        CASE WHEN d.doc_id % 97 <> 96 THEN length(coalesce(t.text, '')) END::BIGINT AS text_chars,
        CASE WHEN d.doc_id % 97 = 96 THEN 'ValueError: payload is no JSON' END AS error
      FROM documents d LEFT JOIN (SELECT doc_id, string_agg(text, {NL} ORDER BY line) AS text FROM fx_lines WHERE text <> '' GROUP BY doc_id) t
      USING (doc_id)""",
    "dummy_engine": with_fx("sizes") + """SELECT image_id::BIGINT AS image_id, 'dummy-ocr-output' AS text,
        '0,0,' || width::VARCHAR || ',' || height::VARCHAR AS bbox, 'id' AS language, 'cpu' AS device FROM sizes""",
}
