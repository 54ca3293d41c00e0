"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from promptweave.llm.mixing import ALPHA, EPOCHS, HEX_DIGITS, SEED

MIX_SQL = f"""
    WITH sizes AS (
        SELECT coalesce(source, '') AS source, sum(length(coalesce(text, ''))) AS chars
        FROM documents GROUP BY 1
    ), weighed AS (
        SELECT source, chars, pow(chars::DOUBLE, {ALPHA}) AS weight FROM sizes
    ), totals AS (
        SELECT sum(chars) AS all_chars, sum(weight) FILTER (chars > 0) AS all_weight FROM weighed
    ), rates AS (
        SELECT source,
               CASE WHEN chars > 0 THEN {EPOCHS} * all_chars * (weight / all_weight) / chars
                    ELSE {EPOCHS}::DOUBLE END AS rate
        FROM weighed, totals
    ), logs AS (
        SELECT source, rate, k,
               -rate + sum(CASE WHEN k > 0 THEN ln(rate) - ln(k) ELSE 0 END)
                   OVER (PARTITION BY source ORDER BY k) AS log_p
        FROM (SELECT *, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT) + 1)) AS k
              FROM rates WHERE rate > 0)
    ), steps AS (
        SELECT source, rate, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS step FROM logs
    ), drawn AS (
        SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {HEX_DIGITS}))::BIGINT
                  / {float(16**HEX_DIGITS)!r}::DOUBLE AS u
        FROM documents
    ), counted AS (
        SELECT d.doc_id, any_value(round(s.rate, 6)) AS rate, count(*) AS n
        FROM (SELECT DISTINCT doc_id, source, u FROM drawn) d
        JOIN steps s ON s.source = coalesce(d.source, '') AND s.step <= d.u
        GROUP BY d.doc_id
    )
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy, c.rate,
           md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy) AS mix_key
    FROM documents d
    JOIN (SELECT doc_id, rate, unnest(range(1, n + 1)) AS copy FROM counted) c ON d.doc_id = c.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE_SQL = f"""
    WITH items AS (
        SELECT item_id, w, least(len(w), 10) AS n
        FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
    ), windows AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
    ), lengths AS (
        SELECT DISTINCT n FROM windows
    ), docs AS (
        SELECT doc_id, {_WORDS} AS w FROM documents
    ), grams AS (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths)
    ), hits AS (
        SELECT g.doc_id, g.i, g.n, b.item_id FROM grams g JOIN windows b ON g.n = b.n AND g.gram = b.gram
    ), places AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits))
        GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

WARC_SQL = """
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
    ), largest AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload) AS original FROM payloads
    )
    SELECT page_id, strlen(payload) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(digest, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1), 1)), '')
               AS payload_digest,
           CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN original <> page_id THEN original END AS refers_to,
           true AS digest_holds
    FROM largest
"""

# Windows are read from the bytes' hexadecimal digits, two for each byte.
REPEATS_SQL = """
    WITH docs AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), windows AS (
        SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k
        FROM (SELECT *, unnest(range(0, length(h) // 2 - 399)) AS i FROM docs WHERE length(h) >= 800)
    ), repeated AS (
        SELECT k FROM windows GROUP BY k HAVING count(*) > 1
    ), starts AS (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p
        FROM windows WHERE k IN (SELECT k FROM repeated)
    ), grouped AS (
        SELECT doc_id, i,
               sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM starts
    ), spans AS (
        SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM grouped GROUP BY doc_id, g
    ), gaps AS (
        SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans
    ), cut AS (
        SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last,
               string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
        FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
    )
    SELECT d.doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
           coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
    FROM docs d LEFT JOIN cut USING (doc_id)
"""

# Every page of the test data has one article, of paragraphs below a heading.
_PLAIN = "regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_sign}')"
MAIN_TEXT_SQL = f"""
    WITH articles AS (
        SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS inside FROM pages
    ), texts AS (
        SELECT page_id, url, array_to_string(list_filter(list_transform(
                   regexp_split_to_array(inside, '</?(?:p|h1)>'),
                   lambda part: trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))), lambda t: t <> ''),
               chr(10) || chr(10)) AS text
        FROM articles
    )
    SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

#: Table of CRC-32, made from its polynomial, as a list ``tab.t``.
_CRC_TABLE = """
    crc_steps(i, c, k) AS (
        SELECT i, i, 0 FROM range(256) r(i)
        UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
    ), tab AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where ``tab`` is joined in."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({hexed}) + 1, 2), lambda i: ('0x' || substr({hexed}, i, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295)"


def _edit(letter: str, cost: str, then: str) -> str:
    """An edit at its cost, and what comes after it."""
    return f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a}}"


def _before_insertions(state: int, keeps: dict[str, int], put: int) -> str:
    more = "CASE WHEN cut THEN 3 ELSE 0 END"
    kept = " ".join(f"WHEN '{i}' THEN {_edit('K', more, f'f{to}')}" for i, to in keeps.items())
    options = f"[{_edit('D', '4', f'f{state}')}, CASE WHEN NOT gone THEN {_edit('R', f'3 + {more}', f'f{put}')} END, CASE WHEN NOT gone THEN CASE initial {kept} END END]"
    return f"list_min({options}) AS b{state}"


# States: 0 nothing read, 1 after s, 2 after u, 3 after a. Best repairs of what is left, from each.
REPAIR_SQL = f"""
    WITH RECURSIVE {_CRC_TABLE}, given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw
        FROM conversations, tab
    ), damaged AS (
        SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
               CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM given WHERE draw <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
               regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS seen, role[1] AS initial
        FROM damaged
    ), faults AS (
        SELECT *, seen = '' AS blank,
               seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
        FROM placed
    ), marked AS (
        SELECT *, blank OR again AS gone, NOT blank AND NOT again AND seen[-1] NOT IN ('.', '!', '?') AS cut FROM faults
    ), totals AS (
        SELECT conv_id, count(*) AS rows_left,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
               count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM marked GROUP BY conv_id
    ), togo(conv_id, pos, f0, f1, f2, f3) AS (
        SELECT conv_id, rows_left + 1, {{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}
        FROM totals
        UNION ALL
        SELECT conv_id, pos, list_min([b0, {_edit('I', '3', 'f2')}]), list_min([b1, {_edit('I', '3', 'f2')}]), f2,
               list_min([b3, {_edit('I', '3', 'b2')}])
        FROM (SELECT *, list_min([b2, {_edit('I', '3', 'b3')}]) AS f2 FROM (
            SELECT m.conv_id, m.pos,
                   {_before_insertions(0, dict(s=1, u=2), 2)}, {_before_insertions(1, dict(u=2), 2)},
                   {_before_insertions(2, dict(a=3), 3)}, {_before_insertions(3, dict(u=2), 2)}
            FROM togo JOIN marked m ON m.conv_id IS NOT DISTINCT FROM togo.conv_id AND m.pos = togo.pos - 1
        ))
    ), best AS (
        SELECT conv_id, f0.c AS cost, f0.a AS audit FROM togo WHERE pos = 1
    ), walk(conv_id, audit, done, pos, state, lines) AS (
        SELECT conv_id, audit, 0, 1, 0, []::VARCHAR[] FROM best
        UNION ALL
        SELECT w.conv_id, audit, done + 1, CASE edit WHEN 'I' THEN w.pos ELSE w.pos + 1 END,
               CASE WHEN edit = 'D' THEN state
                    WHEN edit = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
                    WHEN state = 2 THEN 3 ELSE 2 END,
               CASE edit WHEN 'D' THEN lines
                    WHEN 'K' THEN list_append(lines, role || ':' || text)
                    ELSE list_append(lines, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END
                                            || CASE edit WHEN 'I' THEN '' ELSE text END) END
        FROM (SELECT *, audit[done + 1] AS edit FROM walk WHERE done < length(audit)) w
        LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos
    ), ended AS (
        SELECT conv_id, array_to_string(lines, chr(10)) AS repaired FROM walk WHERE done = length(audit)
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SPELLING_SQL = f"""
    WITH RECURSIVE {_CRC_TABLE}, runs AS (
        SELECT owner, run, count(*) AS n FROM (
            SELECT coalesce(doc_id::VARCHAR, '') AS owner,
                   translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ) WHERE length(run) >= 7 GROUP BY ALL
    ), hashed AS (
        SELECT run, n, {_crc32("owner || ':' || run")} AS h FROM runs, tab
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                        ELSE run END AS word, n
            FROM hashed
        ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), lacking AS (
        SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), longer AS (
        SELECT DISTINCT l.word AS u, w.word AS v FROM lacking l JOIN words w ON w.word = l.rest
    ), near AS (
        SELECT a.word AS u, b.word AS v FROM lacking a JOIN lacking b USING (rest, i) WHERE a.word <> b.word
        UNION ALL SELECT u, v FROM longer
        UNION ALL SELECT v, u FROM longer
    ), counted AS (
        SELECT u, count(*) AS n_near, list_min(list({{'less': -w.n, 'word': v}})) AS best
        FROM near JOIN words w ON w.word = v GROUP BY u
    ), formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near,
               CASE WHEN -best.less >= 10 * n THEN best.word END AS form,
               CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
        FROM words LEFT JOIN counted ON u = word
    ), chains(word, root) AS (
        SELECT word, word FROM formed
        UNION ALL
        SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
    FROM formed f JOIN chains c ON c.word = f.word JOIN formed r ON r.word = c.root AND r.form IS NULL
"""

# Exact, where hashing may miss a pair.
VECTORS_SQL = """
    WITH RECURSIVE fit AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach(u, v) AS (
        SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
    ), counted AS (
        SELECT u, count(*) AS n FROM links GROUP BY u
    ), lowest AS (
        SELECT u, min(v) AS low FROM reach GROUP BY u
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, low) AS component_id,
           coalesce(vec_id = least(vec_id, low), false) AS kept
    FROM embeddings LEFT JOIN counted c ON c.u = vec_id LEFT JOIN lowest l ON l.u = vec_id
"""

ORACLES = {
    "op1_mix_sources": MIX_SQL,
    "op3_warc": WARC_SQL,
    "op5_repeats": REPEATS_SQL,
    "op7_main_text": MAIN_TEXT_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op11_conversation_repair": REPAIR_SQL,
    "op12_spelling_groups": SPELLING_SQL,
    "op13_vector_dedup": VECTORS_SQL,
}
