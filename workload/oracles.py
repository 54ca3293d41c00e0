"""DuckDB SQL for every registered query, over whole tables and whole texts.

Written from the definitions, not from the Spark code: words are counted one by
one, characters are unnested and grouped, norms are summed per row.
"""

from __future__ import annotations

from promptweave.config import LabelRules
from promptweave.functions.constants import (
    COMPLEX_KEYWORDS,
    ENGLISH_STOP_WORDS,
    PUNCTUATION,
    WHITESPACE,
)
from workload.battles import BATTLES_SQL


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


RULES = LabelRules()
WS = _text(WHITESPACE)
NOT_WS = (
    r"'[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
)
WON = "CASE WHEN winner = 'model_a' THEN model_a ELSE model_b END"


def _tier(model: str) -> str:
    whens = " ".join(f"WHEN {model} IN ({_list(t.models)}) THEN '{t.label}'" for t in RULES.tiers)
    return f"CASE {whens} END"


BATTLES = f"battles AS ({BATTLES_SQL})"
CLEANED = f"""{BATTLES},
cleaned AS (
    SELECT battle_id, trim(model_a, {WS}) AS model_a, trim(model_b, {WS}) AS model_b,
           winner, trim(user_prompt, {WS}) AS user_prompt
    FROM battles
    WHERE user_prompt IS NOT NULL AND trim(user_prompt, {WS}) <> ''
      AND winner IN ('model_a', 'model_b')
)"""
LABELED = f"""{CLEANED},
labeled AS (
    SELECT battle_id, {WON} AS winning_model, user_prompt, {_tier(WON)} AS "Target_Tier"
    FROM cleaned WHERE {_tier(WON)} IS NOT NULL
)"""
STORED = f"""{LABELED},
stored AS (
    SELECT row_number() OVER (ORDER BY battle_id) - 1 AS id, user_prompt, "Target_Tier"
    FROM labeled
)"""
# The same after three loads, one after the other.
LOADED = f"""{LABELED},
loaded AS (
    SELECT row_number() OVER (ORDER BY battle_id % 3, battle_id) - 1 AS id, user_prompt, "Target_Tier"
    FROM labeled
)"""
SHARES = """
    SELECT {col}, count(*) AS "count", count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct
    FROM {table} WHERE {col} IS NOT NULL GROUP BY {col}
"""
BAR = "repeat('█', trunc(pct / 2)::BIGINT) || repeat('░', 50 - trunc(pct / 2)::BIGINT)"


def _features(source: str, key: str, text: str) -> str:
    """CTE ``features`` with the eight measures of ``source``, unrounded."""
    syllables = (
        "[greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace("
        "lower(w), '[^a-z]', '', 'g'), 'e$', ''), '[aeiouy]+'))) for w in words]"
    )
    return f"""
split_text AS (
    SELECT {key}, {text} AS t, regexp_extract_all({text}, {NOT_WS}) AS words,
           regexp_extract_all(lower({text}), {NOT_WS}) AS lower_words
    FROM {source}
),
char_counts AS (
    SELECT {key}, ch, count(*) AS k
    FROM (SELECT {key}, unnest(regexp_extract_all(t, '(?s).')) AS ch FROM split_text)
    GROUP BY ALL
),
entropies AS (
    SELECT {key}, log2(sum(k)::DOUBLE) - sum(k * log2(k)) / sum(k)::DOUBLE AS char_entropy
    FROM char_counts GROUP BY ALL
),
features AS (
    SELECT {', '.join('s.' + k.strip() for k in key.split(','))},
           length(t) AS prompt_length,
           len(words) AS word_count,
           CASE WHEN len(words) = 0 THEN 0.0
                ELSE list_sum([length(w) for w in words])::DOUBLE / len(words)
           END AS avg_word_len,
           CASE WHEN len(words) = 0 THEN 0.0
                ELSE len(list_distinct(lower_words))::DOUBLE / len(words)
           END AS unique_word_ratio,
           CASE WHEN t = '' THEN 0.0
                ELSE (length(t) - length(translate(t, {_text(PUNCTUATION)}, '')))::DOUBLE / length(t)
           END AS punctuation_ratio,
           len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'),
               lambda w: w IN ({_list(COMPLEX_KEYWORDS)}))) AS complex_keyword_count,
           coalesce(char_entropy, 0.0) AS char_entropy,
           CASE WHEN len(words) = 0 THEN 0.0
                ELSE 206.835::DOUBLE
                     - 1.015::DOUBLE * len(words)
                       / greatest(1, len(regexp_extract_all(t, '[.!?]+')))
                     - 84.6::DOUBLE * list_sum({syllables})::DOUBLE / len(words)
           END AS flesch_reading_ease
    FROM split_text s LEFT JOIN entropies e USING ({key})
)"""


WHOLE_NUMBERS = ("prompt_length", "word_count", "complex_keyword_count")
FEATURES = (
    "prompt_length", "word_count", "avg_word_len", "unique_word_ratio",
    "punctuation_ratio", "complex_keyword_count", "char_entropy", "flesch_reading_ease",
)


def _shown(names=FEATURES) -> str:
    return ", ".join(
        f"{n}::BIGINT AS {n}" if n in WHOLE_NUMBERS else f"round({n}::DOUBLE, 6) AS {n}"
        for n in names
    )


def _feature_query(source: str, key: str, text: str, names=FEATURES) -> str:
    return f"WITH {_features(source, key, text)} SELECT {key}, {_shown(names)} FROM features"


def _describe(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS "count",
                   round_even(avg({c}::DOUBLE), 2) AS mean,
                   round_even(stddev_samp({c}::DOUBLE), 2) AS std,
                   round_even(min({c}::DOUBLE), 2) AS "min",
                   round_even(quantile_cont({c}::DOUBLE, 0.25), 2) AS p25,
                   round_even(quantile_cont({c}::DOUBLE, 0.50), 2) AS p50,
                   round_even(quantile_cont({c}::DOUBLE, 0.75), 2) AS p75,
                   round_even(max({c}::DOUBLE), 2) AS "max"
            FROM {source}"""
        for c in columns
    )


TOKENS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _terms(source: str, key: str, text: str) -> str:
    """CTEs ``worded`` (content words) and ``termed`` (with bigrams) of ``source``."""
    return f"""
worded AS (
    SELECT {key}, list_filter({TOKENS.format(text=text)},
                              lambda w: w NOT IN ({_list(ENGLISH_STOP_WORDS)})) AS ws
    FROM {source}
),
termed AS (
    SELECT {key}, list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS terms
    FROM worded
)"""


def _vocabulary(source: str, key: str, text: str) -> str:
    return f"""{_terms(source, key, text)},
pairs AS (
    SELECT {key}, term, count(*) AS n
    FROM (SELECT {key}, unnest(terms) AS term FROM termed) GROUP BY ALL
),
vocabulary AS (
    SELECT term, sum(n)::BIGINT AS tf, count(*) AS df,
           ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + count(*))) + 1 AS idf
    FROM pairs GROUP BY term ORDER BY tf DESC, term LIMIT 1000
),
weighted AS (SELECT {key}, term, n * idf AS w FROM pairs JOIN vocabulary USING (term)),
cells AS (
    SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM weighted
)"""


DOC_VOCABULARY = _vocabulary("documents", "doc_id", "text")
CELLS = f"WITH {DOC_VOCABULARY} SELECT doc_id, term, round(weight, 6) AS weight FROM cells"
INDEXED = "SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, tf, df FROM vocabulary"

ORACLES: dict[str, str] = {
    "tier_summary": f"""
        WITH {LABELED}
        SELECT "Target_Tier", count(*) AS prompt_count,
               round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
        FROM labeled GROUP BY "Target_Tier" """,
    "first_prompt": """
        SELECT conv_id, coalesce(text, '') AS user_prompt
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
              FROM conversations)
        WHERE rn = 1""",
    "collected_prompts": """
        SELECT doc_id AS battle_id,
               CASE WHEN doc_id % 10 IN (3, 4) THEN '' ELSE coalesce(text, '') END AS user_prompt
        FROM documents""",
    "collect_job_columns": f"""
        WITH {BATTLES}
        SELECT b.battle_id, 'q' || battle_id AS question_id, lang AS language, 'train' AS split,
               model_a, model_b, winner,
               CASE battle_id % 10 WHEN 3 THEN 0 WHEN 4 THEN -1 ELSE 2 END::BIGINT AS conversation_a,
               CASE WHEN battle_id % 10 IN (3, 4) THEN '' ELSE coalesce(text, '') END AS user_prompt
        FROM battles b JOIN documents d ON b.battle_id = d.doc_id WHERE battle_id % 5 <> 0""",
    "collect_job_csv": """
        SELECT 'q' || doc_id AS question_id, lang AS language, 'train' AS split,
               CASE WHEN doc_id % 10 IN (3, 4) THEN NULL ELSE nullif(text, '') END AS user_prompt,
               CASE WHEN doc_id % 10 IN (3, 4) THEN NULL ELSE text END AS opening,
               CASE WHEN doc_id % 10 IN (3, 4) THEN NULL ELSE 'assistant' END AS second_role
        FROM documents WHERE doc_id % 5 <> 0""",
    "custom_rules": f"""
        WITH {BATTLES},
        kept AS (
            SELECT battle_id, trim(user_prompt, {WS}) AS user_prompt, trim(model_a, {WS}) AS won
            FROM battles WHERE winner = 'model_a' AND trim(user_prompt, {WS}) <> ''
        )
        SELECT row_number() OVER (ORDER BY battle_id) - 1 AS id, user_prompt,
               CASE WHEN won = 'gpt-4' THEN 'Large' ELSE 'Small' END AS "Target_Tier"
        FROM kept WHERE won IN ('koala-13b', 'llama-13b', 'gpt-4')""",
    "drop_null_prompt": f"WITH {BATTLES} SELECT * FROM battles WHERE user_prompt IS NOT NULL",
    "drop_blank_prompt": f"WITH {BATTLES} SELECT * FROM battles WHERE trim(user_prompt, {WS}) <> ''",
    "decisive_only": f"WITH {BATTLES} SELECT * FROM battles WHERE winner IN ('model_a', 'model_b')",
    "strip_text": f"""
        WITH {BATTLES}
        SELECT battle_id, trim(model_a, {WS}) AS model_a, trim(model_b, {WS}) AS model_b,
               trim(winner, {WS}) AS winner, trim(user_prompt, {WS}) AS user_prompt
        FROM battles""",
    "winning_model": f"WITH {CLEANED} SELECT battle_id, {WON} AS winning_model FROM cleaned",
    "assign_tier": f"""
        WITH {CLEANED}
        SELECT battle_id, {WON} AS winning_model, {_tier(WON)} AS "Target_Tier" FROM cleaned""",
    "tier_lookup": f"""WITH {LABELED} SELECT battle_id, winning_model, "Target_Tier" FROM labeled""",
    "labeled_prompts": f"""WITH {LABELED} SELECT user_prompt, "Target_Tier" FROM labeled""",
    "drop_audit": f"""
        WITH {BATTLES},
        ruled AS (
            SELECT CASE
                WHEN user_prompt IS NULL THEN 1
                WHEN trim(user_prompt, {WS}) = '' THEN 2
                WHEN winner IS NULL OR winner NOT IN ('model_a', 'model_b') THEN 3
                WHEN {_tier(f"trim({WON}, {WS})")} IS NULL THEN 4
                ELSE 0 END AS failed
            FROM battles
        ),
        rules(rule, reason) AS (
            VALUES (1, 'null_prompt'), (2, 'blank_prompt'),
                   (3, 'no_decisive_winner'), (4, 'unlisted_model')
        ),
        steps AS (
            SELECT rule, reason,
                   (SELECT count(*) FROM ruled WHERE failed = 0 OR failed >= rule) AS rows_before,
                   (SELECT count(*) FROM ruled WHERE failed = rule) AS dropped
            FROM rules
        )
        SELECT rule::BIGINT AS rule, reason, rows_before, dropped,
               round(coalesce(dropped * 100.0::DOUBLE / nullif(rows_before, 0), 0), 6) AS dropped_pct,
               rows_before - dropped AS remaining
        FROM steps""",
    "winner_counts": f"""
        WITH {BATTLES}
        SELECT winner, count(*) AS "count" FROM battles WHERE winner IS NOT NULL GROUP BY winner""",
    "segment_counts": """
        SELECT c_mktsegment, count(*) AS "count" FROM customer
        WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
    "model_coverage": f"""
        WITH {LABELED}
        SELECT winning_model, "Target_Tier", count(*) AS "count" FROM labeled GROUP BY ALL""",
    "tier_report": f"""
        WITH {LABELED}, shares AS ({SHARES.format(col='"Target_Tier"', table='labeled')})
        SELECT "Target_Tier", "count", round(pct, 6) AS pct, {BAR} AS bar FROM shares""",
    "percent_bar": f"""
        WITH shares AS ({SHARES.format(col='event_type', table='events')})
        SELECT event_type, {BAR} AS bar FROM shares""",
    "imbalance": f"""
        WITH {LABELED}, tiers AS (SELECT count(*) AS n FROM labeled GROUP BY "Target_Tier")
        SELECT round(max(n)::DOUBLE / min(n), 6) AS ratio,
               coalesce(max(n)::DOUBLE / min(n) > 1.5, false) AS imbalanced
        FROM tiers""",
    "dense_id": f"""
        WITH {LABELED}
        SELECT row_number() OVER (ORDER BY battle_id) - 1 AS id, battle_id, "Target_Tier"
        FROM labeled""",
    "dense_id_text_key": """
        SELECT row_number() OVER (ORDER BY source || '/' || doc_id) - 1 AS id,
               source || '/' || doc_id AS k, length(text) AS chars
        FROM documents""",
    "dense_id_lineitem": """
        SELECT l_orderkey, count(*) AS n, min(id) AS "first", max(id) AS "last"
        FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS id FROM lineitem)
        GROUP BY l_orderkey""",
    "fetch_all": f"WITH {STORED} SELECT * FROM stored WHERE user_prompt IS NOT NULL",
    "fetch_tier": f"""
        WITH {STORED}
        SELECT * FROM stored WHERE user_prompt IS NOT NULL AND "Target_Tier" = 'Tier_2_API'""",
    "fetch_head": f"""
        WITH {STORED}
        SELECT id, "Target_Tier", substring(user_prompt, 1, 80) || '...' AS preview
        FROM stored ORDER BY id LIMIT 10""",
    "stored_summary": f"""
        WITH {STORED}
        SELECT "Target_Tier", count(*) AS prompt_count,
               round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
        FROM stored GROUP BY "Target_Tier" """,
    "append_load": f"""
        WITH {STORED}
        SELECT id, "Target_Tier" FROM stored
        UNION ALL
        SELECT id + (SELECT count(*) FROM stored), "Target_Tier" FROM stored""",
    "store_loads": f"WITH {LOADED} SELECT * FROM loaded",
    "store_head": f"""
        WITH {LOADED}
        SELECT id, substring(user_prompt, 1, 80) || '...' AS preview
        FROM loaded WHERE "Target_Tier" = 'Tier_2_API' ORDER BY id LIMIT 50""",
    "store_range": f"WITH {LOADED} SELECT * FROM loaded WHERE id BETWEEN 90 AND 310",
    "stream_store": f"""
        WITH {LABELED} SELECT user_prompt, "Target_Tier", count(*) AS n FROM labeled GROUP BY ALL""",
    "preview": "SELECT doc_id, substring(text, 1, 80) || '...' AS preview FROM documents",
    "documents_tier": f"""
        WITH {STORED}
        SELECT id AS doc_id, user_prompt, "Target_Tier"
        FROM (SELECT * FROM stored ORDER BY id LIMIT 100) WHERE "Target_Tier" = 'Tier_2_API'""",
    "documents_all": f"""
        WITH {STORED} SELECT id AS doc_id, user_prompt, "Target_Tier" FROM stored""",
    "json_array_file": f"""
        WITH {STORED} SELECT id AS doc_id, user_prompt, "Target_Tier" FROM stored""",
    "csv_roundtrip": f"""WITH {LABELED} SELECT battle_id, user_prompt, "Target_Tier" FROM labeled""",
    "csv_na_words": f"""
        WITH {BATTLES}
        SELECT battle_id, nullif(model_a, 'gpt-4') AS model_a, nullif(model_b, 'gpt-4') AS model_b,
               nullif(winner, 'tie') AS winner
        FROM battles""",
    "csv_one_file": "SELECT page_id, url, html FROM pages",
    "csv_file_order": "SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS id, doc_id, length(text) AS chars FROM documents",
    "csv_pages": "SELECT page_id, url, html FROM pages",
    **{name: _feature_query("documents", "doc_id", "text", (name,)) for name in FEATURES},
    "keyword_hits": f"""
        WITH put AS (
            SELECT doc_id, text, (list_value({_list(COMPLEX_KEYWORDS)}))[doc_id % {len(COMPLEX_KEYWORDS)} + 1] AS k
            FROM documents
        )
        SELECT doc_id, len(list_filter(
                   regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
                   lambda w: w IN ({_list(COMPLEX_KEYWORDS)}))) + 3 AS hits
        FROM put""",
    "common_word_count": """
        SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'),
            lambda w: w IN ('the', 'and', 'with', 'die', 'und', 'les', 'que', 'tion'))) AS hits
        FROM documents""",
    "text_features": _feature_query("documents", "doc_id", "text"),
    "page_features": _feature_query("pages", "page_id", "html"),
    "conversation_features": _feature_query("conversations", "conv_id, turn", "text"),
    "feature_describe": f"""
        WITH {_features("documents", "doc_id", "text")} {_describe("features", FEATURES)}""",
    "lineitem_describe": _describe(
        "lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "tokens": f"""
        SELECT doc_id, array_to_string({TOKENS.format(text='text')}, '|') AS tokens FROM documents""",
    "content_words": f"""
        WITH {_terms("documents", "doc_id", "text")}
        SELECT doc_id, array_to_string(ws, '|') AS words FROM worded""",
    "ngrams": f"""
        WITH {_terms("documents", "doc_id", "text")}
        SELECT doc_id, array_to_string(terms, '|') AS terms FROM termed""",
    "vocab_top": f"WITH {DOC_VOCABULARY} {INDEXED}",
    "idf_table": f"WITH {DOC_VOCABULARY} SELECT term, df, round(idf, 6) AS idf FROM vocabulary",
    "vocab_refit": f"WITH {DOC_VOCABULARY} SELECT term, tf, df, round(idf, 6) AS idf FROM vocabulary",
    "benchmark_vocab": f"WITH {_vocabulary('benchmark', 'item_id', 'text')} {INDEXED}",
    "tfidf_long": CELLS,
    "tfidf_reloaded": CELLS,
    "tfidf_sparsity": f"""
        WITH {DOC_VOCABULARY}, sizes AS (
            SELECT (SELECT count(*) FROM documents) AS "rows",
                   (SELECT count(*) FROM cells) AS nonzero,
                   (SELECT count(*) FROM vocabulary) AS width
        )
        SELECT "rows", nonzero, round(1 - nonzero::DOUBLE / ("rows" * width), 6) AS sparsity
        FROM sizes""",
    "tfidf_wide_totals": f"""
        WITH {DOC_VOCABULARY}
        SELECT 'tfidf_' || term AS feature, round(sum(weight), 4) AS total
        FROM cells GROUP BY term""",
    "feature_csv": f"""
        WITH {STORED}, {_features("stored", "id", "user_prompt")},
        {_vocabulary("stored", "id", "user_prompt")},
        sums AS (SELECT id, sum(weight) AS total FROM cells GROUP BY id)
        SELECT prompt_length::BIGINT AS prompt_length, word_count::BIGINT AS word_count,
               round(char_entropy, 6) AS char_entropy, round(coalesce(total, 0), 6) AS tfidf_sum, "Target_Tier"
        FROM features f JOIN stored USING (id) LEFT JOIN sums USING (id)""",
    "feature_matrix": f"""
        WITH {STORED}, {_features("stored", "id", "user_prompt")},
        {_vocabulary("stored", "id", "user_prompt")},
        shape AS (
            SELECT id, count(*) AS nonzero, sum(weight) AS total, sqrt(sum(weight * weight)) AS norm
            FROM cells GROUP BY id
        )
        SELECT f.id, {_shown()},
               coalesce(nonzero, 0) AS tfidf_nonzero,
               round(coalesce(total, 0), 6) AS tfidf_sum,
               round(coalesce(norm, 0), 6) AS tfidf_norm,
               "Target_Tier"
        FROM features f JOIN stored USING (id) LEFT JOIN shape USING (id)""",
    "class_report": """
        WITH ruled AS (
            SELECT lang AS label, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de'
                                       ELSE 'other' END AS guess
            FROM documents WHERE ('0x' || substr(md5(coalesce(text, '')), 1, 4))::BIGINT % 10 < 2
        ), labels_seen AS (
            SELECT label FROM ruled UNION SELECT guess FROM ruled
        ), counts AS (
            SELECT l.label, (SELECT count(*) FROM ruled r WHERE r.label = l.label) AS "rows",
                   (SELECT count(*) FROM ruled r WHERE r.guess = l.label) AS predicted,
                   (SELECT count(*) FROM ruled r WHERE r.label = l.label AND r.guess = l.label) AS hits
            FROM labels_seen l
        )
        SELECT *, round(hits / nullif(predicted, 0), 6) AS "precision", round(hits / nullif("rows", 0), 6) AS recall,
               round(2.0::DOUBLE * hits / ("rows" + predicted), 6) AS f1
        FROM counts""",
    "feature_report": f"""
        WITH {STORED}, {_vocabulary("stored", "id", "user_prompt")},
        width AS (SELECT count(*) AS n FROM vocabulary)
        SELECT 'input_rows' AS metric, count(*) AS "value", NULL::DOUBLE AS pct FROM stored
        UNION ALL SELECT 'statistical_features', 5, NULL
        UNION ALL SELECT 'semantic_features', 3, NULL
        UNION ALL SELECT 'tfidf_features', n, NULL FROM width
        UNION ALL SELECT 'total_feature_columns', 8 + n, NULL FROM width
        UNION ALL
        SELECT 'tier:' || "Target_Tier", count(*),
               round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stored), 6)
        FROM stored GROUP BY "Target_Tier" """,
}

# The audit does not depend on what counts it.
ORACLES["label_job_audit"] = ORACLES["stream_audit"] = ORACLES["drop_audit"]
