"""Personal data, and the terms that give it away, with built-in functions only.

Entities (mail and IP addresses, card and phone numbers) are found by pattern.
Terms are the words of the same document. From counts over the whole corpus the
share of an entity's information that a term discloses is the mutual information
of the two, ln(p(t,e) / (p(t) p(e))), over the information of the entity,
-ln p(e), with p(x) the share of documents. Terms above a threshold are
generalised wherever they stand in a document with the entity, those that occur
nowhere else are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweave.llm.common import join_checked, stored

# Kinds in the order in which spans at one place are listed, and their patterns. Groups
# repeat possessively and a match starts at the start of its run, which finds the same and stays linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
DISCLOSURE = 0.9
SHORTEST_NUMBER = 10
FREQUENT_TERMS = 100_000
TERM = r"(?<![\p{L}\p{N}_%+@.-])\p{L}++(?!\.?[\p{L}\p{N}_%+@-])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn() -> str:
    """True if the check sum of ``digits`` is a multiple of ten."""
    digits = "transform(split(reverse(digits), ''), d -> coalesce(TRY_CAST(d AS INT), 0))"
    each = f"transform({digits}, (d, n) -> IF(n % 2 = 1, 2 * d - IF(d > 4, 9, 0), d))"
    return f"aggregate({each}, 0, (a, d) -> a + d) % 10 = 0"


def _is_valid() -> Column:
    n = F.length("digits")
    parts = F.expr(
        "forall(split(value, r'\\.'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND CAST(concat('0', right(p, 3)) AS INT) <= 255)"
    )
    return (
        F.when(F.col("kind") == "ip", parts)
        .when(F.col("kind") == "card", n.between(14, 19) & F.expr(_luhn()))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _spaced(pattern: str) -> str:
    """Matches of a pattern in ``text`` as structs of gap, the distance from the match before, and value.

    Splitting a text by a pattern gives what lies between the very matches that
    extracting it gives, so lengths make places.
    """
    each = "zip_with(slice(ps, 1, size(ms)), ms, (p, m) -> named_struct('gap', length(p), 'value', m))"
    return (
        f"transform(array(regexp_extract_all(text, r'{pattern}', 0)), ms -> IF(size(ms) = 0, NULL, "
        f"transform(array(split(text, r'{pattern}', -1)), ps -> {each})[0]))[0]"
    )


def _matches(kind: str, rank: int) -> str:
    """Matches of the pattern of a kind."""
    need = {"email": "contains(text, '@')", "phone": "contains(text, '+')"}.get(kind, "text rlike '[0-9]'")
    found = (
        f"transform({_spaced(PATTERNS[kind])}, m -> "
        f"named_struct('kind', '{kind}', 'rank', {rank}, 'gap', m.gap, 'value', m.value))"
    )
    return f"IF({need}, {found}, NULL)"  # a null text has no match


def _entity() -> Column:
    return F.concat(
        F.col("kind"), F.lit(":"), F.when(F.col("kind").isin("card", "phone"), F.col("digits")).otherwise(F.lower("value"))
    )


def scan(docs: DataFrame, *columns: str) -> DataFrame:
    """Matches of each text as an array, with a key per row; stored, as the key must not change.

    ``_text`` is the text where a match may be valid, else null.
    """
    found = [F.expr(_matches(kind, rank)) for rank, kind in enumerate(PATTERNS)]
    listed = F.flatten(F.array_compact(F.array(*found)))
    keyed = docs.select(F.monotonically_increasing_id().alias("_key"), *dict.fromkeys([*columns, "text"]), listed.alias("_found"))
    long = f"exists(_found, m -> m.kind IN ('email', 'ip') OR length(m.value) >= {SHORTEST_NUMBER})"
    text = F.expr(f"IF({long}, text, NULL)").alias("_text")
    return stored(keyed.select("_key", *columns, text, "_found"))


def base_matches(scanned: DataFrame) -> DataFrame:
    """Valid matches, one row each: ``_key, kind, rank, start, end, entity``.

    Starts are running sums over the matches of one text and kind, in code points.
    """
    rows = scanned.select("_key", F.posexplode("_found").alias("_n", "m"))
    along = Window.partitionBy("_key", "m.kind").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("m.gap") + F.length("m.value")).over(along))
    valid = placed.select(
        "_key", "m.*", (F.col("end") - F.length("m.value")).alias("start"), "end", _digits(F.col("m.value")).alias("digits")
    ).where(_is_valid())
    return valid.select("_key", "kind", "rank", "start", "end", _entity().alias("entity"))


_TERMS = f"array_distinct(transform(regexp_extract_all(text, r'{TERM}', 0), w -> lower(w)))"
# Entities of the very same documents: how many, and two hashes over their keys.
_CLASS = ["n_entity", "_x", "_y"]


def entity_classes(matches: DataFrame) -> DataFrame:
    """``(_key, classes)``: the classes of the entities of each document with any.

    Entities that the same documents hold have equal counts with every term, so
    they are one class; all values that one document alone holds are.
    """
    held = matches.select("_key", "entity").distinct()
    classes = held.groupBy("entity").agg(
        F.count("*").alias("n_entity"),
        F.bit_xor(F.xxhash64("_key")).alias("_x"),
        F.bit_xor(F.xxhash64("_key", F.lit(1))).alias("_y"),
    )
    return held.join(classes, "entity").groupBy("_key").agg(F.collect_set(F.struct(*_CLASS)).alias("classes"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``(_key, term, disclosure)`` of the terms of a document that disclose an entity of it.

    ``texts`` has ``_key, text, classes`` of the documents with entities. Counts
    run over all documents: those with both, with the entity, and with the term.
    A pair is counted unless the term alone is so frequent that no joint count
    can reach the threshold; the frequent terms are at most ``FREQUENT_TERMS``,
    as each holds more than that share of all counts.
    """
    total = docs.count()
    frequency = stored(docs.select(F.explode(F.expr(_TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    mass = frequency.agg(F.sum("n_term")).first()[0] or 0
    frequent = F.broadcast(frequency.where(F.col("n_term") > mass / FREQUENT_TERMS).withColumnRenamed("n_term", "_n"))
    most = F.col("n_entity") * F.pow(F.lit(float(max(total, 1))) / F.col("n_entity"), F.lit(1 - threshold)) * (1 + 1e-9)
    held = stored(
        texts.select("_key", "classes", F.explode(F.expr(_TERMS)).alias("term"))
        .join(frequent, "term", "left")
        .select("_key", "term", "_n", F.inline("classes"))
        .where(F.col("_n").isNull() | (F.col("_n") <= most))
        .drop("_n")
    )
    pairs = held.groupBy(*_CLASS, "term").agg(F.count("*").alias("n_both")).join(frequency, "term")
    mutual = F.ln(F.lit(float(total)) * F.col("n_both") / F.col("n_entity") / F.col("n_term"))
    own = F.ln(F.lit(float(total)) / F.col("n_entity"))
    disclosure = F.when(own > 0, mutual / own)
    flagged = stored(pairs.withColumn("disclosure", disclosure).where(disclosure >= threshold).drop("n_both", "n_term"))
    own_terms = join_checked(held, flagged, [*_CLASS, "term"], "inner")
    return own_terms.groupBy("_key", "term").agg(F.max("disclosure").alias("disclosure"))


def term_places(texts: DataFrame) -> DataFrame:
    """All terms of texts with their places: ``_key, term, start, end``."""
    rows = texts.select("_key", F.posexplode(F.expr(_spaced(TERM))).alias("_n", "m")).select(
        "_key", "_n", "m.gap", F.length("m.value").alias("_size"), F.lower("m.value").alias("term")
    )
    along = Window.partitionBy("_key").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("_size")).over(along))
    return placed.select("_key", "term", (F.col("end") - F.col("_size")).alias("start"), "end")


def sensitive_spans(scanned: DataFrame, docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """Spans of each document that has any: ``_key`` and ``spans``, sorted ``(start, rank, kind, end, disclosure)``.

    ``scanned`` is the ``scan`` of ``docs``. A term is listed wherever it
    stands, with its largest disclosure.
    """
    matches = stored(base_matches(scanned))
    texts = scanned.select("_key", F.col("_text").alias("text")).join(stored(entity_classes(matches)), "_key")
    found = stored(disclosing_terms(docs, texts, threshold))
    terms = term_places(texts.join(found.select("_key").distinct(), "_key", "left_semi")).join(found, ["_key", "term"])
    terms = terms.withColumns({"kind": F.lit("term"), "rank": F.lit(len(PATTERNS))})
    columns = ["_key", "start", "rank", "kind", "end", "disclosure"]
    base = matches.withColumn("disclosure", F.lit(1.0))
    spans = base.select(*columns).union(terms.select(*columns))
    return spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(*columns[1:]))).alias("spans"))


_NO_SPANS = "CAST(array() AS array<struct<start:bigint,rank:int,kind:string,end:bigint,disclosure:double>>)"


def pii_report(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)``, one row per row of ``docs``.

    A null text is empty and has no spans; rows that repeat are reported each.
    """
    scanned = scan(docs, "doc_id")
    found = sensitive_spans(scanned, docs, threshold)
    named = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind <> 'term')"
    counts = [
        F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in KINDS
    ]
    return (
        scanned.select("_key", "doc_id")
        .join(found, "_key", "left")
        .select("doc_id", F.coalesce("spans", F.expr(_NO_SPANS)).alias("spans"))
        .select(
            "doc_id",
            *counts,
            F.sha2(F.expr(named.format(base)), 256).alias("base_sha256"),
            F.expr(named.format("spans")).alias("spans"),
        )
    )


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms by [TERM] or, if they disclose all, nothing.

    Spans that overlap are one. Null texts stay null, other columns as they are.
    """
    scanned = scan(docs, *docs.columns)
    found = sensitive_spans(scanned, docs, threshold)
    label = (
        "CASE WHEN s.kind <> 'term' THEN concat('[', upper(s.kind), ']') "
        "WHEN s.disclosure < 0.999999 THEN '[TERM]' ELSE '' END"
    )
    rebuilt = (
        "aggregate(_spans, named_struct('at', 0L, 'parts', CAST(array() AS array<string>)), (a, s) -> "
        "IF(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'parts', a.parts), "
        "named_struct('at', s.end, 'parts', concat(a.parts, array("
        f"substring(text, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), {label})))), "
        "a -> concat(array_join(a.parts, ''), substring(text, CAST(a.at + 1 AS INT))))"
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(rebuilt))
    return scanned.join(found.withColumnRenamed("spans", "_spans"), "_key", "left").withColumn("text", text).select(*docs.columns)
