"""One callable ``(spark, sf_dir) -> DataFrame`` per operator and composed job.

Results are cast to one width and doubles rounded to six places, so that they
can be compared value by value with the SQL of ``workload.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.config import TIER_COL, WINNING_MODEL_COL, LabelRules, Tier
from promptweave.functions import terms as term_functions
from promptweave.functions import text as text_functions
from promptweave.functions.constants import COMPLEX_KEYWORDS
from promptweave.functions.conversation import first_messages
from promptweave.operators import labeling, reduction, summaries, tfidf
from promptweave.operators.describe import describe
from promptweave.operators.features import with_text_features
from promptweave.operators.partitioning import spread
from promptweave.operators.row_ids import with_dense_id
from promptweave.operators.term_state import TermState
from promptweave.plans import classifier, jobs
from promptweave.plans.reports import feature_report
from promptweave.session import scratch_path
from promptweave.sources import prompt_table, readers, writers
from promptweave.sources.one_file import write_one_file
from promptweave.sources.prompt_store import PromptStore
from promptweave.streaming.labeling import battle_stream, label_stream
from workload.battles import battles, read_table

Query = Callable[[SparkSession, str], DataFrame]

INTEGER_FEATURES = ("prompt_length", "word_count", "complex_keyword_count")


def _six(c: str | Column) -> Column:
    return F.round(c, 6)


def _texts(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, table).select(*columns))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents", "doc_id", "text")


def _comparable(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return df.withColumns(
        {f: F.col(f).cast("long") if f in INTEGER_FEATURES else _six(f) for f in features}
    )


# --- collection and labelling -------------------------------------------------


def first_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_messages(read_table(spark, sf_dir, "conversations"))


def collected_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conversations, some of them empty or absent, through a landed snapshot."""
    collected = jobs.collect_prompts(readers.read_battles(spark, _snapshot(spark, sf_dir)))
    return collected.select("battle_id", "user_prompt")


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    """A snapshot of named splits with nested conversations and columns of its own; returns its path."""
    path = scratch_path(spark, "snapshot")
    message = F.struct(F.col("text").alias("content"), F.lit("user").alias("role"))
    reply = F.struct(F.lit("reply").alias("content"), F.lit("assistant").alias("role"))
    no_message = F.array().cast("array<struct<content:string,role:string>>")
    nested = (
        F.when(F.col("battle_id") % 10 == 3, no_message)
        .when(F.col("battle_id") % 10 == 4, F.lit(None))
        .otherwise(F.array(message, reply))
    )
    battles(spark, sf_dir, "text", "lang").select(
        "battle_id",
        F.concat(F.lit("q"), "battle_id").alias("question_id"),
        F.col("lang").alias("language"),
        F.when(F.col("battle_id") % 5 == 0, "test").otherwise("train").alias("split"),
        "model_a",
        "model_b",
        "winner",
        nested.alias("conversation_a"),
    ).write.parquet(path)
    return path


def collect_job_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of a snapshot through the collection job: every column comes along, by a text key."""
    out = scratch_path(spark, "raw")
    jobs.collect_job(spark, _snapshot(spark, sf_dir), out, split="train", key="question_id")
    return spark.read.parquet(out).withColumn(
        "conversation_a", F.coalesce(F.size("conversation_a"), F.lit(-1)).cast("long")
    )


def collect_job_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as CSV, the conversation as JSON text."""
    out = scratch_path(spark, "raw")
    jobs.collect_job(spark, _snapshot(spark, sf_dir), out, split="train", as_csv=True, key="question_id")
    names = ("question_id", "language", "split", "conversation_a", "user_prompt")
    read = readers.read_csv(spark, out, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    nested = F.from_json("conversation_a", "array<struct<content:string,role:string>>")
    return read.select(
        "question_id",
        "language",
        "split",
        "user_prompt",
        F.get(nested["content"], F.lit(0)).alias("opening"),
        F.get(nested["role"], F.lit(1)).alias("second_role"),
    )


OWN_RULES = LabelRules(
    tiers=(Tier("Small", ("koala-13b", "llama-13b")), Tier("Large", ("gpt-4", "koala-13b"))),
    decisive_winners=("model_a",),
    prompt_col="question",
    winner_col="verdict",
    model_a_col="left_model",
    model_b_col="right_model",
)


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own tiers and column names from CSV through labelling to the stored table."""
    raw, out, path = (scratch_path(spark, n) for n in ("raw", "labeled", "prompts"))
    named = battles(spark, sf_dir).withColumnsRenamed(
        {"user_prompt": "question", "winner": "verdict", "model_a": "left_model", "model_b": "right_model"}
    )
    writers.write_csv(named, raw)
    labeled = jobs.label_job(spark, raw, out, OWN_RULES, as_csv=True)
    table = "prompts_" + path.rsplit("-", 1)[1]
    prompt_table.save_prompts(labeled, "battle_id", table, path=path)
    return prompt_table.read_prompts(spark, table)


def drop_null_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).where(labeling.has_prompt())


def drop_blank_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).where(labeling.has_visible_prompt())


def decisive_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).where(labeling.has_decisive_winner())


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.strip_text(battles(spark, sf_dir))


def winning_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = labeling.clean_battles(battles(spark, sf_dir))
    return cleaned.select("battle_id", labeling.winning_model().alias(WINNING_MODEL_COL))


def assign_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = winning_model(spark, sf_dir)
    return named.withColumn(TIER_COL, labeling.tier_of(F.col(WINNING_MODEL_COL)))


def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = labeling.label_wins_by_lookup(battles(spark, sf_dir))
    return labeled.select("battle_id", WINNING_MODEL_COL, TIER_COL)


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.labeled_prompts(battles(spark, sf_dir), keep=("battle_id",))


def labeled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labeled(spark, sf_dir).drop("battle_id")


def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = summaries.tier_shares(_labeled(spark, sf_dir))
    return shares.select(
        TIER_COL, F.col("count").alias("prompt_count"), F.round("pct", 2).alias("pct")
    ).orderBy(F.desc("prompt_count"), TIER_COL)


def drop_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = labeling.drop_audit(battles(spark, sf_dir))
    return audit.withColumns({"rule": F.col("rule").cast("long"), "dropped_pct": _six("dropped_pct")})


def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.value_counts(battles(spark, sf_dir), "winner")


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.value_counts(read_table(spark, sf_dir, "customer"), "c_mktsegment")


def model_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.model_coverage(labeling.label_wins(battles(spark, sf_dir)))


def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.tier_report(_labeled(spark, sf_dir)).withColumn("pct", _six("pct"))


def percent_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars for the share of every event type."""
    shares = summaries.tier_shares(read_table(spark, sf_dir, "events"), "event_type")
    return shares.select("event_type", text_functions.percent_bar("pct").alias("bar"))


def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.imbalance(_labeled(spark, sf_dir)).withColumn("ratio", _six("ratio"))


# --- storage ------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Labelled prompts saved as a table of this run; returns its name."""
    path = scratch_path(spark, "prompts")
    table = "prompts_" + path.rsplit("-", 1)[1]
    prompt_table.save_prompts(_labeled(spark, sf_dir), "battle_id", table, path=path)
    return table


def dense_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dense_id(_labeled(spark, sf_dir).select("battle_id", TIER_COL), "battle_id")


def dense_id_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of a text key, over whole texts."""
    docs = read_table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("k"), "text")
    return with_dense_id(docs, "k").select("id", "k", F.length("text").cast("long").alias("chars"))


def dense_id_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over a key that repeats; equal keys may be ordered either way, so they are summed."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    per_key = with_dense_id(lines, "l_orderkey").groupBy("l_orderkey")
    return per_key.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def fetch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_table.fetch_prompts(spark, table=_stored(spark, sf_dir))


def fetch_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_table.fetch_prompts(spark, "Tier_2_API", _stored(spark, sf_dir))


def fetch_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = prompt_table.fetch_prompts(spark, table=_stored(spark, sf_dir)).limit(10)
    return head.select("id", TIER_COL, text_functions.preview("user_prompt").alias("preview"))


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_table.prompt_summary(spark, _stored(spark, sf_dir))


def append_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prompts loaded twice; ids of the second load go on where the first ended."""
    table = _stored(spark, sf_dir)
    prompt_table.save_prompts(_labeled(spark, sf_dir), "battle_id", table, mode="append")
    return prompt_table.read_prompts(spark, table).select("id", TIER_COL)


def _in_thirds(df: DataFrame) -> list[DataFrame]:
    return [df.where(F.col("battle_id") % 3 == k) for k in range(3)]


def _store(spark: SparkSession, sf_dir: str, block_rows: int = 100) -> PromptStore:
    """Three loads, of which one breaks off before its commit and one is tried twice."""
    store = PromptStore(spark, scratch_path(spark, "store"), block_rows)
    loads = _in_thirds(_labeled(spark, sf_dir))
    store.load(loads[0], "battle_id", "load-0")
    store.load(loads[0], "battle_id", "load-0")
    store._write(loads[2], "battle_id", "load-1", store.loads().agg(F.sum("n")).first()[0])
    store.load(loads[1], "battle_id", "load-1")
    store.load(loads[2], "battle_id", "load-2")
    return store


def store_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt once under dense ids, whatever was tried twice or broke off."""
    return _store(spark, sf_dir).prompts()


def store_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of one tier, from the blocks of ids that hold them."""
    head = _store(spark, sf_dir).head(50, "Tier_2_API")
    return head.select("id", text_functions.preview("user_prompt").alias("preview"))


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of ids across the bounds of loads and blocks."""
    return _store(spark, sf_dir).prompts(first=90, last=310)


def label_job_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit that the labelling job counts while it writes."""
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "labeled")
    battles(spark, sf_dir).write.parquet(raw)
    _, audit = jobs.audited_label_job(spark, raw, out)
    return audit.withColumns({"rule": F.col("rule").cast("long"), "dropped_pct": _six("dropped_pct")})


def _streamed(spark: SparkSession, sf_dir: str) -> PromptStore:
    """Battles that arrive in files, labelled and stored by a stream that is started again in between."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "store")
    store, rows = PromptStore(spark, path, 100), battles(spark, sf_dir)
    for third in _in_thirds(rows):
        third.repartition(3).write.mode("append").parquet(landed)
        arriving = battle_stream(spark, landed, rows.schema, files_per_batch=2)
        label_stream(arriving, store, f"{path}/stream").awaitTermination()
    return store


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream has stored; ids follow the batches, which files make up."""
    rows = _streamed(spark, sf_dir).prompts()
    return rows.groupBy("user_prompt", TIER_COL).agg(F.count("*").alias("n"))


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running audit over all batches."""
    audit = _streamed(spark, sf_dir).audit()
    return audit.withColumns({"rule": F.col("rule").cast("long"), "dropped_pct": _six("dropped_pct")})


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", text_functions.preview("text").alias("preview"))


def documents_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    return jobs.document_job(_labeled(spark, sf_dir), path, "Tier_2_API")


def documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export without a number of documents holds every row."""
    path = scratch_path(spark, "documents")
    labeled = _labeled(spark, sf_dir)
    writers.export_documents(labeled, path, "battle_id", n_docs=None)
    return readers.read_documents(spark, path)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV to labelled CSV and back, texts with quotes and newlines included."""
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "labeled")
    writers.write_csv(battles(spark, sf_dir), raw)
    return jobs.label_job(spark, raw, out, as_csv=True)


def csv_na_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some words are taken as missing when the raw CSV is read."""
    raw = scratch_path(spark, "raw")
    writers.write_csv(battles(spark, sf_dir), raw)
    read = readers.read_raw_battles_csv(spark, raw, keep=("battle_id",), na_words=("tie", "gpt-4"))
    return read.select("battle_id", "model_a", "model_b", "winner")


def csv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    pages = read_table(spark, sf_dir, "pages")
    writers.write_csv(pages, path)
    return readers.read_csv(spark, path, pages.schema)


def csv_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, which hold quotes and line ends, from one file that many tasks read."""
    path = scratch_path(spark, "pages")
    pages = read_table(spark, sf_dir, "pages")
    writers.write_csv(pages, path, one_file=True)
    return readers.read_csv(spark, path, pages.schema, split_above=0)


def csv_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of one CSV file, whose rows have no key of their own."""
    path = scratch_path(spark, "documents")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    writers.write_csv(docs, path, one_file=True, order=(F.desc("doc_id"),))
    read = readers.read_csv(spark, path, docs.schema, split_above=0, place="place")
    return with_dense_id(read, "place").select("id", "doc_id", F.length("text").cast("long").alias("chars"))


def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled prompts from a file that holds one JSON array."""
    path = scratch_path(spark, "array")
    docs = writers.first_documents(_labeled(spark, sf_dir), "battle_id", n_docs=None)
    opening = F.when(F.col("doc_id") == 0, "[").otherwise(",")
    lines = docs.select("doc_id", F.concat(opening, F.to_json(F.struct("*"))).alias("line"))
    ending = spark.range(1).select(F.lit((1 << 63) - 1).alias("doc_id"), F.lit("]").alias("line"))
    write_one_file(lines.union(ending), path, "text", {}, order=("doc_id",), columns=("line",))
    return readers.read_documents(spark, path, single_array=True)


# --- text features ------------------------------------------------------------


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default keywords, put into every text next to signs, capitals and underscores."""
    put = ", ".join(f"'{k}'" for k in COMPLEX_KEYWORDS)
    texts = _documents(spark, sf_dir).withColumn("k", F.expr(f"array({put})[doc_id % {len(COMPLEX_KEYWORDS)}]"))
    text = F.expr("concat(text, ' ', k, '! (', upper(k), ') ', k, '_ x', k, ' ', initcap(k), ';')")
    count = text_functions.complex_keyword_count("text")
    return texts.withColumn("text", text).select("doc_id", count.cast("long").alias("hits"))


def _feature(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        featured = with_text_features(_documents(spark, sf_dir), "text", (name,))
        return _comparable(featured, (name,)).select("doc_id", name)

    return query


def _features(table: str, key: str, text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        featured = with_text_features(_texts(spark, sf_dir, table, key, text), text)
        return _comparable(featured, tuple(text_functions.TEXT_FEATURES)).drop(text)

    return query


COMMON_WORDS = ("the", "and", "with", "die", "und", "les", "que", "tion")


def common_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword counting with words these texts do hold."""
    count = text_functions.complex_keyword_count("text", COMMON_WORDS)
    return _documents(spark, sf_dir).select("doc_id", count.cast("long").alias("hits"))


def conversation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _texts(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    featured = with_text_features(turns, "text")
    return _comparable(featured, tuple(text_functions.TEXT_FEATURES)).drop("text")


def feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = with_text_features(_documents(spark, sf_dir), "text")
    return describe(featured, tuple(text_functions.TEXT_FEATURES))


def lineitem_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return describe(read_table(spark, sf_dir, "lineitem"), columns, materialise=False)


# --- terms and TF-IDF ---------------------------------------------------------


def _joined(make: Callable[[str], Column], out: str) -> Query:
    """The terms of every text, in order, as one string per row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", F.array_join(make("text"), "|").alias(out))

    return query


def _fit(spark: SparkSession, sf_dir: str, table: str = "documents") -> tfidf.TfidfModel:
    return tfidf.fit_tfidf(_texts(spark, sf_dir, table, "text"), "text")


def vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _fit(spark, sf_dir).vocabulary_table(spark)
    return table.select(F.col("idx").cast("long").alias("idx"), "term", "tf", "df")


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _fit(spark, sf_dir).vocabulary_table(spark)
    return table.select("term", "df", _six("idf").alias("idf"))


def vocab_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary from stored counts of three loads of the documents, one of them loaded twice."""
    state = TermState(spark, scratch_path(spark, "terms"))
    docs = _documents(spark, sf_dir)
    loads = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]
    for name, load in (("first", loads[0]), ("second", loads[1]), ("second", loads[1])):
        state.add(load, name, "text")
    merged = state.compact(scratch_path(spark, "terms"))
    merged.add(loads[2], "third", "text")
    table = merged.fit(text_col="text").vocabulary_table(spark)
    return table.select("term", "tf", "df", _six("idf").alias("idf"))


def benchmark_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small corpus, where many terms tie at the cut."""
    table = _fit(spark, sf_dir, "benchmark").vocabulary_table(spark)
    return table.select(F.col("idx").cast("long").alias("idx"), "term", "tf", "df")


def tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit(spark, sf_dir)
    scored = model.transform(_documents(spark, sf_dir))
    return tfidf.long_form(scored, model, "doc_id").withColumn("weight", _six("weight"))


def tfidf_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells from a model that was saved and loaded again."""
    path = scratch_path(spark, "model")
    _fit(spark, sf_dir).save(spark, path)
    model = tfidf.TfidfModel.load(spark, path)
    scored = model.transform(_documents(spark, sf_dir))
    return tfidf.long_form(scored, model, "doc_id").withColumn("weight", _six("weight"))


def tfidf_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit(spark, sf_dir)
    scored = model.transform(_documents(spark, sf_dir))
    return tfidf.sparsity(scored, model.out, len(model.terms)).withColumn("sparsity", _six("sparsity"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature job through the stored table and a saved model.

    The vector is shown by its number of non-zero cells, its sum and its norm.
    """
    table, out, model_path = _stored(spark, sf_dir), scratch_path(spark, "features"), scratch_path(spark, "model")
    jobs.feature_job(spark, out, model_path, table)
    cells = F.expr("filter(cells, w -> w != 0)")
    stored = spark.read.parquet(out)
    shown = stored.withColumn("cells", F.unwrap_udt("tfidf")["values"]).select(
        "id",
        *text_functions.TEXT_FEATURES,
        F.size(cells).cast("long").alias("tfidf_nonzero"),
        _six(F.aggregate(cells, F.lit(0.0), lambda a, w: a + w)).alias("tfidf_sum"),
        _six(F.sqrt(F.aggregate(cells, F.lit(0.0), lambda a, w: a + w * w))).alias("tfidf_norm"),
        TIER_COL,
    )
    return _comparable(shown, tuple(text_functions.TEXT_FEATURES))


def tfidf_wide_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column sums of the wide export, one row per term."""
    model = _fit(spark, sf_dir)
    wide = tfidf.widen(model.transform(_documents(spark, sf_dir)), model)
    columns = [c for c in wide.columns if c.startswith("tfidf_")]
    row = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in columns])
    totals = row.unpivot([], [f"`{c}`" for c in columns], "feature", "total")
    return totals.withColumn("total", F.round("total", 4))


def feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature job's wide CSV, with the statistical features and the sum over all terms."""
    table, out, model_path = _stored(spark, sf_dir), scratch_path(spark, "features"), scratch_path(spark, "model")
    jobs.feature_job(spark, out, model_path, table, as_csv=True)
    wide = spark.read.option("header", True).option("maxColumns", 4000).csv(out)
    terms = ", ".join(f"`{c}`" for c in wide.columns if c.startswith("tfidf_"))
    total = F.expr(f"aggregate(transform(array({terms}), w -> CAST(w AS DOUBLE)), 0.0D, (a, w) -> a + w)")
    return wide.select(
        F.col("prompt_length").cast("long").alias("prompt_length"),
        F.col("word_count").cast("long").alias("word_count"),
        _six(F.col("char_entropy").cast("double")).alias("char_entropy"),
        _six(total).alias("tfidf_sum"),
        TIER_COL,
    )


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts, their language as the tier."""
    docs = read_table(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", F.col("text").alias("user_prompt"), F.col("lang").alias(TIER_COL)))


def language_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out figures of a classifier that tells languages by their words, rare ones weighing more."""
    docs = _languages(spark, sf_dir)
    model = tfidf.fit_tfidf(docs.where(~classifier.held_out()))
    _, report = classifier.evaluate_tiers(docs, model)
    return report.withColumns({c: _six(c) for c in ("precision", "recall", "f1")})


def _term_space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, reduction.TermSpace]:
    """Scored documents, written once as every pass reads them, and the space of their terms."""
    path, model = scratch_path(spark, "scored"), _fit(spark, sf_dir)
    model.transform(_documents(spark, sf_dir)).select("doc_id", model.out).write.parquet(path)
    scored = spark.read.parquet(path)
    return scored, reduction.fit_term_space(scored, model.out, len(model.terms), 20)


def term_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values of the documents' TF-IDF matrix and the share of it that they explain."""
    _, space = _term_space(spark, sf_dir)
    rows = [(i + 1, float(s), float(e)) for i, (s, e) in enumerate(zip(space.singular, space.shares))]
    table = spark.createDataFrame(rows, "dimension long, singular double, share double")
    return table.withColumns({"singular": F.round("singular", 4), "share": F.round("share", 4)})


def document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cluster in the reduced space."""
    scored, space = _term_space(spark, sf_dir)
    reduced = space.project(scored, "tfidf")
    return reduction.with_cluster(reduced, reduction.fit_clusters(reduced, 8)).select("doc_id", "cluster")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures of a fixed rule over the held-out documents."""
    unseen = _languages(spark, sf_dir).where(classifier.held_out())
    rule = F.when(F.col("user_prompt").contains(" the "), "en").when(F.col("user_prompt").contains(" der "), "de")
    ruled = unseen.withColumn("predicted_tier", rule.otherwise("other"))
    report = classifier.class_report(classifier.confusion(ruled))
    return report.withColumns({c: _six(c) for c in ("precision", "recall", "f1")})


def feature_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = spread(_labeled(spark, sf_dir))
    model = tfidf.fit_tfidf(labeled)
    return feature_report(labeled, len(model.terms)).withColumn("pct", _six("pct"))


QUERIES: dict[str, Query] = {
    "tier_summary": tier_summary,
    "first_prompt": first_prompt,
    "collected_prompts": collected_prompts,
    "collect_job_columns": collect_job_columns,
    "collect_job_csv": collect_job_csv,
    "custom_rules": custom_rules,
    "drop_null_prompt": drop_null_prompt,
    "drop_blank_prompt": drop_blank_prompt,
    "decisive_only": decisive_only,
    "strip_text": strip_text,
    "winning_model": winning_model,
    "assign_tier": assign_tier,
    "tier_lookup": tier_lookup,
    "labeled_prompts": labeled_prompts,
    "drop_audit": drop_audit,
    "winner_counts": winner_counts,
    "segment_counts": segment_counts,
    "model_coverage": model_coverage,
    "tier_report": tier_report,
    "percent_bar": percent_bar,
    "imbalance": imbalance,
    "dense_id": dense_id,
    "dense_id_text_key": dense_id_text_key,
    "dense_id_lineitem": dense_id_lineitem,
    "fetch_all": fetch_all,
    "fetch_tier": fetch_tier,
    "fetch_head": fetch_head,
    "stored_summary": stored_summary,
    "append_load": append_load,
    "store_loads": store_loads,
    "store_head": store_head,
    "store_range": store_range,
    "label_job_audit": label_job_audit,
    "stream_store": stream_store,
    "stream_audit": stream_audit,
    "preview": preview,
    "documents_tier": documents_tier,
    "documents_all": documents_all,
    "csv_roundtrip": csv_roundtrip,
    "csv_na_words": csv_na_words,
    "csv_pages": csv_pages,
    "csv_one_file": csv_one_file,
    "csv_file_order": csv_file_order,
    "json_array_file": json_array_file,
    **{name: _feature(name) for name in text_functions.TEXT_FEATURES},
    "keyword_hits": keyword_hits,
    "common_word_count": common_word_count,
    "text_features": _features("documents", "doc_id", "text"),
    "page_features": _features("pages", "page_id", "html"),
    "conversation_features": conversation_features,
    "feature_describe": feature_describe,
    "lineitem_describe": lineitem_describe,
    "tokens": _joined(term_functions.tokens, "tokens"),
    "content_words": _joined(term_functions.content_words, "words"),
    "ngrams": _joined(term_functions.terms, "terms"),
    "vocab_top": vocab_top,
    "idf_table": idf_table,
    "vocab_refit": vocab_refit,
    "benchmark_vocab": benchmark_vocab,
    "tfidf_long": tfidf_long,
    "tfidf_reloaded": tfidf_reloaded,
    "tfidf_sparsity": tfidf_sparsity,
    "tfidf_wide_totals": tfidf_wide_totals,
    "feature_matrix": feature_matrix,
    "feature_csv": feature_csv,
    "feature_report": feature_report_query,
    "language_classifier": language_classifier,
    "class_report": class_report,
    "term_space": term_space,
    "document_clusters": document_clusters,
}
