from __future__ import annotations

import json

import pytest
from pyspark.sql import types as T

from promptweave.functions.constants import PANDAS_NA_WORDS
from promptweave.schemas import LABELED, PROMPT_DOCUMENTS
from promptweave.sources import prompt_table, readers, writers

TRICKY = [
    'say "hi"', "a,b", "two\nlines", "dos\r\nlines", "back\\slash", "\\", '"', '""', "quote\\\"end",
    " padded ", "\ttab\t", "NA", "null", "None", " NA ", "", None, "é😀", "#x", "'single'", ",", "\n",
]


@pytest.fixture
def tricky(spark):
    rows = [(t, f"tier{i % 2}") for i, t in enumerate(TRICKY)]
    return spark.createDataFrame(rows, LABELED).coalesce(1)


def test_csv_round_trip_keeps_every_text_but_the_empty_one(spark, tricky, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(tricky, path)
    back = [tuple(r) for r in readers.read_labeled_csv(spark, path).collect()]
    kept = [(t or None, tier) for t, tier in tricky.collect()]
    assert sorted(back, key=str) == sorted(kept, key=str)


def test_na_words_become_null_on_request(spark, tricky, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(tricky, path)
    read = readers.read_labeled_csv(spark, path, na_words=PANDAS_NA_WORDS)
    texts = [r["user_prompt"] for r in read.collect()]
    assert texts.count(None) == 5
    assert " NA " in texts and "NA" not in texts


def test_csv_as_pandas_writes_it(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "raw.csv")
    texts = [t for t in TRICKY if t]
    frame = pd.DataFrame(
        {"extra": 1, "winner": "model_a", "model_a": "x", "model_b": "y", "user_prompt": texts}
    )
    frame.to_csv(path, index=False, encoding="utf-8")
    read = readers.read_raw_battles_csv(spark, path)
    assert read.columns == ["winner", "model_a", "model_b", "user_prompt"]
    assert sorted(r["user_prompt"] for r in read.collect()) == sorted(texts)


def test_csv_in_files_of_bounded_size(spark, tmp_path):
    path = tmp_path / "csv"
    writers.write_csv(spark.range(25).coalesce(1), str(path), rows_per_file=10)
    assert len(list(path.glob("*.csv"))) == 3
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert readers.read_csv(spark, str(path), schema).count() == 25


def test_csv_holds_nested_columns_as_json(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [(1, [("hé", "user")])], "id long, c array<struct<content:string,role:string>>"
    )
    writers.write_csv(df, path)
    schema = T.StructType([T.StructField("c", T.StringType())])
    assert json.loads(readers.read_csv(spark, path, schema).first()["c"]) == [
        {"content": "hé", "role": "user"}
    ]


def test_csv_without_a_needed_column(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(spark.range(2), path)
    with pytest.raises(ValueError, match="user_prompt"):
        readers.read_labeled_csv(spark, path)


def test_missing_paths_name_the_job_to_run(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    for read, hint in [
        (lambda: readers.read_battles(spark, nowhere), "snapshot"),
        (lambda: readers.read_raw_battles_csv(spark, nowhere), "collection"),
        (lambda: readers.read_labeled_csv(spark, nowhere), "labelling"),
        (lambda: readers.read_documents(spark, nowhere), "export"),
    ]:
        with pytest.raises(FileNotFoundError, match=hint):
            read()


def test_split_of_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = [(1, "train"), (2, "test"), (3, "train")]
    spark.createDataFrame(rows, "battle_id long, split string").write.parquet(path)
    assert readers.read_battles(spark, path).count() == 3
    train = readers.read_battles(spark, path, split="train")
    assert sorted(r["battle_id"] for r in train.collect()) == [1, 3]


def test_csv_files_are_bounded_by_bytes(spark, tmp_path):
    path = tmp_path / "csv"
    df = spark.range(1000).selectExpr("id", "repeat('x', 1000) AS t").coalesce(1)
    writers.write_csv(df, str(path), file_bytes=100_000)
    sizes = [f.stat().st_size for f in path.glob("*.csv")]
    assert 10 <= len(sizes) <= 12 and max(sizes) < 120_000


def test_a_missing_table_names_the_job_to_run(spark):
    with pytest.raises(FileNotFoundError, match="store job"):
        prompt_table.read_prompts(spark, "no_such_table")


def test_a_missing_split_is_named(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="split"):
        readers.read_battles(spark, str(tmp_path / "s"), split="train")


@pytest.mark.parametrize("n_docs", [3, 10_000, 10_001, None])
def test_documents_of_any_number_follow_one_rule(spark, n_docs):
    rows = [("b", "x"), ("a", "y"), ("b", "z"), ("", "v")]
    df = spark.createDataFrame(rows, "k string, user_prompt string")
    found = writers.first_documents(df, "k", n_docs).orderBy("doc_id").collect()
    whole = writers.first_documents(df, "k", None).orderBy("doc_id").collect()
    assert found == whole[: n_docs or 4] and [r["doc_id"] for r in whole] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="NULL in 1 rows"):
        writers.first_documents(df.union(spark.createDataFrame([(None, "n")], df.schema)), "k", n_docs)


def test_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(10 * i, f"prompt é {i}", "A" if i % 3 else "B") for i in range(30)]
    df = spark.createDataFrame(rows, "key long, user_prompt string, Target_Tier string").repartition(4)
    assert writers.export_documents(df, path, "key", n_docs=7) == 7
    docs = readers.read_documents(spark, path).orderBy("doc_id").collect()
    assert [tuple(d) for d in docs] == [(i, f"prompt é {i}", "A" if i % 3 else "B") for i in range(7)]
    found = readers.find_documents(spark, path, "B").collect()
    assert sorted(d["doc_id"] for d in found) == [0, 3, 6]
    assert writers.export_documents(df, path, "key", n_docs=100) == 30
    assert writers.export_documents(df, path, "key", n_docs=None) == 30
    large = readers.read_documents(spark, path).orderBy("doc_id").collect()
    assert [d["user_prompt"] for d in large] == [r[1] for r in rows]


def test_document_without_a_tier_matches_none(spark, tmp_path):
    docs = [{"doc_id": 0, "user_prompt": "é", "Target_Tier": "A"}, {"doc_id": 1, "user_prompt": "b"}]
    array = tmp_path / "array.json"
    array.write_text(json.dumps(docs, ensure_ascii=False, indent=2), encoding="utf-8")
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(d) for d in docs), encoding="utf-8")
    for path, single in [(array, True), (lines, False)]:
        read = readers.read_documents(spark, str(path), single)
        assert read.schema.names == PROMPT_DOCUMENTS.names
        assert read.count() == 2
        found = readers.find_documents(spark, str(path), "A", single).collect()
        assert [tuple(d) for d in found] == [(0, "é", "A")]


@pytest.fixture
def table(spark):
    name = "prompts_under_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_prompt_table(spark, table):
    rows = [(5, "b", "T2"), (3, "a", "T1"), (9, None, "T1"), (11, "d", "T2"), (20, "e", "T2")]
    df = spark.createDataFrame(rows, "key long, user_prompt string, Target_Tier string")
    assert prompt_table.save_prompts(df, "key", table) == 5
    stored = prompt_table.read_prompts(spark, table).orderBy("id").collect()
    assert [tuple(r) for r in stored] == [
        (0, "a", "T1"), (1, "b", "T2"), (2, None, "T1"), (3, "d", "T2"), (4, "e", "T2"),
    ]
    fetched = prompt_table.fetch_prompts(spark, table=table).collect()
    assert [r["id"] for r in fetched] == [0, 1, 3, 4]
    assert [r["id"] for r in prompt_table.fetch_prompts(spark, "T2", table).collect()] == [1, 3, 4]
    assert prompt_table.fetch_prompts(spark, "' OR '1'='1", table).count() == 0
    summary = prompt_table.prompt_summary(spark, table).collect()
    assert [tuple(r) for r in summary] == [("T2", 3, 75.0), ("T1", 1, 25.0)]

    assert prompt_table.save_prompts(df.limit(2), "key", table, mode="append") == 2
    ids = sorted(r["id"] for r in prompt_table.read_prompts(spark, table).collect())
    assert ids == list(range(7))
    assert prompt_table.save_prompts(df, "key", table) == 5
    assert spark.table(table).count() == 5


def test_append_creates_the_table(spark, table):
    df = spark.createDataFrame([(5, "b", "T2")], "key long, user_prompt string, Target_Tier string")
    assert prompt_table.save_prompts(df, "key", table, mode="append") == 1
    assert prompt_table.read_prompts(spark, table).first()["id"] == 0
    with pytest.raises(ValueError, match="mode"):
        prompt_table.save_prompts(df, "key", table, mode="merge")


def test_a_key_called_id(spark, table):
    df = spark.createDataFrame(
        [(70, "b", "T2"), (60, "a", "T1")], "id long, user_prompt string, Target_Tier string"
    )
    prompt_table.save_prompts(df, "id", table)
    stored = prompt_table.fetch_prompts(spark, table=table).collect()
    assert [tuple(r) for r in stored] == [(0, "a", "T1"), (1, "b", "T2")]
