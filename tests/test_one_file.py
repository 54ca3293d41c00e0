from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from promptweave.sources import readers, writers
from promptweave.sources.one_file import write_one_file
from workload.queries import csv_file_order, csv_one_file, json_array_file


def rows_of(spark, n=200, parts=7):
    text = F.concat(F.lit('a "q",\n'), F.repeat(F.lit("é "), F.col("id").cast("int") % 50))
    return spark.range(n).select("id", text.alias("text")).repartition(parts)


def files_in(folder):
    return [p for p in Path(folder).iterdir() if not p.name.startswith(("_", "."))]


def test_one_csv_of_many_tasks(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = rows_of(spark).unionByName(spark.createDataFrame([(None, None), (5, "x")], "id long, text string"))
    for _ in range(2):
        writers.write_csv(df, path, one_file=True, order=(F.desc("id"),))
    (file,) = files_in(path)
    assert file.read_text().splitlines()[0] == "id,text" and file.read_text().count("id,text") == 1
    read = readers.read_csv(spark, path, df.schema)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    ids = [r["id"] for r in readers.read_csv(spark, path, df.schema).collect()]
    assert ids == [*range(199, 5, -1), 5, 5, *range(4, -1, -1), None]
    assert [p.name for p in tmp_path.iterdir()] == ["csv"]


def test_one_csv_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(rows_of(spark).where("id < 0"), path, one_file=True)
    (file,) = files_in(path)
    assert file.read_text() == "id,text\n"


def test_other_modes(spark, tmp_path):
    df, path = rows_of(spark, 3), str(tmp_path / "csv")
    with pytest.raises(ValueError, match="beside"):
        writers.write_csv(df, path, mode="append", one_file=True)
    with pytest.raises(ValueError, match="one_file"):
        writers.write_csv(df, path, order=("id",))


def test_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = spark.range(1000).select("id", F.concat(F.lit("line "), "id").alias("line")).repartition(9)
    write_one_file(lines, path, "text", {}, order=("id",), columns=("line",))
    (file,) = files_in(path)
    assert file.read_text() == "".join(f"line {i}\n" for i in range(1000))


@pytest.mark.parametrize("query", [csv_file_order, csv_one_file, json_array_file])
def test_no_task_reads_all(spark, tmp_path, monkeypatch, query):
    """The tasks that write the one file of a query each read a part of the rows."""
    n = 4000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("en").alias("lang")
    )
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    pages.repartition(8).write.parquet(f"{tmp_path}/pages.parquet")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    most, real = [], type(docs.write).save

    def counted(writer, path=None, *args, **kwargs):
        real(writer, path, *args, **kwargs)
        if "-parts-" in str(path):
            found = [p for p in files_in(path) if p.stat().st_size]
            most.append(max(p.stat().st_size for p in found) / sum(p.stat().st_size for p in found))

    monkeypatch.setattr(type(docs.write), "save", counted)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert query(spark, str(tmp_path)).count() > n / 10
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(most) == 1 and most[0] < 0.5
