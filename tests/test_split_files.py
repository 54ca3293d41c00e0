"""Large files cut by many tasks give what a reader of whole files gives."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import types as T

from promptweave.sources import readers
from promptweave.sources.split_files import csv_records, json_objects, split_csv

BITS = ["a", 'b "q"', ",", "\n", "\n\n", '""', "é한𝔘", "x" * 60, " ", "end", "}", '{"a":[', "\\", '\\"', "]", "'"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "c")])


@pytest.fixture(params=[150, 2500])
def small_ranges(spark, request):
    """Ranges of so few bytes that records begin, end and lie in all places of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(request.param))
    yield request.param
    for n, value in before.items():
        spark.conf.set(n, value)


def texts(seed, n):
    draw = random.Random(seed)
    sizes = [0, 1, 3, 9, 40]
    return ["".join(draw.choice(BITS) for _ in range(draw.choice(sizes + [300] * (i % 17 == 0)))) for i in range(n)]


def write(path, rows, end="\n", header=("id", "text", "c"), before="", after=""):
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(before)
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)
        file.write(after)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv(spark, tmp_path, small_ranges, end):
    rows = [(str(i), t.replace("\n", end), "z" * (i % 3)) for i, t in enumerate(texts(1, 60))]
    path = str(tmp_path / "one.csv")
    write(path, rows, end)
    found = split_csv(spark, path, readers.CSV_OPTIONS, "place")
    assert found.rdd.getNumPartitions() > 1
    plain = readers.read_csv(spark, path, SCHEMA, split_above=None)
    assert sorted(map(str, found.drop("place").collect())) == sorted(map(str, plain.collect()))
    assert [r["id"] for r in found.orderBy("place").collect()] == [r[0] for r in rows]
    texts_read = {r["id"]: r["text"] or "" for r in found.collect()}
    assert texts_read == {r[0]: r[1].replace("\r\n", "\n") for r in rows}


def test_csv_folder(spark, tmp_path, small_ranges):
    """Several files, a byte order mark, blank lines in front, no line end at the end, an empty file."""
    rows = [(str(i), t, "") for i, t in enumerate(texts(2, 45))]
    write(tmp_path / "a.csv", rows[:15], before="﻿")
    write(tmp_path / "b.csv", rows[15:30], before="\n\n", after="\n\n")
    write(tmp_path / "c.csv", rows[30:], after='"99","no end')
    with open(tmp_path / "c.csv", "a", encoding="utf-8") as file:
        file.write('"')
    (tmp_path / "d.csv").touch()
    found = readers.read_csv(spark, str(tmp_path), SCHEMA, split_above=0)
    wanted = {r[0]: r[1] for r in rows} | {"99": "no end"}
    assert {r["id"]: r["text"] or "" for r in found.collect()} == wanted and found.count() == 46


def test_csv_one_field_over_all_ranges(spark, tmp_path, small_ranges):
    text = "line\n" * 1000
    path = str(tmp_path / "long.csv")
    write(path, [("1", "a", ""), ("2", text, "x"), ("3", "b", "")])
    found = readers.read_csv(spark, path, SCHEMA, split_above=0).orderBy("id").collect()
    assert [tuple(r) for r in found] == [("1", "a", None), ("2", text, "x"), ("3", "b", None)]


def test_csv_errors(spark, tmp_path):
    write(tmp_path / "odd.csv", [("1", "a", "")], after='2,"open,\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        csv_records(spark, str(tmp_path / "odd.csv"))
    (tmp_path / "none.csv").touch()
    with pytest.raises(ValueError, match="no header"):
        readers.read_csv(spark, str(tmp_path / "none.csv"), SCHEMA, split_above=0)
    with pytest.raises(FileNotFoundError, match="write the CSV first"):
        readers.read_csv(spark, str(tmp_path / "absent"), SCHEMA, split_above=0)
    with pytest.raises(FileNotFoundError, match="write the CSV first"):
        readers.read_csv(spark, str(tmp_path / "absent"), SCHEMA)
    with pytest.raises(ValueError, match="place"):
        readers.read_csv(spark, str(tmp_path), SCHEMA, place="at")
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder / "a.csv", [("1", "a", "")])
    write(folder / "b.csv", [("1", "a", "")], header=("id", "c", "text"))
    with pytest.raises(Exception, match="header differs"):
        readers.read_csv(spark, str(folder), SCHEMA, split_above=0).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json(spark, tmp_path, small_ranges, indent):
    docs = [
        {"doc_id": i, "user_prompt": t, "Target_Tier": "T", "more": {"list": [1, {"k": t}, {}]}}
        for i, t in enumerate(texts(4, 30))
    ]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(docs, indent=indent, ensure_ascii=False))
    found = json_objects(spark, str(path))
    assert found.rdd.getNumPartitions() > 1
    ordered = found.orderBy("file", "block", "place").collect()
    assert [json.loads(r["record"]) for r in ordered] == docs
    assert [r["doc_id"] for r in readers.read_documents(spark, str(path), single_array=True).orderBy("doc_id").collect()] == list(range(30))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    lines = readers.read_documents(spark, str(tmp_path / "lines"))
    array = readers.read_documents(spark, str(path), single_array=True)
    assert sorted(map(str, lines.collect())) == sorted(map(str, array.collect()))


@pytest.mark.parametrize("content,n", [("[]", 0), ("", 0), (" [ {} ]\n", 1), ('﻿[{"a":"}"},\n{"a":1}]', 2)])
def test_json_small(spark, tmp_path, content, n):
    (tmp_path / "a.json").write_text(content, encoding="utf-8")
    assert json_objects(spark, str(tmp_path / "a.json")).count() == n


@pytest.mark.parametrize("content", ['[1, {"a": 2}]', '{"a": [{"b": 1}]}', '[{"a":1}, null]'])
def test_json_of_other_things(spark, tmp_path, content):
    (tmp_path / "a.json").write_text(content)
    with pytest.raises(Exception, match="array of objects"):
        json_objects(spark, str(tmp_path / "a.json")).collect()
