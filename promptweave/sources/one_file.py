"""One file written by many tasks, for formats whose rows simply follow one another.

All tasks write their rows as files of their own through Spark's writers. The lengths of
these say where each belongs in the whole, and tasks copy them there side by side.
"""

from __future__ import annotations

import os
import shutil
import uuid
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = "file:"


def _local(uri: str) -> str:
    return "/" + uri.removeprefix(_SCHEME).lstrip("/")


def _put(job: tuple[str, str, int, int]) -> None:
    """Copy a file to its place in the whole; doing so again changes nothing."""
    source, whole, at, length = job
    with open(source, "rb") as rows, open(whole, "r+b") as out:
        out.seek(at)
        shutil.copyfileobj(rows, out, 1 << 20)
        if out.tell() != at + length:
            raise OSError(f"{source} has {out.tell() - at} bytes in place of {length}")


def write_one_file(
    df: DataFrame,
    path: str,
    fmt: str,
    options: dict[str, object],
    mode: str = "overwrite",
    order: tuple[str | Column, ...] = (),
    columns: tuple[str, ...] = (),
) -> None:
    """All rows as one file in the folder ``path``, sorted by ``order`` if it names anything.

    ``columns`` are those written, all by default. No task holds more than its part of the
    rows, as long as the folder is one that all executors mount; a header is written once.
    Other stores let a file only be written from start to end, so one task does it there.
    """
    if mode not in ("overwrite", "error", "errorifexists"):
        raise ValueError(f"mode {mode!r} leaves other files beside the one")
    spark = df.sparkSession
    columns = columns or tuple(df.columns)
    named = [F.col(f"`{c}`") for c in columns]
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    rows = (df.orderBy(*order) if order else df).select(*named)
    nothing = spark.createDataFrame([], rows.schema)
    nothing.write.format(fmt).mode(mode).options(**options).save(path)
    rows.write.format(fmt).options(**options | {"header": False}).save(parts)
    listed = spark.read.format("binaryFile").load(parts).select("path", "length").where("length > 0").collect()
    found = sorted((r["path"], r["length"]) for r in listed)
    if not found:
        return
    if not found[0][0].startswith(_SCHEME):
        rest = df.coalesce(1)
        rest = rest.sortWithinPartitions(*order) if order else rest
        rest.select(*named).write.format(fmt).mode("overwrite").options(**options).save(path)
        return
    folder = Path(_local(found[0][0])).parent
    target = next(p for p in (folder.parent / Path(path).name).iterdir() if p.name.startswith("part-"))
    whole = target.with_name(f"_whole-{uuid.uuid4().hex}")
    shutil.copyfile(target, whole)
    places = list(accumulate((n for _, n in found), initial=target.stat().st_size))
    jobs = [(_local(part), str(whole), at, n) for (part, n), at in zip(found, places)]
    spark.sparkContext.parallelize(jobs, len(jobs)).foreach(_put)
    target.with_name(f".{target.name}.crc").unlink(missing_ok=True)
    os.replace(whole, target)
    shutil.rmtree(folder)
