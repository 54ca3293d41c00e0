"""Token ids as flat binary files with 64-bit document offsets, written and read by Spark tasks.

A folder holds, for each range of doc_ids, three files: ``.bin`` (ids as
little-endian unsigned integers, nothing else), ``.off`` (64-bit offsets of the
documents within the file, one more than documents) and ``.ids`` (64-bit
doc_ids); one with null doc_ids has their places in ``.nul``. ``manifest`` rows give each file's first position in the whole, from
prefix sums over the files; a document starts at that plus its offset.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 2
CACHED_CHUNKS = 500_000
MANIFEST = "part int, name string, docs long, nulls long, ids long, width int"


class _Cache(dict):
    """Makes what it lacks. Full, it starts anew but still looks into what it held before."""

    def __init__(self, make: Callable[[str], object], size: int | None = None):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key: str):
        made = self.before.get(key)
        value = self[key] = self.make(key) if made is None else made
        return value

    def tidy(self) -> None:
        if self.size and len(self) > self.size:
            self.before = dict(self)
            self.clear()


class ChunkEncoder:
    """Encodes with a public tokenizer, chunk by chunk between blanks, remembering chunks.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its chunks in a row. A plain word, which its normaliser
    and splitter leave whole but for the case, goes straight to its model, and
    so do full stops and commas after it; all else takes the whole way. Up to
    twice ``CACHED_CHUNKS`` chunks are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens_of = self.tokenizer.model.tokenize
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(size)]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.byte_signs = _Cache(lambda sign: as_bytes(sign)[0][0])
        self.stops = _Cache(lambda stops: self._whole(stops) if stops else b"")
        self.known = _Cache(self._encoded, CACHED_CHUNKS)

    def _whole(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in ids])

    def _encoded(self, chunk: str) -> bytes:
        word = chunk.rstrip(".,")
        # Letters up to U+024F have no other normal form; U+0130 is lowered to two signs.
        if not word.isalpha() or not word.isascii() and (max(word) > "\u024f" or "\u0130" in word):
            return self._whole(chunk)
        lowered = word.lower()
        if not lowered.isascii():
            lowered = "".join([self.byte_signs[sign] for sign in lowered])
        ids = b"".join([self.packed[token.id] for token in self.tokens_of(lowered)])
        return ids if len(word) == len(chunk) else ids + self.stops[chunk[len(word) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes."""
        self.known.tidy()
        known = self.known.__getitem__
        spaced = (t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts)
        return [b"".join(map(known, t.split(" "))) for t in spaced]


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder per worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer), TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        # Each attempt has names of its own; only those of the one that ends well get listed.
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        docs, at, nulls, out = 0, 0, 0, {}
        for ids, texts in _blocks(batches):
            if not out:
                system.create_dir(root, recursive=True)
                out = {s: system.open_output_stream(f"{root}/{name}.{s}") for s in ("bin", "off", "ids")}
                out["off"].write(np.zeros(1, "<i8").tobytes())
            encoded = encoder.encode(texts)
            for data in encoded:
                out["bin"].write(data + end)
            ends = at + np.cumsum([len(data) // encoder.width + 1 for data in encoded])
            at = int(ends[-1])
            out["off"].write(ends.astype("<i8").tobytes())
            out["ids"].write(np.array([d or 0 for d in ids], "<i8").tobytes())
            missing = [docs + i for i, d in enumerate(ids) if d is None]
            if missing:
                if "nul" not in out:
                    out["nul"] = system.open_output_stream(f"{root}/{name}.nul")
                out["nul"].write(np.array(missing, "<i8").tobytes())
            nulls += len(missing)
            docs += len(ids)
        if not out:
            return
        for stream in out.values():
            stream.close()
        row = [task.partitionId(), name, docs, nulls, at, encoder.width]
        fields = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(row, fields, strict=True)], names)

    return write


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    partitions: int | None = None,
    order: Sequence[str] = ("doc_id",),
) -> list[dict]:
    """Write ``docs`` in the order of some columns to a folder all executors share; returns the manifest.

    A null or empty text is the end id alone. Nulls come first in the order; rows
    equal in it follow each other by a hash of doc_id and text, which also splits very
    many of them over ranges, copies by their places. Ranges are written side by side,
    a block of rows at a time; one row per range reaches the driver.
    """
    count = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(order)]
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *keys)
    placed = given.withColumns({"tie": F.xxhash64("doc_id", "text"), "place": F.monotonically_increasing_id()})
    by = [f"key{i}" for i in range(len(keys))] + ["tie", "place"]
    ordered = placed.repartitionByRange(count, *by).sortWithinPartitions(*by)
    rows = ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).collect()
    manifest = [r.asDict() for r in sorted(rows)]
    starts = accumulate((m["ids"] for m in manifest), initial=0)
    manifest = [m | {"base": base} for m, base in zip(manifest, starts, strict=False)]
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array; mapped into memory where the folder is a mounted one."""
    system, root = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        path = f"{root}/{name}"
        return np.memmap(path, kind, "r")
    with system.open_input_file(f"{root}/{name}") as file:
        return np.frombuffer(file.read(), kind)


def _reader(folder: str, length: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = _mapped(folder, f"{m['name']}.bin", f"<u{m['width']}")
                offsets = _mapped(folder, f"{m['name']}.off", "<i8")
                doc_ids = _mapped(folder, f"{m['name']}.ids", "<i8")
                nulls = _mapped(folder, f"{m['name']}.nul", "<i8") if m["nulls"] else np.empty(0, np.int64)
                for first in range(0, m["docs"], length):
                    last = min(first + length, m["docs"])
                    bounds = np.asarray(offsets[first : last + 1])
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                    null = np.isin(np.arange(first, last), nulls)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc_ids[first:last]), pa.int64(), mask=null),
                            pa.array(bounds[:-1] + m["base"], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files."""
    if manifest is None:
        system, root = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{root}/manifest.json") as file:
            manifest = json.loads(file.read())
    schema = f"{MANIFEST}, base long"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = spark.createDataFrame([tuple(m[n] for n in names) for m in manifest], schema)
    spread = rows.repartition(max(1, len(manifest)))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spread.mapInArrow(_reader(folder, 4096), out)
