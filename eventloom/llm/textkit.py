"""Shared pieces of the training-data operators.

Text is handled as the bytes of whole Arrow columns: words are found and hashed
for a few megabytes of documents at a time with numpy, without a Python loop
over words.  A *word* is a maximal run of bytes other than ASCII white space;
ASCII letters count without case.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES, BATCH_BYTES, TASK_BYTES, PART_BYTES = 2 << 20, 8 << 20, 64 << 20, 16 << 20
_BYTES, _DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", (str(64 << 20), str((1 << 31) - 1))
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240117).integers(1, 1 << 64, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_made: list[str] = []
_pow = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


# Spark side


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches to BATCH_BYTES, where the session says nothing else: texts are long, and a batch lies in the
    JVM's and in the worker's memory at once."""
    if spark.conf.get(_BYTES).rstrip("b") in _DEFAULTS:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", at)
        _remove_at_exit(spark, at)
    return at.rstrip("/")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def temporary_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/eventloom/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back.

    A table is removed by drop_materialized() or released(), else when the driver ends, since the result that reads it is lazy.
    """
    spark = df.sparkSession
    tune(spark)
    path = temporary_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.eventloom_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_materialized(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    _remove(df.sparkSession, df.eventloom_path)


@contextmanager
def released(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Remove on leaving all tables materialized inside, but for those of `keep`, which may be filled inside."""
    before = len(_made)
    yield
    for path in set(_made[before:]) - {df.eventloom_path for df in keep}:
        _remove(spark, path)
    del _made[before:]


def spread(df: DataFrame, n_bytes: int, *by: str) -> DataFrame:
    """df shuffled by the columns into as many tasks as its bytes ask for, shuffle.partitions at least."""
    return df.repartition(max(tasks_for(df.sparkSession), -(-n_bytes // TASK_BYTES)), *by)


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """Parts for so many bytes of parcels, of which a task holds one part at once."""
    return min(65_535, max(tasks_for(spark), -(-n_bytes // PART_BYTES)))


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with doc_id as a long, and for ids of another type the table (name, id) of their numbers; rows without an id go."""
    docs = docs.where("doc_id is not null")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn("doc_id", F.col("doc_id").cast("long")), None
    names = materialize(docs.select(F.col("doc_id").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    return docs.join(names, docs["doc_id"] == names["name"]).withColumn("doc_id", F.col("id")).drop("name", "id"), names


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """df with the columns' numbers turned into ids again."""
    order = df.columns
    for c in columns if names is not None else ():
        df = df.withColumnRenamed(c, "__el_id").join(names, F.col("__el_id") == F.col("id")).withColumn(c, F.col("name")).select(*order)
    return df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b) of longs: rows (id, root), root the least id reached.

    Large-star / small-star rounds over narrow rows, each cut by a written table;
    ends when a round changes nothing.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    stamp = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.where("u <> v").distinct(), "cc")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialized(e)
        e = nxt
        if now == stamp:
            break
        stamp = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")


# Arrow side


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each; whole documents only."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_bytes(b.column(b.schema.get_field_index("text")))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _MULT), ("down", _INV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _pow[key] = np.multiply.accumulate(x)
        _pow["n"] = n
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(buf)
    ink = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = ink[:-1]
    start = np.flatnonzero(ink & (first[:n] | ~prev))
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = ink[1:]
    end = np.flatnonzero(ink & (first[1:] | ~nxt)) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text column, and each document's first word (one more at the end)."""
    buf, off = text_bytes(column)
    start, end, first = word_spans(buf, off)
    return span_hash(prefix_hash(buf), start, end), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word n-grams in order; a document of fewer words has one, of all its words."""
    total = len(words)
    acc = np.zeros(total, np.uint64)
    doc_end = np.repeat(first[1:], np.diff(first))
    pos = np.arange(total)
    for j in range(n):
        c = np.uint64(pow(_MULT, j + 2, 1 << 64))
        here = np.zeros(total, np.uint64)
        here[: max(0, total - j)] = words[j:] * c
        here[pos + j >= doc_end] = 0
        acc += here
    length = np.diff(first)
    keep = pos + n <= doc_end
    short = first[:-1][(length > 0) & (length < n)]
    keep[short] = True
    count = np.where(length >= n, length - n + 1, (length > 0).astype(length.dtype))
    out = np.zeros(len(first), np.int64)
    np.cumsum(count, out=out[1:])
    return mix(acc[keep]), out


def parcel(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Structured rows as one blob for each part, (part, rows): so many fewer rows to shuffle; parts are under 65,536."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    part, rows = part[order], rows[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    off = (np.append(begin, len(rows)) * rows.dtype.itemsize).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off), pa.py_buffer(rows)])
    return pa.record_batch([pa.array(part[begin].astype(np.int32)), blobs], ["part", "rows"])


def unparcel(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All rows of a task's parcels."""
    return np.frombuffer(b"".join(x.as_buffer() for b in batches for x in b.column(1)), dtype)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
