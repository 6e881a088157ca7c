"""Helpers shared by the operators of this folder: the shared work folder, tables that cut lineage, word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs of anything but space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"
_WORK: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of this application: under spark.checkpoint.dir, or under a new folder where that is unset and all runs in one process (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _WORK:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lexspark-")
            spark.conf.set("spark.checkpoint.dir", base)
        _WORK[app] = f"{base.rstrip('/')}/{app}-{uuid.uuid4().hex[:8]}"
    return _WORK[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and no executor's loss undoes it.

    The shuffle files of the write go with its end, as nothing reads them again. ``paths`` collects the place, for ``drop`` once nothing
    reads the table any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


class Scratch:
    """The stored tables between the steps of one call; they go once its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return store(df, name, self.paths)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        out = store(df, name)
        drop(self.spark, self.paths)
        return out


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, as documents can be long; a smaller setting of the session stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def word_count(text) -> "F.Column":
    """Number of words of the contracts' pattern (null: 0), in the JVM: splits of what remains once outer space is trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def with_plain_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of docs with ``doc_id`` free of nulls and ``no_id``, which tells them: pandas would make floats of ids beside a null one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *columns)


def with_nulls(rows: DataFrame) -> DataFrame:
    """Undo ``with_plain_ids``."""
    return rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


# ---- hashing of words on bytes ------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed by a digest: from some 1000 bytes on, different strings exist whose polynomials agree modulo 2**64 for every base.
LONG_WORD = 64
_POWERS: dict[str, np.ndarray] = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["fwd"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("fwd", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["fwd"][:n], _POWERS["inv"][:n]


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the runs of equal kinds but 0; the last kind must be 0."""
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    return (start := edge[kind[edge] != 0]), np.append(edge, len(kind))[np.searchsorted(edge, start, "right")]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    fwd, inv = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * fwd[: len(data)])])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bounds(texts: list[bytes]) -> np.ndarray:
    """Where each text begins in the texts joined by one byte, and where the next would."""
    return np.cumsum([0] + [len(t) + 1 for t in texts])


def word_hashes(texts: list[bytes], lower: bool = True, space: tuple[int, ...] = (32, 9, 10, 11, 12, 13), spans: bool = False) -> tuple:
    """64-bit hashes of the words of many texts, and the offset of each text's first word (one more entry at the end).

    A word's hash is the polynomial of its bytes, taken as a difference of prefix sums, then mixed with its length; that of a long word a digest.
    ``space``: the bytes between words. ``spans``: return the words' first and end bytes and the joined bytes too.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    kinds = np.ones(256, np.int8)
    kinds[list(space)] = 0
    start, end = runs(kinds[data])
    h = span_hashes(data, start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    first = np.searchsorted(start, text_bounds(texts))
    return (h, first, start, end, data) if spans else (h, first)


def by_bytes(texts: list, most: int = 1 << 20):
    """Slices of at most ``most`` bytes or characters together (a longer text stands alone), as (first, last) indices."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def span_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans ``a`` hold the same bytes as the spans ``b``, by pairs."""
    size = end[a] - start[a]
    equal = size == end[b] - start[b]
    live = np.flatnonzero(equal)
    k = 0
    while len(live):
        live = live[size[live] > k]
        same = data[start[a[live]] + k] == data[start[b[live]] + k]
        equal[live[~same]] = False
        live, k = live[same], k + 1
        if len(live) <= 64:  # a few long ones: compared as they are
            for i in live.tolist():
                equal[i] = np.array_equal(data[start[a[i]] : end[a[i]]], data[start[b[i]] : end[b[i]]])
            break
    return equal


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct string, the number of each span's string). Hashes only sort: strings of one hash are told apart by their bytes."""
    _, head, number = np.unique(hashes, return_index=True, return_inverse=True)
    others: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(~span_equal(data, start, end, np.arange(len(hashes)), head[number])).tolist():
        own = (int(number[i]), data[start[i] : end[i]].tobytes())
        if own not in others:
            others[own] = len(head)
            head = np.append(head, i)
        number[i] = others[own]
    return head, number


def span_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings, copied in one piece."""
    size = end - start
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    flat = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
