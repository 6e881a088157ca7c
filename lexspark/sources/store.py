"""A chunk store of plain Parquet, dealt into folders by a hash of the key: idempotent upsert, delete, append, delivery and quarantine.

A change rewrites the folders of the keys that it touches and no others: their new rows are written to the shared folder first, and Spark's dynamic
partition overwrite then puts them in place of the old ones when all tasks have ended. A change that dies before that leaves the store as it was;
one that dies while folders are moved is made whole by doing it again, as ids are deterministic. There is one writer at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stage


def merge_upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", newest: str | None = None) -> DataFrame:
    """``old`` rows whose key ``new`` lacks, and one row of each key in ``new`` (the newest, if a column for that is given)."""
    if newest:
        order = Window.partitionBy(key).orderBy(F.desc(newest))
        new = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


class ChunkStore:
    """Chunks under ``path``, keyed by ``key``, in ``buckets`` folders. Their number is part of the folders' names and stays for good."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.folder = f"bucket_of_{buckets}"

    def _fs(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> list[int]:
        """Numbers of the folders that there are."""
        place, fs = self._fs()
        found = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "bucket_of_*")) or []
        names = [f.getPath().getName() for f in found]
        if other := [n for n in names if not n.startswith(f"{self.folder}=")]:
            raise ValueError(f"{self.path} is dealt otherwise: {other[0]}")
        return sorted(int(n.split("=")[1]) for n in names)

    def _rows(self) -> DataFrame:
        if not self.folders():
            raise FileNotFoundError(f"no chunks under {self.path}")
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(self.folder)

    def find(self, limit: int = 5, **equal) -> DataFrame:
        """At most ``limit`` rows whose columns equal the values given; the filter reaches the Parquet scan, and a key's only its own folder."""
        rows = self._rows()
        if self.key in equal:
            rows = rows.where(F.col(self.folder) == self._bucket(F.lit(equal[self.key])))
        for name, value in equal.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows.drop(self.folder).limit(limit)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.folder, self._bucket(F.col(self.key)))

    def _write(self, rows: DataFrame, mode: str, how: str = "dynamic") -> None:
        writer = rows.repartition(self.folder).write.mode(mode).partitionBy(self.folder)
        (writer.option("partitionOverwriteMode", how) if mode == "overwrite" else writer).parquet(self.path)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.folder).distinct().collect()]

    def overwrite(self, rows: DataFrame) -> None:
        self._write(stage(self._dealt(rows), "chunks"), "overwrite", "static")

    def upsert(self, rows: DataFrame) -> int:
        """Replace or add rows by key; the number of different keys given. The same rows again change nothing. Rows without a key are not stored."""
        new = stage(self._dealt(rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])), "new-chunks")
        n, touched = new.count(), self._touched(new)
        if held := set(self.folders()) & set(touched):
            old = self._rows().where(F.col(self.folder).isin(*held))
            new = stage(merge_upsert(old, new, self.key), "merged-chunks")
        if n:
            self._write(new, "overwrite")
        return n

    def append(self, rows: DataFrame, prefix: str, order: str) -> None:
        """Insert only, with ids ``prefix``_0, _1, ... in the order given, after those that are there; no folder is rewritten.

        Rows are sorted across partitions and written once; each one's number is its place in its partition after the sizes of those before it, so
        that no task sees all rows and only one number a partition goes to the driver.
        """
        start = self.read().where(F.col(self.key).startswith(f"{prefix}_")).count() if self.folders() else 0
        placed = stage(rows.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "append")
        sizes = dict(placed.groupBy("_part").agg(F.count("*")).orderBy("_part").collect())
        firsts, total = [], start
        for part, n in sizes.items():
            firsts.append((part, total))
            total += n
        first = F.create_map(*[F.lit(v) for pair in firsts for v in pair])[F.col("_part")] if firsts else F.lit(0)
        # the lower 33 bits of the running id are the place in the partition
        place = first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        self._write(self._dealt(placed.withColumn(self.key, F.concat(F.lit(f"{prefix}_"), place.cast("string"))).drop("_part", "_at")), "append")

    def delete(self, condition: Column, title: str = "doc_title") -> tuple[int, list[str]]:
        """Delete rows; (how many, and if none, up to 1000 titles that there are). Only folders that hold such rows are rewritten."""
        rows = self._rows()
        gone = rows.where(condition).groupBy(self.folder).count().collect()
        if not gone:
            return 0, [r[0] for r in rows.select(title).distinct().orderBy(title).limit(1000).collect()]
        touched = [r[0] for r in gone]
        rest = stage(rows.where(F.col(self.folder).isin(*touched)).where(~F.coalesce(condition, F.lit(False))), "kept-chunks")
        left = self._touched(rest)
        if left:
            self._write(rest, "overwrite")
        place, fs = self._fs()
        for k in set(touched) - set(left):  # a folder without rows is not overwritten, so it goes
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, f"{self.folder}={k}"), True)
        return sum(r[1] for r in gone), []

    def drop(self) -> None:
        place, fs = self._fs()
        fs.delete(place, True)


def deliver(rows: DataFrame, key: str, send: Callable[[pd.DataFrame], None], batch_rows: int = 100, rejected: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """Send ``rows`` in batches to a service outside Spark: (key, stored, error, tries).

    A batch that ``send`` rejects (raises one of ``rejected`` for) is halved until the bad rows stand alone, so b bad rows of n cost some 2 b log2(n) calls more.
    ``tries`` counts the calls that a row was part of. Other errors fail the task, which Spark tries again: ``send`` must bear rows that come twice.
    """
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def narrow(part: pd.DataFrame, tries: int) -> list[tuple]:
            try:
                send(part)
            except rejected as e:
                if len(part) == 1:
                    return [(part[key].iat[0], False, str(e) or type(e).__name__, tries)]
                half = len(part) // 2
                return narrow(part.iloc[:half], tries + 1) + narrow(part.iloc[half:], tries + 1)
            return [(k, True, None, tries) for k in part[key].tolist()]

        for batch in batches:
            for i in range(0, len(batch), batch_rows):
                yield pd.DataFrame(narrow(batch.iloc[i : i + batch_rows], 1), columns=[key, "stored", "error", "tries"])

    return rows.mapInPandas(work, f"`{key}` {kind}, stored boolean, error string, tries int")


def most_tries(batch_rows: int) -> int:
    """Calls that a row can be part of."""
    return 1 + math.ceil(math.log2(max(1, batch_rows)))


def split_bad_rows(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``): bad are rows that fail a named check, rather than a whole batch that is tried again."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def quarantine(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Both shapes of the log in one table: a missing field is null."""
    return spark.read.option("mergeSchema", True).json(path)
