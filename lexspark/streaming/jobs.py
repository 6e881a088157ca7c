"""Structured Streaming: file-triggered ingestion, idempotent sinks, job states, caches and session histories."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import ChunkStore
from ..sources.tables import stage

FINAL = ("done", "failed")
NO_TITLE = "Legal Query"  # fixed value
TITLE_PROMPT = "Name this question in three to five words, and answer with the name alone: {question}"


def job_states(events: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Per job its last status and the number of log lines; a final status is not left again."""
    ended = F.min(F.when(F.col("status").isin(*FINAL), F.struct(order, "status")))
    last = F.max(F.struct(order, "status"))
    return events.groupBy(job).agg(F.coalesce(ended, last)["status"].alias("status"), F.count("*").alias("log_lines"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"))


def live_entries(entries: DataFrame, now: Column, key: str = "key", order: str = "ts") -> DataFrame:
    """The newest entry of each key, if its time to live (ttl_s, null: for ever) has not passed."""
    fresh = F.col("ttl_s").isNull() | (F.unix_timestamp(now) - F.unix_timestamp(order) < F.col("ttl_s"))
    newest = entries.withColumn("_fresh", fresh).groupBy(key).agg(F.max_by(F.struct("value", "ttl_s", order, "_fresh"), F.struct(order, "value")).alias("e")).select(key, "e.*")
    return newest.where("_fresh").drop("_fresh")


def titles(changes: DataFrame) -> DataFrame:
    """Conversations (conv_id, title, updated_at) from an append-only log (conv_id, ts, title or null)."""
    named = F.max_by(F.when(F.col("title").isNotNull(), F.col("title")), F.when(F.col("title").isNotNull(), F.col("ts")))
    return changes.groupBy("conv_id").agg(F.coalesce(named, F.lit("New Chat")).alias("title"), F.max("ts").alias("updated_at"))


def model_titles(questions: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(conv_id, title) by a pluggable model from each conversation's first question (conv_id, question); where the model fails, or there is no question, a fixed title."""

    @F.pandas_udf("string")
    def name(asked: pd.Series) -> pd.Series:
        def one(q) -> str:
            try:
                return model(TITLE_PROMPT.format(question=q)).strip() if q else NO_TITLE
            except Exception:  # whatever a model raises, the conversation needs a title
                return NO_TITLE

        return asked.map(one)

    return questions.select("conv_id", name("question").alias("title"))


def persisted(session: Column) -> Column:
    return ~(session.startswith("guest_") | session.startswith("test_"))


def numbered_within(rows: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """``rows`` with their places (from 0) among those of the same ``by`` in ``order``, ties in any order.

    Rows are sorted across partitions; a place is that within a partition after the rows of those before it. So a hot ``by`` is spread over many tasks,
    and only counts by partition and ``by`` are put in order.
    """
    held = stage(rows.orderBy(by, order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    per = held.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_by", "_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = held.join(per, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return placed.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def drift(scores: DataFrame, every: int = 100, by: str = "doc_type", order: str = "seq") -> DataFrame:
    """Mean quality of each run of ``every`` chunks and its change from the run before."""
    run = F.floor(F.col("_place") / every)
    per = numbered_within(scores, by, order, "_place").groupBy(by, run.alias("run")).agg(F.avg("overall").alias("mean_score"), F.count("*").alias("n"))
    return per.withColumn("change", F.col("mean_score") - F.lag("mean_score").over(Window.partitionBy(by).orderBy("run")))


def upsert_stream(chunks: DataFrame, store: ChunkStore, checkpoint: str, once: bool = True):
    """Write a stream of chunks into the store. A batch that is tried again changes nothing, as ids are deterministic."""
    writer = chunks.writeStream.foreachBatch(lambda batch, _: store.upsert(batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(spark: SparkSession, folder: str, plan: Callable[[DataFrame], DataFrame], store: ChunkStore, checkpoint: str, schema: str = "doc_id string, text string"):
    """Ingest the JSON documents that arrive in a folder: each batch goes through the batch plan."""
    docs = spark.readStream.schema(schema).json(folder)

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(plan(batch))

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Events per window and type, late ones within the watermark; the same plan for tables and streams. An extension: the original has no streams."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size, step) if step else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: what comes a ``gap`` or more after the event before it begins a new one. ``session_window`` joins windows that touch, so its gap is a microsecond less."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    found = marked.groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n"))
    window = F.struct(F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"))
    return found.select("user_id", window.alias("session_window"), "n")
