"""The third fallback tier: a model lists a document's sections as JSON, which is checked and made into chunks row by row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_array, once, strip
from ..operators.detect import densest_window
from ..sources import nested
from ..sources.tables import stage

# fixed values: characters of the sample's parts and of the prompt's share of it, least chunks, longest title
HEAD, TAIL, SAMPLE, LEAST_ITEMS, LONGEST_TITLE = 4_000, 3_000, 10_000, 3, 200


def sample(text: Column) -> Column:
    """Head, densest window and tail of a document, those of them that are not blank, each once, joined by a mark."""
    parts = F.array_distinct(F.array(F.substring(text, 1, HEAD), densest_window(text), F.substr(text, F.greatest(F.length(text) - TAIL, F.lit(0)) + 1, F.lit(TAIL))))
    return F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n\n[...]\n\n")


def requests(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_title, prompt) of documents (doc_id, doc_title, text)."""
    ask = F.concat(
        F.lit("List every numbered section or rule of this statute as a JSON array of objects with section (its number), title and content (its whole text), and nothing else.\nTitle: "),
        F.coalesce("doc_title", F.lit("")),
        F.lit("\nText:\n"),
        F.substring(sample(F.col("text")), 1, SAMPLE),
    )
    return docs.select("doc_id", "doc_title", ask.alias("prompt"))


def replies(asked: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """``asked`` with ``reply`` of a pluggable model; stored, so that the model is asked once."""
    return stage(asked.withColumn("reply", F.pandas_udf(lambda p: p.map(complete), "string")("prompt")), "replies")


def read_replies(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of rows (doc_id, doc_title, reply).

    Chunks: doc_id, chunk_index, section_number, section_title, text. A reply is rejected, with its reason, if it holds no array, if that is no JSON, if it has under
    three items, if its items have fewer distinct numbers than half of them, or if under three items are objects with content. All of this is done in the
    JVM and inside a reply's row, which is read once and stored with its usable items; numbers are written as JSON has them.
    """
    read = answered.select("doc_id", "doc_title", json_array(F.coalesce("reply", F.lit(""))).alias("body")).withColumn("v", F.try_parse_json("body"))

    def item(v: Column, place: Column) -> Column:
        def fields(is_object: Column) -> Column:
            known = lambda field, missing: F.when(is_object, nested.text_of(v, field, missing))
            return F.struct((place + 1).cast("int").alias("chunk_index"), is_object.alias("is_object"), known("section", None).alias("number"), F.substring(known("title", ""), 1, LONGEST_TITLE).alias("section_title"), known("content", "").alias("content"))

        return once(nested.is_object(v), fields)

    read = read.withColumn("items", F.transform(F.try_variant_get("v", "$", "array<variant>"), item)).withColumn("bad", F.col("v").isNull()).drop("v")
    read = read.withColumn("objects", F.filter("items", lambda x: x["is_object"])).withColumn("usable", F.filter("objects", lambda x: strip(x["content"]) != ""))
    kinds = F.size(F.array_distinct(F.transform("objects", lambda x: F.coalesce(x["number"], F.lit("")))))
    reason = F.when(F.col("body").isNull(), "no array").when(F.col("bad"), "not JSON").when(F.coalesce(F.size("items"), F.lit(0)) < LEAST_ITEMS, "too few items")
    reason = reason.when(kinds < F.greatest(F.lit(1), F.floor(F.size("objects") / 2)), "repeated numbers").when(F.size("usable") < LEAST_ITEMS, "too few usable items")
    judged = read.withColumn("reason", reason).select("doc_id", "doc_title", "reason", F.when(F.col("reason").isNull(), F.col("usable")).alias("items"))
    judged = stage(judged, "replies-read")
    good = judged.where("reason IS NULL").select("doc_id", "doc_title", F.explode("items").alias("i")).select("doc_id", "doc_title", "i.chunk_index", F.coalesce("i.number", F.lit("N/A")).alias("section_number"), "i.section_title", "i.content")
    text = F.concat(F.lit("["), F.coalesce("doc_title", F.lit("")), F.lit("] Section "), "section_number", F.lit(" — "), "section_title", F.lit("\n"), "content")
    return good.select("doc_id", "chunk_index", "section_number", "section_title", text.alias("text")), judged.where("reason IS NOT NULL").select("doc_id", "reason")


def model_chunks(complete: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A model of ``ingest.ingest`` made of a function that answers prompts."""
    return lambda docs: read_replies(replies(requests(docs), complete))[0]
