"""Recursive overlapping split of long chunks, micro-fragment merge and context lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import bound_batches

# fixed values: separators by preference, schedule markers, least fragment
LEGAL_SEPARATORS = ("\n\n", "\n\nCHAPTER ", "\n\nPART ", "\nSection ", "\nSec. ", "\nRule ", "\nORDER ", "\nSCHEDULE ", "\n    (", "\n(", ". ", "\n", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
SCHEDULE_MARKERS = r"(?i)SCHEDULE|APPENDIX|TABLE|FORM\s+[A-Z]|Item\s+\d|Sl\.?\s*No\."
LEAST_FRAGMENT = 40


def pack_pieces(pieces: list[str], glue: str, size: int, overlap: int) -> list[str]:
    """Greedy windows of neighbouring pieces of at most ``size`` characters, each beginning with up to ``overlap`` characters of the last one."""
    out, now, total = [], [], 0
    for piece in pieces:
        if now and total + len(piece) + len(glue) > size:
            out.append(glue.join(now).strip())
            while now and (total > overlap or total + len(piece) + len(glue) > size):
                total -= len(now.pop(0)) + (len(glue) if now else 0)
        total += len(piece) + (len(glue) if now else 0)
        now.append(piece)
    out.append(glue.join(now).strip())
    return [x for x in out if x]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = PLAIN_SEPARATORS, keep: bool = False) -> list[str]:
    """Split at the first separator that occurs; pieces of ``size`` or more go on with the later separators, smaller ones are packed.

    ``keep``: each piece begins with the separator before it, and nothing stands between packed pieces; else separators are dropped and put between them.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    glue, later = separators[at], separators[at + 1 :]
    pieces = text.split(glue) if glue else list(text)
    if keep and glue:
        pieces = [pieces[0], *[glue + p for p in pieces[1:]]]
    pieces = [p for p in pieces if p]
    if keep:
        glue = ""
    out: list[str] = []
    small: list[str] = []
    for p in [*pieces, None]:
        if p is not None and len(p) < size:
            small.append(p)
            continue
        if small:
            out += pack_pieces(small, glue, size, overlap)
            small = []
        if p is not None:
            out += split_text(p, size, overlap, later, keep) if later else [p]
    return out


def splitter(separators: tuple[str, ...], overlap: int, keep: bool = False):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, int(n), overlap, separators, keep) for t, n in zip(texts, sizes, strict=True)])

    return split


def adaptive_size(text: Column, size: Column | int) -> Column:
    """A third more for text that looks like a schedule or table at its start."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.substring(text, 1, 500).rlike(SCHEDULE_MARKERS), F.floor(size * 1.35)).otherwise(size).cast("int")


def merge_fragments(pieces: Column) -> Column:
    """Fragments under 40 characters go before the next piece; what is left at the end goes after the last one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        t, held, done = strip(x), acc["held"], acc["done"]
        small = F.length(t) < LEAST_FRAGMENT
        joined = F.when(held == "", t).otherwise(strip(F.concat(held, F.lit(" "), t)))
        full = F.when(held == "", x).otherwise(F.concat(held, F.lit("\n"), x))
        return F.when(t == "", acc).when(small, F.struct(done.alias("done"), joined.alias("held"))).otherwise(F.struct(F.concat(done, F.array(full)).alias("done"), F.lit("").alias("held")))

    def finish(acc: Column) -> Column:
        done, held = acc["done"], acc["held"]
        last = F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit("\n"), held))
        return F.when(held == "", done).when(F.size(done) == 0, F.array(held)).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), last))

    return F.aggregate(pieces, start, step, finish)


def context_line(number: Column, title: Column, chapter: Column) -> Column:
    known = lambda c, *not_: F.when(~F.coalesce(c, F.lit("")).isin("", "N/A", *not_), c)
    line = F.concat_ws(" — ", F.concat(F.lit("Section "), known(number)), F.substring(known(title), 1, 80), F.concat(F.lit("["), F.substring(known(chapter, "Unknown Chapter"), 1, 60), F.lit("]")))
    return F.when(line == "", "").otherwise(F.concat(line, F.lit("\n")))


def split_chunks(chunks: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """One row per sub-chunk with parent_chunk_index, sub_chunk, total_chunks, chunk_source_strategy, chunk_char_length.

    Texts of at most their size pass as they are; only longer ones go through Arrow. For that ``chunks`` is read twice, so what is costly should be stored.
    """
    bound_batches(chunks.sparkSession)
    wanted = adaptive_size(F.col("text"), size)
    # the adaptive size is never under ``size``, so most texts need not be looked into
    fits = F.coalesce((F.length("text") <= size) | (F.length("text") <= wanted), F.lit(True))
    # a function of Python's is called for every row, whatever stands around it
    whole = chunks.where(fits).withColumns({"total_chunks": F.lit(1), "_i": F.lit(0), "_text": F.col("text")})
    cut = chunks.where(~fits).withColumn("_pieces", merge_fragments(splitter(LEGAL_SEPARATORS, overlap)(F.col("text"), wanted)))
    # an inner explode has Spark infer a filter on the pieces, which goes down to the tables and splits all texts a second time there
    cut = cut.withColumn("total_chunks", F.size("_pieces")).select("*", F.posexplode_outer("_pieces").alias("_i", "_text")).where("_i IS NOT NULL").drop("_pieces")
    rows = whole.unionByName(cut)
    prefix = F.when(F.col("_i") > 0, context_line(F.col("section_number"), F.col("section_title"), F.col("chapter"))).otherwise("")
    text = F.concat(prefix, F.col("_text"))
    rows = rows.withColumn("parent_chunk_index", F.col("chunk_index")).withColumn("sub_chunk", F.col("_i") + 1).withColumn("chunk_source_strategy", F.when(F.col("total_chunks") == 1, "passthrough").otherwise("recursive_legal"))
    return rows.withColumn("text", text).withColumn("chunk_char_length", F.length("text")).drop("_i", "_text")


def generic_size(text: Column) -> Column:
    """Window size of the plain fallback by the document's length."""
    return F.when(F.length(text) < 30_000, 600).when(F.length(text) > 150_000, 1200).otherwise(800)


def generic_chunks(docs: DataFrame, overlap: int = 100, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, chunk_index, text): plain windows of each document (doc_title, text), each after a line with its title; never none.

    Windows keep the separators that they begin with, inside. A document without anything but white space has one window of its first characters.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    pieces = splitter(PLAIN_SEPARATORS, overlap, keep=True)(text, generic_size(text))
    whole = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substr(text, F.lit(1), generic_size(text))))
    title = F.concat(F.lit("["), F.coalesce("doc_title", F.lit("")), F.lit("]\n"))
    return docs.select(*by, title.alias("_title"), F.posexplode(whole).alias("_i", "_text")).select(*by, (F.col("_i") + 1).alias("chunk_index"), F.concat("_title", "_text").alias("text"))
