"""Chunks by a schema's own patterns: regular expressions in Python's dialect that a model gave, one schema a document.

Only what needs a document's patterns is done in Python (an Arrow function that cuts a text into blocks); running chapters and parts,
numbering and labels are windows and columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NOT_AVAILABLE, UNKNOWN_CHAPTER, UNKNOWN_PART
from .parse import running

# fixed values: patterns of schemas that name none, the plain head, ends of titles
DEFAULT_SECTION = r"(?=\n\s*\d{1,3}[A-Z]?\.\s)"
DEFAULT_HEAD = r"^(\d+[A-Z]?)\.\s*([^\n(]{0,200})"
PLAIN_HEAD = r"^(?:\d*\[)?\[?(\d+[A-Z]*)\.\s*(.*)"
TITLE_END = r"—|\.--|--|\n"
TITLE_CHARS = 200

PATTERNS = ("section_pattern", "chapter_pattern", "part_pattern", "title_extract_pattern")
BLOCKS = "array<struct<chapter: string, part: string, number: string, title: string, content: string>>"


@lru_cache(maxsize=4096)
def compiled(pattern: str | None, flags: int = 0) -> re.Pattern | None:
    """None for a missing pattern and for one that does not compile."""
    try:
        return re.compile(pattern, flags) if pattern else None
    except (re.error, TypeError):
        return None


def take_heading(block: str, pattern: re.Pattern | None) -> tuple[str | None, str]:
    """The heading in a block ("G1 - G2", a single group, or the whole match), and the block without it. A group that did not match is empty."""
    found = pattern.search(block) if pattern else None
    if not found:
        return None, block
    named = [g or "" for g in found.groups()[:2]] or [found[0]]
    return " - ".join(g.strip() for g in named), (block[: found.start()] + block[found.end() :]).strip()


def short_title(raw: str | None) -> str:
    return re.split(TITLE_END, raw or "", maxsplit=1)[0].strip()[:TITLE_CHARS]


def head_of(block: str, pattern: re.Pattern | None) -> tuple[str, str, str]:
    """(number, title, content) by the schema's head pattern, else by the plain one on the first line, else the block without a number."""
    if pattern and (found := pattern.match(block)):
        number, title = [*found.groups(), NOT_AVAILABLE, ""][:2] if found.re.groups != 1 else (found[1], "")
        content = block[found.end() :].strip() or (block.partition(".")[2].strip() if "." in block else block)
        return number or NOT_AVAILABLE, short_title(title), content
    line, _, rest = block.partition("\n")
    if found := re.match(PLAIN_HEAD, line.strip()):
        return found[1], short_title(found[2]), rest.strip()
    return NOT_AVAILABLE, "", block


def blocks_of(text: str | None, section: str | None, chapter: str | None, part: str | None, head: str | None) -> list[dict]:
    """Blocks of a text, in order. A block of headings only has no number. A section pattern that does not compile leaves the text whole."""
    text, cut = text or "", compiled(section or DEFAULT_SECTION)
    out = []
    for raw in cut.split(text) if cut else [text]:
        body = (raw or "").strip()
        if not body:
            continue
        chapter_found, body = take_heading(body, compiled(chapter, re.I))
        part_found, body = take_heading(body, compiled(part, re.I))
        number, title, content = head_of(body, compiled(head or DEFAULT_HEAD, re.S)) if body else (None, None, None)
        out.append({"chapter": chapter_found, "part": part_found, "number": number, "title": title, "content": content})
    return out


def cut_blocks(*columns: Column | str) -> Column:
    """BLOCKS of (text, the four PATTERNS)."""

    @F.pandas_udf(BLOCKS)
    def cut(text: pd.Series, section: pd.Series, chapter: pd.Series, part: pd.Series, head: pd.Series) -> pd.Series:
        rows = zip(text, section, chapter, part, head, strict=True)
        return pd.Series([blocks_of(*[v if isinstance(v, str) else None for v in row]) for row in rows])

    return cut(*columns)


def parse_by_schema(docs: DataFrame, schemas: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks, in the columns of ``parse.parse``, of the ``docs`` (by, doc_title, text) that have a schema (by, the four PATTERNS, year, doc_type).

    A heading labels the blocks after its own; blocks of headings alone give no chunk. Missing section and head patterns are the default ones, a
    missing document type is GENERIC. Empty and null texts give no chunks.
    """
    rows = docs.select(*by, "doc_title", "text").join(schemas.select(*by, *PATTERNS, "year", "doc_type"), list(by))
    cut = cut_blocks("text", *PATTERNS)
    b = rows.select(*by, "doc_title", F.coalesce("doc_type", F.lit("GENERIC")).alias("doc_type"), "year", F.posexplode(cut).alias("pos", "_b"))
    own = Window.partitionBy(*by).orderBy("pos")
    b = b.withColumn("chapter", running(F.col("_b.chapter"), own, UNKNOWN_CHAPTER, True)).withColumn("part", running(F.col("_b.part"), own, UNKNOWN_PART, True))
    b = b.where("_b.number IS NOT NULL")
    number, title, none = F.col("_b.number"), F.col("_b.title"), F.lit(None).cast("string")
    label = F.trim(F.concat_ws(" ", "doc_title", F.nullif("year", F.lit(""))))
    return b.select(
        *by,
        "doc_title",
        "doc_type",
        F.lit("section").alias("type"),
        number.alias("section_number"),
        title.alias("section_title"),
        *[none.alias(c) for c in ("order", "rule", "rule_title")],
        "chapter",
        "part",
        F.concat("chapter", F.lit(" > Section "), number).alias("hierarchy_path"),
        F.row_number().over(own).alias("chunk_index"),
        F.lit("schema").alias("parse_strategy"),
        F.concat(F.lit("["), label, F.lit("] ["), F.col("chapter"), F.lit("] Section "), number, F.lit(" — "), title, F.lit("\n"), F.col("_b.content")).alias("text"),
    )
