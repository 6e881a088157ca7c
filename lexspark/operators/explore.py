"""Chunk explorer: projections, labels, filters, ordering, pages, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_footer_leak

DEFAULTS = {"chapter": "Unknown", "doc_title": "Unknown", "doc_type": "Unknown", "law_code": "Unknown", "year": "Unknown", "source": "Unknown", "section_title": "", "type": "Unknown", "order": "Unknown", "order_title": "", "rule": "Unknown", "rule_title": ""}  # fixed values


def project(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The explorer's columns with their defaults, length, has_footer and display_id; columns that ``chunks`` lacks take the default."""
    have = lambda name, default: F.coalesce(F.col(f"`{name}`"), default) if name in chunks.columns else default
    section = have("section_number", have("section", F.lit("Unknown"))).cast("string")
    text = F.coalesce("text", F.lit(""))
    out = chunks.select(
        F.col(id_col).alias("id"),
        section.alias("section"),
        *[have(c, F.lit(d)).alias(c) for c, d in DEFAULTS.items()],
        have("chunk_index", F.lit(0)).alias("chunk_index"),
        have("total_chunks", F.lit(0)).alias("total_chunks"),
        text.alias("text"),
        F.length(text).alias("length"),
        has_footer_leak(text).alias("has_footer"),
    )
    return out.withColumn("display_id", display_id())


def display_id() -> Column:
    return F.when(F.col("type") == "rule", F.concat(F.lit("Order "), F.col("order"), F.lit(" Rule "), F.col("rule"))).otherwise(F.concat(F.lit("Section "), F.col("section")))


def law_label() -> Column:
    """The title, else code and year; with the source's file name in brackets where known."""
    titled = F.when(~F.col("doc_title").isin("Unknown", ""), F.col("doc_title")).otherwise(F.concat_ws(" ", "law_code", "year"))
    name = F.regexp_extract("source", r"([^/\\]+)$", 1)
    return F.when(F.col("source").isin("Unknown", ""), titled).otherwise(F.concat(titled, F.lit(" ["), name, F.lit("]")))


def leading_number(text: Column, missing: int) -> Column:
    n = F.regexp_extract(text, r"^(\d+)", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.lit(missing).cast("long"))


def sort_keys() -> list[Column]:
    """Sections before rules; sections by number, text, place; rules by order, number, place; what has no number last."""
    rule = F.col("type") == "rule"
    return [
        rule.cast("int"),
        F.when(rule, F.col("order")),
        F.when(rule, leading_number(F.col("rule"), 999)).otherwise(leading_number(F.col("section"), 9999)),
        F.when(~rule, F.col("section")),
        F.col("chunk_index"),
        F.col("id"),
    ]


def cascade(rows: DataFrame, law: str = "All", chapter: str = "All") -> DataFrame:
    """Equality filters that "All" switches off."""
    if law != "All":
        rows = rows.where(law_label() == law)
    return rows.where(F.col("chapter") == chapter) if chapter != "All" else rows


def search(rows: DataFrame, text: str, section: str | None = None) -> DataFrame:
    """Rows whose text holds the words, or whose id does, whatever the case; with ``section``, a column, that must equal the words instead of the id."""
    words = F.lit(text.lower())
    other = F.contains(F.lower(F.col("id").cast("string")), words) if section is None else F.lower(section) == words
    return rows.where(F.contains(F.lower("text"), words) | F.coalesce(other, F.lit(False)))


def outcome(judged: DataFrame, which: str = "All") -> DataFrame:
    """Judged rows (passed), "All", "Passed" or "Failed" of them; a null outcome is a failure."""
    passed = F.coalesce("passed", F.lit(False))
    return judged if which == "All" else judged.where(passed if which == "Passed" else ~passed)


def unit(rows: DataFrame, display: str) -> DataFrame:
    return rows.where(F.lower("display_id") == display.lower())


def flagged(rows: DataFrame, law: str = "All", text: str = "") -> DataFrame:
    rows = cascade(rows.where("has_footer"), law)
    return search(rows, text) if text else rows


def page(rows: DataFrame, number: int, order: list[Column], size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) in the order given."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def n_pages(rows: DataFrame, size: int = 10) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"), F.floor(F.avg("length")).cast("long").alias("mean_length"), F.count_if("has_footer").alias("footers"), F.count_if(F.col("section").isin("Unknown", "N/A")).alias("unnumbered"))


def counts(rows: DataFrame, by: Column | str, name: str = "value") -> DataFrame:
    """(name, chunks), largest first."""
    by = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), name)


def length_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("length").agg(F.count("*").alias("chunks")).orderBy("length")


def tagged_values(rows: DataFrame, columns: tuple[str, ...] = ("law_code", "doc_title")) -> DataFrame:
    """Distinct (tag, value) of several columns in one pass."""
    tags = F.explode(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(tags.alias("t")).select("t.*").where("value IS NOT NULL").distinct()


def first_seen(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values in the order in which they are seen first."""
    return rows.groupBy(value).agg(F.min(place).alias("first_place")).orderBy("first_place", value)


def latest(rows: DataFrame, by: str, n: int = 50, key: str = "id") -> DataFrame:
    """The n newest rows; ties to the smaller key."""
    return rows.orderBy(F.desc(by), key).limit(n)


def sample(rows: DataFrame, n: int = 100, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows in an order that a hash of key and seed gives; the same for every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def newest_per_group(rows: DataFrame, group: str, by: str, n: int, key: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(by), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
