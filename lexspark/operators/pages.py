"""From page layouts to document text: footer rules, footnote strips, crops and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FOOTNOTE_WORDS

PAGE = ["doc_id", "page_num"]


def separators(drawings: DataFrame, least_width: float = 50, most_width_share: float | None = 0.45, least_y_share: float = 0.30, most: int | None = 2) -> DataFrame:
    """The footer rule of each page (doc_id, page_num, sep_y): the highest of its one or two short horizontal lines below ``least_y_share``.

    With ``most_width_share`` and ``most`` None and 0.40 it is the older rule without upper bounds.
    """
    flat = (F.abs(F.col("y0") - F.col("y1")) < 2) & (F.col("width") > least_width) & (F.col("y0") > F.col("page_height") * least_y_share)
    if most_width_share is not None:
        flat &= F.col("width") < F.col("page_width") * most_width_share
    found = drawings.where(flat).groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("y0").alias("sep_y"))
    return found.where(F.col("n") <= most if most is not None else F.lit(True)).select(*PAGE, "sep_y")


def cut_footers(lines: DataFrame, rules: DataFrame, least_size: float = 8.0) -> DataFrame:
    """Lines above their page's footer rule, with ``text`` of their spans of at least ``least_size`` points."""
    text = F.array_join(F.transform(F.filter("spans", lambda s: s["size"] >= least_size), lambda s: s["text"]), "")
    above = lines.join(rules, PAGE, "left").where(F.col("sep_y").isNull() | (F.col("y0") < F.col("sep_y")))
    return above.withColumn("text", text).drop("sep_y")


def is_footnote(line: Column) -> Column:
    t = F.trim(line)
    words = t.rlike("(?i)" + FOOTNOTE_WORDS)
    return (t == "") | (t.rlike(r"^\d{1,2}\.\s") & words & ~t.contains("[")) | (t.startswith("*") & words)


def strip_trailing_footnotes(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Without the longest run of footnote or blank lines at each page's end."""
    last = F.max(F.when(~is_footnote(F.col("text")), F.col(order))).over(Window.partitionBy(*PAGE))
    return lines.withColumn("_last", last).where(F.col(order) <= F.col("_last")).drop("_last")


def drop_after_footnote_span(blocks: DataFrame, most_size: float = 9.5) -> DataFrame:
    """Without the first block of a page that begins with a small numbered span, and all after it."""
    head = F.try_element_at("spans", F.lit(1))
    note = F.coalesce((head["size"] <= most_size) & head["text"].rlike(r"^\W*\d+\."), F.lit(False)).cast("int")
    before = Window.partitionBy(*PAGE).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_seen", F.max(note).over(before)).where("_seen = 0").drop("_seen")


def crop(lines: DataFrame, left: float = 50, right: float = 50, top: float = 72, bottom: float = 72) -> DataFrame:
    """Lines (x0, x1, y0, y1, page_width, page_height) inside the page's margins."""
    return lines.where((F.col("x0") >= left) & (F.col("x1") <= F.col("page_width") - right) & (F.col("y0") >= top) & (F.col("y1") <= F.col("page_height") - bottom))


def page_text(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(doc_id, page_num, text) from lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def slice_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with the name of each range (name, first_page, last_page: a handful of rows) that holds them."""
    return pages.join(F.broadcast(ranges), F.col("page_num").between(F.col("first_page"), F.col("last_page")))
