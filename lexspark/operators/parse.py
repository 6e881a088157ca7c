"""From document text to section and rule chunks, with running chapter, part and order state as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, strip
from ..schema import NOT_AVAILABLE, UNKNOWN_CHAPTER, UNKNOWN_ORDER, UNKNOWN_PART
from .detect import SECTION_PATTERNS

# ---- fixed values: heading and section-head patterns --------------------------------------------------------------

CHAPTER_PATTERNS = (
    r"(CHAPTER\s+[IVXLCDM]+)\s*\n+(.*?)(?=\n|\z)",
    r"(CHAPTER\s+\d+)\s*[-–—]\s*(.*?)(?=\n|\z)",
)
PART_PATTERNS = (
    r"(PART\s+[IVXLCDM]+)\s*\n+(.*?)(?=\n|\z)",
    r"(PART\s+[A-Z])\s*[-–—]\s*(.*?)(?=\n|\z)",
)
ORDER_PATTERN = r"(?m)^\[?(ORDER\s+[IVXLCDM]+[A-Z]?)\b"
SPLITS_TITLE = r"(?:\.[—–]|\.[\-]+|[\-]{2,}|\.\s*\n)"
SECTION_HEADS = (
    (r"^\d+\[(\d+[A-Z]?)\.\s*([^\n]{0,200}?)" + SPLITS_TITLE + r"(.*)", 3),
    (r"^\d+\[(\d+[A-Z]?)\.\s*([^\n(]{0,200})\n(.*)", 3),
    (r"^\d+\[(\d+[A-Z]?)\.\s*(\(.*)", 2),
    (r"^(\d+[A-Z]?)\.\s*([^\n]{0,200}?)" + SPLITS_TITLE + r"(.*)", 3),
    (r"^(\d+[A-Z]?)\.\s*([^\n(]{0,200})\n(.*)", 3),
    (r"^(\d+[A-Z]?)\.\s*(\(.*)", 2),
    (r"^\[(\d+[A-Z]?)\.\s*(.*)", 2),
    (r"^\*\[(\d+[A-Z]?)\.\s*(.*)", 2),
)
LEAST_CONTENT, LEAST_RAW = 30, 50


def split_blocks(docs: DataFrame, pattern: Column | str = SECTION_PATTERNS[0], by: tuple[str, ...] = ("doc_id",), along: tuple[str, ...] = ()) -> DataFrame:
    """(by, along, pos, block): texts split before each match of a look-ahead pattern (a column may give each row its own); blank parts are dropped."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    rows = docs.select(*by, *along, F.posexplode(F.split("text", pattern)).alias("pos", "block"))
    return rows.withColumn("block", strip(F.col("block"))).where("block <> ''")


def heading(block: Column, patterns: tuple[str, ...]) -> Column:
    """"G1 - G2" of the first pattern that matches, else null; a pattern with one group gives that."""
    found = []
    for p in patterns:
        java = "(?id)" + p
        one = F.trim(F.regexp_extract(block, java, 1))
        text = F.concat(one, F.lit(" - "), strip(F.regexp_extract(block, java, 2))) if p.count("(") - p.count("(?") - p.count("\\(") > 1 else one
        found.append(F.when(block.rlike(java), text))
    return F.coalesce(*found)


def without_heading(block: Column, patterns: tuple[str, ...]) -> Column:
    """``block`` less the first occurrence of the first pattern that matches."""
    out = block
    for p in reversed(patterns):
        java = "(?id)" + p
        cut = lambda place: strip(F.concat(F.substr(block, F.lit(1), place - 1), F.substr(block, place + F.length(F.regexp_extract(block, java, 0)))))  # noqa: B023, E731
        out = once(F.regexp_instr(block, F.lit(java)), lambda place: F.when(place > 0, cut(place)).otherwise(out))  # noqa: B023
    return out


def running(found: Column, window, default: str, deferred: bool = False) -> Column:
    """The last heading found up to this block; ``deferred``: up to the one before it."""
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if deferred else 0)
    return F.coalesce(F.last(found, ignorenulls=True).over(frame), F.lit(default))


def section_head(block: Column) -> Column:
    """struct<number, title, content> by the first head pattern that matches, else null. A number has a digit at least, so an empty one is no match."""

    def read(x: Column, pattern: str, groups: int, otherwise: Column) -> Column:
        java = "(?sd)" + pattern
        two = strip(F.regexp_extract(x, java, 2))

        def of(n: Column, title: Column, content: Column) -> Column:
            return F.struct(n.alias("number"), F.substring(title, 1, 200).alias("title"), content.alias("content"))

        def here(n: Column) -> Column:
            if groups == 3:
                return of(n, two, strip(F.regexp_extract(x, java, 3)))
            return once(two, lambda t: once(F.instr(t, "\n"), lambda at: F.when(at > 0, of(n, strip(F.substr(t, F.lit(1), at - 1)), strip(F.substr(t, at + 1)))).otherwise(of(n, t, t))))

        return once(F.regexp_extract(x, java, 1), lambda n: F.when(n != "", here(n)).otherwise(otherwise))

    def tried(x: Column, heads) -> Column:
        out = F.lit(None).cast("struct<number: string, title: string, content: string>")
        for pattern, groups in reversed(heads):
            out = read(x, pattern, groups, out)
        return out

    # a block is tried with the patterns that begin as it does
    noted, plain, marked = SECTION_HEADS[:3], SECTION_HEADS[3:6], SECTION_HEADS[6:]
    return once(block, lambda x: F.when(x.rlike(r"^\d+\["), tried(x, noted)).when(x.rlike(r"^\d"), tried(x, plain)).when(x.rlike(r"^\*?\["), tried(x, marked)))


def _facts(block: Column) -> Column:
    """struct of what a block tells by itself: reset and set of the schedule, chapter, part and order headings, the rest without chapter and part, and its section head.

    Headings are looked for only where their word occurs. A heading ends with its line, so taking it out makes no word of the ends.
    """

    def within(x: Column, word: str, found: Column) -> Column:
        return F.when(F.contains(x["upper"], F.lit(word)), found)

    def less(x: Column, text: Column, word: str, patterns: tuple[str, ...]) -> Column:
        return F.coalesce(within(x, word, without_heading(text, patterns)), text)

    def facts(x: Column) -> Column:
        reset = (F.contains(x["upper"], F.lit("PRELIMINARY")) | F.contains(x["upper"], F.lit("PART"))) & x["text"].rlike(r"(?imd)^\s*(?:PRELIMINARY|PART\s+[IVX]+)\s*$")
        begin = F.contains(x["upper"], F.lit("SCHEDULE")) & x["text"].rlike(r"(?imd)^\s*THE\s+FIRST\s+SCHEDULE\s*$")
        chapter = within(x, "CHAPTER", heading(x["text"], CHAPTER_PATTERNS))

        def rest(t: Column) -> Column:
            part = within(x, "PART", heading(t, PART_PATTERNS))
            own = lambda r: F.struct(reset.alias("reset"), begin.alias("begin"), chapter.alias("chapter"), part.alias("part"), within(x, "ORDER", heading(r, (ORDER_PATTERN,))).alias("order"), r.alias("rest"), section_head(r).alias("head"))
            return once(less(x, t, "PART", PART_PATTERNS), own)

        return once(less(x, x["text"], "CHAPTER", CHAPTER_PATTERNS), rest)

    return once(F.struct(block.alias("text"), F.upper(block).alias("upper")), facts)


def parse(docs: DataFrame, pattern: Column | str = SECTION_PATTERNS[0], by: tuple[str, ...] = ("doc_id",), heading_scope: str = "eager", title: str = "doc_title") -> DataFrame:
    """Chunks of ``docs`` (by, doc_title, doc_type, text).

    ``heading_scope`` "eager": a chapter or part heading labels the block that holds it, though it stands at that block's end; "deferred": the blocks
    after it. Orders count only once a first schedule has begun after some chunk, label the blocks after theirs, and are
    lost in a block that holds nothing else. A preliminary or part line ends the schedule and the order.
    """
    # rows without an id are no documents
    blocks = split_blocks(docs.dropna(subset=list(by)), pattern, by, ("doc_title", "doc_type"))
    own = Window.partitionBy(*by).orderBy("pos")
    late = heading_scope == "deferred"
    b = blocks.withColumn("_f", _facts(F.col("block"))).drop("block")
    whole = F.coalesce(F.length("_f.head.content") >= LEAST_CONTENT, F.lit(False))
    # of a block that is a section whatever the order, only the head is taken along
    b = b.select(*by, "pos", "doc_title", "doc_type", *[F.col(f"_f.{c}").alias(f"_{c}") for c in ("reset", "begin", "chapter", "part", "order", "head")], F.when(~whole | F.col("_f.order").isNotNull(), F.col("_f.rest")).alias("_rest"))
    # what a block would emit does not depend on the order but for its heading, so the first chunk's place is known before
    emits = F.coalesce(F.length("_head.content") >= LEAST_CONTENT, F.lit(False)) | F.coalesce(F.length("_rest") >= LEAST_RAW, F.lit(False))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_first": F.min(F.when(emits, F.col("pos"))).over(so_far), "chapter": running(F.col("_chapter"), own, UNKNOWN_CHAPTER, late), "part": running(F.col("_part"), own, UNKNOWN_PART, late)}).drop("_chapter", "_part")
    event = F.when(F.col("_begin") & (F.col("pos") > F.col("_first")), True).when(F.col("_reset"), False)
    b = b.withColumn("_schedule", F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(False)))
    b = b.withColumn("_order", F.when(F.col("_schedule"), F.col("_order")))
    ordered = F.col("_order").isNotNull()
    b = b.withColumn("body", F.when(ordered, without_heading(F.col("_rest"), (ORDER_PATTERN,))).otherwise(F.col("_rest")))
    # an order found takes effect from the next block on; a reset at once
    kept = F.when(F.col("body") != "", F.col("_order"))
    after = F.coalesce(kept, F.when(F.col("_reset"), F.lit(UNKNOWN_ORDER)))
    before = F.last(after, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_now", F.when(F.col("_reset"), F.lit(UNKNOWN_ORDER)).otherwise(F.coalesce(before, F.lit(UNKNOWN_ORDER))))
    b = b.where("body IS NULL OR body <> ''").withColumn("_head", F.when(ordered, section_head(F.col("body"))).otherwise(F.col("_head")))
    b = b.withColumn("_good", F.coalesce(F.length("_head.content") >= LEAST_CONTENT, F.lit(False)))
    good, rule = F.col("_good"), F.col("_good") & (F.col("_now") != UNKNOWN_ORDER)
    b = b.where(good | (F.length("body") >= LEAST_RAW)).withColumn("type", F.when(rule, "rule").when(good, "section").otherwise("raw"))
    rule = F.col("type") == "rule"
    n, t, c = F.col("_head.number"), F.col("_head.title"), F.col("_head.content")
    above = F.when(rule, F.col("_now")).otherwise(F.col("chapter"))
    called = F.when(good, F.concat(F.when(rule, "] Rule ").otherwise("] Section "), n, F.lit(" — "), t, F.lit("\n"), c)).otherwise(F.concat(F.lit("]\n"), F.col("body")))
    text = F.concat(F.lit("["), F.col(title), F.lit("] ["), above, called)
    path = F.when(rule, F.concat_ws(" > ", "chapter", "_now", F.concat(F.lit("Rule "), n))).when(good, F.concat_ws(" > ", "chapter", F.concat(F.lit("Section "), n))).otherwise(F.col("chapter"))
    return b.select(
        *by,
        "doc_title",
        "doc_type",
        "type",
        F.when(rule, F.lit(None)).when(good, n).otherwise(NOT_AVAILABLE).alias("section_number"),
        F.when(rule, F.lit(None)).when(good, t).otherwise(NOT_AVAILABLE).alias("section_title"),
        F.when(rule, F.col("_now")).alias("order"),
        F.when(rule, n).alias("rule"),
        F.when(rule, t).alias("rule_title"),
        "chapter",
        "part",
        path.alias("hierarchy_path"),
        F.row_number().over(own).alias("chunk_index"),
        F.when(good, "regex").otherwise("regex_fallback").alias("parse_strategy"),
        text.alias("text"),
    )


def is_definition_section(content: Column) -> Column:
    return content.rlike(r"\(\d+\)") & content.rlike("[\"“”].+?[\"“”]") & content.rlike(r"(?i)\b(means|includes)\b")


def definitions(chunks: DataFrame) -> DataFrame:
    """One row per defined term: clause, term, content, of the chunks that are definition sections."""
    pattern = "(?sid)\\n?\\s*\\((\\d+)\\)\\s*[\"“](.*?)[\"”](.*?)(means|includes|include)\\b\\s*(.*?)(?=\\n\\s*\\(\\d+\\)|\\z)"
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in range(1, 6)]
    each = chunks.where(is_definition_section(F.col("text"))).select("*", F.explode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])).alias("_d"))
    body = F.trim(F.concat(F.col("_d.g3"), F.col("_d.g4"), F.lit(" "), F.col("_d.g5")))
    return each.select(*[c for c in chunks.columns if c not in ("text", "clause", "term", "type")], F.lit("definition").alias("type"), F.col("_d.g1").alias("clause"), strip(F.col("_d.g2")).alias("term"), F.regexp_replace(body, r"[\s*]+\z", "").alias("text"))


def split_schedule(docs: DataFrame) -> DataFrame:
    """``docs`` with main and schedule texts: the schedule begins at its line, and ends before an appendix."""
    at = F.regexp_instr("text", F.lit(r"\nTHE FIRST SCHEDULE"))
    rest = F.substr("text", at)
    cut = F.regexp_instr(rest, F.lit(r"\nAPPENDIX\s+[A-D]\s*\n"))
    return docs.withColumn("main", F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text"))).withColumn("schedule", F.when(at > 0, F.when(cut > 0, F.substr(rest, F.lit(1), cut - 1)).otherwise(rest)).otherwise(""))


def order_rules(docs: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, order, pos, rule, text) of the rules in each order of the schedule."""
    orders = split_schedule(docs).select(*by, F.posexplode(F.split("schedule", r"(?=\n\[?ORDER\s+[IVXLCDM]+)")).alias("order_no", "block"))
    orders = orders.withColumn("order", F.regexp_extract("block", r"ORDER\s+([IVXLCDM]+[A-Z]?)", 1)).where("order <> ''")
    rules = orders.select(*by, "order_no", "order", F.posexplode(F.split("block", r"(?=\n\s*\*?\[?\d+[A-Z]?\.(?:\s+|[A-Z]))")).alias("pos", "text"))
    rule = F.regexp_extract(F.col("text"), r"^\s*\*?\[?(\d+[A-Z]?)\.", 1)
    return rules.withColumn("rule", rule).where("rule <> ''").withColumn("text", strip(F.col("text")))
