"""Per-act source profiles: each act's cleaning rules, split pattern and chunk sizes as data, for one shared parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import apply_rules, strip
from ..schema import NOT_AVAILABLE, UNKNOWN_CHAPTER, UNKNOWN_PART
from .parse import definitions, running
from .split import PLAIN_SEPARATORS, splitter

# ---- fixed values: rules, patterns and page ranges of the acts -----------------------------------------------------

PAGE_NUMBER = (r"(?md)^\s*\d+\s*$", "")
BLANKS = (r"\n{3,}", "\n\n")
GAZETTE_LINE = (r"(?imd)^.*THE GAZETTE OF INDIA.*$", "")
PART_TAG = (r"(?i)\[?PART\s+[IVX]+[—\-\]]?", "")
SEC_TAG = (r"(?i)SEC\.\s*\d+[A-Z]?(\(\w+\))?\]?", "")
CODE_PAGES = (("COW", "2019", 8, 36), ("IRC", "2020", 37, 92), ("CSS", "2020", 93, 209), ("OSH", "2020", 210, 294))
CODE_TITLES = ("THE CODE ON WAGES, 2019", "THE INDUSTRIAL RELATIONS CODE, 2020", "THE CODE ON SOCIAL SECURITY, 2020", "THE OCCUPATIONAL SAFETY, HEALTH AND WORKING CONDITIONS CODE, 2020")


@dataclass(frozen=True)
class Profile:
    """How one act is read. ``starts``: the text begins at the first of these that occurs. ``back_to``: at the last such word up to 200 characters before."""

    law_code: str
    year: str
    rules: tuple[tuple[str, str], ...]
    starts: tuple[str, ...] = ()
    back_to: str = ""
    split: str = r"(?=\n\s*\d+\.\s)"
    titled: bool = True
    least: int = 50
    size: int = 600
    overlap: int = 50
    chapter: str = r"(?d)(CHAPTER\s*[IVXLCDMivxlcdm]+)\s*\n+(.*?)(?=\n|\z)"


BNS = Profile("BNS", "2023", ((r"(?s)vlk/kkj\.k.*?CG-DL-E-\d+-\d+", ""), (r"_+", ""), ("THE GAZETTE OF INDIA EXTRAORDINARY", ""), (r"\[?Part II—", ""), (r"Sec\.\s*\d+\]?", ""), PAGE_NUMBER, BLANKS), size=300, overlap=30)
RTI = Profile("RTI", "2005", ((r"(?s)ARRANGEMENT OF SECTIONS.*?(?=CHAPTER I)", ""), ("THE RIGHT TO INFORMATION ACT, 2005", ""), PAGE_NUMBER, (r"_+", ""), BLANKS), starts=("An Act to provide for setting out the practical regime",), back_to="THE RIGHT TO INFORMATION ACT, 2005")
CPA = Profile(
    "CPA", "2019",
    (GAZETTE_LINE, PART_TAG, SEC_TAG, (r"(?is)ARRANGEMENT OF SECTIONS.*?CHAPTER I", "CHAPTER I"), (r"(?i)THE CONSUMER PROTECTION ACT,?\s*2019", ""), PAGE_NUMBER, (r"\r", "\n"), BLANKS, (r"(?i)Short title,?\s*extent,?\s*commencement\s*and\s*application\.?", "")),
    starts=(r"(?i)CHAPTER\s+I\s*\n*PRELIMINARY", r"(?i)1\.\s*\(1\)\s*This Act may be called"), split=r"(?=\n\s*\d{1,3}[A-Z]?\.\s)", titled=False,
)
LABOUR = Profile(
    "LABOUR", "2020",
    (GAZETTE_LINE, (r"(?imd)^.*MINISTRY OF LAW AND JUSTICE.*$", ""), PART_TAG, SEC_TAG, PAGE_NUMBER, (r"\r", "\n"), BLANKS),
    starts=(r"(?i)1\.\s*\(\s*1\s*\)\s*This\s+(Act|Code)\s+may\s+be\s+called",), back_to="CHAPTER",
    split=r"(?i)(?=\n\s*CHAPTER\s+[IVXLCDM]+\b|\n\s*\d{1,3}[A-Z]?\.\s|\n\s*THE\s+[A-Z]+\s+SCHEDULE|\n\s*SCHEDULE\b)", titled=False,
)
PROFILES = {p.law_code: p for p in (BNS, RTI, CPA, LABOUR)}


def clean(text: Column, profile: Profile, reach: int = 200) -> Column:
    """The act's rules, then its text from its start. The starts of RTI stand in text that its rules would delete, so they are looked for first."""
    first = profile is RTI
    text = text if first else apply_rules(text, profile.rules)
    out = text
    for start in reversed(profile.starts):
        at = F.regexp_instr(text, F.lit(start))
        begin = at
        if profile.back_to:
            before = F.upper(F.substr(text, F.lit(1), at - 1))
            back = F.length(before) - F.locate(profile.back_to.upper()[::-1], F.reverse(before)) - len(profile.back_to) + 2
            near = F.locate(profile.back_to.upper()[::-1], F.reverse(before)) > 0
            begin = F.when(near & ((at - back < reach) | F.lit(first)), back).otherwise(at)
        out = F.when(at > 0, F.substr(text, begin)).otherwise(out)
    return strip(apply_rules(out, profile.rules) if first else out)


def chunks(docs: DataFrame, profile: Profile) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text) by an act's profile: sections with their running chapter, split with overlap, prefixed.

    Blocks without a section number of at most ``least`` characters are dropped, longer ones have the number N/A.
    """
    rows = docs.select("doc_id", clean(F.col("text"), profile).alias("text"))
    blocks = rows.select("doc_id", F.posexplode(F.split("text", profile.split)).alias("pos", "block")).withColumn("block", strip(F.col("block"))).where("block <> ''")
    name = F.when(F.col("block").rlike(profile.chapter), F.concat(F.regexp_extract("block", profile.chapter, 1), F.lit(" - "), F.trim(F.regexp_extract("block", profile.chapter, 2))))
    own = Window.partitionBy("doc_id").orderBy("pos")
    blocks = blocks.withColumn("chapter", running(name, own, UNKNOWN_CHAPTER)).withColumn("block", strip(F.regexp_replace("block", profile.chapter, "")))
    schedule = r"(?is)^(THE\s+[A-Z]+\s+SCHEDULE|SCHEDULE)\s*(.*)"
    titled, plain = r"(?s)^(\d+[A-Z]?)\.\s*(.*?)(?:\.—|\.–|\.-|\.\s*-|\n)(.*)", r"(?s)^(\d+[A-Z]?)\.\s*(.+)"
    form = titled if profile.titled else plain
    number = F.coalesce(F.nullif(F.regexp_extract("block", form, 1), F.lit("")), F.nullif(F.upper(F.trim(F.regexp_extract("block", schedule, 1))), F.lit("")) if profile is LABOUR else F.lit(None))
    title = strip(F.regexp_extract("block", titled, 2)) if profile.titled else F.lit(NOT_AVAILABLE)
    body = F.when(F.col("block").rlike(form), strip(F.regexp_extract("block", form, 3 if profile.titled else 2))).when(F.lit(profile is LABOUR) & F.col("block").rlike(schedule), strip(F.regexp_extract("block", schedule, 2))).otherwise(F.col("block"))
    rows = blocks.select("doc_id", "pos", "chapter", F.coalesce(number, F.lit(NOT_AVAILABLE)).alias("section_number"), F.when(number.isNotNull(), title).otherwise(NOT_AVAILABLE).alias("section_title"), body.alias("body"))
    rows = rows.where((F.col("section_number") != NOT_AVAILABLE) | (F.length("body") > profile.least))
    parts = splitter(PLAIN_SEPARATORS, profile.overlap, keep=True)(F.col("body"), F.lit(profile.size))
    rows = rows.withColumn("_parts", parts).withColumn("total_chunks", F.size("_parts")).select("*", F.posexplode("_parts").alias("_i", "_text"))
    law = F.lit(f"[{profile.law_code} {profile.year}] [")
    named = F.concat(F.lit("] Section "), F.col("section_number"), F.when(F.col("section_title") != NOT_AVAILABLE, F.concat(F.lit(" ["), "section_title", F.lit("]"))).otherwise(""), F.lit(": "))
    text = F.concat(law, F.col("chapter"), F.when(F.col("section_number") != NOT_AVAILABLE, named).otherwise("] "), F.col("_text"))
    return rows.select("doc_id", F.lit(profile.law_code).alias("law_code"), F.lit(profile.year).alias("year"), "chapter", "section_number", "section_title", "pos", (F.col("_i") + 1).alias("chunk_index"), "total_chunks", text.alias("text"))


def split_compendium(docs: DataFrame, titles: tuple[str, ...] = CODE_TITLES) -> DataFrame:
    """(doc_id, title, text) of a compendium's acts, from each title to the next; titles that don't occur give no row."""
    places = F.array_sort(F.filter(F.array(*[F.struct(F.instr(F.col("text"), t).alias("at"), F.lit(t).alias("title")) for t in titles]), lambda s: s["at"] > 0))
    rows = docs.select("doc_id", "text", F.posexplode(places).alias("i", "s")).withColumn("next", F.lead("s.at").over(Window.partitionBy("doc_id").orderBy("i")))
    end = F.coalesce("next", F.length("text") + 1)
    return rows.select("doc_id", F.col("s.title").alias("title"), F.substr("text", F.col("s.at"), end - F.col("s.at")).alias("text"))


# ---- the Code of Civil Procedure: sections under parts, defined terms, and a schedule of orders and rules ------------

# fixed values of the act: replacements, rules, words of footnotes, heads
CPC_REPLACEMENTS = (("ù", " "), ("\uf0b7", " "), ("\u2013", "-"), ("\u2014", "--"))
CPC_FOOTNOTE = r"(Subs\.|Ins\.|Omitted|w\.e\.f\.|ibid\.|A\.O\.|Rep\.|amended in its application|extended to .{1,40} by Act|extended to the .{1,40} by)"
CPC_RULES = ((r"\n\s*\d{1,4}\s*\n", "\n"), (r"_+", ""), (r" {2,}", " "), BLANKS, (r"(?id)\n\s*\d{1,2}\.\s+(?=[^\[\n]*?" + CPC_FOOTNOTE + r")[^\n]+", ""))
CPC_SECTION = r"(?=\n\s*\*?\[?\d{1,3}[A-Z]?\.(?:\s+|[A-Z]))"
CPC_RULE = r"(?=\n\s*\*?\[?\d+[A-Z]?\.(?:\s+|[A-Z]))"
CPC_PART = r"(?d)(PART\s+[IVXLCDM]+)\s*\n+(.*)"
CPC_HEAD = r"(?sd)^\*?\[?(\d+[A-Z]?)\.\s*(.*)"
CPC_ORDER = r"(?id)^\[?ORDER\s+([IVXLCDM]+[A-Z]?)\s+(.*)"
CPC_SIZE, CPC_OVERLAP, CPC_LEAST_SECTION, CPC_LEAST_RULE = 800, 100, 50, 20


def civil_clean(text: Column) -> Column:
    """Cleaned text of the act from behind its contents: from a PRELIMINARY that no SECTIONS follows, else from the second "1. Short title", else all of it."""
    for old, new in CPC_REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = strip(apply_rules(text, CPC_RULES))
    real = F.regexp_instr(text, F.lit(r"\nPRELIMINARY\s*\n(?!SECTIONS)"))
    first = F.regexp_instr(text, F.lit(r"\n\s*1\.\s+Short title"))
    behind = F.substr(text, first + 1)
    second = F.regexp_instr(behind, F.lit(r"\n\s*1\.\s+Short title"))
    return F.when(real > 0, F.substr(text, real)).when((first > 0) & (second > 0), F.substr(behind, second)).otherwise(text)


def civil_split(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``main`` and ``schedule``: the schedule begins at its heading, or main ends at an appendix where there is none."""
    at, forms = (F.regexp_instr("text", F.lit(p)) for p in (r"(?i)\nTHE FIRST SCHEDULE", r"(?i)\nAPPENDIX\s+[A-D]"))
    end = F.when(at > 0, at).when(forms > 0, forms)
    schedule = F.when(at > 0, F.substr("text", at)).otherwise("")
    cut = F.regexp_instr(schedule, F.lit(r"\nAPPENDIX\s+[A-D]\s*\n"))
    return docs.select("doc_id", F.when(end.isNotNull(), F.substr("text", F.lit(1), end - 1)).otherwise(F.col("text")).alias("main"), F.when(cut > 0, F.substr(schedule, F.lit(1), cut - 1)).otherwise(schedule).alias("schedule"))


def split_body(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """``rows`` by windows of their ``body``: chunk_index, total_chunks, chunk."""
    parts = splitter(PLAIN_SEPARATORS, overlap, keep=True)(F.col("body"), F.lit(size))
    rows = rows.withColumn("_parts", parts).withColumn("total_chunks", F.size("_parts"))
    return rows.select("*", F.posexplode("_parts").alias("_i", "chunk")).withColumn("chunk_index", F.col("_i") + 1).drop("_parts", "_i")


def civil_sections(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of sections, defined terms) of ``docs`` (doc_id, main). A part heading labels the block that holds it and those after it."""
    blocks = docs.select("doc_id", F.posexplode(F.split("main", CPC_SECTION)).alias("pos", "block")).withColumn("block", strip(F.col("block"))).where("block <> ''")
    name = F.when(F.col("block").rlike(CPC_PART), F.concat(F.regexp_extract("block", CPC_PART, 1), F.lit(" - "), F.trim(F.regexp_extract("block", CPC_PART, 2))))
    blocks = blocks.withColumn("chapter", running(name, Window.partitionBy("doc_id").orderBy("pos"), UNKNOWN_PART))
    heading = r"(?d)PART\s+[IVXLCDM]+\s*\n+.*?\n"
    at = F.regexp_instr("block", F.lit(heading))
    less = strip(F.concat(F.substr("block", F.lit(1), at - 1), F.substr("block", at + F.length(F.regexp_extract("block", heading, 0)))))
    blocks = blocks.withColumn("block", F.when(F.col("block").rlike(CPC_PART) & (at > 0), less).otherwise(F.col("block")))
    rows = blocks.select("doc_id", "pos", "chapter", F.regexp_extract("block", CPC_HEAD, 1).alias("section_number"), strip(F.regexp_extract("block", CPC_HEAD, 2)).alias("body")).where("section_number <> ''")
    rows = rows.where(F.length("body") >= CPC_LEAST_SECTION).withColumn("section_title", strip(F.regexp_extract("body", r"^([^\n(]+)", 1)))
    head = F.concat(F.lit("[CPC 1908] ["), "chapter", F.lit("] Section "), "section_number", F.lit(" — "), "section_title", F.lit("\n"))
    terms = definitions(rows.withColumnRenamed("body", "text"))
    told = terms.withColumn("text", F.concat(head, F.lit("Clause ("), "clause", F.lit(') "'), "term", F.lit('": '), "text"))
    plain = split_body(rows.join(terms.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti"), CPC_SIZE, CPC_OVERLAP)
    return plain.withColumn("type", F.lit("section")).withColumn("text", F.concat(head, "chunk")).drop("body", "chunk"), told


def civil_rules(docs: DataFrame) -> DataFrame:
    """Chunks of the rules in the orders of ``docs`` (doc_id, schedule). An order whose first line holds nothing but its number is passed over."""
    orders = docs.select("doc_id", F.posexplode(F.split("schedule", r"(?=\n\[?ORDER\s+[IVXLCDM]+[A-Z]?)")).alias("order_no", "block")).withColumn("block", F.ltrim("block", F.lit("\n")))
    line = F.substring_index("block", "\n", 1)
    orders = orders.withColumn("order", F.regexp_extract(line, CPC_ORDER, 1)).where("order <> ''")
    orders = orders.withColumn("order_title", strip(F.regexp_extract("block", r"(?d)ORDER\s+[IVXLCDM]+[A-Z]?\s*\n+(.*?)(?:\nRULES|\n\d+\.)", 1)))
    rules = orders.select("doc_id", "order_no", "order", "order_title", F.posexplode(F.split("block", CPC_RULE)).alias("pos", "block")).withColumn("block", strip(F.col("block")))
    rules = rules.select("doc_id", "order_no", "order", "order_title", "pos", F.regexp_extract("block", CPC_HEAD, 1).alias("rule"), strip(F.regexp_extract("block", CPC_HEAD, 2)).alias("body")).where("rule <> ''")
    rules = split_body(rules.where(F.length("body") >= CPC_LEAST_RULE).withColumn("rule_title", strip(F.regexp_extract("body", r"^([^\n.]+)", 1))), CPC_SIZE, CPC_OVERLAP)
    order = F.concat(F.lit("Order "), "order", F.lit(" — "), "order_title")
    text = F.concat(F.lit("[CPC 1908] "), order, F.lit("\nRule "), "rule", F.lit(" — "), "rule_title", F.lit("\n"), "chunk")
    number = F.concat(F.lit("O"), "order", F.lit(" R"), "rule")
    return rules.select("*", F.lit("rule").alias("type"), order.alias("chapter"), number.alias("section_number"), text.alias("text")).drop("body", "chunk")


def civil_procedure(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text) as the Code of Civil Procedure: type section, definition or rule."""
    parts = civil_split(docs.select("doc_id", civil_clean(F.col("text")).alias("text")))
    plain, terms = civil_sections(parts)
    out = plain.unionByName(terms, allowMissingColumns=True).unionByName(civil_rules(parts), allowMissingColumns=True)
    return out.withColumn("law_code", F.lit("CPC")).withColumn("year", F.lit("1908"))
