"""Text functions, Column to Column. Patterns are in Java's dialect, with (?d) where only line feeds end lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: replacements, patterns and anchors of the cleaning rules ----------------------------------------

REPLACEMENTS = (
    ("\u00f9", " "),
    ("\uf0b7", " "),
    ("\u2013", "-"),
    ("\u2014", "--"),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
)
FOOTNOTE_WORDS = r"(?:Subs\.|Ins\.|Omitted|w\.e\.f\.|ibid\.|A\.O\.|Rep\.|amended in its application|extended to .{1,40} by Act|extended to the .{1,40} by|vide notification|Gazette of India)"
CLEANING_RULES = (
    (r"\n\s*\d{1,4}\s*\n", "\n"),
    (r"_+", ""),
    (r" {2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?imd)^.*THE GAZETTE OF INDIA.*$", ""),
    (r"(?imd)^.*MINISTRY OF LAW AND JUSTICE.*$", ""),
    (r"(?i)SEC\.\s*\d+[A-Z]?(\(\w+\))?\]?", ""),
    (r"(?id)\n\s*\d{1,2}\.\s+(?=[^\[\n]*?" + FOOTNOTE_WORDS + r")[^\n]+(?:\n(?!\s*(?:\(\w+\)\s|\d+\.\s))[^\n]+)*", ""),
)
BLANK_RULES = CLEANING_RULES[0], CLEANING_RULES[3]
FOOTNOTE_NEEDS = ("SUBS.", "INS.", "OMITTED", "W.E.F.", "IBID.", "A.O.", "REP.", "AMENDED IN ITS APPLICATION", "EXTENDED TO ", "VIDE NOTIFICATION", "GAZETTE OF INDIA")
RULE_NEEDS = dict(zip([p for p, _ in CLEANING_RULES], [(), ("_",), ("  ",), ("\n\n\n",), ("THE GAZETTE OF INDIA",), ("MINISTRY OF LAW AND JUSTICE",), ("SEC.",), FOOTNOTE_NEEDS], strict=True))  # one of them is in every text with a match, in some case
CONTENT_ANCHORS = (
    r"\nCHAPTER\s+[IVXLCDM]+\s*\n+PRELIMINARY\s*\n(?!\s*SECTIONS)",
    r"\nPRELIMINARY\s*\n(?!\s*SECTIONS)",
    r"\nCHAPTER\s+[IVXLCDM]+\s*\n+1\.\s+Short title",
    r"\n\s*1\.\s*\(1\)\s*This Act may be called",
    r"\n\s*1\.\s+Short title",
    r"\bWhereas\s+it\s+is\s+expedient\b",
)
ANCHOR_NEEDS = ("PRELIMINARY", "PRELIMINARY", "SHORT TITLE", "THIS ACT MAY BE CALLED", "SHORT TITLE", "WHEREAS")
TOC_MARKERS = ("ARRANGEMENT OF SECTIONS", "TABLE OF CONTENTS", r"CONTENTS\s*\n\s*SECTIONS", "LIST OF SECTIONS")
TOC_NEEDS = ("ARRANGEMENT OF SECTIONS", "TABLE OF CONTENTS", "CONTENTS", "LIST OF SECTIONS")
LEAK_WORDS = r"(?i)(Subs\.|Ins\.|Omitted|w\.e\.f\.|ibid\.|A\.O\.|Rep\.)"
SPECIFIC_QUERY = r"(?i)(section\s+\d+[A-Z]?|order\s+[IVXLCDM]+)"
TOKEN = r"[\p{L}\p{N}_]+"
AS_THEY_ARE = "\u2013\u2014\u2018\u2019\u201c\u201d\u2022"  # dashes, quotes and the bullet, which decomposition leaves alone as it does ASCII
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# ---- cleaning -----------------------------------------------------------------------------------------------------


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of ``words`` (in capitals) occurs, in any case."""
    if not any(c.isalpha() for w in words for c in w):
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return once(F.upper(text), lambda upper: reduce(lambda a, b: a | b, [F.contains(upper, F.lit(w)) for w in words]))


def apply_rules(text: Column, rules) -> Column:
    """``text`` after the replacements; a pattern goes only over texts that hold what every match of it needs."""

    def after(x: Column, pattern: str, by: str) -> Column:
        new, needs = F.regexp_replace(x, pattern, by), RULE_NEEDS.get(pattern)
        return F.when(holds(x, needs), new).otherwise(x) if needs else new

    for pattern, by in rules:
        text = once(text, lambda x: after(x, pattern, by))  # noqa: B023
    return text


def strip(text: Column) -> Column:
    """Without white space at both ends, which is looked at from the ends; a pattern would go over the whole text."""
    return F.trim(text, F.lit(WHITE_SPACE))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it.

    As a lambda's body it is not compiled into one method: a method of many patterns is too large for the virtual machine's compiler and runs many times slower.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Encoding repairs, page numbers, rules, running headers and embedded footnotes; the order of the steps matters."""

    def repaired(x: Column) -> Column:
        new = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REPLACEMENTS, x)
        return F.when(F.octet_length(x) > F.length(x), new).otherwise(x)  # all that is replaced is beyond ASCII

    return strip(apply_rules(once(text, repaired), CLEANING_RULES))


def filter_blank(text: Column) -> Column:
    return apply_rules(text, BLANK_RULES)


def remove_headers(text: Column, title: Column) -> Column:
    """Without every occurrence of the literal ``title``, whatever its case."""
    quoted = F.concat(F.lit(r"(?i)\Q"), title, F.lit(r"\E"))
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit("")))


def first_at(text: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 for none."""
    return F.regexp_instr(text, F.lit(pattern))


def suffix_from(text: Column, place: Column) -> Column:
    return F.substr(text, place)


def remove_toc(text: Column) -> Column:
    """From the first anchor that matches; else from the heading above a table's end; else unchanged.

    The second "1. Short title" of older rule sets cannot be reached, as the fifth anchor matches its first one.
    """

    def cut(x: Column) -> Column:
        out = x["text"]
        for marker, word in zip(reversed(TOC_MARKERS), reversed(TOC_NEEDS), strict=True):
            after = F.regexp_extract(x["text"], rf"(?is){marker}(.*)\z", 1)
            place = first_at(after, r"(?i)\nCHAPTER\s+I|\n\s*1\.\s")
            out = F.when(F.contains(x["upper"], F.lit(word)) & (first_at(x["text"], f"(?i){marker}") > 0) & (place > 0), suffix_from(after, place)).otherwise(out)
        for anchor, word in zip(reversed(CONTENT_ANCHORS), reversed(ANCHOR_NEEDS), strict=True):
            place = F.when(F.contains(x["upper"], F.lit(word)), first_at(x["text"], f"(?i){anchor}")).otherwise(0)
            out = once(place, lambda p: F.when(p > 0, suffix_from(x["text"], p)).otherwise(out))  # noqa: B023
        return out

    return once(F.struct(text.alias("text"), F.upper(text).alias("upper")), cut)


# ---- tokens, flags and labels -------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def has_footer_leak(text: Column) -> Column:
    return text.rlike(LEAK_WORDS)


def leaking_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(LEAK_WORDS))


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def section_mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"Section (\d+[A-Z]?):"), F.lit(1)))


def base_section(section: Column) -> Column:
    """First run of digits; else lower case without the word section and spaces."""
    digits = F.regexp_extract(section, r"(\d+)", 1)
    rest = F.trim(F.replace(F.replace(F.lower(section), F.lit("section"), F.lit("")), F.lit(" "), F.lit("")))
    return F.when(digits != "", digits).otherwise(rest)


def is_specific_query(question: Column) -> Column:
    return question.rlike(SPECIFIC_QUERY)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def law_code(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_stem(path), r"^([A-Za-z]+)_(\d{4})", 1), F.lit(""))


def law_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_stem(path), r"^([A-Za-z]+)_(\d{4})", 2), F.lit(""))


def title_from_path(path: Column) -> Column:
    return F.replace(file_stem(path), F.lit("_"), F.lit(" "))


def document_title(text: Column) -> Column:
    """An act's title in the first 2000 characters; else the first line of over 10 in the first 500; else a constant."""
    act = F.regexp_extract(F.substring(text, 1, 2000), r"(THE\s+[A-Z][A-Z\s,'\-]+ACT,?\s+\d{4})", 1)
    line = F.try_element_at(F.filter(F.transform(F.split(F.substring(text, 1, 500), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 10), F.lit(1))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(act, r"\s+", " ")), F.lit("")), line, F.lit("Unknown Document"))


def json_object(text: Column) -> Column:
    """The JSON object in free text: a fenced block's, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalise(text: Column) -> Column:
    """Compatibility decomposition, lower case, single spaces. Spark has no NFKD, so texts with characters that it may change pass through Arrow, nulls in place of the others.

    Single spaces are left as they are, not put in again one by one; after that white space is spaces only.
    """
    wide = lambda t: F.octet_length(t) > F.length(t)
    # the dash that headings have is put aside first, as most texts are plain then and need not be translated
    some = wide(F.replace(text, F.lit("\u2014"), F.lit("-")))
    changed = F.when(some, F.when(wide(F.translate(text, AS_THEY_ARE, "-" * len(AS_THEY_ARE))), text))
    lower = F.lower(F.coalesce(_nfkd(changed), text))
    spaced = F.when(some, F.regexp_replace(lower, r"(?U)\s{2,}|[\s&&[^ ]]", " ")).otherwise(F.regexp_replace(lower, r"\s{2,}|[\t\n\x0B\f\r]", " "))
    return F.trim(spaced)
