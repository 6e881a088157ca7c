"""Document type detection: windows, marker templates, penalties and boosts; segmentation; strategy and pattern choice."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_title, once, strip

# ---- fixed values: markers by document type, as patterns or (pattern, weight) --------------------------------------

ACT_TITLE = r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+ACT,?\s+\d{4}"
ACT_OR_CODE_TITLE = r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+(?:ACT|CODE),?\s+\d{4}"
ANNOTATION = r"\[(?:Ins\.|Subs\.|Omitted|Rep\.)\s+by"
GAZETTE = r"THE\s+GAZETTE\s+OF\s+INDIA"
ORDER_LINE = r"(?m)^ORDER\s+[IVXLCDM]+"
CHAPTER_LINE = r"(?m)^CHAPTER\s+[IVXLCDM]+"
PART_LINE = r"(?m)^PART\s+[IVXLCDM]+"
SECTION_LINE = r"(?m)^\s*\d{1,3}[A-Z]?\.\s+[A-Z]"
PRELIMINARY = r"CHAPTER\s+I\s*\n\s*PRELIMINARY"
MAY_BE_CALLED = r"(?m)^1\.\s*\(1\)\s*This\s+(?:Act|Code)\s+may\s+be\s+called"
IN_EXERCISE = r"In\s+exercise\s+of\s+the\s+powers?\s+conferred"
ENACTED = r"Be\s+it\s+enacted\s+by"

TEMPLATES = {
    "GAZETTE_ACT": {
        "title": [(GAZETTE, 2.0), r"MINISTRY\s+OF\s+LAW\s+AND\s+JUSTICE", r"MINISTRY\s+OF\s+(LABOUR|FINANCE|HOME|COMMERCE|HEALTH)", r"An\s+Act\s+to\b", r"No\.\s*\d+\s+of\s+\d{4}", ACT_TITLE, ENACTED, "EXTRAORDINARY", r"PART\s+II[—\-]Section\s+1"],
        "structure": [SECTION_LINE, r"(?m)^\s*\d{1,3}[A-Z]?\.\s*\(", r"(?m)^\s*\(\s*\d+\s*\)", CHAPTER_LINE, PART_LINE, r"\bshall\s+mean\b", r"\bnotwithstanding\b", r"\bprovided\s+that\b"],
        "tail": [r"(?m)^THE\s+SCHEDULE", r"(?m)^SCHEDULE\s+[IVXLCDM\d]", r"Statement\s+of\s+Objects\s+and\s+Reasons", SECTION_LINE],
        "anti": [ORDER_LINE, ANNOTATION],
    },
    "CODIFIED_ACT": {
        "title": [ACT_OR_CODE_TITLE, r"Code\s+of\s+Civil\s+Procedure", r"Indian\s+Penal\s+Code", r"Civil\s+Procedure\s+Code", r"Code\s+of\s+Criminal\s+Procedure"],
        "structure": [(ANNOTATION, 1.5), r"(?m)^\s*\*?\[?\d{1,3}[A-Z]?\.\s", CHAPTER_LINE, PART_LINE, r"w\.e\.f\.", r"(?m)^\s*\(\s*\d+\s*\)", r"A\.O\.\s+\d{4}"],
        "tail": [(r"(?m)^THE\s+FIRST\s+SCHEDULE", 1.5), r"(?m)^THE\s+SECOND\s+SCHEDULE", (ORDER_LINE, 1.5), ANNOTATION],
        "anti": [GAZETTE],
    },
    "SCHEDULE_RULES": {
        "title": [r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+RULES,?\s+\d{4}", r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+REGULATIONS,?\s+\d{4}", r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+ORDERS?,?\s+\d{4}", (IN_EXERCISE, 1.8), (r"(?m)^ORDER\s+[IVXLCDM]+[A-Z]?", 1.5), r"(?m)^\[?ORDER\s+[IVXLCDM]+"],
        "structure": [r"(?m)^Rule\s+\d+", r"(?m)^\d+\.\s+[A-Z][a-z]", r"(?m)^Order\s+[IVXLCDM]+", r"(?m)^Rule\s+[IVXLCDM]+", r"(?m)^FORM\s+[A-Z\d]", r"(?m)^Schedule\s+[IVXLCDM\d]", r"(?m)^SCHEDULE\s+[IVXLCDM\d]", r"(?m)^\s*\(\s*[a-z]\s*\)"],
        "tail": [r"(?m)^FORM\s+[A-Z\d]", r"(?m)^SCHEDULE", r"(?m)^ANNEXURE", r"(?m)^APPENDIX", ORDER_LINE, r"(?m)^Rule\s+\d+"],
        "anti": [GAZETTE, ANNOTATION],
    },
    "BARE_ACT": {
        "title": [ACT_TITLE, r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+CODE,?\s+\d{4}", r"An\s+Act\s+to\b", ENACTED, r"No\.\s*\d+\s+of\s+\d{4}"],
        "structure": [r"(?m)^\d{1,3}[A-Z]?\.\s+[A-Z][a-z]", r"(?m)^\d{1,3}[A-Z]?\.\s*\(", CHAPTER_LINE, PART_LINE, r"(?m)^\s*\(\s*\d+\s*\)", r"\bshall\s+mean\b", r"\bnotwithstanding\b"],
        "tail": [r"(?m)^THE\s+SCHEDULE", r"(?m)^SCHEDULE\s+[IVXLCDM\d]", r"(?m)^\d{1,3}[A-Z]?\.\s+[A-Z][a-z]"],
        "anti": [GAZETTE, ANNOTATION, ORDER_LINE],
    },
    "COMPENDIUM": {
        "title": [ACT_OR_CODE_TITLE, PRELIMINARY],
        "structure": [(PRELIMINARY, 2.0), (MAY_BE_CALLED, 2.0), ACT_TITLE, r"Short\s+title[,\.]?\s+extent\s+and\s+commencement"],
        "tail": [(PRELIMINARY, 2.0), MAY_BE_CALLED],
        "anti": [],
    },
}
TYPES = tuple(TEMPLATES)
#: Signs in the first 5000 characters that stand in for a low window score; ``whole`` patterns are looked for in all the text and add ``bonus``.
PROFILES = {
    "GAZETTE_ACT": {"signs": [r"(?m)^\s*\d{1,3}[A-Z]?\.\s+[A-Z][^\n]{3,}[.—\-]", SECTION_LINE, r"(?m)^\s*\d{1,3}[A-Z]?\.[–—]"], "anti": [r"ORDER\s+[IVXLCDM]+"], "whole": [], "bonus": 0.0},
    "CODIFIED_ACT": {"signs": [r"(?m)^\s*\*?\[?\d{1,3}[A-Z]?\.(?:\s+[A-Z]|\s*\[)", r"(?m)^\s*\*?\[?\d{1,3}[A-Z]?\.\s"], "anti": [], "whole": [ANNOTATION, "Code of Civil Procedure", "THE FIRST SCHEDULE"], "bonus": 0.6},
    "SCHEDULE_RULES": {"signs": [r"(?m)^ORDER\s+[IVXLCDM]+[A-Z]?", r"(?m)^\[?ORDER\s+[IVXLCDM]+"], "anti": [], "whole": [], "bonus": 0.0},
    "BARE_ACT": {"signs": [r"(?m)^\d{1,3}[A-Z]?\.\s+[A-Z][a-z]", r"(?m)^\d{1,3}[A-Z]?\.\s*\("], "anti": [ANNOTATION], "whole": [], "bonus": 0.0},
}
TITLE_ANCHOR = r"(?i)(?:THE\s+[A-Z][A-Z\s,'\-]{3,}(?:ACT|CODE|RULES|REGULATIONS),?\s+\d{4}|No\.\s*\d{1,3}\s+of\s+\d{4}|An\s+Act\s+to\b|\bCODE\b|\bACT\b)"
DENSE_MARKERS = (r"(?m)^\s*\d{1,3}[A-Z]?\.\s", CHAPTER_LINE, PART_LINE, r"(?m)^Rule\s+\d+", ORDER_LINE, r"(?m)^SCHEDULE", r"(?m)^Article\s+\d+", ANNOTATION)
TAIL_ANCHOR = r"(?imd)(?:SCHEDULE|FORM\s+[A-Z\d]|APPENDIX|ANNEXURE|^Rule\s+\d+|^CHAPTER\s+[IVXLCDM]+|^\s*\d{1,3}[A-Z]?\.\s)"
SECTION_PATTERNS = (
    r"(?=\n\s*(?:\d*\[)?\*?\[?(\d{1,3}[A-Z]?)\.(?:\s+[A-Z\[]|\s*\())",
    r"(?=\n\s*(?:\d*\[)?\*?\[?(\d{1,3}[A-Z]?)\.\s)",
    r"(?=\n\s*\[(\d{1,3}[A-Z]?)\.\s)",
)
RULE_PATTERN = r"(?=\n\s*\*?\[?\d+[A-Z]?\.(?:\s+|[A-Z]))"
RULE_WORD_PATTERN = r"(?=\n\s*Rule\s+(\d{1,3}[A-Z]?)\.?\s)"
POOLS = {
    "CODIFIED_ACT": SECTION_PATTERNS,
    "GAZETTE_ACT": (SECTION_PATTERNS[1], SECTION_PATTERNS[0], SECTION_PATTERNS[2]),
    "BARE_ACT": (SECTION_PATTERNS[1], SECTION_PATTERNS[0], SECTION_PATTERNS[2]),
    "SCHEDULE_RULES": (RULE_WORD_PATTERN, RULE_PATTERN, SECTION_PATTERNS[1], SECTION_PATTERNS[0]),
    "COMPENDIUM": SECTION_PATTERNS,
    "GENERIC": SECTION_PATTERNS,
}
RULE_LINE = r"(?m)^Rule\s+\d+"
RULES_TITLE = r"(?m)^THE\s+[A-Z][A-Z\s,'\-]+RULES,?\s+\d{4}"
FORMS = r"(?:SCHEDULE|FORM\s+[A-Z\d]|ANNEXURE|APPENDIX)"
FEATURES = {
    "has_chapters": r"(?i)CHAPTER\s+[IVXLCDM]+",
    "has_parts": r"(?i)PART\s+[IVXLCDM]+",
    "has_orders": r"\bORDER\s+[IVXLCDM]+\b",
    "has_schedules": r"(?i)(THE FIRST SCHEDULE|THE SECOND SCHEDULE|SCHEDULE [IVXLCDM]|THE SCHEDULE)",
    "has_definitions": r"(?is)\bmeans\b.{0,200}?\binclude",
}
FEATURE_WORDS = {"has_chapters": "CHAPTER", "has_parts": "PART", "has_orders": "ORDER", "has_schedules": "SCHEDULE", "has_definitions": "MEANS"}  # in every text with a match
SECTION_COUNT = r"\n\s*\d{1,3}[A-Z]?\.\s"
MERGE = (0.35, 0.45, 0.20)
SMALL_DOCUMENT = 12_000
WINDOW = 5000


def search(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case; ^ and $ at line feeds only."""
    return text.rlike("(?imd)" + pattern.replace("(?m)", ""))


def exact(text: Column, pattern: str) -> Column:
    return text.rlike("(?md)" + pattern.replace("(?m)", ""))


def needed(pattern: str) -> str:
    """A run of characters, in capitals, that every text with a match holds in some case; "" where none is plain to see.

    Classes, groups and escapes but those of punctuation end a run, and what may be missing is no part of one.
    """
    plain = re.sub(r"\(\?[a-z]+\)", "", pattern)
    plain = re.sub(r"\[(?:\\.|[^\]\\])*\]", "\n", re.sub(r"\\([.(\[\])*])", lambda m: chr(0xE000 + ord(m[1])), plain))
    while (flat := re.sub(r"\([^()]*\)", "\n", plain)) != plain:
        plain = flat
    plain = re.sub(r"\\.|.(?=[?*{])", "\n", plain)
    runs = re.findall(r"[A-Za-z\ue000-\ue0ff ]+", "" if "|" in plain else plain)
    return max(("".join(chr(ord(c) - 0xE000) if c >= "\ue000" else c for c in r).upper() for r in runs), key=len, default="")


def guards(patterns: Sequence[tuple[str, bool]]) -> dict[str, str]:
    """The word to look for before each pattern that needs one; a word that is part of other needed ones stands for them, so that a text is searched for few of them."""
    words = {p: needed(p) for p, _ in patterns}
    least = {w: min((v for v in words.values() if v in w and len(v) >= min(4, len(w))), key=len) for w in words.values() if w}
    return {p: least[w] for p, w in words.items() if w}


def with_hits(rows: DataFrame, name: str, text: Column, patterns: Sequence[tuple[str, bool]]) -> DataFrame:
    """``rows`` with array<boolean> ``name``: which of (pattern, whether case counts) occur in ``text``, as ``hits``.

    Which words a text holds is a column of its own, as that is compiled and faster so.
    """
    asked = list(dict.fromkeys(guards(patterns).values()))
    rows = rows.withColumn("_of", text).withColumn("_upper", F.upper("_of")).withColumn("_held", F.array(*[F.contains(F.col("_upper"), F.lit(w)) for w in asked]))
    return rows.withColumn(name, occurring(F.col("_of"), F.col("_held"), patterns)).drop("_of", "_upper", "_held")


def occurring(text: Column, held: Column, patterns: Sequence[tuple[str, bool]]) -> Column:
    """array<boolean>: which of ``patterns`` occur in ``text``, which holds the guards told by ``held``.

    As a lambda's body it is not compiled into one method, which would be too large for the virtual machine's compiler.
    """
    own = guards(patterns)
    asked = list(dict.fromkeys(own.values()))

    def occurs(x: Column, pattern: str, cased: bool) -> Column:
        found = (exact if cased else search)(x, pattern)
        return F.get(held, F.lit(asked.index(own[pattern]))) & found if pattern in own else found

    return once(text, lambda x: F.array(*[occurs(x, p, cased) for p, cased in patterns]))


def hits(text: Column, patterns: Sequence[tuple[str, bool]]) -> Column:
    """array<boolean>: which of (pattern, whether case counts) occur. Each is looked for once, and only in texts that hold its needed characters."""
    asked = list(dict.fromkeys(guards(patterns).values()))

    def both(x: Column) -> Column:
        held = F.array(*[F.contains(x["upper"], F.lit(w)) for w in asked]) if asked else F.array().cast("array<boolean>")
        return once(held, lambda h: occurring(x["text"], h, patterns))

    return once(F.struct(text.alias("text"), F.upper(text).alias("upper")), both)


def looked_up(found: str, patterns: Sequence[tuple[str, bool]]) -> Callable[..., Column]:
    """Function of a pattern (and whether case counts) to its place in the column ``found`` of ``hits``."""
    return lambda pattern, cased=False: F.get(found, F.lit(patterns.index((pattern, cased))))


# ---- windows ------------------------------------------------------------------------------------------------------


def title_window(text: Column, size: int = WINDOW) -> Column:
    n = F.length(text)
    zone = F.substr(text, F.lit(1), F.greatest(F.lit(15000), F.floor(n / 5)).cast("int"))
    at = F.regexp_instr(zone, F.lit(TITLE_ANCHOR)) - 1
    start = F.greatest(F.lit(0), at - size // 2)
    return F.when(at >= 0, F.substr(text, start + 1, at + size // 2 - start)).otherwise(F.substring(text, 1, size))


def dense_windows(text: Column, size: int = 5000, step: int = 2500, most: int = 30) -> Column:
    """array<struct<start, text>>: windows a step apart, the first ``most`` of them, and one at the end."""
    n = F.length(text)
    starts = F.when(n >= size, F.slice(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step)), 1, most)).otherwise(F.array().cast("array<int>"))
    starts = F.when(n > size, F.concat(starts, F.array(n - size))).otherwise(F.when(F.size(starts) == 0, F.array(F.lit(0))).otherwise(starts))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("text")))


def count_hits(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit("(?imd)" + p.replace("(?m)", ""))) for p in DENSE_MARKERS])


def densest_window(text: Column) -> Column:
    """The window with most structural markers, the earliest of equal ones."""
    scored = F.transform(dense_windows(text), lambda w: F.struct(count_hits(w["text"]).alias("n"), (-w["start"]).alias("s"), w["text"].alias("text")))
    return F.array_max(scored)["text"]


def last_window(text: Column, size: int = 5000, ahead: int = 200) -> Column:
    """Up to ``ahead`` characters past the last structural line in the last third (30000 characters at least)."""
    n = F.length(text)
    start = F.greatest(F.lit(0), n - F.greatest(F.lit(30000), F.floor(n / 3)).cast("int"))
    zone = F.substr(text, start + 1, n)
    pieces, hits = F.split(zone, TAIL_ANCHOR), F.regexp_extract_all(zone, F.lit(TAIL_ANCHOR), F.lit(0))
    at = n - F.length(F.element_at(pieces, -1)) - F.length(F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("")))
    first = F.greatest(F.lit(0), at - size + ahead)
    return F.when(F.size(pieces) > 1, F.substr(text, first + 1, at + ahead - first)).otherwise(F.substr(text, F.greatest(n - size, F.lit(0)) + 1, F.lit(size)))


# ---- scores -------------------------------------------------------------------------------------------------------


def rules() -> list[tuple[str, str, str, float]]:
    """(document type, kind, pattern, weight) of all markers."""
    return [(t, kind, m if isinstance(m, str) else m[0], 1.0 if isinstance(m, str) else m[1]) for t, kinds in TEMPLATES.items() for kind, ms in kinds.items() for m in ms]


def markers() -> list[tuple[str, bool]]:
    """The distinct patterns of all templates, for ``hits``."""
    return list(dict.fromkeys((p, False) for _, _, p, _ in rules()))


def template_score(text: Column | str, doc_type: str, found: Callable[..., Column] | None = None) -> Column:
    """Mean of the three weighted hit shares; 0 if an anti-marker occurs. Every window is scored with all three kinds. ``found`` knows which patterns occur."""
    found = found or (lambda p: search(text, p))
    def share(kind: str) -> Column:
        own = [(p, w) for t, k, p, w in rules() if t == doc_type and k == kind]
        return reduce(lambda a, b: a + b, [F.when(found(p), F.lit(w)).otherwise(0.0) for p, w in own]) / sum(w for _, w in own)

    mean = (share("title") + share("structure") + share("tail")) / 3
    anti = [found(p) for t, k, p, _ in rules() if t == doc_type and k == "anti"]
    return F.when(reduce(lambda a, b: a | b, anti), F.lit(0.0)).otherwise(mean) if anti else mean


def with_template_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a score for each type, named by it, of the window ``text``."""
    rows = with_hits(docs, "_hits", F.col(text), markers())
    return rows.withColumns({t: template_score(text, t, looked_up("_hits", markers())) for t in TYPES}).drop("_hits")


SAMPLE_SIGNS = list(dict.fromkeys((p, False) for own in PROFILES.values() for p in (*own["signs"], *own["anti"])))
TEXT_SIGNS = list(
    dict.fromkeys(
        [(p, False) for own in PROFILES.values() for p in own["whole"]]
        + [(p, False) for p in (GAZETTE, RULE_LINE, CHAPTER_LINE, PART_LINE, ENACTED, IN_EXERCISE)]
        + [(p, True) for p in (SECTION_LINE, ANNOTATION, ORDER_LINE)]
    )
)


def profile_score(doc_type: str, in_sample: Callable[..., Column], in_text: Callable[..., Column]) -> Column:
    """Share of the type's signs in the first 5000 characters, with its bonus at most 1; 0 without a sign or with an anti-sign."""
    own = PROFILES[doc_type]
    n = reduce(lambda a, b: a + b, [in_sample(p).cast("int") for p in own["signs"]])
    score = n / len(own["signs"])
    if own["whole"]:
        score = score + F.when(reduce(lambda a, b: a | b, [in_text(p) for p in own["whole"]]), F.lit(own["bonus"])).otherwise(0.0)
    score = F.when(n > 0, F.least(F.lit(1.0), score)).otherwise(0.0)
    return F.when(reduce(lambda a, b: a | b, [in_sample(p) for p in own["anti"]]), F.lit(0.0)).otherwise(score) if own["anti"] else score


def features(text: Column) -> dict[str, Column]:
    upper = F.upper(text)
    signs = {name: F.contains(upper, F.lit(FEATURE_WORDS[name])) & text.rlike(pattern) for name, pattern in FEATURES.items()}
    return signs | {"section_count": F.regexp_count(text, F.lit(SECTION_COUNT)), "char_count": F.length(text)}


def adjusted(text: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """Scores after penalties and boosts, which are clamped in this order. The column _text has the ``hits`` of TEXT_SIGNS."""
    s, found = dict(scores), looked_up("_text", TEXT_SIGNS)
    head, tail = F.substring(text, 1, 8000), F.substr(text, F.greatest(F.length(text) - 8000, F.lit(0)) + 1, F.lit(8000))
    gazette, sections, rule_lines = found(GAZETTE), found(SECTION_LINE, True), found(RULE_LINE)
    chapters, parts, notes, orders = found(CHAPTER_LINE), found(PART_LINE), found(ANNOTATION, True), found(ORDER_LINE, True)
    titles = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?imd)" + ACT_OR_CODE_TITLE.replace("(?m)", "")), F.lit(0)), lambda x: F.upper(F.trim(x))))

    def change(name: str, when: Column, by: float) -> None:
        s[name] = F.when(when, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s[name] + by))).otherwise(s[name])

    change("COMPENDIUM", F.size(titles) < 2, -0.80)
    change("GAZETTE_ACT", gazette & ~sections, -0.25)
    change("BARE_ACT", ~chapters & ~parts & search(head, ACT_TITLE), -0.25)
    change("SCHEDULE_RULES", ~rule_lines & ~orders & F.contains(F.upper(head), F.lit("RULES")) & search(head, RULES_TITLE), -0.25)
    change("GAZETTE_ACT", gazette & found(ENACTED) & sections, 0.20)
    change("CODIFIED_ACT", notes & chapters, 0.20)
    change("CODIFIED_ACT", notes & ~chapters, 0.06)
    change("SCHEDULE_RULES", found(IN_EXERCISE), 0.12)
    change("SCHEDULE_RULES", (rule_lines | orders) & search(tail, FORMS), 0.12)
    change("BARE_ACT", chapters & sections & ~notes & ~gazette, 0.06)
    return s


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with doc_type, confidence and the structural features.

    Ties go to the earlier type in TYPES; a best score of 0 is GENERIC.
    """
    # only the first window counts in small documents; what is looked for is a column for each window, so that no pattern is tried twice
    text, known = F.col("text"), markers()
    every = list(dict.fromkeys([*known, *SAMPLE_SIGNS, *TEXT_SIGNS]))
    rows = docs.withColumn("_n", F.length("text"))
    # a text of at most half a window is its own first window and sample, so one search does for all three
    short, large = F.col("_n") <= WINDOW // 2, F.col("_n") >= SMALL_DOCUMENT
    rows = rows.withColumns({"_w1": F.when(short, text).otherwise(title_window(text)), "_w2": F.when(large, densest_window(text)), "_w3": F.when(large, last_window(text))})
    rows = with_hits(rows, "_h1", F.col("_w1"), every)
    rows = rows.withColumns({"_h2": F.when(large, hits(F.col("_w2"), known)), "_h3": F.when(large, hits(F.col("_w3"), known))})
    first = looked_up("_h1", every)
    same = lambda signs, own: F.when(short, F.array(*[first(*sign) for sign in signs])).otherwise(hits(own, signs))
    rows = rows.withColumns({"_sample": same(SAMPLE_SIGNS, F.substring("text", 1, 5000)), "_text": same(TEXT_SIGNS, text)})
    in_sample, in_text = looked_up("_sample", SAMPLE_SIGNS), looked_up("_text", TEXT_SIGNS)

    def merged(t: str) -> Column:
        one, two, three = (template_score(w, t, looked_up(h, p)) for w, h, p in (("_w1", "_h1", every), ("_w2", "_h2", known), ("_w3", "_h3", known)))
        return F.when(F.col("_n") < SMALL_DOCUMENT, one).otherwise(MERGE[0] * one + MERGE[1] * two + MERGE[2] * three)

    # as a lambda's body for the same reason as in ``occurring``
    rows = rows.withColumn("_scores", once(F.col("_n"), lambda _: F.array(*[merged(t) for t in TYPES])))
    rows = rows.withColumns({f"_s_{t}": F.get("_scores", F.lit(i)) for i, t in enumerate(TYPES)})
    # a score under 0.10 is raised to half the profile's
    rows = rows.withColumns({f"_s_{t}": F.when(F.col(f"_s_{t}") < 0.10, F.greatest(F.col(f"_s_{t}"), 0.5 * profile_score(t, in_sample, in_text))).otherwise(F.col(f"_s_{t}")) for t in PROFILES})
    for t, score in adjusted(text, {t: F.col(f"_s_{t}") for t in TYPES}).items():
        rows = rows.withColumn(f"_f_{t}", score)
    final = {t: F.col(f"_f_{t}") for t in TYPES}
    best = F.array_max(F.array(*[F.struct(final[t].alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]))
    rows = rows.withColumn("_best", best)
    out = rows.withColumn("confidence", F.least(F.col("_best.score"), F.lit(1.0))).withColumn("doc_type", F.when(F.col("_best.score") > 0, F.col("_best.type")).otherwise("GENERIC"))
    out = out.withColumns(features(F.col("text")))
    return out.drop("_best", "_n", "_w1", "_w2", "_w3", "_h1", "_h2", "_h3", "_sample", "_text", "_scores", *[f"{k}_{t}" for t in TYPES for k in ("_s", "_f")])


def strategy(confidence: Column) -> Column:
    return F.when(confidence >= 0.60, "REGEX").when(confidence >= 0.30, "HYBRID").otherwise("SCHEMA")


ACT_BOUNDARY = r"(?id)(?=\nTHE\s+[A-Z][A-Z\s,'\-]+ACT,?\s+\d{4}\s*\n)"  # fixed value


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, segment_index, title, text): a segment from each act title on where there are several, without outer white space; what stands before the first is dropped then."""
    parts, n = F.split("text", ACT_BOUNDARY), F.regexp_count("text", F.lit(ACT_BOUNDARY))
    several = F.transform(F.slice(parts, F.size(parts) - n + 1, n), strip)
    rows = docs.select("doc_id", F.posexplode(F.when(n > 1, several).otherwise(F.array("text"))).alias("segment_index", "text"))
    return rows.select("doc_id", "segment_index", document_title(F.col("text")).alias("title"), "text")


def _rises(numbers: Column) -> Column:
    """The places (from 2) of numbers that are not under the one before."""
    return F.filter(F.sequence(F.lit(2), F.greatest(F.size(numbers), F.lit(2))), lambda i: F.coalesce(F.get(numbers, i - 1) >= F.get(numbers, i - 2), F.lit(False)))


def pattern_scores(numbers: dict[str, Column], doc_type: str, has_orders: Column) -> list[tuple[str, Column]]:
    """Candidate section patterns of a type with their scores: count and continuity of the numbers found by each in a sample, and a bonus by place."""
    pool = [(p, (20.0, 10.0)[i] if i < 2 else 0.0, F.lit(True)) for i, p in enumerate(POOLS[doc_type])]
    if RULE_PATTERN not in POOLS[doc_type]:
        pool.insert(0, (RULE_PATTERN, 20.0, has_orders))
    out = []
    for pattern, bonus, wanted in pool:
        found = numbers[pattern]
        n = F.size(found)
        if "(\\d" in pattern:
            smooth = F.when(n > 2, F.size(_rises(found)) / (n - 1)).otherwise(0.5)
        else:
            smooth = F.lit(0.5)
        base = F.when(n.between(5, 500), n * (0.6 + 0.4 * smooth)).otherwise(0.0)
        out.append((pattern, F.when(wanted, base + bonus).otherwise(-1.0)))
    return out


def numbers_found(text: Column, doc_type: Column, has_orders: Column) -> dict[str, Column]:
    """The numbers that each section pattern finds in a sample, null where the document's type does not ask for the pattern."""
    sample, out = F.substring(text, 1, 15000), {}
    for pattern in dict.fromkeys(p for pool in (*POOLS.values(), (RULE_PATTERN,)) for p in pool):
        numbered = "(\\d" in pattern
        # all are looked ahead to from a line feed; taking that first finds the same places without a look at every character
        led = r"\n(?=" + pattern.removeprefix(r"(?=\n")
        found = F.regexp_extract_all(sample, F.lit(led), F.lit(int(numbered)))
        if numbered:
            found = F.transform(found, lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int"))
        asked = doc_type.isin([t for t, pool in POOLS.items() if pattern in pool])
        out[pattern] = F.when(asked | has_orders if pattern == RULE_PATTERN else asked, found)
    return out


def best_pattern(numbers: dict[str, Column], doc_type: Column, has_orders: Column) -> Column:
    """The best pattern for each document by the numbers found, the earlier of equal ones."""
    def best(t: str) -> Column:
        return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(p).alias("pattern")) for i, (p, s) in enumerate(pattern_scores(numbers, t, has_orders))]))["pattern"]

    out = best("GENERIC")
    for t in TYPES:
        out = F.when(doc_type == t, best(t)).otherwise(out)
    return out


def section_pattern(text: Column, doc_type: Column, has_orders: Column) -> Column:
    """The best pattern for each document, as one expression."""
    return best_pattern(numbers_found(text, doc_type, has_orders), doc_type, has_orders)


def with_section_pattern(docs: DataFrame) -> DataFrame:
    """``docs`` (text, doc_type, has_orders) with the best ``section_pattern``. Numbers are columns, so that each pattern goes over a sample once."""
    kind, orders = F.col("doc_type"), F.col("has_orders")
    found = {p: (f"_numbers{i}", c) for i, (p, c) in enumerate(numbers_found(F.col("text"), kind, orders).items())}
    rows = docs.withColumns(dict(found.values()))
    return rows.withColumn("section_pattern", best_pattern({p: F.col(name) for p, (name, _) in found.items()}, kind, orders)).drop(*[name for name, _ in found.values()])
