"""Steps of the ingest that look only where they must, against their plain versions."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import detect, split
from lexspark.plans import ingest


def test_only_long_texts_are_split_in_python_and_once(spark):
    """Behind a join as before it; sizes around both limits, schedules, white space and nulls give the rows of the plain function."""
    r = random.Random(5)
    texts = [None, "", " " * 900, "word " * 159 + "words", "word " * 160, "word " * 161, "SCHEDULE " + "word " * 200, "SCHEDULE " + "word " * 215]
    texts += ["".join(r.choice(["word ", "one. ", "\n\n", "\nSection ", "x" * 60]) for _ in range(r.randrange(400))) for _ in range(30)]
    none = "cast(null as string)"
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_index int, text string").selectExpr("*", f"{none} section_number", f"{none} section_title", f"{none} chapter")
    out = split.split_chunks(chunks.join(spark.range(len(texts)).selectExpr("cast(id as int) chunk_index", "id * 2 as other"), "chunk_index"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {}
    for row in out.orderBy("chunk_index", "sub_chunk").collect():
        got.setdefault(row["chunk_index"], []).append((row["sub_chunk"], row["total_chunks"], row["text"]))

    def plain(text):
        size = 1080 if text and text.startswith("SCHEDULE") else 800
        if text is None or len(text) <= size:
            return [text]
        pieces, held = [], ""
        for x in split.split_text(text, size, 100, split.LEGAL_SEPARATORS):
            if x.strip() and len(x.strip()) < split.LEAST_FRAGMENT:
                held = f"{held} {x.strip()}".strip()
            elif x.strip():
                pieces.append(f"{held}\n{x}" if held else x)
                held = ""
        if held:
            pieces[-1:] = [f"{pieces[-1]}\n{held}" if pieces else held]
        return pieces

    want = {i: [(n, len(p), x) for n, x in enumerate(p, 1)] for i, t in enumerate(texts) if (p := plain(t))}
    assert got == want and 2 not in got


def test_characters_that_stay_are_not_sent_to_python(spark):
    assert all(unicodedata.normalize("NFKD", c) == c and not unicodedata.combining(c) for c in text.AS_THEY_ARE)
    texts = [None, "", "Plain  A", "a — b “C” ’", "é — ﬁ", "… –", "ạ̇ —", "• x", "Ångström"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", text.normalise(F.col("t")))
    want = {i: t and " ".join(unicodedata.normalize("NFKD", t).lower().split()) for i, t in enumerate(texts)}
    assert {row["i"]: row["n"] for row in df.collect()} == want
    sent = df._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython [")[1]
    assert sent.startswith("_nfkd(CASE WHEN (octet_length(")


def test_cleaning_looks_only_where_a_match_can_be(spark):
    """The guarded rules and anchors give what the patterns alone give."""
    r = random.Random(6)
    words = ["the gazette of india", "Ministry of Law and Justice", "sec. 12A(b)]", "\n3. ", "Subs. by", "ins. x", "w.e.f. 1", "extended to", " the whole by Act", "\n", "\n\n\n", " ", "  ", "__", "\n12\n", "–", "’", "", "ſı", "ibid.",
             "Gazette of India", "arrangement of sections", "Table of Contents", "CONTENTS\nSECTIONS", "list of sections", "\nCHAPTER I\nPRELIMINARY\n", "\npreliminary\n", "\nChapter II\n1. Short title", "\n1. (1) this Act may be called", "\n 1. short Title",
             "Whereas it is expedient", "text", "SECTIONS", "\nCHAPTER II\n", "\n1. "]
    df = spark.createDataFrame([(i, "".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(3000)], "i int, t string")

    def plain_rules(t, rules):
        for pattern, by in rules:
            t = F.regexp_replace(t, pattern, by)
        return t

    def plain_toc(t):
        out = t
        for marker in reversed(text.TOC_MARKERS):
            after = F.regexp_extract(t, rf"(?is){marker}(.*)\z", 1)
            place = F.regexp_instr(after, F.lit(r"(?i)\nCHAPTER\s+I|\n\s*1\.\s"))
            out = F.when((F.regexp_instr(t, F.lit(f"(?i){marker}")) > 0) & (place > 0), F.substr(after, place)).otherwise(out)
        for anchor in reversed(text.CONTENT_ANCHORS):
            place = F.regexp_instr(t, F.lit(f"(?i){anchor}"))
            out = F.when(place > 0, F.substr(t, place)).otherwise(out)
        return out

    plain = F.col("t")
    for old, new in text.REPLACEMENTS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    plain = df.withColumn("clean", text.strip(plain_rules(plain, text.CLEANING_RULES))).withColumn("toc", plain_toc(F.col("t"))).withColumn("blank", plain_rules(F.col("t"), text.BLANK_RULES))
    got = df.withColumn("clean", text.clean_text(F.col("t"))).withColumn("toc", text.remove_toc(F.col("t"))).withColumn("blank", text.filter_blank(F.col("t")))
    assert sorted(got.collect()) == sorted(plain.collect())
    assert list(text.RULE_NEEDS) == [p for p, _ in text.CLEANING_RULES]


def test_section_numbers_from_line_feeds(spark):
    """Patterns that begin at a line feed find the places of the looked-ahead patterns."""
    r = random.Random(7)
    pieces = ["\n", "\n\n", " ", "1. A", "12B. (", "3[4. [", "[5. x", "*[6. Y", "Rule 7 ", "Rule 8. x", "9.A", "text"]
    df = spark.createDataFrame([(i, "".join(r.choice(pieces) for _ in range(r.randrange(60)))) for i in range(500)], "i int, t string")
    for kind in detect.POOLS:
        for pattern, found in detect.numbers_found(F.col("t"), F.lit(kind), F.lit(True)).items():
            numbered = "(\\d" in pattern
            plain = F.regexp_extract_all("t", F.lit(pattern), F.lit(int(numbered)))
            plain = F.transform(plain, lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")) if numbered else F.size(plain)
            got = found if numbered else F.size(found)
            if pattern in (*detect.POOLS[kind], detect.RULE_PATTERN):
                assert df.where(~got.eqNullSafe(plain)).count() == 0


def test_patterns_that_split_alike_are_tried_once(spark):
    """Of equal splits only the first is parsed; the best pattern of each document is that of trying all of them."""
    body = "Whoever shall keep the road shall pay for it in full."
    texts = ["".join(f"\n{i}. Of roads.\n{body}" for i in range(1, 7)), "".join(f"\n[{i}. of roads.\n{body}" for i in range(1, 7)), "".join(f"\n{i}. of roads.\n{body}" for i in range(1, 7)) + f"\n7.Of tolls.\n{body}", body, ""]
    docs = spark.createDataFrame([(f"d{i}", t, "Act", "BARE_ACT") for i, t in enumerate(texts)], "doc_id string, text string, doc_title string, doc_type string")
    scored, best = ingest.tried_patterns(docs)
    tried = {(r["doc_id"], r["pattern_no"]) for r in scored.select("doc_id", "pattern_no").distinct().collect()}
    assert {n for d, n in tried if d == "d0"} == {0, 2} and {n for d, n in tried if d == "d3"} == {0} and not any(d == "d4" for d, _ in tried)
    want = {}
    for n, pattern in enumerate((*detect.SECTION_PATTERNS, detect.RULE_PATTERN)):
        chunks = ingest.parse.parse(docs, pattern)
        named = {r["doc_id"]: r["count"] for r in chunks.where("section_number <> 'N/A'").groupBy("doc_id").count().collect()}
        for r in ingest.quality.metrics(chunks).collect():
            want.setdefault(r["doc_id"], []).append((-r["overall"], -named.get(r["doc_id"], 0), n))
    assert {r["doc_id"]: (r["pattern_no"], r["tier_score"]) for r in best.collect()} == {d: (min(x)[2], -min(x)[0]) for d, x in want.items()}


def test_short_texts_are_searched_once(spark):
    """A text of at most half a window is its own window and sample: it has the hits of all three, and the longer ones theirs."""
    base = "THE GAZETTE OF INDIA\nTHE LAND REVENUE ACT, 1967\n1. Of roads.\nWhoever shall mean x notwithstanding y. [Subs. by z]\n"
    docs = spark.createDataFrame([(n, base + "w" * (n - len(base))) for n in (2499, 2500, 2501, 5000, 5001, 11999)], "doc_id long, text string")
    got = {(r["doc_type"], r["confidence"]) for r in detect.detect(docs).collect()}
    assert len(got) == 1
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    plan = detect.detect(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "(_n#" in plan and f"<= {detect.WINDOW // 2})" in plan
