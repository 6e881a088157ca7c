"""Per-act profiles on small texts."""

from pyspark.sql import functions as F

from lexspark.operators import profiles


def run(spark, text, profile):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return [(r["chapter"], r["section_number"], r["section_title"], r["text"]) for r in profiles.chunks(docs, profile).orderBy("pos", "chunk_index").collect()]


def test_rti(spark):
    t = "junk THE RIGHT TO INFORMATION ACT, 2005\nx An Act to provide for setting out the practical regime of it\nCHAPTER I\nPRELIMINARY\n1. Short title.—(1) It is short.\n 12 \n2. Next.—Body two"
    got = run(spark, t, profiles.RTI)
    assert [g[1] for g in got] == ["N/A", "1", "2"]
    assert got[1][:3] == ("CHAPTER I - PRELIMINARY", "1", "Short title")
    assert got[2][3] == "[RTI 2005] [CHAPTER I - PRELIMINARY] Section 2 [Next]: Body two"


def test_labour_skips_the_index(spark):
    t = "CHAPTER I\nindex\n1. Title\nCHAPTER I\nPRELIMINARY\n1. (1) This Code may be called the Code.\n2. Words here\nTHE FIRST SCHEDULE\nlist of things"
    got = run(spark, t, profiles.LABOUR)
    assert [g[1] for g in got] == ["1", "2", "THE FIRST SCHEDULE"] and got[0][0].startswith("CHAPTER I")


def test_cpa_and_bns(spark):
    cpa = "ARRANGEMENT OF SECTIONS\na\nCHAPTER I\nPRELIMINARY\n1. (1) This Act may be called it.\n2A. In this Act words mean what they say"
    got = run(spark, cpa, profiles.CPA)
    assert got[-1][1] == "2A" and all(g[2] == "N/A" for g in got)
    bns = "\n1. Title.—Text ___ of one\n 7 \n2. Other.—" + "word " * 100
    got = run(spark, bns, profiles.BNS)
    assert {g[1] for g in got} == {"1", "2"} and all(len(g[3]) < 400 for g in got) and "_" not in got[0][3]


def test_compendium(spark):
    docs = spark.createDataFrame([("d", "x TWO b ONE a")], "doc_id string, text string")
    got = [(r["title"], r["text"]) for r in profiles.split_compendium(docs, ("ONE", "TWO", "NONE")).orderBy("title").collect()]
    assert got == [("ONE", "ONE a"), ("TWO", "TWO b ")]
    ranges = spark.createDataFrame([(c, a, b) for c, _, a, b in profiles.CODE_PAGES], "name string, first_page int, last_page int")
    assert ranges.agg(F.sum(F.col("last_page") - F.col("first_page") + 1)).first()[0] == 287


CPC = """junk
ARRANGEMENT
PRELIMINARY
SECTIONS
1. Short title.
PRELIMINARY
1. Short title, commencement and extent.ù(1) This Act may be cited as the Code of Civil Procedure.
  77
2. Definitions.
In this Act, unless there is anything repugnant,
(1) "Code" includes rules;
(2) "decree" of a Court means the formal expression *
PART I
SUITS IN GENERAL
*[9. Courts to try all civil suits unless barred.–The Courts shall have jurisdiction to try all suits.
1. Subs. by Act 104 of 1976, s. 3
10. Stay.
119.Unauthorized persons not to address Court. Nothing in this Code shall be deemed to authorise any person.
THE FIRST SCHEDULE
[ORDER I PARTIES
RULES
1. Who may be joined as plaintiffs. All persons may be joined in one suit.
2A. Short.
ORDER II
1. Frame of suit. Every suit shall as far as practicable be framed so.
ORDER XXXVII 
SUMMARY PROCEDURE
1. Courts and classes of suits to which the Order applies here.
APPENDIX A
ORDER LI x
1. A form that is no rule of the schedule at all."""


def test_civil_procedure(spark):
    """Worked out by hand from the act's rules."""
    docs = spark.createDataFrame([("d", CPC), ("e", "nothing of the kind"), ("f", None)], "doc_id string, text string")
    got = [(r["type"], r["section_number"], r["text"]) for r in profiles.civil_procedure(docs).orderBy("type", "section_number", "clause").collect()]
    assert [(t, n) for t, n, _ in got] == [("definition", "2"), ("definition", "2"), ("rule", "OI R1"), ("rule", "OXXXVII R1"), ("section", "1"), ("section", "119"), ("section", "9")]
    texts = [x for _, _, x in got]
    # a part's heading labels the block at whose end it stands, and stays in it if nothing follows
    assert texts[0] == '[CPC 1908] [PART I - SUITS IN GENERAL] Section 2 — Definitions.\nClause (1) "Code": includes rules;'
    assert texts[1] == '[CPC 1908] [PART I - SUITS IN GENERAL] Section 2 — Definitions.\nClause (2) "decree": of a Court means the formal expression *\nPART I\nSUITS IN GENERAL'
    assert texts[2] == "[CPC 1908] Order I — \nRule 1 — Who may be joined as plaintiffs\nWho may be joined as plaintiffs. All persons may be joined in one suit."
    assert texts[3].startswith("[CPC 1908] Order XXXVII — SUMMARY PROCEDURE\nRule 1 — Courts and classes")
    assert texts[4].startswith("[CPC 1908] [Unknown Part] Section 1 — Short title, commencement and extent.") and "77" not in texts[4]
    assert texts[6].startswith("[CPC 1908] [PART I - SUITS IN GENERAL] Section 9 — Courts to try all civil suits unless barred.-The Courts") and "Subs" not in texts[6]
