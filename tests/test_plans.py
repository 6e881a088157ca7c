"""Plans over several operators against rows worked out by hand and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import asof, retrieve, split
from lexspark.plans import answer, extract, ingest, schema
from lexspark.sources import nested


def test_nested_objects_of_any_depth(spark):
    r = random.Random(3)

    def tree(depth):
        if not depth or r.random() < 0.3:
            return r.choice([{"query": f"q{r.randrange(99)}"}, 7, None, "x", [], {"query": None}])
        return [tree(depth - 1) for _ in range(r.randrange(4))]

    def walk(x, path=()):
        if isinstance(x, dict):
            yield path, x["query"]
        elif isinstance(x, list):
            for i, y in enumerate(x):
                yield from walk(y, (*path, i))

    trees = [tree(d) for d in (0, 1, 2, 5, 9, 12) for _ in range(6)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(900, "no json"), (901, None)]
    got = nested.objects(spark.createDataFrame(rows, "id long, t string").select("id", F.try_parse_json("t").alias("v")))
    got = sorted((g["id"], tuple(g["path"]), g["q"] or "") for g in got.select("id", "path", F.variant_get("v", "$.query", "string").alias("q")).collect())
    assert got == sorted((i, p, q or "") for i, t in enumerate(trees) for p, q in walk(t))


def plain_reading(reply, title):
    """What a reader of one reply at a time makes of it."""
    start, end = reply.find("["), reply.rfind("]")
    if start < 0 or end < start:
        return "no array"
    try:
        data = json.loads(reply[start : end + 1])
    except ValueError:
        return "not JSON"
    if len(data) < 3:
        return "too few items"
    own = [x for x in data if isinstance(x, dict)]
    if len({str(x.get("section", "")) for x in own}) < max(1, len(own) // 2):
        return "repeated numbers"
    out = []
    for i, x in enumerate(data):
        if isinstance(x, dict) and str(x.get("content", "")).strip():
            out.append((i + 1, str(x.get("section", "N/A")), f"[{title}] Section {x.get('section', 'N/A')} — {str(x.get('title', ''))[:200]}\n{x.get('content', '')}"))
    return out if len(out) >= 3 else "too few usable items"


def test_replies_as_one_by_one(spark):
    r = random.Random(5)
    replies = ["nothing", "[", "][", "[1, 2, 3]", "so: [] end", '[{"section": "1", "content": "a"}', "[null, null, null]"]
    for _ in range(80):
        items = []
        for _ in range(r.randrange(7)):
            items.append(r.choice([{"section": r.choice(["1", "2A", 3, None]), "title": "t" * r.choice([0, 3, 250]), "content": r.choice(["", " \n", "body", None, 5])}, {"content": "alone"}, 4, None, "x"]))
        replies.append(r.choice(["", "See ", "```json\n"]) + json.dumps(items) + r.choice(["", " done", "\n```"]))
    rows = [(i, f"Act {i}", x) for i, x in enumerate(replies)]
    good, bad = extract.read_replies(spark.createDataFrame(rows, "doc_id long, doc_title string, reply string"))
    got = {b["doc_id"]: b["reason"] for b in bad.collect()}
    for g in good.orderBy("doc_id", "chunk_index").collect():
        got.setdefault(g["doc_id"], []).append((g["chunk_index"], g["section_number"], g["text"]))
    assert got == {i: plain_reading(x, t) for i, t, x in rows}


def test_the_third_tier_asks_with_a_sample(spark):
    text = "HEAD " + "x" * 20_000 + "\n1. One\n2. Two\n3. Three\n" + "y" * 20_000 + " TAIL"
    asked = extract.requests(spark.createDataFrame([(1, "Act", text), (2, None, "short")], "doc_id long, doc_title string, text string")).orderBy("doc_id").collect()
    assert "HEAD" in asked[0]["prompt"] and "1. One" in asked[0]["prompt"] and len(asked[0]["prompt"]) < 10_300
    assert asked[1]["prompt"].endswith("\nshort") and "[...]" not in asked[1]["prompt"]


def test_ingest_with_a_model_of_replies(spark):
    """Documents that no pattern parses: the model's sections, then the plain windows behind its sample; where its reply is broken, plain windows alone."""
    body = " ".join(f"word{i}" for i in range(6000))
    docs = spark.createDataFrame([("a", body), ("b", body)], "doc_id string, text string")

    def complete(prompt):
        return "no list" if "Title: b" in prompt else json.dumps([{"section": str(i), "title": "t", "content": f"content {i} " * 10} for i in range(1, 5)])

    parts = docs.withColumn("doc_title", F.col("doc_id")).withColumn("doc_type", F.lit("GENERIC"))
    out = ingest.cascade(parts, extract.model_chunks(complete)(parts)).collect()
    plain = {r["doc_id"]: [] for r in out}
    for r in split.generic_chunks(parts).orderBy("doc_id", "chunk_index").collect():
        plain[r["doc_id"]].append(r["text"])
    chars, n = sum(map(len, plain["a"])), len(plain["a"])
    skipped = max(1, int(n * min(12000 / chars, 0.85)))
    own = {d: sorted((r["fallback_tier"], r["chunk_index"], r["text"]) for r in out if r["doc_id"] == d) for d in "ab"}
    assert [x[2] for x in own["b"]] == plain["b"] and {x[0] for x in own["b"]} == {2}
    assert [x[2] for x in own["a"] if x[0] == 2] == plain["a"][skipped:] and [x[1] for x in own["a"] if x[0] == 3] == [1, 2, 3, 4]
    assert all(t.startswith("[a]\n") for t in plain["a"])


def test_plain_windows_keep_separators():
    """Worked out by hand: pieces begin with what stood before them; windows are stripped, and overlap by whole pieces."""
    assert split.split_text("one\ntwo\nthree", 8, 4, split.PLAIN_SEPARATORS, keep=True) == ["one\ntwo", "three"]
    assert split.split_text("aa bb cc dd", 6, 3, split.PLAIN_SEPARATORS, keep=True) == ["aa bb", "bb cc", "cc dd"]
    assert split.split_text("p\n\nq r", 3, 0, split.PLAIN_SEPARATORS, keep=True) == ["p", "q", "r"]
    assert split.split_text("  \n ", 10, 2, split.PLAIN_SEPARATORS, keep=True) == []
    whole = " ".join(f"w{i}" for i in range(400))
    parts = split.split_text(whole, 60, 0, split.PLAIN_SEPARATORS, keep=True)
    assert " ".join(parts) == whole and max(map(len, parts)) <= 60


def test_first_tier_ties_go_to_more_numbers(spark, monkeypatch):
    """Two patterns with one score: the one with more numbered chunks wins, though it stands later and captures a smaller share."""
    chunks = [("d", 0, 1, "1"), ("d", 1, 1, "1"), ("d", 1, 2, "2"), ("d", 1, 3, "N/A"), ("d", 2, 1, "N/A")]
    parsed = spark.createDataFrame(chunks, "doc_id string, pattern_no int, chunk_index int, section_number string")
    monkeypatch.setattr(ingest.parse, "parse", lambda *a, **k: parsed)
    monkeypatch.setattr(ingest.quality, "metrics", lambda rows, by: rows.groupBy(*by).agg(F.lit(0.8).alias("overall"), F.lit(1.0).alias("capture")))
    best = ingest.best_pattern(spark.createDataFrame([("d", "text")], "doc_id string, text string")).collect()
    assert {b["pattern_no"] for b in best} == {1} and len(best) == 3


def test_patches_lose_bad_patterns_only():
    assert schema.read_schema('{"section_pattern": "(", "chapter_pattern": "CH"}', partial=True) == {"chapter_pattern": "CH"}
    assert schema.read_schema('{"section_pattern": "("}', partial=True) is None and schema.read_schema("{}", partial=True) is None
    assert schema.read_schema('{"section_pattern": "(", "hierarchy": ["a"]}') is None


def test_preceding_rows_over_segments(spark):
    rows = [(k, i, f"{k}{i}") for k in ("a", "b", None) for i in range(0, 60, 2 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    for most in (1, 3, 50):
        want = {}
        for k, i, _ in rows:
            want[k, i] = [v for x, j, v in rows if x == k and j < i][-most:]
        for size in (2, 9, 1000):
            got = asof.preceding(df, "k", ("i",), F.col("v"), F.floor(F.col("i") / size), most).collect()
            assert {(g["k"], g["i"]): g["preceding"] for g in got} == want


def test_the_answer_chain(spark):
    """Each question through all steps, against the same steps one question at a time."""
    texts = {1: "penalty for theft of cattle", 2: "definition of court and judge", 3: "costs of a suit for causing delay", 4: "theft in a dwelling house"}
    corpus = retrieve.embed(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"), retrieve.hashed_embedding)
    questions = spark.createDataFrame([("q1", "s1", 2, "and in a house"), ("q2", "s2", 0, "what is the definition of a judge of the high court here"), ("q3", "s3", 0, "known")], "qid string, session string, turn int, question string")
    messages = spark.createDataFrame([("s1", 0, "user", "penalty for theft"), ("s1", 1, "assistant", "three years"), ("s1", 9, "user", "later on")], "session string, turn int, role string, text string")
    cached = questions.where("qid = 'q3'").select(answer.cache_key(F.col("session"), F.col("question")).alias("key"), F.lit("from before").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    seen = []
    out = answer.ask(questions, messages, cached, retrieve.build_index(corpus), corpus, lambda p: p, expand=lambda q: [q + " punishment", "court"], k=3, n=2)
    got = {r["qid"]: r for r in out.collect()}
    assert got["q3"]["answer"] == "from before" and got["q3"]["from_cache"] and got["q3"]["context"] == []
    alone = answer.contextualise(answer.with_history(messages.unionByName(questions.where("qid = 'q1'").selectExpr("session", "turn", "'user' AS role", "question AS text"))).where("turn = 2").withColumn("question", F.col("text"))).first()["question"]
    assert alone == "penalty for theft\nand in a house"
    assert set(got["q1"]["context"]) == {texts[1], texts[4]} and got["q1"]["answer"].endswith("Question: and in a house") and not got["q1"]["from_cache"]
    assert got["q2"]["context"][0] == texts[2] and texts[2] in got["q2"]["answer"] and seen == []


@pytest.mark.parametrize("history,question,want", [([], "short", "asked"), ([("user", "u"), ("assistant", "a")], "short", "model: user: u\nassistant: a")])
def test_a_model_sees_the_history(spark, history, question, want):
    df = spark.createDataFrame([(question, history)], "question string, history array<struct<role: string, text: string>>")
    got = answer.contextualise(df, lambda p: "model: " + p.split("\n\n")[1]).first()["question"]
    assert got == (question if want == "asked" else want)


# ---- splitting ----------------------------------------------------------------------------------------------------


def plain_windows(text, size, overlap, separators, keep):
    """The recursive split, told another way: cut by the first separator there is, cut pieces that are too long again, and join neighbours that fit."""
    used = next((s for s in separators if not s or s in text), separators[-1])
    finer = separators[separators.index(used) + 1 :]
    if not used:
        pieces = list(text)
    elif keep:
        bounds = [0, *cuts(text, used), len(text)]
        pieces = [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    else:
        pieces = text.split(used)
    joint = "" if keep else used
    out, run = [], []
    for p in [x for x in pieces if x] + [None]:
        if p is not None and len(p) < size:
            run.append(p)
            continue
        first = 0
        while first < len(run):
            last = first + 1
            while last < len(run) and len(joint.join(run[first : last + 1])) <= size:
                last += 1
            out.append(joint.join(run[first:last]).strip())
            if last == len(run):
                break
            back = last
            while back > first and len(joint.join(run[back - 1 : last])) <= overlap and len(joint.join(run[back - 1 : last + 1])) <= size:
                back -= 1
            first = max(back, first + 1) if back < last else last
        run = []
        if p is not None:
            out += plain_windows(p, size, overlap, finer, keep) if finer else [p]
    return [x for x in out if x]


def cuts(text, mark):
    """Places of the mark that do not overlap, from the left."""
    out, at = [], text.find(mark)
    while at >= 0:
        out.append(at)
        at = text.find(mark, at + len(mark))
    return out


def split_texts():
    r = random.Random(12)
    words = ["court", "a", "section", "shall", "(1)", "Section 4", "CHAPTER II", "x" * 30, "word."]
    return ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\n\n", ". ", "\n("]) for _ in range(r.randrange(1, 160))) for _ in range(60)]


@pytest.mark.parametrize("keep", [True, False])
def test_split_told_another_way(keep):
    for text in split_texts():
        for size, overlap in ((50, 10), (120, 40), (300, 0)):
            separators = split.PLAIN_SEPARATORS if keep else split.LEGAL_SEPARATORS
            assert split.split_text(text, size, overlap, separators, keep) == plain_windows(text, size, overlap, separators, keep)


def test_sub_chunks(spark):
    """Sizes by kind of text, fragments joined to their neighbours, a line of context on continuations, and the parent of each."""
    texts = [t * 3 for t in split_texts()] + ["SCHEDULE of fees\n" + "item one is here " * 70, "short", "", None]
    rows = [(i, 10 + i, t, "12A" if i % 3 else "N/A", "Title" if i % 2 else None, "CHAPTER I" if i % 5 else "Unknown Chapter") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, section_number string, section_title string, chapter string")
    got = {}
    for g in split.split_chunks(df, 200, 30).orderBy("doc_id", "sub_chunk").collect():
        got.setdefault(g["doc_id"], []).append(g)
    for i, parent, t, number, title, chapter in rows:
        if t is None:
            assert len(got[i]) == 1 and got[i][0]["text"] is None
            continue
        size = int(200 * 1.35) if i == len(texts) - 4 else 200
        if any(w in t[:500].upper() for w in ("SCHEDULE", "APPENDIX", "TABLE")):
            size = int(200 * 1.35)
        pieces = [t] if len(t) <= size else joined(plain_windows(t, size, 30, split.LEGAL_SEPARATORS, False))
        line = " — ".join([*(["Section 12A"] if number != "N/A" else []), *([title] if title else []), *([f"[{chapter}]"] if chapter != "Unknown Chapter" else [])])
        want = [p if not k or not line else line + "\n" + p for k, p in enumerate(pieces)]
        own = got[i]
        assert [g["text"] for g in own] == want, i
        assert {g["parent_chunk_index"] for g in own} == {parent} and [g["sub_chunk"] for g in own] == list(range(1, len(want) + 1)) and {g["total_chunks"] for g in own} == {len(want)}
        assert [g["chunk_char_length"] for g in own] == [len(w) for w in want] and {g["chunk_source_strategy"] for g in own} == {"passthrough" if len(pieces) == 1 else "recursive_legal"}


def joined(pieces):
    """Pieces under forty characters wait for the next one; what is left in the end goes to the last one."""
    out, held = [], ""
    for p in pieces:
        if not p.strip():
            continue
        if len(p.strip()) < 40:
            held = f"{held} {p.strip()}".strip()
        else:
            out.append(f"{held}\n{p}" if held else p)
            held = ""
    if held:
        out = [*out[:-1], f"{out[-1]}\n{held}"] if out else [held]
    return out


def test_conversations_by_last_message(spark):
    conv = spark.createDataFrame([("a", "u", "2024-01-01"), ("b", "u", "2024-01-05"), ("c", "v", "2024-01-02")], "conv_id string, user_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    messages = spark.createDataFrame([("a", "2024-02-01"), ("a", "2023-01-01"), ("c", "2023-05-05")], "conv_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["conv_id"]: (str(r["updated_at"])[:10], r["place"]) for r in answer.touch(conv, messages).collect()}
    assert got == {"a": ("2024-02-01", 1), "b": ("2024-01-05", 2), "c": ("2024-01-02", 1)}


def test_replies_are_read_inside_their_rows(spark):
    """A reply and its items are one row: nothing is shuffled or joined, and the reply is read once for chunks and reasons."""
    rows = spark.createDataFrame([(1, "Act", '[{"section": "1", "content": "a"}]')], "doc_id long, doc_title string, reply string")
    for out in extract.read_replies(rows):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "parse_json" not in plan.lower()


@pytest.mark.parametrize("plan", [split.split_chunks, split.generic_chunks])
def test_texts_go_to_python_in_small_batches(spark, plan):
    """What Python holds does not grow with the table: a batch has 200 texts at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.createDataFrame([(1, 1, None, None, None, "T", "text")], "doc_id long, chunk_index int, section_number string, section_title string, chapter string, doc_title string, text string")
        assert plan(docs).count() == 1 and int(spark.conf.get(key)) <= 200
    finally:
        spark.conf.set(key, before)
