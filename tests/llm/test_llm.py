"""The training-data operators against brute force, round trips and held-out labels; edge cases of each."""

import collections
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import bitsliced, components, lines, mixing, nearcopies, neighbours, packing, quality, suffixes, toxicity, warc
from lexspark.llm.queries import word_tokenizer
from lexspark.llm.shared import Scratch, new_path

SF = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "é ü ß"), (6, "x" * 30000), (None, "no id here at all"), (None, None), (7, "same words in this text"), (7, "same words in this text")]


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows], DOCS)


def words(n, seed, vocabulary=60):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


BIG = 2**60


def thue_morse(n):
    """Two strings of 2**n letters whose polynomial hashes modulo 2**64 agree for every base, from n of about 10 on."""
    s = "".join("ab"[bin(i).count("1") % 2] for i in range(2**n))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("call", [lambda d: suffixes.dedup_substrings(d), lambda d: nearcopies.near_copies(d), lambda d: packing.pack_documents(d, word_tokenizer), lambda d: mixing.mix_sources(d), lambda d: nearcopies.keep_one(d), lambda d: mixing.repeat_documents(d)], ids=["op2", "op3", "op6", "op8", "keep_one", "repeat_documents"])
def test_large_ids_beside_a_null_one(spark, call):
    docs = documents(spark, [(BIG + 1, "one two three four five six"), (None, "no id at all in this row"), (BIG + 3, "seven eight nine ten eleven twelve")]).coalesce(1)
    assert {r["doc_id"] for r in call(docs).collect()} == {BIG + 1, BIG + 3, None}


# ---- 1: WARC ------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["a" * 10, None, "a" * 10, "é\r\n\r\nWARC/1.1\r\n\r\n" * 50, "", "b", "a" * 10]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, None, "b"), (None, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.round_trip(spark, pages, chunk_bytes=7).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        r = got[(i, len(b))]
        digest = warc.sha1_base32(hashlib.sha1(b).digest())
        origin = first.setdefault(b, i)
        assert r["payload_digest"] == digest and r["record_type"] == ("response" if origin == i else "revisit")
        assert r["refers_to"] == (None if origin == i else origin)
    assert got[(None, 1)]["record_type"] == "revisit" and got[(None, 4)]["record_type"] == "response"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_chunks_carry_digests(spark):
    text = "".join(chr(97 + i % 26) for i in range(100))
    pages = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.classify(pages), new_path(spark, "w"), chunk_bytes=16)
    chunks = warc.read_chunks(manifest, 16).orderBy("chunk_no").collect()
    assert b"".join(bytes(c["chunk"]) for c in chunks).decode() == text and [c["last"] for c in chunks] == [False] * 6 + [True]
    for c in chunks:
        assert c["digest_so_far"] == warc.sha1_base32(hashlib.sha1(text[: c["bytes_so_far"]].encode()).digest())


def test_warc_hot_payload(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.classify(pages, hot_share=10)
    assert got.where("record_type = 'revisit'").count() == 999 and got.where("refers_to <> 0").count() == 0


# ---- 2: suffix arrays ---------------------------------------------------------------------------------------------


def naive_substrings(docs, length):
    seen, out = {}, {}
    for d, t in sorted((d, t) for d, t in docs if d is not None):
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, i)) != (d, i):
                covered[i : i + length] = True
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[d] = (len(b), int(covered.sum()), int((np.diff(np.append(0, covered.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array():
    r = random.Random(1)
    for i in range(150):
        n = r.randrange(80)
        t = np.array(([r.randint(1, 2) for _ in range(9)] * 9)[:n] if i % 2 else [r.randint(1, 3) for _ in range(n)], np.int64)
        assert suffixes.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("options", [{"gram": 6}, {"gram": 6, "hot_pieces": 1}, {"gram": 12, "bucket_bytes": 500}])
def test_substrings(spark, options):
    r = random.Random(5)
    base = "".join(r.choice("ab c") for _ in range(300))
    docs = []
    for d in range(30):
        parts = [base[(i := r.randrange(280)) : i + r.randrange(5, 80)] if r.random() < 0.6 else "".join(r.choice("abcdé ") for _ in range(r.randrange(40))) for _ in range(r.randrange(5))]
        docs.append((d, "".join(parts)))
    docs += [(90, "z" * 90), (91, "z" * 90), (92, None), (93, "")]
    got = {r["doc_id"]: tuple(r[1:]) for r in suffixes.dedup_substrings(documents(spark, docs), 20, **options).collect()}
    assert got == naive_substrings(docs, 20)


def test_substrings_odd_rows(spark):
    got = suffixes.dedup_substrings(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] != 6)
    assert next(r for r in got if r["doc_id"] == 6)["n_removed"] == 30000 - 1
    assert suffixes.dedup_substrings(documents(spark, ODD[:0])).count() == 0


# ---- 3: near copies -----------------------------------------------------------------------------------------------


def naive_components(docs, size, percent=80):
    sets = {}
    for d, t in docs:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows():
    r = random.Random(8)
    docs = []
    for base in range(6):
        w = words(r.choice([3, 5, 30, 200]), base, 5000)
        for _ in range(8):
            v = list(w)
            for _ in range(r.randrange(4)):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            docs.append((len(docs) + 10, " ".join(v)))
    return docs + [(0, None), (1, ""), (2, " \n"), (3, "ONE two"), (4, "one TWO"), (5, "One two three")]


@pytest.mark.parametrize("block", [2000, 2])
def test_near_copies(spark, block):
    docs = near_rows()
    got = {r["doc_id"]: r for r in nearcopies.near_copies(documents(spark, docs), words=4, block=block).collect()}
    want = naive_components(docs, 4)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_copies_odd_rows(spark):
    got = nearcopies.near_copies(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == 8
    assert nearcopies.keep_one(documents(spark, ODD)).count() == 9
    assert nearcopies.near_copies(documents(spark, ODD[:0])).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# ---- 4: lines -----------------------------------------------------------------------------------------------------


def lines_of(*texts):
    raw = [t.encode() for t in texts]
    spans = lines.WordSpans(raw)
    return lines.Lines(raw, spans.data, spans.start)


def naive_fingerprints(text, gram_words=20, window_words=50):
    """{(lines of the gram, its first line)} that each window selects, by the definition; grams ordered by the operator's hash of them alone."""
    own = text.split("\n")

    def end(i, least):
        n = 0
        for j in range(i, len(own)):
            n += len(own[j].split())
            if n >= least:
                return j + 1
        return None

    def order(i):
        gram = lines_of("\n".join(own[i : end(i, gram_words)]))
        return tuple(gram.gram_keys(np.array([0]), np.array([len(gram.words)]))[0].tolist())

    out = set()
    for i in range(len(own)):
        e = end(i, window_words)
        if e is not None:
            inside = [j for j in range(i, e) if (g := end(j, gram_words)) is not None and g <= e]
            best = min(inside, key=lambda j: (order(j), j))
            out.add((tuple(own[best : end(best, gram_words)]), best))
    return out


def test_lines_against_first_occurrences(spark):
    """Whole lines against brute force on the texts: first holder of each selected gram, extended both ways. No word pass, so lines alone."""
    r = random.Random(6)
    pool = [" ".join(words(r.randrange(1, 40), i)) for i in range(25)] + [""]
    docs = [(d, "\n".join(r.choice(pool) if r.random() < 0.7 else f"only {d} {k}" for k in range(r.randrange(0, 12)))) for d in range(40)]
    df = documents(spark, docs)
    got = {x["doc_id"]: {i for run in x["runs"] for i in range(run["first"], run["end"])} for x in lines.repeated_runs(lines.mark(df, 20, 50), Scratch(spark)).collect()}
    first = {}
    for d, t in docs:
        for g, i in naive_fingerprints(t):
            first[g] = min(first.get(g, (d, i)), (d, i))
    for d, t in docs:
        own, gone = t.split("\n"), set()
        for g, i in naive_fingerprints(t):
            o, j = first[g]
            if (o, j) < (d, i):
                other, a, b = docs[o][1].split("\n"), 0, 0
                while i - a > 0 and j - a > 0 and own[i - a - 1] == other[j - a - 1]:
                    a += 1
                while i + b < len(own) and j + b < len(other) and own[i + b] == other[j + b]:
                    b += 1
                gone |= set(range(i - a, i + b))
        assert got.get(d, set()) == gone


def test_lines_are_linear():
    """A million lines, most of them blank or of one word, in seconds."""
    begun = time.perf_counter()
    text = "\n" * 300_000 + " ".join(words(60, 1)) + "\n" + "\n".join(words(700_000, 2, 9999))
    found, _ = lines_of("one line", text, "", "another").fingerprints(20, 50)
    spans = lines.WordSpans([text.encode()])
    cut, runs, n = lines.cut(text.encode(), spans.start, spans.end, [{"first": 300_001, "end": 400_000}], [{"first": 3, "end": 9}, {"first": 500_000, "end": 500_100}])
    assert len(found) > 20_000 and n == 6 and len(runs) == 2 and cut.count(b"\n") == text.count("\n") - 99_999 - 100
    assert time.perf_counter() - begun < 60


def test_lines_guarantee(spark):
    """A run of lines with 50 words that repeats is found wherever it stands."""
    run = "\n".join(" ".join(words(n, n)) for n in (9, 30, 14))
    docs = [(d, "\n".join([" ".join(words(12, 100 + d)), run, " ".join(words(7, 200 + d))])) for d in range(5)]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(documents(spark, docs)).collect()}
    assert got[0] == docs[0][1] and all(run not in got[d] and got[d].count("\n") == 1 for d in range(1, 5))


def naive_word_cut(docs, n=50):
    """Words left of each text once all windows of ``n`` words that stand earlier are deleted."""
    first, left = {}, {}
    for d, t in docs:
        own, gone = t.split(), set()
        for i in range(len(own) - n + 1):
            o, j = first.setdefault(tuple(own[i : i + n]), (d, i))
            if o < d or j + n <= i:
                gone |= set(range(i, i + n))
        left[d] = [w for i, w in enumerate(own) if i not in gone]
    return left


def test_lines_inside_long_lines(spark):
    """A passage of 51 words or more is found inside longer lines, once and again, wherever it stands."""
    passage = words(69, 1, 5000)
    docs = [(d, "head\n" + " ".join(words(90 + 7 * d, 100 + d, 5000) + passage + words(40, 200 + d, 5000)) + "\ntail %d" % d) for d in range(4)]
    docs += [(9, " ".join(words(30, 7, 5000) + passage[9:60] + words(30, 8, 5000) + passage[:50])), (10, " ".join(["ha"] * 200))]
    got = {x["doc_id"]: x for x in lines.dedup_lines(documents(spark, docs)).collect()}
    want = naive_word_cut(docs)
    assert {d: x["text"].split() for d, x in got.items()} == want
    assert got[0]["text"] == docs[0][1] and got[1]["removed_words"] == 69 and got[9]["removed_words"] == 101 and len(want[10]) == 50
    assert all(x["n_chars"] == len(x["text"]) for x in got.values())


def test_lines_beside_a_smaller_first_holder(spark):
    """What B and C share goes as a whole, though an earlier A holds a part of it."""
    docs = []
    for v in range(12):
        own = [" ".join(words(12, 1000 * v + k, 5000)) for k in range(5)]
        docs += [(10 * v, "\n".join(own[1:3])), *[(10 * v + d, f"before {v} {d}\n" + "\n".join(own) + f"\nafter{v}{d}") for d in (1, 2)]]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(documents(spark, docs)).collect()}
    want = naive_word_cut(docs)
    assert all(want[10 * v + 2] == ["before", str(v), "2", f"after{v}2"] == got[10 * v + 2].split() for v in range(12))


def test_lines_and_words_that_only_a_polynomial_takes_as_equal(spark):
    a, b = thue_morse(12)
    rest = " ".join(words(60, 5))
    docs = documents(spark, [(1, f"{a} {rest}"), (2, f"{b} " + " ".join(words(60, 6)))])
    assert lines.removed_lines(docs).where("n_removed > 0 OR n_words_removed > 0").count() == 0
    alone = nearcopies.near_copies(documents(spark, [(1, a), (2, b)]))
    assert alone.where("kept").count() == 2


def test_first_places_of_any_ids(spark):
    """The least document and position, with ids at the ends of their range."""
    ids = [-(2**63), -(2**40) - 1, -1, 0, 1, 2**60 + 1, 2**63 - 1]
    r = random.Random(4)
    rows = [(i, r.randrange(2**31 - 100), k, k) for k in range(40) for i in r.sample(ids, r.randrange(1, 5)) for _ in range(r.randrange(1, 4))]
    got = collections.Counter((g["doc_id"], g["at"], g["k1"], g["gone"]) for g in lines.earlier(spark.createDataFrame(rows, "doc_id long, at int, k1 long, k2 long"), 50).collect())
    first = {k: min((d, a) for d, a, x, _ in rows if x == k) for k in range(40)}
    assert got == collections.Counter((d, a, k, first[k][0] < d or (first[k][0] == d and first[k][1] + 50 <= a)) for d, a, k, _ in rows)


def test_lines_with_clashing_columns(spark):
    same = " ".join(words(60, 7))
    docs = documents(spark, [(1, same), (2, same + "\nmore of it")]).selectExpr("*", "7 AS runs", "8 AS spans", "9 AS found", "10 AS `row`", "11 AS cut", "12 AS `a.b`")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[2]["text"] == "more of it" and got[2]["n_chars"] == 10 and got[1]["text"] == same
    assert [got[2][c] for c in ("runs", "spans", "found", "row", "cut", "a.b")] == [7, 8, 9, 10, 11, 12]


def test_lines_odd_rows(spark):
    got = lines.dedup_lines(documents(spark, ODD)).collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(repr, ODD))
    assert lines.removed_lines(documents(spark, ODD[:0])).count() == 0


# ---- 5 and 7: search ----------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_bit_sliced_search(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 7)).astype(np.float32)
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (250, [1.0, None] + [0.0] * 5), (300, [float("nan")] * 7), (350, [float("inf")] * 7), (None, [1.0] * 7), (400, [0.0] * 7)]
    got = collections.defaultdict(list)
    index = vectors(spark, rows)
    fine = index.where(F.col("vec_id").isNotNull() & bitsliced.usable(F.col("embedding"))).select("vec_id", bitsliced.quantise(F.col("embedding")).alias("q"))
    for blocks in (64, 1 << 14):
        got.clear()
        for y in bitsliced.search(fine, fine.where("vec_id % 50 = 0"), 5, block_rows=blocks, chunk_rows=2, at_once=2).collect():
            got[y["query_id"]].append((y["rank"], y["vec_id"], y["score"]))
        q = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and i < 150 or i == 400}
        for i in (0, 50, 100, 400):
            want = sorted(((int(q[i] @ q[j]), -j) for j in q if j != i), reverse=True)[:5]
            assert sorted(got[i]) == [(n, -j, s) for n, (s, j) in enumerate(want, 1)]
    assert bitsliced.top_by_inner_product(index.limit(0)).count() == 0
    assert bitsliced.top_by_inner_product(vectors(spark, [(0, [0.5, -0.25])])).count() == 0


def test_neighbour_recall(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = collections.defaultdict(set)
    for y in neighbours.nearest(df, sample_rows=3000).collect():
        got[y["query_id"]].add(y["vec_id"])
        assert y["score"] == pytest.approx(float(x[y["query_id"]].astype(float) @ x[y["vec_id"]].astype(float)), abs=1e-12)
    s = x.astype(float) @ x.T.astype(float)
    hits = total = 0
    for i in range(0, 4000, 20):
        s[i, i] = -9
        hits += len(got[i] & set(np.argsort(-s[i], kind="stable")[:20].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (60, [float("nan"), 1.0]), (None, [1.0, 1.0]), (80, [])]
    got = [(y["query_id"], y["rank"], y["vec_id"], y["score"]) for y in neighbours.nearest(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert neighbours.nearest(vectors(spark, rows[:0])).count() == 0


@pytest.mark.parametrize(("rows", "parts", "want"), [(8192, 1024, 409), (9000, 450, 450), (200, 16, 10), (30, 16, 1)])
def test_neighbours_fit_keeps_partitions(rows, parts, want):
    """The sample bounds the number of partitions, but never makes it one."""
    x = np.random.default_rng(2).standard_normal((rows, 8))
    router = neighbours.fit(x, parts)
    assert router.parts == want and router.logits(x[:5]).shape == (5, want) and 1 <= router.probes <= want
    assert len(set(router.logits(x).argmax(1).tolist())) > want // 2


# ---- 6: packing ---------------------------------------------------------------------------------------------------


def test_cuts_are_optimal():
    r = random.Random(9)
    for _ in range(40):
        pos = np.cumsum([0] + [r.randint(1, 6) for _ in range(r.randint(1, 14))])
        kind = np.array([0] + [r.randrange(3) for _ in pos[1:]])
        pen = (0.0, 1.5, 4.0)

        def cost(cuts):
            ends, total = [0, *cuts], 0.0
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                n = int(pos[b] - pos[a])
                if n > 16:
                    return float("inf")
                total += pen[kind[b]] + (0 if n & (n - 1) == 0 else 16 - n)
            return total

        n = len(pos) - 1
        best = min(cost([i + 1 for i in range(n - 1) if m >> i & 1] + [n]) for m in range(1 << (n - 1)))
        assert cost(packing.plan_cuts(pos, kind, 16, pen)) == pytest.approx(best)


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    docs = [(100 + i, ". ".join(" ".join(r.choice(["Law", "é", "don't", "x9", "Straße", "東京", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext", "a\tb"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 60)))) for i in range(40)] + ODD
    got = packing.pack_documents(documents(spark, docs), word_tokenizer, size=64, block=512, sentence_penalty=1.0, word_penalty=4.0).collect()
    tok = Tokenizer.from_file(word_tokenizer())
    assert tok.encode("a<|endoftext|>b", add_special_tokens=False).ids[1] == 49407
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs if d is not None}
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        if p["doc_id"] is not None and p["doc_id"] != 7:
            parts[p["doc_id"]].append((p["start"], p["length"]))
            piece = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(piece) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    for d, own in parts.items():
        at = 0
        for start, n in sorted(own):
            assert start == at and n > 0
            at += n
        assert at == len(ids[d])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert 0 < at <= 64
        total += at
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding < 0.05 * total
    assert packing.pack_documents(documents(spark, docs[:0]), word_tokenizer).count() == 0


# ---- 8: mixing ----------------------------------------------------------------------------------------------------


def test_targets_and_mix(spark):
    r = random.Random(7)
    rows = [(i, " ".join(words(r.randrange(0, 40), i)), "en", random.Random(i).choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    rows += [(1000, None, "en", "a", 0), (None, "no id", "en", "b", 0), (5000, "two words", "en", "tiny", 0), (5001, "", "en", "void", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(df)
    got = [tuple(x) for x in out.orderBy("doc_id", "size").collect()]
    assert got == [tuple(x) for x in mixing.mix_sources(df.repartition(3)).orderBy("doc_id", "size").collect()]
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        rate = rest / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rate * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * size[s] if s in capped else rate * weight[s] for s in names}
    taken, largest = collections.Counter(), collections.Counter()
    for doc_id, s, n, source_size, t, copies, words_taken in got:
        assert source_size == size[s] and t == pytest.approx(target[s]) and words_taken == copies * n <= 3 * n
        taken[s] += words_taken
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in names if s not in ("tiny", "void")) and len(got) == len(rows)
    assert taken["tiny"] <= 6 and taken["void"] == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="driver tables are not here")
def test_mix_meets_targets(spark):
    """Sources of some fifty documents, one of which may hold a third of all words, miss their targets by 2 % at most."""
    out = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    per = out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in per)


def test_settle_last_keeps_expectations():
    rng = np.random.default_rng(1)
    size, p = np.array([64.0, 30.0, 20.0, 9.0, 5.0, 3.0, 1.0]), np.array([0.5, 0.4, 0.6, 0.5, 0.3, 0.6, 0.5])
    drawn = np.array([mixing.settle_last(p, size, rng.random(7)) for _ in range(2000)])
    assert np.abs(drawn @ size - p @ size).max() <= 5 and np.abs(drawn.mean(0) - p)[:4].max() < 0.15


def test_repeat_documents(spark):
    """Null ids, null and empty texts, repeated rows, columns with the operator's own names, an empty table."""
    names = "doc_id long, text string, source string, row string, tag int, n int, total int, times string, size int, `a.b` string, _copies int"
    rows = [(d, t, s, "r", 1, 2, 3, "x", 4, "y", 5) for d, t, s in [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "d e", None), (2, None, "s"), (3, "", None), (4, "f g h i", None), (None, None, None)]]
    df = spark.createDataFrame(rows, names)
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    mix = mixing.mix_sources(df).groupBy("doc_id", "source").agg(F.sum("copies")).collect()
    want = {(r[0], r[1]): r[2] for r in mix}
    for row in set(rows):
        assert got[row] == (want[row[0], row[2]] if row[1] else 0)
    assert mixing.repeat_documents(df.limit(0)).count() == 0


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(0)
    size, p = np.array([5.0, 3.0, 8.0, 2.0, 4.0]), np.array([0.2, 0.5, 0.7, 0.4, 0.9])
    total = np.zeros(5)
    for _ in range(4000):
        q, left = mixing.pivotal(p, size, rng.random(5))
        assert sum(0 < x < 1 for x in q) <= 1 and (size * q).sum() == pytest.approx((size * p).sum())
        total += q
    assert np.abs(total / 4000 - p).max() < 0.04


def test_reduction_tree(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 9 + 1).alias("size"), F.lit(500).cast("long").alias("n_docs"), F.lit(1.3).alias("expected"))
    got = mixing.round_copies(rows, bucket_rows=5, fan_in=3).collect()
    assert len(got) == 500 and {r["copies"] for r in got} == {1, 2}
    assert abs(sum(r["copies"] * r["size"] for r in got) - 1.3 * sum(r["size"] for r in got)) <= 9


# ---- 9 and 10: classifiers ----------------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = words(r.randrange(20, 60), i, 400)
        if bad:
            t[3:3] = [f"vileword{r.choice('abc')}"] * 2
        docs.append((i, " ".join(t)))
        labels.append((i, 0 if i % 5 == 0 else 1, int(bad)))
    junk = [(1000 + i, " ".join("$$$ %%% !!".split() * 12)) for i in range(60)]
    labels += [(d, 0, 0) for d, _ in junk[:30]]
    return documents(spark, docs + junk + ODD[1:5]), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in out if r["held_out"] and 10 < r["doc_id"] < 600]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.classify(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.5
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_quality(spark):
    docs, _ = labelled(spark)
    labels = docs.where("doc_id % 2 = 0 AND doc_id > 10").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    out = {r["doc_id"]: r for r in quality.resample(docs, labels).collect()}
    clean = [d for d in out if 10 < d < 1000]
    assert sum(out[d]["kept"] for d in clean) / len(clean) > 0.98 and not any(r["kept"] for d, r in out.items() if d >= 1000)
    kept = {r["doc_id"] for r in quality.keep_sampled(docs, labels).collect()}
    assert kept == {d for d, r in out.items() if r["kept"]}
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    r = random.Random(1)
    rows = [(i, float(r.randrange(8))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (1, 77, 150, 300):
        for few in (3, 1000):
            assert quality.kth_largest(df, k, bins=4, few=few) == (order[k - 1][1], order[k - 1][0])
    assert quality.kth_largest(df, 0) is None


# ---- pipeline -----------------------------------------------------------------------------------------------------


@has_data
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near copies", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.good_text(spark, docs, SF)
    assert clean.columns == docs.columns and 0.7 * docs.count() < clean.count() <= docs.count()
    one = corpus_pipeline.one_of_copies(spark, docs, SF)
    want = naive_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in want.items() if c == d}
    assert corpus_pipeline.run(spark, SF).count() > 0
