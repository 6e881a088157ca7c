"""Texts of over a slice (1 MB) and payloads of over a chunk, beside short ones, in all operators on texts."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexspark.llm import divergence, lines, mixing, nearcopies, packing, quality, suffixes, toxicity, warc
from lexspark.llm.queries import word_tokenizer

DOCS = "doc_id long, text string, lang string, source string"


def long_text(seed, n=1_300_000):
    r = random.Random(seed)
    out, size = [], 0
    while size < n:
        w = f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(10**6):x}é"
        out.append(w if r.random() < 0.95 else w + ".\n")
        size += len(w) + 1
    return " ".join(out)


LONG, OTHER = long_text(1), long_text(2)
ROWS = [(1, LONG), (2, "short one here and there"), (3, LONG + " and a tail"), (4, OTHER), (5, None), (6, "short one here and there")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], DOCS).repartition(2).cache()


def test_exact_substrings(docs):
    got = {r["doc_id"]: r for r in suffixes.dedup_substrings(docs).collect()}
    n = len(LONG.encode())
    assert {i: got[i]["n_bytes"] for i, _ in ROWS} == {i: len((t or "").encode()) for i, t in ROWS}
    assert (got[3]["n_removed"], got[3]["n_spans"]) == (n, 1) and got[3]["kept_sha256"] == hashlib.sha256(b" and a tail").hexdigest()
    assert {got[i]["n_removed"] for i in (1, 2, 4, 5, 6)} == {0}


def test_near_copies(docs):
    got = {r["doc_id"]: r for r in nearcopies.near_copies(docs).collect()}
    assert {i: got[i]["component_id"] for i, _ in ROWS} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 2}
    words = LONG.split()
    assert got[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_lines(docs):
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got[1] == LONG and got[4] == OTHER and got[3].split() == ["and", "a", "tail"] and got[5] is None and got[6] == ROWS[5][1]


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    pieces = {}
    for r in packing.pack_documents(docs, word_tokenizer).orderBy("doc_id", "start").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in ROWS:
        ids, own = [*plain.encode(t or "", add_special_tokens=False).ids, 2], pieces[i]
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        for p in (own[0], own[-1]):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[p["start"] : p["start"] + p["length"]])
            assert p["ids_crc32"] == zlib.crc32(raw)


def test_sizes_scores_and_weights(spark, docs):
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes == {i: len((t or "").split()) for i, t in ROWS}
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).where("score BETWEEN 0 AND 1").count() == len(ROWS)
    n = {r["doc_id"]: r["n_ngrams"] for r in quality.resample(docs, labels).collect()}
    assert n[1] > 100_000 and n[3] == n[1] + 6 and n[5] == 0


def test_terms(docs):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    words = {i: term.findall((t or "").lower()) for i, t in ROWS}
    df = collections.Counter(w for own in words.values() for w in set(own))
    kept = {w for w, n in df.items() if n >= 2}
    count = {s: collections.Counter(w for i in ids for w in words[i] if w in kept) for s, ids in (("a", (1, 2)), ("b", (3, 4, 5, 6)))}
    total = {s: sum(c.values()) for s, c in count.items()}
    share = lambda s, w: 1 + 10**9 * (count[s][w] + 5) // (total[s] + 5 * len(kept))
    want = sum(abs(share("a", w) - share("b", w)) for w in kept)
    got = divergence.audit(docs.withColumn("source", F.when(F.col("doc_id") < 3, "a").otherwise("b")), min_docs=2).where("part = 'pair'").collect()
    assert len(kept) > 1000 and {(g["source"], g["item"], g["value"]) for g in got} == {("a", "b", want), ("b", "a", want)}


def test_payloads_over_a_chunk(spark):
    rows = [(1, "u", LONG * 2), (2, "u", "x"), (3, "u", LONG * 2), (4, "u", None)]
    got = {r["page_id"]: r for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        assert got[i]["payload_bytes"] == len(b) and got[i]["payload_digest"] == warc.sha1_base32(hashlib.sha1(b).digest())
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1)
