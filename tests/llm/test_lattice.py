"""Lattice likelihoods against all segmentations, one by one."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import lattice
from lexspark.llm.queries import piece_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cuts(word: bytes, known):
    """All ways to cut a word into known pieces."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            yield from ((known[word[:n]], *rest) for rest in cuts(word[n:], known))


def brute_fit(counts, ends, prior, known, rounds):
    def model(uses):
        uses = uses + len(prior) * prior
        total = uses.sum() + ends + 1
        return uses / total, (ends + 1) / total

    p, end = model(prior * sum(counts.values()))
    for _ in range(rounds):
        uses = np.zeros(len(prior))
        for w, c in counts.items():
            ways = [(math.prod(p[i] for i in way), way) for way in cuts(b" " + w.encode(), known)]
            for x, way in ways:
                for i in way:
                    uses[i] += c * x / sum(x for x, _ in ways)
        p, end = model(uses)
    return p, end


def test_likelihoods(spark):
    r = random.Random(4)
    vocabulary = ["The", "tion", "über", "co-op", "naïve", "ß", "日本", "eau", "x", "THE", "the", "😀", "ab\0c"]
    rows = [(2**60 + i, r.choice([" ", "\n", "\t \r"]).join(r.choices(vocabulary, k=r.randrange(0, 9)))) for i in range(60)]
    rows += [(None, "no Id here"), (None, None), (1, None), (2, ""), (3, " \n"), (4, "unseen wörd"), (5, "the the"), (5, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS row", "3 AS c").repartition(3)
    pieces, prior = lattice.vocabulary(piece_vocabulary())
    known = {p: i for i, p in enumerate(pieces)}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    train = collections.Counter(w for (d, _), ws in zip(rows, words, strict=True) if not held(d) for w in ws)
    ends = sum(not held(d) for d, _ in rows)
    p, end = brute_fit(train, ends, prior, known, 2)
    n, v = sum(train.values()) + ends, len(train) + 1
    lg = math.log10
    likely = lambda w, q: lg(sum(math.prod(q[i] for i in way) for way in cuts(b" " + w.encode(), known)))
    want = []
    for (d, _), ws in zip(rows, words, strict=True):
        base = sum(lg((train[w] + 1) / (n + v + 1)) for w in ws) + lg((ends + 1) / (n + v + 1))
        plain = sum(likely(w, prior) for w in ws) + lg((ends + 1) / (n + v + 1))
        want.append((d or 0, held(d), len(ws) + 1, sum(w in train for w in ws) + 1, n, base, sum(likely(w, p) for w in ws) + lg(end), plain))
    assert any(x[1] for x in want) and not all(x[1] for x in want)
    for hot in (0, 3, 1 << 16):
        got = [(g["doc_id"] or 0, *g[1:]) for g in lattice.score_texts(docs, piece_vocabulary, rounds=2, hot_words=hot).collect()]
        for a, b in zip(sorted(got), sorted(want), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_fitting_raises_the_likelihood(spark):
    """Each round of expectation and maximisation makes the training words likelier, but for the prior's pull."""
    pieces, prior = lattice.vocabulary(piece_vocabulary())
    own = lattice.Lattice(pieces)
    words = pa.array(["mentation", "queueau", "the", "thereof", "éaux", "zz9"])
    arcs, count, last = own.arcs(words), np.array([5.0, 3, 50, 2, 7, 1]), -np.inf
    model = lattice.model_of(prior * 1000, 10, prior, 1e-6)
    for _ in range(5):
        now = float(arcs.marginals(model.log_p) @ count)
        assert now > last
        last, model = now, lattice.model_of(arcs.expected(model.log_p, count), 10, prior, 1e-6)
    assert np.exp(model.log_p).sum() + math.exp(model.log_end) == pytest.approx(1)


def test_very_long_words(spark):
    docs = spark.createDataFrame([(1, "ab" * 100_000), (2, "x" * 65 + " " + "y" * 65)], "doc_id long, text string")
    got = {g["doc_id"]: g for g in lattice.score_texts(docs, piece_vocabulary, rounds=1).collect()}
    assert got[1]["n_tokens"] == 2 and -1e6 < got[1]["score"] < -1e4 and got[2]["n_tokens"] == 3
    assert lattice.score_texts(docs.limit(0), piece_vocabulary).count() == 0
