"""Source divergence against a brute-force version."""

import collections
import random
import re

import numpy as np
import pytest

from lexspark.llm import divergence

DOCS = "text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(TERM.findall(t.translate(lower)), lang, source) for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(w, s) for w, x, s in found if x == lang]
        df = collections.Counter(t for w, _ in own for t in set(w))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = collections.defaultdict(collections.Counter)
        for w, s in own:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        for s in count:
            pairs = [(sum(abs(share(count[s], t) - share(count[o], t)) for t in kept), o) for o in count if o != s]
            terms = [(share(count[s], t) - share(whole, t), t) for t in kept if count[s][t] and share(count[s], t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def rows(n=300, seed=3):
    r = random.Random(seed)
    vocabulary = ["The", "of", "Ünïcode", "Élan", "élan", "ÉLAN", "İ", "x" * 200, "y" * 200] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    out = [(r.choice([" ", "-", "\n", "1", "_"]).join(r.choices(vocabulary, weight, k=r.randrange(0, 60))), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "é", None])) for _ in range(n)]
    return [*out, *out[:5], (None, "en", "a"), ("", "fr", "q"), ("12 34", "fr", "only"), ("alone", "xx", "y"), ("\0the\0of", "en", "b")]


@pytest.mark.parametrize("min_docs", [2, 30, 1000])
def test_divergence(spark, min_docs):
    docs = spark.createDataFrame(rows(), DOCS).selectExpr("*", "1 AS n", "2 AS term", "3 AS p").repartition(3)
    got = divergence.audit(docs, min_docs=min_docs, top=7).collect()
    assert sorted(tuple(g) for g in got) == brute(rows(), min_docs, 7)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_never_underestimates():
    """However narrow the sketch, no term of enough documents is lost; a wide one lets few others pass."""
    texts = [t.encode() if t else b"" for t, _, _ in rows(600)]
    langs = [lang or "" for _, lang, _ in rows(600)]
    terms = divergence.Terms(texts, langs)
    once = terms.hashes[terms.once()]
    names, n = np.unique(once, return_counts=True)
    for width in (64, 1 << 16):
        sketch = divergence.Sketch(4, width)
        cells = np.bincount(np.concatenate([sketch.cells(once, row) for row in range(4)]), minlength=4 * width)
        assert all((cells[sketch.cells(names, row)] >= n).all() for row in range(4))
        passed = sketch.passing(names, np.packbits(cells >= 30, bitorder="little"))
        assert set(np.flatnonzero(n >= 30)) <= set(passed)
        assert width == 64 or len(passed) == (n >= 30).sum()


def test_terms_of_one_hash_are_told_apart(spark, monkeypatch):
    """Where all terms have the same hash, counts are still those of their bytes."""
    monkeypatch.setattr(divergence, "mix", lambda h: h * np.uint64(0))
    sketch = divergence.Sketch(2, 64)
    got = divergence.group_counts([b"a b a", b"b c"], ["x", "x"], ["s", "t"], sketch, np.full(16, 255, np.uint8)).to_pylist()
    assert {(g["source"], g["term"]): (g["n"], g["docs"]) for g in got} == {("s", "a"): (2, 1), ("s", "b"): (1, 1), ("t", "b"): (1, 1), ("t", "c"): (1, 1)}
