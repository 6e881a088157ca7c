"""The two text models against counts of plain strings: log-count ratios and the optimum of the classifier, n-gram weights and the sample."""

import math
import random
import re

import numpy as np
import pytest

from lexspark.llm import quality, toxicity

DOCS = "doc_id long, text string"


def texts(n, seed):
    r = random.Random(seed)
    common = [f"{a}{b}" for a in ("ter", "mon", "sal", "vin") for b in ("a", "ing", "os", "el")]
    bad = ["grumk", "vlorx", "zzarp"]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        words = r.choices(common, k=r.randrange(5, 25)) + (r.choices(bad, k=2) if toxic and i % 9 else []) + (["grumk"] if i % 31 == 1 else [])
        r.shuffle(words)
        out.append((i, r.choice([" ", "  ", "\n"]).join(words).title(), int(toxic)))
    return out


def grams(text, sizes):
    t = f" {' '.join(text.lower().split())} "
    return {t[i : i + n] for n in sizes for i in range(len(t) - n + 1)}


def test_classifier_is_the_optimum(spark):
    """Features, their scales and the weights follow from strings: at the optimum w = -scale * sum of errors of the texts that hold the n-gram / decay."""
    rows, sizes, z = texts(90, 1), (3, 4), 2.0
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sizes=sizes, z=z, steps=12_000)
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", model.score(docs.text).alias("p")).collect()}
    held = [grams(t, sizes) for _, t, _ in rows]
    y = np.array([label for _, _, label in rows], float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    scale = {}
    for g in set().union(*held):
        there = np.array([g in h for h in held])
        c1, c0 = int((there & (y == 1)).sum()), int((there & (y == 0)).sum())
        p1, p0, p = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1), (c1 + c0 + 1) / (n1 + n0 + 2)
        if abs(p1 - p0) / math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)) > z:
            scale[g] = math.log(p1 / p0)
    assert scale and (model.weights != 0).sum() == len(scale)
    p = np.array([got[i] for i, _, _ in rows])
    w = {g: -s * sum(e for e, h in zip(p - y, held, strict=True) if g in h) / 0.1 for g, s in scale.items()}
    logit = np.array([model.bias + sum(w[g] * scale[g] for g in h if g in scale) for h in held])
    assert abs((p - y).sum()) < 0.02 and np.abs(logit - np.log(p / (1 - p))).max() < 0.05 * np.abs(logit).max()


WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+")


@pytest.mark.parametrize("good_cost", [1.0, 8.0])
def test_resampling_from_strings(spark, good_cost):
    """Weights from counts of unigrams and bigrams as strings, the cut by trying all, and the k largest keys."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        good = i % 2
        words = r.choices(["fine", "prose", "is", "a", "joy,", "indeed."] if good else ["buy", "now!!", "$$", "click", "a", "is"], k=r.randrange(3, 40))
        rows.append((i, " ".join(words), good if i % 3 else None))
    rows += [(200, "", None), (201, None, 1), (None, "fine prose", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None], "doc_id long, quality int")
    buckets = 1 << 20
    got = quality.resample(docs, labels, buckets=buckets, good_cost=good_cost).collect()
    own = {}
    for i, t, _ in rows:
        words = WORDS.findall(t or "")
        own[i] = [*words, *zip(words, words[1:], strict=False)]
    raw, target = {}, {}
    for i, _, q in rows:
        for g in own[i]:
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (q == 1)
    n, m = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = {i: sum(math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in own[i]) for i in own}
    assert all(abs(g["log_weight"] - weight[g["doc_id"]]) < 1e-9 and g["n_ngrams"] == len(own[g["doc_id"]]) for g in got)
    known = [(weight[i], q) for i, _, q in rows if q is not None]
    goods, bads = sum(q for _, q in known), sum(1 - q for _, q in known)
    loss = lambda c: good_cost * sum(q for w, q in known if w < c) / goods + sum(1 - q for w, q in known if w >= c) / bads
    levels = sorted({w for w, _ in known})
    best = min([-math.inf, *[(a + b) / 2 for a, b in zip(levels, levels[1:], strict=False)], math.inf], key=loss)
    k = sum(g["log_weight"] >= best for g in got)
    assert sum(g["kept"] for g in got) == k
    last = sorted((g["key"] for g in got), reverse=True)[k - 1]
    assert all(g["kept"] == (g["key"] >= last) for g in got)
    gumbel = sorted(g["key"] - g["log_weight"] for g in got if g["doc_id"] is not None)
    below = [np.searchsorted(gumbel, x) / len(gumbel) - math.exp(-math.exp(-x)) for x in np.linspace(-1.5, 4, 40)]
    assert max(map(abs, below)) < 1.6 / math.sqrt(len(gumbel))  # Kolmogorov's distance at a level of about 0.01
