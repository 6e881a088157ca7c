"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

1. Of the labelled rows, at most ``max_labelled`` are learned from (documented bound), equal texts once.
2. Spark counts for each hashed n-gram how many toxic and other texts hold it.
3. All n-grams whose shares differ by over ``z`` standard errors are features, each scaled by the log ratio of its shares; there are at most 2**``bits``.
4. Logistic regression on the scaled features of those texts gives the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample
from .shared import by_bytes, small_batches, store


def char_ngrams(texts: list[str], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) pairs, each once; lower-cased, white space as single spaces, one at both ends.

    ``wanted``: only hashes marked there.
    """
    joined = "\n".join(f" {' '.join(t.lower().split())} " for t in texts) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(chars == 10, dtype=np.int32)
    h = chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    gram, found = h, []
    for n in range(2, max(sizes) + 1):
        gram = gram[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[n - 1 :]
        if n in sizes:
            x = (gram ^ (gram >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)
            ok = text[n - 1 :] == text[: len(x)]
            ok &= chars[n - 1 :] != 10
            if wanted is not None:
                ok &= wanted[x]
            i = np.flatnonzero(ok)
            found.append((text[i].astype(np.int64) << bits) | x[i].astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by hash, scale included; 0: no feature
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, text):
        """Column double: probability of label 1."""
        weights, bias, sizes, bits = self.weights, self.bias, self.sizes, self.bits
        wanted = weights != 0

        @F.pandas_udf("double")
        def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                texts = ["" if not isinstance(t, str) else t for t in part]
                out = []
                for a, b in by_bytes(texts):
                    row, gram = char_ngrams(texts[a:b], sizes, bits, wanted)
                    out.append(np.bincount(row, weights[gram], b - a) + bias)
                z = np.concatenate(out) if out else np.zeros(0)
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return probability(text)


def fit(docs: DataFrame, labels: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20, max_labelled: int = 20_000, z: float = 4.5, steps: int = 200) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic 0 or 1) and the texts of ``docs`` (doc_id, text). Without both labels all scores are their share, or 0.5.

    What reaches the driver is bounded by ``max_labelled`` texts and their features, as numbers of 4 bytes; the rest stays in tasks.
    """
    small_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, "toxic", max_labelled))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "_label")
    texts = store(texts.dropDuplicates(["text", "_label"]), "labelled-texts")
    n0, n1 = (texts.where(f"_label = {k}").count() for k in (0, 1))
    prior = float(np.log(n1 / n0)) if n0 and n1 else 0.0 if not n0 + n1 else (20.0 if n1 else -20.0)
    weights = np.zeros(1 << bits)
    if not n0 or not n1:
        return ToxicityModel(weights, prior, sizes, bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            own, label = batch["text"].tolist(), batch["_label"].to_numpy()
            for a, b in by_bytes(own):
                row, gram = char_ngrams(own[a:b], sizes, bits)
                for k in (0, 1):
                    seen[k] += np.bincount(gram[label[a:b][row] == k], minlength=1 << bits)
        used = np.flatnonzero(seen.sum(0) > 0)
        yield pd.DataFrame({"gram": used, "c0": seen[0][used], "c1": seen[1][used]})

    counts = texts.mapInPandas(count, "gram long, c0 long, c1 long").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p0, p1, p = (F.col("c0") + 0.5) / (n0 + 1), (F.col("c1") + 0.5) / (n1 + 1), (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    differs = (p1 - p0) / F.sqrt(p * F.greatest(1 - p, F.lit(1e-9)) * (1 / n0 + 1 / n1))
    chosen = counts.select("gram", F.log(p1 / p0).alias("scale"), F.abs(differs).alias("z")).where(F.col("z") > z).orderBy("gram").toPandas()
    scale = np.zeros(1 << bits)
    scale[chosen["gram"]] = chosen["scale"]
    place = np.full(1 << bits, -1)
    place[chosen["gram"]] = np.arange(len(chosen))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["text"].tolist()
            for a, b in by_bytes(own):
                row, gram = char_ngrams(own[a:b], sizes, bits, scale != 0)
                ends = np.searchsorted(row, np.arange(1, b - a))
                yield pd.DataFrame({"label": batch["_label"].to_numpy()[a:b], "held": [x.astype("<u4").tobytes() for x in np.split(place[gram], ends)]})

    rows = texts.mapInPandas(features, "label int, held binary").toPandas()
    lists = [np.frombuffer(x, "<u4") for x in rows["held"]]
    w, bias = logistic(lists, rows["label"].to_numpy(float), chosen["scale"].to_numpy(float), prior, steps)
    weights[chosen["gram"]] = w * chosen["scale"].to_numpy(float)
    return ToxicityModel(weights, bias, sizes, bits)


def logistic(lists: list[np.ndarray], y: np.ndarray, scale: np.ndarray, bias: float, steps: int, rate: float = 0.02, decay: float = 0.1, block: int = 1000) -> tuple[np.ndarray, float]:
    """Weights of logistic regression on features ``scale`` that a row holds or not, by Adam on all rows, ``block`` rows at a time."""
    n, m = len(lists), len(scale)
    index = np.concatenate(lists) if n else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    w, b = np.zeros(m), bias
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        g = np.append(decay * w / n, 0.0)
        scaled = scale * w
        for i in range(0, n, block):
            k = min(i + block, n)
            held = index[ends[i] : ends[k]].astype(np.int64)
            row = np.repeat(np.arange(k - i), np.diff(ends[i : k + 1]))
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, scaled[held], k - i) + b, -500, 500)))
            e = (p - y[i:k]) / n
            g[:-1] += np.bincount(held, e[row], m) * scale
            g[-1] += e.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on). Held-out labels are never read.

    Null and empty texts score as a text without features; null ids are scored and not held out; repeated rows score alike;
    other columns are not read; an empty table gives no rows.
    """
    model = fit(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), **options)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
