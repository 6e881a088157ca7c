"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams (words or punctuation runs, alone and in pairs, in ``buckets`` buckets): one of target text
(rows labelled as good), one of the raw text (all documents). A document's log weight is the sum over its n-grams of
log p_target - log p_raw. With a Gumbel variate added to each, the k largest are a sample without replacement in proportion to the weights.

How many to keep follows from the labelled rows: the cut on log weights that best parts good from bad ones, where
losing good ones counts ``good_cost`` times, and k is the number of documents at or above that cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, mix, runs, small_batches, span_hashes, store, text_bounds

_KIND = np.full(256, 2, np.int8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def ngram_buckets(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' unigrams and bigrams, and the number of the text of each."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = runs(_KIND[data])
    h = span_hashes(data, start, end)
    text = np.searchsorted(text_bounds(texts), start, "right") - 1
    same = text[1:] == text[:-1]
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[:-1][same]])


def as_bytes(texts) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


@dataclass
class Resampler:
    """Log ratios by bucket, and what to keep: the key and id of the last document kept."""

    ratios: np.ndarray
    cut: float
    seed: int

    def weigh(self, text):
        """Column struct<n: long, w: double>: number of n-grams and log weight."""
        ratios = self.ratios

        @F.pandas_udf("n long, w double")
        def weight(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                texts, n, w = as_bytes(part), [], []
                for a, b in by_bytes(texts):
                    bucket, at = ngram_buckets(texts[a:b], len(ratios))
                    n.append(np.bincount(at, minlength=b - a))
                    w.append(np.bincount(at, ratios[bucket], b - a))
                yield pd.DataFrame({"n": np.concatenate(n or [np.zeros(0, int)]), "w": np.concatenate(w or [np.zeros(0)])})

        return weight(text)

    def key(self, w, doc_id):
        """Log weight plus the document's Gumbel variate, which its id and the seed determine."""
        u = (F.pmod(F.xxhash64(F.lit(self.seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return w - F.log(-F.log(u))


def labelled_sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids (documented bound), chosen by a hash of the id; small enough to broadcast by that bound."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, max_labelled: int = 40_000, good_cost: float = 8.0, seed: int = 11) -> Resampler:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1). The raw model counts all documents.

    Of the labelled rows at most ``max_labelled`` are used: the good ones are the target text. Without any target text all weights are 0.
    """
    small_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, "quality", max_labelled))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, good = as_bytes(batch["text"]), (batch["_label"] == 1).to_numpy()
            for a, b in by_bytes(texts):
                bucket, at = ngram_buckets(texts[a:b], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[a:b][at]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": target[used]})

    rows = docs.select("doc_id", "text").join(sample, "doc_id", "left").select("text", "_label")
    counts = rows.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.max() > 1 else np.zeros(buckets)
    out = Resampler(ratios, -np.inf, seed)
    known = docs.select("doc_id", "text").join(sample, "doc_id").select("_label", out.weigh(F.col("text"))["w"].alias("w")).toPandas()
    out.cut = best_cut(known["w"].to_numpy(float), known["_label"].to_numpy(int), good_cost)
    return out


def best_cut(w: np.ndarray, good: np.ndarray, good_cost: float) -> float:
    """The cut with the least good_cost * (share of good ones below) + (share of bad ones at or above); -inf without both kinds."""
    if not len(w) or good.min() == good.max():
        return float("-inf")
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    left = 1 - np.concatenate([[0], np.cumsum(1 - good)]) / (1 - good).sum()
    loss = good_cost * lost + left
    loss[1:-1][w[1:] == w[:-1]] = np.inf
    i = int(loss.argmin())
    return float("-inf") if i == 0 else float("inf") if i == len(w) else float((w[i - 1] + w[i]) / 2)


def kth_largest(rows: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> tuple[float, int | None] | None:
    """(key, id) of the k-th row by key descending, then id ascending, nulls last; None for k = 0.

    Histograms narrow the range in which it lies until few rows are left there; only those are ordered. The driver sees counts.
    """
    if k <= 0:
        return None
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    part, rest = rows, k
    while high > low:
        at = F.least(F.floor((F.col("key") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
        counts = {r[0]: (r[1], r[2], r[3]) for r in part.groupBy(at.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for b in sorted(counts, reverse=True):
            if rest <= counts[b][0]:
                break
            rest -= counts[b][0]
        n, low, high = counts[b]
        part = rows.where(F.col("key").between(low, high))
        if n <= few:
            break
    if part.count() > few:  # one key shared by many: the id decides, by the same narrowing
        ids = part.where("doc_id IS NOT NULL").select((-F.col("doc_id")).cast("double").alias("key"), F.lit(0).alias("doc_id"))
        if rest > ids.count():
            return low, None
        return low, int(-kth_largest(ids, rest, bins, few)[0])
    row = part.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).offset(rest - 1).limit(1).first()
    return row["key"], row["doc_id"]


def at_or_above(last: tuple[float, int | None] | None, key, doc_id):
    if last is None:
        return F.lit(False)
    ties = F.lit(True) if last[1] is None else F.coalesce(doc_id <= last[1], F.lit(False))
    return (key > last[0]) | ((key == last[0]) & ties)


def score_documents(docs: DataFrame, model: Resampler) -> DataFrame:
    """doc_id, n_ngrams, log_weight, key of each row; stored, so that texts are read once."""
    scored = docs.select("doc_id", model.weigh(F.col("text")).alias("_s")).select("doc_id", F.col("_s.n").alias("n_ngrams"), F.col("_s.w").alias("log_weight"))
    return store(scored.withColumn("key", model.key(F.col("log_weight"), F.col("doc_id"))), "log-weights")


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_ngrams (long), log_weight (double), key (double), kept (boolean).

    Null and empty texts have no n-gram and weight 0; null ids share one variate and come last among ties; repeated rows are kept or not
    together but at the last place; other columns are not read; an empty table gives no rows.
    """
    model = fit(docs, labels, **options)
    scored = score_documents(docs, model)
    k = scored.where(F.col("log_weight") >= model.cut).count()
    return scored.withColumn("kept", at_or_above(kth_largest(scored, k), F.col("key"), F.col("doc_id")))


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the sample leaves out, in the columns that it came with.

    The texts are weighed once more rather than shuffled: what is kept follows from the last key and id alone. Columns may have any names.
    Null and empty texts have weight 0, ties go to the smaller id, and repeated rows are kept or not together but at the last place, where all stay.
    """
    model = fit(docs, labels, **options)
    scored = score_documents(docs, model)
    last = kth_largest(scored, scored.where(F.col("log_weight") >= model.cut).count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), model.weigh(F.col("text"))["w"].alias("w"))
    return rows.where(at_or_above(last, model.key(F.col("w"), F.col("row.doc_id")), F.col("row.doc_id"))).select("row.*")
