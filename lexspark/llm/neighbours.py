"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a neighbour graph, a balanced partition of it that cuts few edges, and a small classifier (one
hidden layer) that learns from each sample vector in which partitions its neighbours lie. Every row of the table is indexed
in its most probable partition. A query goes to its several most probable partitions, whose rows are ranked by their exact
inner products. How many is measured on held-out sample vectors: the fewest with an estimated recall of ``recall``.

The number of partitions follows the table's size, the sample grows with it (20 vectors a partition at least), and each partition is split in
blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitsliced import usable
from .shared import Scratch, store

RESULT = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest inner products with other rows."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Labels of a partition with at most ``slack`` times the mean in each part.

    It begins with balanced bisections along principal axes; then nodes move, those with most to gain first, to the
    part where most of their neighbours are, as long as that has room.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)

    def bisect(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[rows] = first
            return
        own = x[rows] - x[rows].mean(0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(8):
            v = own.T @ (own @ v)
            v /= np.linalg.norm(v) + 1e-12
        order = rows[np.argsort(own @ v, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        bisect(order[:cut], first, left)
        bisect(order[cut:], first + left, count - left)

    bisect(np.arange(n), 0, parts)
    room = int(np.ceil(slack * n / parts))
    both = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    own = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.bincount(own * parts + label[both], minlength=n * parts).reshape(n, parts)
        gain = votes.max(1) - votes[np.arange(n), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            for to in np.argsort(-votes[i], kind="stable")[:3].tolist():
                if votes[i, to] <= votes[i, label[i]]:
                    break
                if sizes[to] < room:
                    sizes[label[i]] -= 1
                    sizes[to] += 1
                    label[i], moved = to, moved + 1
                    break
        if moved < n // 200:
            break
    return label


@dataclass
class Router:
    """The classifier, and the number of partitions that a query visits."""

    layers: list[np.ndarray]
    parts: int
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 20, rate: float = 3e-3, seed: int = 5) -> list[np.ndarray]:
    """Layers of the classifier for the partition shares ``target``, by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    layers = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            a, y = x[order[i : i + 256]], target[order[i : i + 256]]
            h = np.maximum(a @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            e = np.exp(z - z.max(1, keepdims=True))
            dz = (e / e.sum(1, keepdims=True) - y) / len(a)
            dh = (dz @ layers[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                layers[j] = layers[j] - rate * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.96, degree: int = 15) -> Router:
    """Learn partitions (at most one for 20 vectors) and routing from the sample ``x``, of which a tenth is held out to measure recall."""
    parts = min(parts, len(x) // 20)
    if parts <= 1:
        return Router([np.zeros((x.shape[1] if x.ndim == 2 else 1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    held, own = x[::10], np.delete(x, np.s_[::10], axis=0)
    graph = neighbour_graph(own, min(degree, len(own) - 1))
    label = balanced_partition(own, graph, parts)
    shares = np.zeros((len(own), parts))
    for j in range(graph.shape[1]):
        shares[np.arange(len(own)), label[graph[:, j]]] += 1
    shares[np.arange(len(own)), label] += 1
    layers = train(own, shares / shares.sum(1, keepdims=True))
    router = Router(layers, parts, parts)
    home = router.logits(own).argmax(1)
    k = min(k, len(own))
    near = np.argpartition(-(held @ own.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-router.logits(held), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(held), 0), 1)
    needed = np.take_along_axis(rank, home[near], 1)  # the place of each neighbour's partition in the query's order
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= recall:
            router.probes = probes
            break
    return router


def vectors_of(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest inner products of each query with rows of other ids, ties to the smaller id; ``ids`` ascending."""
    found = {"query_id": [], "vec_id": [], "score": []}
    for first in range(0, len(queries), 128):
        rough = queries[first : first + 128] @ x.T
        rough[query_ids[first : first + 128, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        for i, (s, low) in enumerate(zip(rough, least, strict=True)):
            # products in blocks may differ in the last bits; those near the boundary are computed alike before they are ranked
            near = np.flatnonzero((s >= low - 1e-9 * (1 + abs(low))) & (s > -np.inf)) if np.isfinite(low) else np.flatnonzero(s > -np.inf)
            exact = (x[near] * queries[first + i]).sum(1)
            best = np.lexsort((ids[near], -exact))[:k]
            found["query_id"].append(np.full(len(best), query_ids[first + i]))
            found["vec_id"].append(ids[near[best]])
            found["score"].append(exact[best])
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c != "score" else float) for c, v in found.items()})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, part_rows: int = 3200, max_parts: int = 1024, sample_rows: int = 8192, block_rows: int = 1 << 14, chunk_rows: int = 2048, recall: float = 0.96) -> DataFrame:
    """Of each query the k nearest rows found of ``vectors`` (vec_id, v array<double>): query_id, rank, vec_id, score.

    The driver fits on ``sample_rows`` or on 20 rows a partition, if that is more; the number of partitions is the table's rows over ``part_rows``, between 16 and ``max_parts``.
    """
    scratch = Scratch(vectors.sparkSession)
    n = vectors.count()
    parts = min(max_parts, max(16, n // part_rows))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample_rows, 20 * parts)).toPandas()
    dims = int(sample["v"].map(len).max()) if len(sample) else 1
    router = fit(vectors_of(sample["v"], dims), parts, k, recall)

    def route(probes: int):
        @F.pandas_udf("array<int>")
        def parts(batch: pd.Series) -> pd.Series:
            x = vectors_of(batch.map(lambda v: v[:dims]), dims)
            return pd.Series(list(np.argsort(-router.logits(x), axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return parts

    home = scratch.store(vectors.withColumn("_part", F.element_at(route(1)(F.col("v")), 1)), "homes")
    sizes = home.groupBy("_part").count().select(F.col("_part"), F.ceil(F.col("count") / block_rows).cast("int").alias("_blocks"))
    asked = scratch.store(queries.withColumn("_part", F.explode(route(router.probes)(F.col("v")))), "routes")
    loads = asked.groupBy("_part").count().select(F.col("_part"), F.ceil(F.col("count") / chunk_rows).cast("int").alias("_chunks"))
    grid = F.broadcast(sizes.join(loads, "_part"))  # a row for each partition: at most max_parts

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.join(grid, "_part").withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own_n)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return df.select("vec_id", "v", "_part", "_block", "_chunk").groupBy("_part", "_block", "_chunk")

    def pair(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        rows = rows.sort_values("vec_id", kind="stable")
        wide = max(rows["v"].map(len).max(), own["v"].map(len).max())
        return top_k(rows["vec_id"].to_numpy(np.int64), vectors_of(rows["v"], wide), own["vec_id"].to_numpy(np.int64), vectors_of(own["v"], wide), k)

    best = dealt(home, "_block", "_blocks", "_chunk", "_chunks").cogroup(dealt(asked, "_chunk", "_chunks", "_block", "_blocks")).applyInPandas(pair, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scratch.finish(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """Search ``embeddings`` (vec_id, embedding) for its rows whose id is divisible by ``every``; see ``search``.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, neither do rows without id. A repeated query row
    is one query; repeated candidate rows each take a rank; ties go to the smaller id; missing components count 0; vectors may be of any length. Other columns are not read. An empty table gives no rows.
    """
    v = F.col("embedding")
    fine = embeddings.where(F.col("vec_id").isNotNull() & usable(v) & F.exists(v, lambda x: x != 0))
    rows = store(fine.select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v")), "vectors")
    return search(rows, rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), k, **options)
