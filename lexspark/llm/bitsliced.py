"""Exact top-k search by inner product of quantised vectors, on a bit-sliced index.

Each block of at most ``block_rows`` vectors keeps, for every component and every bit, one bitmap over its rows. A query's
scores of all rows of a block are added up with bitmap arithmetic only: sums of components are taken from tables of the 16 subset
sums of four components (themselves bit-sliced), one for each bit of the query's components, and then weighed by
doubling. The k best rows follow from the slices of the result, the most significant first; rows on the boundary have equal scores and are
taken by id. The bitmaps of a block are made once and stored as one row, so are the vectors of a chunk of queries; they meet in a
cogroup by the numbers of both, so every task holds one block and one chunk, and a row crosses the network once as a row and then as a few bits
a component for each ``chunk_rows`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, store

RESULT = "query_id long, vec_id long, score long"
Slices = list[np.ndarray]


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor empty and hold no null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def quantise(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def width_of(values: np.ndarray) -> int:
    """Bits of two's complement that hold all values."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Bitmaps along the last axis: uint64 words, row 0 in the lowest bit."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def add(a: Slices, b: Slices, carry: np.ndarray | None = None, width: int | None = None) -> Slices:
    """Sum of two unsigned bit-sliced numbers (missing slices are 0), one slice longer, or ``width`` slices."""
    out, n = [], max(len(a), len(b)) + 1 if width is None else width
    for i in range(n):
        x, y = (s[i] if i < len(s) else None for s in (a, b))
        if x is None and y is None:
            if carry is None:
                break
            out.append(carry)
            carry = None
        elif x is None or y is None:
            one = y if x is None else x
            out.append(one if carry is None else one ^ carry)
            carry = None if carry is None else one & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            either = x ^ y
            out.append(either ^ carry)
            carry = (x & y) | (either & carry)
    return out


class Block:
    """Bit-sliced index over the rows of ``vectors`` (ids ascending). Components are kept as unsigned numbers, less by ``offset``."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray):
        self.ids, self.rows, (self.width, dims, self.words) = ids, len(ids), slices.shape
        self.offset = 1 << (self.width - 1)
        zero = np.zeros(self.words, np.uint64)
        self.tables = []  # of four components each: [slice][mask, word]
        for first in range(0, dims, 4):
            sums: list[Slices] = [[]]
            for j in range(first, min(first + 4, dims)):
                sums += [add(s, [slices[b, j] for b in range(self.width)]) for s in sums]
            most = max(map(len, sums))
            self.tables.append([np.stack([s[i] if i < len(s) else zero for s in sums]) for i in range(most)])

    @staticmethod
    def slices(vectors: np.ndarray) -> np.ndarray:
        """Bitmaps [bit, component, word] of the components plus the offset that makes them unsigned."""
        width = width_of(vectors)
        shifted = vectors + (1 << (width - 1))
        return np.stack([bitmaps(((shifted >> b) & 1).T.astype(np.uint8)) for b in range(width)])

    def scores(self, queries: np.ndarray) -> tuple[Slices, np.ndarray]:
        """Slices [query, word] of score + a constant per query, as unsigned numbers, and those constants."""
        n, dims = queries.shape
        wide = width_of(queries)
        bits = ((queries[:, None, :] >> np.arange(wide)[None, :, None]) & 1).astype(np.int64)  # two's complement
        parts: Slices = []  # [slice][query, bit, word]: sums of the components where the query has that bit
        for g, table in enumerate(self.tables):
            own = bits[:, :, 4 * g : 4 * g + 4]
            mask = (own << np.arange(own.shape[2])).sum(2)
            parts = add(parts, [t[mask] for t in table]) if parts else [t[mask] for t in table]
        bound = int(np.abs(queries).sum(1).max(initial=0)) * 2 * self.offset + 1
        width = max(bound.bit_length() + 2, len(parts) + wide + 1)
        total: Slices = []
        for a in range(wide - 2, -1, -1):  # the sign bit is taken off below
            total = add([np.zeros((n, self.words), np.uint64), *total] if total else [], [p[:, a] for p in parts])
        zero, ones = np.zeros((n, self.words), np.uint64), np.full((n, self.words), 2**64 - 1, np.uint64)
        top = [zero] * (wide - 1) + [p[:, wide - 1] for p in parts]
        minus = [~top[i] if i < len(top) else ones for i in range(width)]
        total = add(total + [zero] * (width - len(total)), minus, ones, width)
        total[-1] = ~total[-1]  # from two's complement to unsigned: order by value
        return total, (1 << (width - 1)) + self.offset * queries.sum(1).astype(object)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query: its id, the k best rows' places and scores, best first, ties by id; never a row of the query's own id."""
        total, constant = self.scores(queries)
        n = len(queries)
        open_ = np.zeros((n, self.words), np.uint64)
        open_[:] = bitmaps(np.ones(self.rows, np.uint8))
        first, last = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        for i in np.flatnonzero(last > first):
            for r in range(first[i], last[i]):
                open_[i, r >> 6] &= ~np.uint64(1 << (r & 63))
        sure, sure_n = np.zeros_like(open_), np.zeros(n, np.int64)
        for s in reversed(total):
            high = open_ & s
            count = sure_n + np.bitwise_count(high).sum(1, dtype=np.int64)
            narrow = (count > k)[:, None]
            sure = np.where(narrow, sure, sure | high)
            sure_n = np.where(narrow[:, 0], sure_n, count)
            open_ = np.where(narrow, high, open_ & ~s)
        for i in range(n):
            rows = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            if len(rows) < k:  # the boundary: equal scores, smallest ids first
                ties = np.flatnonzero(np.unpackbits(open_[i].view(np.uint8), bitorder="little"))
                rows = np.concatenate([rows, ties[: k - len(rows)]])
            rows = rows[rows < self.rows]
            word, bit = rows >> 6, (rows & 63).astype(np.uint64)
            value = np.zeros(len(rows), object)
            for b, s in enumerate(total):
                value += ((s[i][word] >> bit) & np.uint64(1)).astype(object) << b
            score = (value - constant[i]).astype(np.int64)
            order = np.lexsort((self.ids[rows], -score))
            yield int(query_ids[i]), rows[order], score[order]


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 1 << 14, chunk_rows: int = 4096, at_once: int = 16) -> DataFrame:
    """Of each query the k rows of ``vectors`` (vec_id, q array<long>) with the largest inner products: query_id, rank, vec_id, score.

    Ties go to the smaller id; rows with a query's own id are no candidates of it; missing components count 0. Rows without id take no part.
    """
    scratch = Scratch(vectors.sparkSession)
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    m = queries.count()
    blocks = max(1, -(-n // block_rows))
    # few blocks meet more and smaller chunks, so that all cores have work; results are the same
    chunks = max(1, -(-m // chunk_rows), min(-(-m // at_once), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        slices = Block.slices(matrix(rows["q"], dims))
        return pd.DataFrame({"_block": [rows["_block"].iat[0]], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "width": [len(slices)], "slices": [slices.tobytes()]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        q = matrix(rows["q"], dims)
        kind = next(t for t in ("<i2", "<i4", "<i8") if (q.astype(t) == q).all())
        return pd.DataFrame({"_chunk": [rows["_chunk"].iat[0]], "asked": [rows["vec_id"].to_numpy("<i8").tobytes()], "kind": [kind], "vectors": [q.astype(kind).tobytes()]})

    def pair(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(chunk):
            b, c = block.iloc[0], chunk.iloc[0]
            own = Block(np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["slices"], "<u8").reshape(b["width"], dims, -1))
            ids, qs = np.frombuffer(c["asked"], "<i8"), np.frombuffer(c["vectors"], c["kind"]).reshape(-1, dims).astype(np.int64)
            for i in range(0, len(ids), at_once):
                for q, at, score in own.top(ids[i : i + at_once], qs[i : i + at_once], k):
                    found["query_id"].append(np.full(len(at), q))
                    found["vec_id"].append(own.ids[at])
                    found["score"].append(score)
        return pd.DataFrame({c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in found.items()})

    block = vectors.withColumn("_block", place(blocks)).groupBy("_block").applyInPandas(index, "_block int, ids binary, width int, slices binary")
    block = scratch.store(block, "bit-slices").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = queries.withColumn("_chunk", place(chunks)).groupBy("_chunk").applyInPandas(pack, "_chunk int, asked binary, kind string, vectors binary")
    chunk = scratch.store(chunk, "queries").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = min(blocks * chunks, 20_000)
    dealt = [df.repartition(tasks, "_block", "_chunk").groupBy("_block", "_chunk") for df in (block, chunk)]
    best = dealt[0].cogroup(dealt[1]).applyInPandas(pair, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scratch.finish(ranked.select("query_id", "rank", "vec_id", "score"), "top")


def top_by_inner_product(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Search ``embeddings`` (vec_id, embedding) for its rows whose id is divisible by ``every``; see ``search``.

    Vectors that are null or empty or hold null or non-finite components take no part, neither do rows without id. A repeated query row is
    one query; repeated candidate rows each take a rank. Vectors may be of any length; a block holds all components of its rows. Other columns are not read.
    An empty table gives no rows.
    """
    fine = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = store(fine.select("vec_id", quantise(F.col("embedding"), scale).alias("q")), "quantised")
    return search(rows, rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), k)
