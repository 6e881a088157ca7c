"""Whitening of embeddings from an exact integer scatter.

Each component c becomes the integer x = floor(``scale`` * c) + ``offset``. One pass over the vectors accumulates, per partition, the
sums and cross-products of y = x - ``offset`` (the scatter does not change with a shift) as exact integers of any length; a shuffle adds
them up, limb by limb. From their totals the driver forms n * Y'Y - S S' in whole numbers. Only this matrix, whose size is the square of the
dimension however many rows there are, is turned into floats (each entry rounded once) and decomposed by ``eigh``.

Products within a block are made by the matrix product of floats, which is exact here: the integers are split into limbs of 20 bits, and a
block has at most 2**12 rows, so no sum exceeds 2**52.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

LIMB, ROWS = 20, 1 << 12
WORD = 1 << 32
#: Integers of larger size than this take no part, as scale * c must fit a long with room for the offset.
MOST = float(1 << 62)
TOTALS = "i int, j int, k int, v long"


def usable(v):
    """Whether a vector has entries, all of them there and finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def as_integers(v, scale: float, offset: int):
    """floor(scale * c) + offset for each entry, with c as double."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))


def fit_list(embeddings: DataFrame, scale: float, offset: int) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part, but for their dimension."""
    v = F.col("embedding")
    small = F.forall(v, lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < MOST)
    return embeddings.where(usable(v)).where(small).select("vec_id", as_integers(v, scale, offset).alias("x"))


def split(y: np.ndarray) -> list[np.ndarray]:
    """Limbs of the integers as floats, least first: y = sum of limb * 2**(20 * place); only the last one has a sign."""
    out = []
    while y.size and np.abs(y).max() >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*out, y.astype(float)]


def matrix_of(column: pa.Array, wide: int) -> np.ndarray:
    """int64 [row, entry] of a list column without nulls."""
    return np.asarray(column.flatten()).reshape(-1, wide)


def words_of(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) with value = sum of part * 2**(32 * place); parts lie between -2**32 and 2**32."""
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        value, part = divmod(value, WORD)
        if part:
            yield k, sign * part
        k += 1


class Scatter:
    """Exact sums and cross-products of integer rows: ``add`` rows, then ``rows`` gives the totals as words."""

    BLOCKS = 128  # whose products, each under 2**55, a long holds together

    def __init__(self, wide: int):
        self.wide, self.n, self.blocks = wide, 0, 0
        self.total, self.products = np.zeros(wide, object), np.zeros((wide, wide), object)
        self.held: dict[tuple[str, int], np.ndarray] = {}

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), ROWS):
            limbs = split(y[a : a + ROWS])
            for p, x in enumerate(limbs):
                self.hold("total", p, x.sum(0))
                for q, z in enumerate(limbs[p:], p):
                    m = x.T @ z
                    self.hold("products", p + q, m if p == q else m + m.T)
            self.blocks += 1
            if self.blocks == self.BLOCKS:
                self.flush()
        self.n += len(y)

    def hold(self, what: str, place: int, value: np.ndarray) -> None:
        value = value.astype(np.int64)
        self.held[what, place] = self.held[what, place] + value if (what, place) in self.held else value

    def flush(self) -> None:
        for (what, place), value in self.held.items():
            setattr(self, what, getattr(self, what) + value.astype(object) * (1 << (LIMB * place)))
        self.held, self.blocks = {}, 0

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(i, j, place, part): entries of the upper triangle; j = -1 for sums, i = -1 for the number of rows."""
        self.flush()
        yield -1, -1, 0, self.n
        for i in range(self.wide):
            yield from ((i, -1, k, v) for k, v in words_of(self.total[i]))
            for j in range(i, self.wide):
                yield from ((i, j, k, v) for k, v in words_of(self.products[i, j]))


def add_up(rows, wide: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and cross-products (Python integers) from rows (i, j, place, part)."""
    n, total, products = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
    for i, j, k, v in rows:
        part = int(v) * WORD**k
        if i < 0:
            n += part
        elif j < 0:
            total[i] += part
        else:
            products[i, j] += part
            if i != j:
                products[j, i] += part
    return n, total, products


def scatter_of(fit: DataFrame, wide: int, offset: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Exact n, S and Y'Y of rows x (array<long> of ``wide`` entries) less the offset. The driver gets some wide**2 / 2 rows of few words each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(wide)
        for batch in batches:
            if batch.num_rows:
                own.add(matrix_of(batch.column(0), wide) - offset)
        if own.n:
            i, j, k, v = zip(*own.rows(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], names=["i", "j", "k", "v"])

    parts = fit.select("x").mapInArrow(count, TOTALS).groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return add_up(((r["i"], r["j"], r["k"], int(r["v"])) for r in parts.collect()), wide)


@dataclass
class Whitener:
    """Mean as an exact fraction S / n, eigenvalues (falling) and eigenvectors [entry, component] of the covariance."""

    n: int
    total: np.ndarray  # S of y = x - offset
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    offset: int

    @classmethod
    def of(cls, n: int, total: np.ndarray, products: np.ndarray, offset: int) -> "Whitener":
        """n * Y'Y - S S' is exact; V is that over n**2, each entry rounded once. The sign of a component makes its largest entry positive."""
        whole = products * n - np.outer(total, total)
        v = np.array([[x / (n * n) for x in row] for row in whole.tolist()], float).reshape(len(total), len(total))
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        lead = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
        trace = sum(whole[i, i] for i in range(len(total))) / (n * n)
        return cls(n, total, values, vectors * np.where(lead < 0, -1.0, 1.0), trace, offset)

    def rank(self) -> int:
        """Number of components whose eigenvalue is not lost in rounding."""
        return int((self.values > max(self.values[0], 0.0) * len(self.values) * np.finfo(float).eps * 4).sum()) if len(self.values) and self.values[0] > 0 else 0

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Rows n * x - S rounded to floats once, and the exact sum of their squares."""
        y = x - self.offset
        most = max((abs(int(s)) for s in self.total), default=0) + self.n * (int(np.abs(y).max()) if y.size else 0)
        if most < 1 << 62:
            d = y * np.int64(self.n) - self.total.astype(np.int64)
            if most < 3_000_000_000 // max(1, int(np.sqrt(self.total.size)) + 1):  # squares and their sum fit a long
                return d.astype(float), (d * d).sum(1).tolist()
            d = d.astype(object)
        else:
            d = y.astype(object) * self.n - self.total
        return d.astype(float), [sum(e * e for e in row) for row in d.tolist()]

    def project(self, deviations: np.ndarray, k: int) -> np.ndarray:
        return deviations / self.n @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry by size of the whitened rows' covariance less the identity, measured on all of them (Spark centres before it multiplies)."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    z = F.col("z")
    row = whitened.agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs((row[f"c{i}_{j}"] or 0.0) - (i == j)) for i, j in pairs), default=0.0)


def whiten(embeddings: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding) and component from 1: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over dimensions of (n * x - S)**2 as decimal(38,0), exact. Vectors that are null or empty or hold null or non-finite entries take
    no part, nor do entries beyond 2**62 once scaled, nor vectors of other lengths than the most frequent one (the longer one of ties). Repeated rows and
    ids count each, null ids are kept. Components whose eigenvalue is 0 but for rounding can't be scaled and have no rows, so a table of one vector
    or of equal ones gives none, like an empty one. Other columns are not read. Equal eigenvalues leave the choice of their vectors to ``eigh``.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fit_list(embeddings, scale, offset)
    wide = fit.groupBy(F.size("x").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    if wide is None:
        return spark.createDataFrame([], schema)
    fit = fit.where(F.size("x") == wide["wide"])
    model = Whitener.of(*scatter_of(fit, wide["wide"], offset), offset)
    k = min(components, model.rank())
    if not k:
        return spark.createDataFrame([], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                d, squares = model.deviations(matrix_of(part.column(1), wide["wide"]))
                z = model.project(d, k)
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, k, dtype=np.int32), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(s) for s in squares], pa.string()), lists], names=["vec_id", "deviation", "z"])

    fit = fit.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    whitened = scratch.store(fit.mapInArrow(apply, "vec_id long, deviation string, z array<double>"), "whitened")
    error = identity_error(whitened, k)
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values[:k]]), F.col("component"))
    rows = whitened.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    out = rows.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    return scratch.finish(out, "whitening")
