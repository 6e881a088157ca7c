"""How the sources of each language differ in their words, by counts of terms behind a count-min sketch.

1. Sketch. Each task counts, for each term of a language, the documents that hold it into ``depth`` rows of counters; a shuffle adds the
   counters up. No counter is less than the document frequency of a term that it stands for, so a term with a counter under
   ``min_docs`` can't have that many documents. What is kept of the merged sketch is one bit a counter: whether it reaches
   ``min_docs``. The number of counters grows with the corpus up to ``max_width``, so the bits have a fixed bound (``depth * max_width / 8``
   bytes) and can be sent to all tasks.
2. Counts. A second pass counts the terms that the bits let pass, by (lang, source, term), combined in each task before the shuffle.
   Now frequencies are exact, and the terms that passed by chance go. A source or term that holds much of the corpus is one row a task.
3. Pairs. With p of a term in a group, and p0 that of a kept term which the group lacks, the sum of abs(p - q) over all kept terms is
   V * abs(p0 - q0), plus a correction for the terms of either group, plus one for those of both. The first correction needs only how many terms a
   group holds how often; the last one joins the groups that hold the same term. So no row is made for a term that a group lacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import as_bytes
from .shared import LONG_WORD, Scratch, by_bytes, distinct_spans, mix, runs, small_batches, span_hashes, span_strings, text_bounds

#: Bytes inside a term: letters and all beyond ASCII.
_KIND = np.zeros(256, np.int8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CELLS = "cell long, n long"
COUNTS = "lang string, source string, term string, n long, docs long"
SCALE, SMOOTH = 1_000_000_000, 5


class Terms:
    """Terms of many texts: their hashes (with the language's), spans and texts."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.start, self.end = runs(_KIND[self.data])
        h = span_hashes(self.data, self.start, self.end)
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        self.text = np.searchsorted(text_bounds(texts), self.start, "right") - 1
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        own = np.array([known[x] for x in langs], np.uint64)
        self.hashes = mix(h ^ own[self.text]) if len(h) else h

    def once(self) -> np.ndarray:
        """Indices of one term of each text and hash."""
        order = np.lexsort((self.hashes, self.text))
        new = (self.hashes[order[1:]] != self.hashes[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])
        return order[np.append(True, new)] if len(order) else order


class Sketch:
    """Where a term's counters are: one of ``width`` in each of ``depth`` rows."""

    def __init__(self, depth: int, width: int):
        self.depth, self.width = depth, width

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """The counters of terms in a row. Two terms with one hash share all of theirs: a document that holds both counts once, but for each of them."""
        return (mix(hashes + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(self.width - 1)).astype(np.int64) + row * self.width

    def passing(self, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Indices of the hashes of which every counter's bit is set."""
        at = np.arange(len(hashes))
        for row in range(self.depth):
            cell = self.cells(hashes[at], row)
            at = at[(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        return at


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def sketch_bits(docs: DataFrame, sketch: Sketch, min_docs: int, scratch: Scratch, flush: int = 1 << 20) -> np.ndarray:
    """Bits by counter: whether at least ``min_docs`` documents count there. Only they reach the driver, packed by tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"cell": cell, "n": np.minimum(n, min_docs)})  # more would not tell more

        for batch in batches:
            texts, langs = as_bytes(batch["text"]), batch["lang"].tolist()
            for a, b in by_bytes(texts):
                terms = Terms(texts[a:b], langs[a:b])
                h = terms.hashes[terms.once()]
                held.append(np.concatenate([sketch.cells(h, row) for row in range(sketch.depth)]))
                if sum(map(len, held)) >= flush:
                    yield out()
        if held:
            yield out()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        cell = group["cell"].to_numpy()
        bits = np.zeros(CHUNK, np.uint8)
        bits[cell % CHUNK] = 1
        return pd.DataFrame({"chunk": [int(cell[0] // CHUNK)], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    full = docs.select("text", "lang").mapInPandas(count, CELLS).groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    packed = scratch.store(full.groupBy(F.floor(F.col("cell") / CHUNK)).applyInPandas(pack, "chunk long, bits binary"), "sketch")
    out = np.zeros(sketch.depth * sketch.width // 8, np.uint8)
    for r in packed.collect():
        out[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


CHUNK = 1 << 16  # counters whose bits travel in one row


def exact_counts(docs: DataFrame, sketch: Sketch, bits: np.ndarray, most: int = 4 << 20) -> DataFrame:
    """COUNTS of the terms that the sketch lets pass, by group: first in each slice of ``most`` bytes, then in each task, then by the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in by_bytes(texts, most):
                yield group_counts(texts[a:b], langs[a:b], sources[a:b], sketch, sent.value)

    return docs.select("text", "lang", "source").mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def group_counts(texts: list[bytes], langs: list[str], sources: list[str], sketch: Sketch, bits: np.ndarray) -> pa.RecordBatch:
    """COUNTS of the terms that pass, in a slice of texts. Terms are told apart by their bytes."""
    terms = Terms(texts, langs)
    at = sketch.passing(terms.hashes, bits)
    groups = {g: k for k, g in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
    group = np.array([groups[g] for g in zip(langs, sources, strict=True)], np.int64)
    start, end, text = terms.start[at], terms.end[at], terms.text[at]
    head, number = distinct_spans(terms.data, start, end, terms.hashes[at])
    wide = np.int64(max(len(head), 1))
    key, n = np.unique(group[text] * wide + number, return_counts=True)
    once = np.unique(text * wide + number)
    _, docs = np.unique(group[once // wide] * wide + once % wide, return_counts=True)
    word = head[key % wide] if len(key) else key
    names = [pa.array(x, pa.string()).take(pa.array(key // wide)) for x in zip(*groups, strict=True)]
    return pa.RecordBatch.from_arrays([*names, span_strings(terms.data, start[word], end[word]), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def strings(terms: Terms, at: np.ndarray) -> pa.Array:
    """The terms as an Arrow array, copied in one piece."""
    size = terms.end[at] - terms.start[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = terms.data[np.repeat(terms.start[at] - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def share(count, n, v):
    """1 + floor(10**9 * (count + 5) / (N + 5 V)) in whole numbers; null where V is 0."""
    top = F.lit(SCALE).cast("decimal(20,0)") * (count + SMOOTH).cast("decimal(18,0)")
    return F.when(v > 0, 1 + F.call_function("div", top, (n + SMOOTH * v).cast("decimal(20,0)")))


def kept_counts(docs: DataFrame, min_docs: int, depth: int, max_width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n, v) of kept terms that a group holds, and (lang, v, lang_total) of each language."""
    rows = rows_of(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = 1 << min(max((chars // 128).bit_length(), 16), max_width.bit_length() - 1)
    sketch = Sketch(depth, width)
    bits = sketch_bits(rows, sketch, min_docs, scratch)
    counted = scratch.store(exact_counts(rows, sketch, bits), "term-counts")
    per = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    kept = scratch.store(per, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    return counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), scratch.store(langs, "langs")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, depth: int = 4, max_width: int = 1 << 26) -> DataFrame:
    """Per (lang, source) group of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language and the sum of abs(p - q) over the language's kept terms, p and q the two sources' shares of 10**9.
    Part ``term``: the ``top`` terms whose share lies most over that of the language. Kept are terms in at least ``min_docs`` documents of the language. Null text,
    lang and source are ''. Groups without terms have count 0 of each; without kept terms all values are 0. Repeated rows count each. Ties go to the
    item that is smaller in UTF-8. Texts may be of any length: they are worked off in slices of about 1 MB, a longer one by itself. Other columns are
    not read. An empty table gives no rows. ``max_width`` bounds the sketch: depth * max_width / 8 bytes, 32 MB.
    """
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    held, langs = kept_counts(docs, min_docs, depth, max_width, scratch)
    held = scratch.store(held, "held")
    groups = rows_of(docs).select("lang", "source").groupBy("lang", "source").count().drop("count")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("lang_total", F.lit(0)).cast("long").alias("lang_total"))
    groups = scratch.store(groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).cast("long")), "groups")
    shares = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    shares = scratch.store(shares.select("lang", "source", "term", "n", "p", "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")
    return scratch.finish(pairs(shares, groups).unionByName(terms_over(shares, top)), "divergence")


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda df, k, *names: df.select("lang", *[F.col(c).alias(f"{c}{k}") for c in names])
    both = side(groups, 1, "source", "p0", "v").join(side(groups, 2, "source", "p0"), "lang").where("source1 <> source2")
    base = both.withColumn("value", F.col("v1") * F.abs(F.col("p01") - F.col("p02")))
    # terms of the first group, by how many have the same share, against what the second gives those it lacks; likewise the other way round
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    own = side(alike, 1, "source", "p", "p0", "k").join(side(groups, 2, "source", "p0"), "lang").where("source1 <> source2")
    own = own.groupBy("lang", "source1", "source2").agg(F.sum(F.col("k1") * (F.abs(F.col("p1") - F.col("p02")) - F.abs(F.col("p01") - F.col("p02")))).alias("value"))
    shared = side(shares, 1, "source", "term", "p", "p0").withColumnRenamed("term1", "term").join(side(shares, 2, "source", "term", "p", "p0").withColumnRenamed("term2", "term"), ["lang", "term"]).where("source1 <> source2")
    d = lambda x, y: F.abs(F.col(x) - F.col(y))
    shared = shared.groupBy("lang", "source1", "source2").agg(F.sum(d("p1", "p2") - d("p1", "p02") - d("p01", "p2") + d("p01", "p02")).alias("value"))
    cols = ["lang", "source1", "source2", "value"]
    turned = own.select("lang", F.col("source2").alias("source1"), F.col("source1").alias("source2"), "value")
    out = base.select(cols).union(own.select(cols)).union(turned.select(cols)).union(shared.select(cols)).groupBy("lang", "source1", "source2").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source1").orderBy(F.desc("value"), "source2"))
    return out.select("lang", F.col("source1").alias("source"), F.lit("pair").alias("part"), F.col("source2").alias("item"), "value", rank.alias("rank"))


def terms_over(shares: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = shares.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return over.withColumn("rank", rank).where(F.col("rank") <= top)
