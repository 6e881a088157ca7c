"""Log likelihood of texts under a subword lattice.

A word is written with a space before it, and its lattice holds all ways to cut it into pieces of an existing vocabulary (single bytes included, so
none is without a way). The probability of a word is the sum over all of them, by a forward recursion in logarithms. As no piece spans
a space, that of a text is the product over its words, times that of the end. So each distinct word of the corpus is worked out once.

The vocabulary's scores weigh the segmentations first: they are ranks (0, -1, -2, ...), read as weights 1 / (shift + rank). With these as prior, the
pieces' probabilities are then fitted to the words of the training texts by expectation and maximisation: the expected uses of
each piece follow from forward and backward recursions over each distinct word, times its count. Pieces are never added or changed.

Texts become rows (row, words, counts) once; words and counts of the whole corpus come from an aggregate. The values of the ``hot_words`` most frequent words
(a bounded table) are sent to all tasks and summed there, so none of their many uses becomes a row; all other words are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _TABLE, Scratch, _powers, by_bytes, distinct_spans, small_batches, span_strings, word_hashes

LN10 = float(np.log(10.0))


class Lattice:
    """Pieces by their bytes, and the arcs they make in words.

    Bytes are looked up by polynomials of their windows, length after length, only from where some piece begins alike; so long windows are few.
    """

    BITS = 20

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        size = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(size) - size
        total, inverse = self.sums(data)
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, int(size.max()) + 1):
            longer, own = np.flatnonzero(size >= n), np.flatnonzero(size == n)
            hashes = (total[start + n * (size >= n)] - total[start]) * inverse[start]
            begins, ends = np.zeros(1 << self.BITS, bool), np.zeros(1 << self.BITS, bool)
            begins[hashes[longer] >> np.uint64(64 - self.BITS)] = True
            ends[hashes[own] >> np.uint64(64 - self.BITS)] = True
            own = own[np.argsort(hashes[own])]
            self.by_size.append((begins, ends, hashes[own], own))

    @staticmethod
    def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fwd, inverse = _powers(len(data) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * fwd[:-1])]), inverse

    def arcs(self, words: pa.Array) -> "Arcs":
        data, size = spelt(words)
        total, inverse = self.sums(data)
        at, found = np.arange(len(data)), []
        for n, (begins, ends, keys, own) in enumerate(self.by_size, 1):
            if n > 1:  # no piece has a space but at its start, so no window reaches into the next word
                at = at[: np.searchsorted(at, len(data) - n, "right")]
            h = (total[at + n] - total[at]) * inverse[at]
            top = h >> np.uint64(64 - self.BITS)
            maybe = np.flatnonzero(ends[top])
            k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            hit = keys[k] == h[maybe] if len(keys) else np.zeros(len(maybe), bool)
            found.append((n, at[maybe[hit]], own[k[hit]]))
            at = at[begins[top]]
            if not len(at):
                break
        return Arcs(size, found)


def spelt(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes end to end, each after a space, and the number of bytes of each with its space."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    held = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets) + 1
    data = np.full(int(size.sum()), 32, np.uint8)
    inside = np.ones(len(data), bool)
    inside[np.cumsum(size) - size] = False
    data[inside] = held
    return data, size


class Arcs:
    """Arcs of many words' lattices; the nodes of all words are numbered one after another, one more than a word has bytes.

    ``found``: for each length, where arcs begin in the words' bytes (each with its space) and their pieces. Arcs of one length that begin equally far from their
    words' starts share no node, so each such group is one step of the recursions.
    """

    def __init__(self, size: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]):
        word = np.repeat(np.arange(len(size)), size)
        self.base = np.cumsum(size + 1) - (size + 1)
        self.last, self.nodes = self.base + size, int((size + 1).sum())
        narrow = np.uint16 if not len(size) or size.max() < 1 << 16 else np.int64  # numpy sorts 16 bits in linear time
        parts, groups, first = [], [], 0
        for n, at, piece in found:
            own = word[at]
            far = (at - (self.base - np.arange(len(size)))[own]).astype(narrow)
            order = np.argsort(far, kind="stable")
            far, start = far[order], (at + own)[order]
            edge = np.append(np.flatnonzero(np.append(True, far[1:] != far[:-1])), len(far)) if len(far) else np.zeros(1, np.int64)
            groups += [(int(far[a]), first + a, first + b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            parts.append((own[order], start, start + n, piece[order]))
            first += len(far)
        self.word, self.start, self.end, self.piece = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.groups = [(a, b) for _, a, b in sorted(groups)]

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log of the probability of all ways from a word's start to each node."""
        out, weight = np.full(self.nodes, -np.inf), log_p[self.piece]
        out[self.base] = 0.0
        for a, b in self.groups:
            end = self.end[a:b]
            out[end] = np.logaddexp(out[end], out[self.start[a:b]] + weight[a:b])
        return out

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        """Log of the probability of all ways from each node to its word's end."""
        out, weight = np.full(self.nodes, -np.inf), log_p[self.piece]
        out[self.last] = 0.0
        for a, b in reversed(self.groups):
            start = self.start[a:b]
            out[start] = np.logaddexp(out[start], out[self.end[a:b]] + weight[a:b])
        return out

    def marginals(self, log_p: np.ndarray) -> np.ndarray:
        return self.forward(log_p)[self.last]

    def expected(self, log_p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``count`` times."""
        before, after = self.forward(log_p), self.backward(log_p)
        share = np.exp(before[self.start] + log_p[self.piece] + after[self.end] - before[self.last][self.word])
        return np.bincount(self.piece, share * count[self.word], len(log_p))


def vocabulary(path: str, shift: float = 10.0) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file that can occur in lower-cased words, as bytes with a space for the mark of a word's start, and their weights by the file's scores.

    Bytes of the fallback weigh as much as the last piece. A piece that is one byte and that byte's fallback are one piece.
    """
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    size = file.get_piece_size()
    for i in range(size):
        if file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
            continue
        body = bytes([int(file.id_to_piece(i)[3:5], 16)]) if file.is_byte(i) else file.id_to_piece(i).replace("▁", " ").encode()
        if b" " in body[1:] or any(65 <= b <= 90 for b in body):
            continue
        rank = size if file.is_byte(i) else min(size, -file.get_score(i))
        weights[body] = weights.get(body, 0.0) + 1.0 / (shift + rank)
    w = np.array(list(weights.values()))
    return list(weights), w / w.sum()


_LATTICES: dict[str, tuple[Lattice, np.ndarray]] = {}


def lattice(path: str) -> tuple[Lattice, np.ndarray]:
    """The vocabulary's lattice and prior weights, made once in a process."""
    if path not in _LATTICES:
        pieces, prior = vocabulary(path)
        _LATTICES[path] = Lattice(pieces), prior
    return _LATTICES[path]


# ---- words of the corpus ------------------------------------------------------------------------------------------


def doc_words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, n_words, words, counts) of docs (doc_id, text, held_out): the distinct words of each row and how often it has them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(3).cast(pa.binary()).to_pylist()]
            for a, b in by_bytes(texts):
                hashes, first, start, end, data = word_hashes(texts[a:b], spans=True)
                head, number = distinct_spans(data, start, end, hashes)
                text = np.repeat(np.arange(b - a), np.diff(first))
                key, n = np.unique(text * np.int64(max(len(head), 1)) + number, return_counts=True)
                word = head[key % max(len(head), 1)] if len(key) else key
                offsets = np.searchsorted(key, np.arange(b - a + 1) * np.int64(max(len(head), 1))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, span_strings(data, start[word], end[word])), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(np.diff(first).astype(np.int64)), *lists], names=["row", "doc_id", "held_out", "n_words", "words", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(make, "row long, doc_id long, held_out boolean, n_words long, words array<string>, counts array<long>")


@dataclass
class Model:
    """Log probabilities of the pieces and of the end."""

    log_p: np.ndarray
    log_end: float


def model_of(expected: np.ndarray, ends: float, prior: np.ndarray, strength: float) -> Model:
    """Pieces by expected uses and ``strength`` uses a piece spread by the prior; the end by the number of texts."""
    uses = expected + strength * len(prior) * prior
    total = uses.sum() + ends + 1.0
    return Model(np.log(uses / total), float(np.log((ends + 1.0) / total)))


def in_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of rows whose words (the first column) have about ``most`` bytes together, shorter words first."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(0))).astype(np.int64)
        batch, size = batch.take(pa.array(np.argsort(size, kind="stable"))), np.sort(size)
        total, a = np.concatenate([[0], np.cumsum(size + 1)]), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def fit(words: DataFrame, ends: int, path: Callable[[], str], rounds: int, strength: float) -> Model:
    """Fit pieces to ``words`` (word, c). Each round is one pass over the distinct words; the driver gets a number for each piece."""

    def use(log_p: np.ndarray):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, uses = lattice(path())[0], np.zeros(len(log_p))
            for part in in_slices(batches):
                uses += own.arcs(part.column(0)).expected(log_p, np.asarray(part.column(1)).astype(float))
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], names=["piece", "n"])

        return count

    _, prior = lattice(path())
    total = words.agg(F.sum("c")).first()[0] or 0
    model = model_of(prior * total, ends, prior, strength)
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds if total else 0):
        found = known.mapInArrow(use(model.log_p), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.zeros(len(prior))
        expected[found["piece"]] = found["n"]
        model = model_of(expected, ends, prior, strength)
    return model


def word_scores(words: DataFrame, model: Model, path: Callable[[], str], n: int, v: int) -> DataFrame:
    """``words`` (word, c, uses) with log10 probabilities: ``base``, ``score``, and ``plain`` by the vocabulary's weights alone."""
    log_p, plain = model.log_p, np.log(lattice(path())[1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path())[0]
        for part in in_slices(batches):
            arcs = own.arcs(part.column(0))
            found = [pa.array(arcs.marginals(p) / LN10) for p in (log_p, plain)]
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=["word", "c", "uses", "score", "plain"])

    out = words.select("word", "c", "uses").mapInArrow(score, "word string, c long, uses long, score double, plain double")
    return out.withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))))


SUMS = ("known", "base", "score", "plain")


def sum_often(texts: DataFrame, hot: pa.Table) -> DataFrame:
    """``texts`` (see ``doc_words``) with SUMS over the words in ``hot`` (word, SUMS), and words and counts of the others only."""
    sent = texts.sparkSession.sparkContext.broadcast((hot.column("word").combine_chunks(), np.array([np.asarray(hot.column(c)) for c in SUMS], float).reshape(len(SUMS), -1)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = sent.value
        for batch in batches:
            words, counts = batch.column(4).flatten(), np.asarray(batch.column(5).flatten())
            size = np.asarray(pc.list_value_length(batch.column(4))).astype(np.int64)
            at = pc.index_in(words, value_set=names)
            there = np.asarray(pc.is_valid(at))
            row, k = np.repeat(np.arange(batch.num_rows), size), np.asarray(pc.fill_null(at, 0))
            sums = [np.bincount(row[there], counts[there] * v[k[there]], batch.num_rows).astype(float) for v in values]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~there], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offsets, words.filter(pa.array(~there))), pa.ListArray.from_arrays(offsets, pa.array(counts[~there]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, sums), *rest], names=[*batch.schema.names[:4], *SUMS, "words", "counts"])

    return texts.mapInArrow(apply, "row long, doc_id long, held_out boolean, n_words long, known double, base double, score double, plain double, words array<string>, counts array<long>")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, path: str | Callable[[], str], rounds: int = 5, strength: float = 1.0, hot_words: int = 1 << 16) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score.

    ``score`` is by the fitted pieces, ``vocabulary_score`` by the vocabulary's own weights (the end by its share of the training tokens).
    ``path``: a sentencepiece file, or a function that gives it on the executor. Tokens are the words, A-Z lower-cased, and one end. Null and empty texts are
    one end. Held-out rows are scored but not learnt from; rows without an id are learnt from. Repeated rows count each, ties don't matter, words and
    texts may be of any length (a word's lattice takes some 100 bytes of memory a byte). Without any training text the vocabulary's weights
    alone score. Other columns are not read. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    where = path if callable(path) else lambda: path
    texts = scratch.store(doc_words(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))), "doc-words")
    each = texts.select("row", "held_out", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", "held_out", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = each.groupBy("word").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("n"))).alias("c"), F.sum("n").alias("uses"))
    words = scratch.store(words, "words")
    ends = texts.where("NOT held_out").count()
    n, v = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = (n or 0) + ends, v + (ends > 0)
    model = fit(words, ends, where, rounds, strength)
    scored = scratch.store(word_scores(words, model, where, n, v), "word-scores")
    hot = scratch.store(scored.orderBy(F.desc("uses"), "word").limit(hot_words), "hot-words")
    values = scored.select("word", (F.col("c") > 0).cast("double").alias("known"), *SUMS[1:])
    hot = scratch.store(scored.orderBy(F.desc("uses"), "word").limit(hot_words).select("word"), "hot-words")
    often = scratch.store(sum_often(texts, values.join(F.broadcast(hot), "word", "left_semi").toArrow()), "often")
    rare = often.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    rare = rare.hint("merge").join(values.join(F.broadcast(hot), "word", "left_anti"), "word")
    rare = rare.groupBy("row").agg(*[F.sum(F.col("n") * F.col(c)).alias(f"rare_{c}") for c in SUMS])
    total = lambda c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.col(f"rare_{c}"), F.lit(0.0))
    out = often.join(rare, "row", "left").select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), *[total(c).alias(c) for c in SUMS])
    of_end = float(np.log10((ends + 1) / (n + v + 1)))
    out = out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(of_end)).alias("base_score"),
        (F.col("score") + F.lit(model.log_end / LN10)).alias("score"),
        (F.col("plain") + F.lit(of_end)).alias("vocabulary_score"),
    )
    return scratch.finish(out, "likelihoods")
