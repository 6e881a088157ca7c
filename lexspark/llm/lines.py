"""Line dedup by winnowing over line hashes.

A document is its lines (split at line feeds), each a 128-bit hash. Words are runs of anything but ASCII white space. A gram begins at each line and holds the fewest lines
from there on that have ``gram_words`` words together. A window begins at each line, too, and holds the fewest lines that have
``window_words`` words; of the grams inside a window the one with the least hash is selected as a fingerprint. So what two
documents share is found for certain where it is a run of whole lines with ``window_words`` words, may be found from
``gram_words`` words on, and never below that.

Each fingerprint is joined with its first position in the corpus (least document id, then line), and the match is
extended both ways as long as the lines are equal. The run in the later place is deleted. First positions come from a partial
aggregate, so a passage that a third of all documents hold costs each of them one row.

A passage need not be whole lines, nor need the first holder of a gram hold all of it. So the words are compared as well, whatever
the lines: each window of ``window_words`` words that stands earlier in the corpus is deleted (see ``repeated_words``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import as_bytes
from .shared import Scratch, _powers, by_bytes, mix, runs, small_batches, text_bounds, word_hashes

MARKS = "doc_id long, hashes binary, fp array<long>, fp2 array<long>, line array<int>, at array<int>, n array<int>, gram array<long>, k1 array<long>, k2 array<long>"
WINDOWS = "doc_id long, at int, k1 long, k2 long"
CUT = "text string, runs array<struct<first: int, end: int>>, words int"
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


class Lines:
    """The lines of many texts: a digest of 128 bits and the number of words of each, and where each text's lines begin (one more entry at the end)."""

    def __init__(self, texts: list[bytes], data: np.ndarray, word_starts: np.ndarray):
        end = np.flatnonzero(data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        whole = data.tobytes()
        digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        self.hashes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        self.words = np.bincount(np.searchsorted(start, word_starts, "right") - 1, minlength=len(start))
        self.first = np.searchsorted(start, text_bounds(texts))

    def reach(self, least: int) -> np.ndarray:
        """For each line the line after the fewest lines from it on that have ``least`` words, or the line after the next text's first if its text has fewer."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.words)])
        end = np.searchsorted(total, total[:-1] + least, "left")
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.where(end <= last, end, last + 1), last

    def gram_keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two hashes [run, 2] of each run of lines [start, end), as differences of prefix sums."""
        fwd, inverse = _powers(len(self.hashes) + 1)
        sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(mix(self.hashes) * fwd[:-1, None], axis=0)])
        return mix((sums[end] - sums[start]) * inverse[start][:, None] + ((end - start).astype(np.uint64) * _LENGTH)[:, None]).view(np.int64)

    def fingerprints(self, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first lines, keys) of the selected grams; the first of equal least keys in a window. Linear in the lines but for a logarithm, however many a gram holds."""
        ends, last = self.reach(gram_words)
        stops, _ = self.reach(window_words)
        windows = np.flatnonzero(stops <= last)
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        keys = self.gram_keys(np.arange(len(ends)), np.minimum(ends, last))
        order = np.lexsort((np.arange(len(ends)), keys[:, 1], keys[:, 0]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        to = np.searchsorted(ends, stops[windows], "right")  # after the last gram that ends inside the window
        level = np.frexp((to - windows).astype(float))[1] - 1
        chosen, least, size = np.empty(len(windows), np.int64), rank, 1
        for k in range(int(level.max()) + 1):
            own = level == k
            chosen[own] = order[np.minimum(least[windows[own]], least[to[own] - size])]
            least, size = np.minimum(least[: max(len(least) - size, 0)], least[size:]), 2 * size
        chosen = np.unique(chosen)
        return chosen, keys[chosen]


def extend(own: np.ndarray, other: np.ndarray, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [first, end) of ``own`` lines equal to ``other`` lines, from each pair of lines in ``marks`` both ways; runs found already are not walked again."""
    runs: list[tuple[int, int]] = []
    done: dict[int, int] = {}  # end of the last run by its shift
    for i, j in sorted(marks):
        if done.get(i - j, -1) > i:
            continue
        a = b = 0
        while i - a > 0 and j - a > 0 and own[i - a - 1] == other[j - a - 1]:
            a += 1
        while i + b < len(own) and j + b < len(other) and own[i + b] == other[j + b]:
            b += 1
        runs.append((i - a, i + b))
        done[i - j] = i + b
    return runs


def mark(docs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """Rows MARKS: the lines' hashes, their fingerprints (fp, fp2, line), and the stretches of word windows (at, n, gram, k1, k2)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = as_bytes(batch["text"]), batch["doc_id"].to_numpy()
            for a, b in by_bytes(texts):
                spans = WordSpans(texts[a:b])
                lines = Lines(texts[a:b], spans.data, spans.start)
                chosen, keys = lines.fingerprints(gram_words, window_words)
                own, columns = word_stretches(spans, gram_words, window_words)
                by_text = lambda x, of: np.split(x, np.searchsorted(of, np.arange(1, b - a)))  # noqa: E731, B023
                of = np.searchsorted(lines.first, chosen, "right") - 1
                out = {"doc_id": ids[a:b], "hashes": [x.tobytes() for x in np.split(lines.hashes, lines.first[1:-1])]}
                out |= {"fp": by_text(keys[:, 0], of), "fp2": by_text(keys[:, 1], of), "line": by_text((chosen - lines.first[of]).astype(np.int32), of)}
                out |= {c: by_text(x.astype(np.int32) if c in ("at", "n") else x, own) for c, x in columns.items()}
                yield pd.DataFrame(out)

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return rows.mapInPandas(make, MARKS)


def repeated_runs(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, runs array<struct<first, end>>) of the documents that repeat lines: deleted lines, as disjoint runs [first, end)."""
    each = marked.select("doc_id", F.explode(F.arrays_zip("fp", "fp2", "line")).alias("m")).select("doc_id", "m.*")
    first = each.groupBy("fp", "fp2").agg(F.min(place_of("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = each.join(first, ["fp", "fp2"]).where(place_of("doc_id", "line") > F.col("first")).withColumn("j", F.pmod("first", F.lit(1 << 32).cast("decimal(10,0)")).cast("int"))
    later = later.withColumn("origin", ((F.col("first") - F.col("j")) / F.lit(1 << 32).cast("decimal(10,0)")).cast("long"))
    later = later.groupBy("doc_id", "origin").agg(F.collect_list(F.struct(F.col("line").alias("i"), "j")).alias("marks"))
    own = marked.select("doc_id", F.col("hashes").alias("own"))
    other = marked.select(F.col("doc_id").alias("origin"), F.col("hashes").alias("other"))
    pairs = scratch.store(later, "line-matches").join(own, "doc_id").join(other, "origin")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, origin, marks, a, b in zip(*(batch[c] for c in ("doc_id", "origin", "marks", "own", "other")), strict=True):
                found = extend(np.frombuffer(a, "S16"), np.frombuffer(b, "S16"), [(m["i"], m["j"]) for m in marks])
                rows.append((doc_id, [{"first": x, "end": y} for x, y in found]))
            yield pd.DataFrame(rows, columns=["doc_id", "runs"])

    runs = pairs.mapInPandas(walk, "doc_id long, runs array<struct<first: int, end: int>>")
    runs = runs.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    joined = F.aggregate(
        "runs",
        F.array().cast("array<struct<first: int, end: int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return runs.select("doc_id", joined.alias("runs"))


class PrimeSums:
    """Polynomials of runs of numbers modulo a prime under 2**31, as differences of prefix sums."""

    _known: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, numbers: np.ndarray, prime: int, base: int):
        self.prime, self.inverse = np.uint64(prime), self.powers(pow(base, -1, prime), prime, len(numbers) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers % self.prime * self.powers(base, prime, len(numbers)) % self.prime)])

    @classmethod
    def powers(cls, base: int, prime: int, n: int) -> np.ndarray:
        out = cls._known.get((base, prime), np.ones(1, np.uint64))
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        cls._known[base, prime] = out
        return out[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) % self.prime * self.inverse[start] % self.prime


class WordSpans:
    """128-bit hashes of runs of words of many texts, as differences of prefix sums: one half modulo 2**64, one modulo two primes."""

    def __init__(self, texts: list[bytes]):
        self.words, self.first, self.start, self.end, self.data = word_hashes(texts, lower=False, spans=True)
        fwd, self.inverse = _powers(len(self.words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * fwd[:-1])])
        other = mix(self.words ^ np.uint64(0xA0761D6478BD642F))
        self.primes = PrimeSums(other, 2**31 - 1, 1_103_515_245), PrimeSums(other >> np.uint64(7), 2**31 - 19, 1_812_433_253)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _LENGTH)

    def keys(self, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
        k2 = mix((self.primes[0].of(start, end) << np.uint64(32) | self.primes[1].of(start, end)) + (end - start).astype(np.uint64) * _LENGTH)
        return {"k1": self.hashes(start, end).view(np.int64), "k2": k2.view(np.int64)}


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def word_stretches(spans: WordSpans, gram_words: int, window_words: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Stretches of neighbouring windows whose least gram is the same: the text of each, and its first window, their number, the gram and the whole stretch's keys."""
    n = len(spans.words) - window_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), {c: np.zeros(0, np.int64) for c in ("at", "n", "gram", "k1", "k2")}
    i = np.arange(len(spans.words) - gram_words + 1)
    least = sliding_min(spans.hashes(i, i + gram_words), window_words - gram_words + 1)
    own = np.searchsorted(spans.first, np.arange(len(spans.words)), "right") - 1
    inside = own[:n] == own[window_words - 1 :]
    begins = inside & np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:n] != own[: n - 1]) | ~inside[:-1]])
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(np.concatenate([begins | ~inside, [True]]))
    end = stops[np.searchsorted(stops, start, "right")]  # after the last window of the stretch
    return own[start], {"at": start - spans.first[own[start]], "n": end - start, "gram": least[start].view(np.int64), **spans.keys(start, end - 1 + window_words)}


def place_of(doc_id: str, at: str):
    """Document and position as one number, so that the first place is a minimum that is kept by hashing: doc_id * 2**32 + at."""
    return F.col(doc_id).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(at).cast("decimal(10,0)")


def earlier(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (doc_id, at, k1, k2) with ``gone``: whether equal keys stand earlier, in the same document ``words`` words earlier at least.

    Positions are under 2**31, so places of different documents lie further apart than any window is long.
    """
    first = rows.groupBy("k1", "k2").agg(F.min(place_of("doc_id", "at")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, ["k1", "k2"], "left").withColumn("gone", F.coalesce(place_of("doc_id", "at") - F.col("_first") >= words, F.lit(False))).drop("_first")


def repeated_words(docs: DataFrame, marked: DataFrame, scratch: Scratch, gram_words: int = 20, window_words: int = 50) -> DataFrame:
    """(doc_id, spans array<struct<first, end>>): words [first, end) of all windows of ``window_words`` words that stand earlier in the corpus.

    Equal windows hold the same least gram, so only windows with a least gram that occurs again can repeat. Stretches of windows with the
    same least gram are compared as a whole first. Where all stretches with a gram are equal, that is all; else each window of those that
    do not stand earlier is compared by itself. So each repeated window meets its own first holder. One that overlaps its first holder stays.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    stretches = marked.select("doc_id", F.explode(F.arrays_zip("at", "n", "gram", "k1", "k2")).alias("s")).select("doc_id", "s.*")
    # a stretch of more windows than a window has grams holds its least gram twice
    long = F.col("n") > window_words - gram_words + 1
    often = stretches.groupBy("gram").agg(F.sum(F.when(long, 2).otherwise(1)).alias("_n"), (F.max(long) | (F.min("k1") < F.max("k1"))).alias("mixed"))
    held = stretches.join(often.where("_n > 1").select("gram", "mixed"), "gram").select("doc_id", "at", "n", "k1", "k2", "mixed")
    whole = scratch.store(earlier(held, window_words).where("gone OR mixed").select("doc_id", "at", "n", "gone"), "word-stretches-held")
    asked = whole.where("NOT gone").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("parts"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, parts = batch["doc_id"].to_numpy(), as_bytes(batch["text"]), batch["parts"].tolist()
            for a, b in by_bytes(texts):
                spans = WordSpans(texts[a:b])
                own = np.repeat(np.arange(b - a), [len(p) for p in parts[a:b]])
                first, n = (np.array([x[c] for p in parts[a:b] for x in p], np.int64) for c in ("at", "n"))
                own, at = np.repeat(own, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start = spans.first[own] + at
                yield pd.DataFrame({"doc_id": ids[a:b][own], "at": at, **spans.keys(start, start + window_words)})

    windows = scratch.store(rows.join(asked, "doc_id").mapInPandas(each, WINDOWS), "word-windows")
    gone = earlier(windows, window_words).where("gone").select("doc_id", F.col("at").alias("first"), (F.col("at") + window_words).alias("end"))
    gone = gone.unionByName(whole.where("gone").select("doc_id", F.col("at").alias("first"), (F.col("at") + F.col("n") + (window_words - 1)).alias("end")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def cut(data: bytes, start: np.ndarray, end: np.ndarray, line_runs, spans) -> tuple[bytes, list[dict], int]:
    """The text without lines in ``line_runs`` and words in ``spans``, the runs of whole lines that went, and the number of words that went from other lines.

    ``start`` and ``end``: the words' bytes. A line whose every word goes is gone as a whole; in others a word goes with the space after it.
    """
    lines = data.split(b"\n")
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    edges = np.zeros(len(start) + 1, np.int64)
    for s in [] if spans is None else spans:
        edges[s["first"]] += 1
        edges[s["end"]] -= 1
    lost = np.cumsum(edges)[:-1] > 0
    of = np.searchsorted(begin, start, "right") - 1
    held, n_lost = np.bincount(of, minlength=len(lines)), np.bincount(of[lost], minlength=len(lines))
    gone = (held > 0) & (n_lost == held)
    for r in [] if line_runs is None else line_runs:
        gone[r["first"] : r["end"]] = True
    word = np.concatenate([[0], np.cumsum(held)])  # number of each line's first word
    kept = []
    for i in np.flatnonzero(~gone).tolist():
        if not n_lost[i]:
            kept.append(lines[i])
            continue
        a, b = int(word[i]), int(word[i + 1])
        # pieces of the line between runs of lost words
        edge = np.flatnonzero(np.diff(lost[a:b].astype(np.int8), prepend=0, append=0)) + a
        at = np.append(start[a:b], begin[i + 1] - 1)[edge - a]
        bounds = [int(begin[i]), *at.tolist(), int(begin[i + 1]) - 1]
        kept.append(b"".join(data[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True)))
    first, last = runs(np.append(gone, False).astype(np.int8))
    return b"\n".join(kept), [{"first": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)], int(n_lost[~gone].sum())


def without_repeats(text, line_runs, spans):
    """Column of type CUT, by row; null texts stay null."""

    @F.pandas_udf(CUT)
    def apply(texts: pd.Series, runs_: pd.Series, spans_: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None)] * len(texts)
        there = np.flatnonzero(texts.notna().to_numpy()).tolist()
        raw, line_runs, spans = [texts.iat[i].encode() for i in there], runs_.tolist(), spans_.tolist()
        for a, b in by_bytes(raw):
            _, first, start, end, _ = word_hashes(raw[a:b], lower=False, spans=True)
            bounds = text_bounds(raw[a:b]).tolist()
            for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                i = there[a + k]
                t, gone, n = cut(raw[a + k], start[x:y] - bounds[k], end[x:y] - bounds[k], line_runs[i], spans[i])
                rows[i] = (t.decode(), gone, n)
        return pd.DataFrame(rows, columns=["text", "runs", "words"]).astype({"words": "Int32"})

    return apply(text, line_runs, spans)


def dedup_lines(docs: DataFrame, gram_words: int = 20, window_words: int = 50) -> DataFrame:
    """``docs`` with ``text`` less its repeats, ``removed_runs`` (of whole lines) and ``removed_words`` (from other lines); an n_chars column is set to the new length.

    Null and empty texts and rows without an id stay as they are. Rows that repeat an id repeat its text and lose the same words. A
    document whose every line is repeated becomes empty. Columns removed_runs and removed_words are refused. An empty table gives no rows.
    """
    for c in ("removed_runs", "removed_words"):
        if c in docs.columns:
            raise ValueError(f"docs has a column {c}")
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    marked = scratch.store(mark(docs, gram_words, window_words), "marks")
    by_line, by_word = repeated_runs(marked, scratch), repeated_words(docs, marked, scratch, gram_words, window_words)
    found = scratch.finish(by_line.join(by_word, "doc_id", "full").select("doc_id", "runs", "spans", F.lit(True).alias("found")), "line-runs")
    # the row travels as one column, so that its own columns may have any names
    rows = docs.select(F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(found, "doc_id", "left")
    rows = rows.select("row", without_repeats(F.when(F.col("found"), F.col("row.text")), F.col("runs"), F.col("spans")).alias("cut"))
    was_cut = F.col("cut.runs").isNotNull()
    new = {"text": F.when(was_cut, F.col("cut.text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(was_cut, F.length("cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    own = [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*own, F.col("cut.runs").alias("removed_runs"), F.col("cut.words").alias("removed_words"))


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and n_runs (whole lines), n_words_removed (from other lines), kept_sha256 (of what is left, in UTF-8; null text: empty)."""
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")), **options)
    n = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return out.select("doc_id", "n_lines", F.coalesce(n, F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("removed_runs"), F.lit(0)).cast("long").alias("n_runs"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("n_words_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
