"""Exact substring dedup with suffix arrays by the difference-cover algorithm (modulo 3).

Removed is every byte covered by a string of ``length`` bytes that also starts earlier: in a document of smaller id, or
earlier in the same one. Texts are UTF-8 bytes, and matches never cross documents.

Suffixes need to be sorted against each other only where strings of ``length`` bytes can be equal, so the work is dealt out by content:

1. Anchors. Of the ``length - gram + 1`` grams inside a string, the one with the least hash (the leftmost of these) is its anchor. It
   depends on the string alone, so equal strings have equal anchors at equal places. The strings of one anchor start
   side by side; together they are a piece, of fewer than 2 * ``length`` bytes.
2. Pieces whose anchor gram occurs once hold no repeated string and take no further part.
3. Equal pieces are folded onto the first of them: all bytes of the later ones are removed.
4. What is left are different pieces about equal anchors. They are dealt into buckets by anchor, and each bucket builds the
   suffix array of its pieces: the suffixes at positions 1 and 2 modulo 3 are sorted by their first three symbols and
   named, the text of names is sorted by recursion, the suffixes at 0 modulo 3 are sorted by one symbol and a rank, and merged in. Then
   neighbours are compared on their first ``length`` bytes. In each group of equal ones all but the first are removed.

Recursion ends when names are distinct: pieces are short and differ, so few levels go beyond ``length`` symbols.
An anchor with more different pieces than a bucket should hold is dealt out further: its strings become rows, and the first of
equal ones is found by an aggregate that combines on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import as_bytes
from .shared import _BASE, _TABLE, Scratch, by_bytes, mix, small_batches, span_hashes, text_bounds, with_nulls, with_plain_ids

PIECES = "anchor long, piece long, doc_id long, start int, size int, later boolean"
RANGES = "doc_id long, first int, end int"


# ---- suffix array -------------------------------------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (integers of at least 1)."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    t = np.concatenate([t, np.zeros(3, t.dtype)]).astype(np.int64)
    span = int(t.max()) + 1
    # one suffix more at 1 modulo 3 if n is, so that every suffix at 0 is followed by a named one
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if span < 1 << 21:
        key = (t[sample] * span + t[sample + 1]) * span + t[sample + 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        s = sample[order]
        new = (t[s[1:]] != t[s[:-1]]) | (t[s[1:] + 1] != t[s[:-1] + 1]) | (t[s[1:] + 2] != t[s[:-1] + 2])
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # suffixes at 0: by their symbol and the rank that follows
    zeros = np.arange(0, n, 3)
    base = len(sample) + 2
    zeros = zeros[np.argsort(t[zeros] * base + rank[zeros + 1], kind="stable")]
    # merge: how many suffixes at 1, and at 2, stand before each one at 0
    kind = sampled % 3
    one, two = sampled[kind == 1], sampled[kind == 2]
    before = np.searchsorted(t[one] * base + rank[one + 1], t[zeros] * base + rank[zeros + 1], "left")
    pair = np.unique(np.concatenate([t[two] * span + t[two + 1], t[zeros] * span + t[zeros + 1]]), return_inverse=True)[1]
    before += np.searchsorted(pair[: len(two)] * base + rank[two + 2], pair[len(two) :] * base + rank[zeros + 2], "left")
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zeros))
    out[place] = zeros
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sampled
    return out


def equal_groups(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For suffix starts in suffix order: group numbers, where neighbours with equal first ``length`` bytes are in one group."""
    if not len(starts):
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(starts), bool)
    for i in range(1, len(starts), 50_000):
        a = starts[i - 1 : i + 49_999]
        rows = view[a] if len(a) else a
        more = view[starts[i : i + 50_000]]
        new[i : i + 50_000] = (rows[: len(more)] != more).any(1)
    return np.cumsum(new)


def later_strings(pieces: list[bytes], doc_ids: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(document, first byte, end byte) runs of ``pieces`` covered by strings that also start earlier in another place of the pieces."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0" * 2, np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(pieces)), sizes - length + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    at = first[owner] + offset
    asked = np.full(len(data), -1)
    asked[at] = np.arange(len(at))
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[asked[order] >= 0]
    group = equal_groups(data, order, length)
    string = asked[order]
    doc, start = doc_ids[owner[string]], starts[owner[string]] + offset[string]
    by = np.lexsort((start, doc, group))
    g = group[by]
    later = np.zeros(len(owner), bool)
    if len(g):
        lead = np.append(True, g[1:] != g[:-1])
        head = by[np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))]
        later[string[by]] = (doc[by] != doc[head]) | (start[by] != start[head])
    hit = np.flatnonzero(later)
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
        for run in np.split(hit, cut):
            p = owner[run[0]]
            yield int(doc_ids[p]), int(starts[p] + offset[run[0]]), int(starts[p] + offset[run[-1]] + length)


# ---- anchors and pieces -------------------------------------------------------------------------------------------


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of ``size`` bytes, by doubling."""
    power, have, out, done = {1: _TABLE[data]}, 1, None, 0
    while have * 2 <= size:
        h = power[have]
        power[have * 2] = h[: len(h) - have] * np.uint64(pow(_BASE, have, 2**64)) + h[have:]
        have *= 2
    for n in sorted(power, reverse=True):
        while size - done >= n:
            h = power[n]
            if out is None:
                out = h
            else:
                m = min(len(out), len(h) - done)
                out = out[:m] * np.uint64(pow(_BASE, n, 2**64)) + h[done : done + m]
            done += n
    return mix(out)


def anchored_pieces(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all pieces: anchor hash, content hash, number of the text, start in it, size."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) <= length:
        return none, none, none, none, none
    y = window_hashes(data, gram)
    bits = np.uint64((1 << max(24, len(y).bit_length())) - 1)
    z = (y & ~bits) | np.arange(len(y), dtype=np.uint64)
    w = length - gram + 1
    have = 1
    while have * 2 <= w:
        z = np.minimum(z[: len(z) - have], z[have:])
        have *= 2
    if w > have:
        z = np.minimum(z[: len(z) - (w - have)], z[w - have :])
    anchor = (z & bits).astype(np.int64)
    text = np.searchsorted(text_bounds(texts), np.arange(len(anchor)), "right") - 1
    last = text_bounds(texts)[text + 1] - 1 - length  # the last start of a string in its text
    starts = np.flatnonzero(np.arange(len(anchor)) <= last)
    if not len(starts):
        return none, none, none, none, none
    cut = np.append(True, (anchor[starts[1:]] != anchor[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]]))
    a = starts[cut]
    b = np.append(starts[np.flatnonzero(cut)[1:] - 1], starts[-1]) + length
    return y[anchor[a]].view(np.int64), span_hashes(data, a, b).view(np.int64), text[a], a - text_bounds(texts)[text[a]], b - a


def pieces_of(docs: DataFrame, length: int, gram: int, flush: int = 1 << 20) -> DataFrame:
    """Rows of PIECES. Of equal pieces within a task's block all but the first are marked ``later`` at once, so that copies don't meet in one place."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            anchor, piece, doc, start, size = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((start, doc, piece, anchor))
            anchor, piece, doc, start, size = (c[order] for c in (anchor, piece, doc, start, size))
            later = np.append(False, (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))
            return pd.DataFrame({"anchor": anchor, "piece": piece, "doc_id": doc, "start": start.astype(np.int32), "size": size.astype(np.int32), "later": later})

        for batch in batches:
            texts, ids = as_bytes(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            for a, b in by_bytes(texts):
                anchor, piece, text, start, size = anchored_pieces(texts[a:b], length, gram)
                held.append((anchor, piece, ids[a:b][text], start, size))
                n += len(anchor)
                if n >= flush:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.where("doc_id IS NOT NULL AND octet_length(text) >= " + str(length)).select("doc_id", "text").mapInPandas(make, PIECES)


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, doc_id, start, bytes) of the pieces ``wanted`` (anchor, doc_id, start, size)."""
    per = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("own"))
    rows = docs.select("doc_id", "text").join(per, "doc_id")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch["doc_id"], as_bytes(batch["text"]), batch["own"], strict=True):
                out += [(p["anchor"], doc_id, p["start"], text[p["start"] : p["start"] + p["size"]]) for p in own]
            yield pd.DataFrame(out, columns=["anchor", "doc_id", "start", "bytes"])

    return rows.mapInPandas(make, "anchor long, doc_id long, start int, bytes binary")


def sorted_buckets(cut: DataFrame, buckets: int, length: int) -> DataFrame:
    """RANGES of the strings that the suffix arrays of the buckets show to be later ones."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "start"])
        found = list(later_strings(group["bytes"].tolist(), group["doc_id"].to_numpy(np.int64), group["start"].to_numpy(np.int64), length))
        return pd.DataFrame(found, columns=["doc_id", "first", "end"]).astype({"doc_id": "int64", "first": "int32", "end": "int32"})

    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")
    return cut.select(bucket, "doc_id", "start", "bytes").groupBy("bucket").applyInPandas(one, RANGES)


def counted_strings(cut: DataFrame, length: int) -> DataFrame:
    """RANGES for anchors with very many different pieces: each string is a row, its first place an aggregate."""
    place = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length))
    rows = cut.select("doc_id", "start", "bytes", place.alias("i"))
    rows = rows.select("doc_id", (F.col("start") + F.col("i")).cast("int").alias("first"), F.expr(f"unhex(sha2(substring(bytes, i + 1, {length}), 256))").alias("string"))
    least = rows.groupBy("string").agg(F.min(F.struct("doc_id", "first")).alias("head"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(least, "string").where(F.struct("doc_id", "first") > F.col("head"))
    return later.select("doc_id", "first", (F.col("first") + length).cast("int").alias("end"))


def removed_ranges(docs: DataFrame, scratch: Scratch, length: int = 100, gram: int = 32, bucket_bytes: int = 2 << 20, hot_pieces: int = 5_000) -> DataFrame:
    """RANGES (overlapping) that together cover every removed byte."""
    small_batches(docs.sparkSession)
    every = Window.partitionBy("_key")
    # rows marked later need no partner: a key of their own spreads them
    key = F.when(F.col("later"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    counted = pieces_of(docs, length, gram).withColumn("_key", key).withColumn("_n", F.count("*").over(every))
    known = scratch.store(counted.where("later OR _n > 1").select("anchor", "piece", "doc_id", "start", "size", "later"), "pieces")
    alike = known.where("NOT later")
    first = alike.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "start")).alias("head"), F.first("size").alias("size"), F.count("*").alias("n"))
    first = scratch.store(first, "first-pieces")
    copies = alike.join(first.where("n > 1").select("anchor", "piece", "head"), ["anchor", "piece"]).where(F.struct("doc_id", "start") > F.col("head"))
    folded = known.where("later").select("doc_id", "start", "size").union(copies.select("doc_id", "start", "size"))
    folded = folded.select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("size")).cast("int").alias("end"))
    kinds = first.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = first.join(kinds, "anchor").select("anchor", F.col("head.doc_id").alias("doc_id"), F.col("head.start").alias("start"), "size", "kinds")
    cut = cut_out(docs, open_.select("anchor", "doc_id", "start", "size"))
    often = scratch.store(kinds.where(F.col("kinds") > hot_pieces).select("anchor"), "hot-anchors")
    cut = scratch.store(cut, "cut-pieces")
    n_bytes = open_.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    out = folded.union(sorted_buckets(cut.join(often, "anchor", "left_anti"), buckets, length))
    if often.limit(1).count():
        out = out.union(counted_strings(cut.join(often, "anchor", "left_semi"), length))
    return out


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, length: int = 100, with_text: bool = False, **options) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds kept (binary).

    Null and empty texts have no bytes. Rows without an id take no part and lose nothing. Rows that repeat an id repeat its text; they are one
    document. Ties do not occur, as places differ. Texts may be of any length up to 2**31 bytes. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    ranges = scratch.finish(removed_ranges(docs, scratch, length, **options), "removed")
    per = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    rows = with_plain_ids(docs.select("doc_id", "text").join(per, "doc_id", "left"), "text", "ranges")
    schema = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, no_id, text, own in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), as_bytes(batch["text"]), batch["ranges"], strict=True):
                spans = merge_ranges([(r["first"], r["end"]) for r in own]) if own is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]]) if spans else text
                row = (doc_id, no_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return with_nulls(rows.mapInPandas(finish, schema))
