"""Mixing sources to target weights: how many copies of each document a training mix takes.

Targets are shares of the whole size by weight, where no source exceeds ``max_epochs`` times its own size; what it
cannot take is shared among the others by weight, again and again. A document's expected copies are its source's
target over its source's size, below ``max_epochs``. The whole part is certain; fractional parts are rounded by the
pivotal method: two documents of a source trade mass, size against size, until one of them is whole, which keeps each document's
expected copies and the source's total. Partners are of like size (sizes between two powers of two, in a few lanes), as a small document
could not take up what a large one leaves. A bucket of about ``bucket_rows`` documents leaves one fractional document in each lane of
each size class at most; those of ``fan_in`` buckets meet in the next round, and so on up a tree of reductions. In the end
each source holds a bounded number of them. They become whole from the largest to the smallest, each passing on what it took or left to the
next ones, so that a source misses its target by about its smallest documents. A hot source is so many buckets, never one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, with_nulls, with_plain_ids, word_count

WHOLE = 1e-9


def numbered(rows: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``place`` (long, from 0) in the ``order``: sorted by ranges, counted by partition; only those counts reach the driver."""
    held = scratch.store(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    offsets, total = {}, 0
    for p, n in sorted(tuple(r) for r in held.groupBy(part).count().collect()):
        offsets[p], total = total, total + n
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv]), part) if offsets else F.lit(0).cast("long")
    return held.withColumn("place", first + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """Targets by source from (source, size): source, source_size, n_docs, target, weight.

    Sources stand by code point, null last, and weigh ``weights`` in turn. Each round is one aggregate over the sources; the driver sees
    two sums. All capped sources of a round stay capped, so there are no more rounds than sources.
    """
    scratch = scratch or Scratch(sizes.sparkSession)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.pmod("place", F.lit(len(weights)))
    per = numbered(per, [F.col("source").asc_nulls_last()], "sources", scratch).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).drop("place")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = float("inf")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    rate = None
    while rate is None or rate != level:
        level = rate if rate is not None else 0.0
        full = cap <= F.col("weight") * F.lit(level) if rate is not None else F.lit(False)
        taken, weight = per.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        rate = (total - taken) / weight
        if rate <= level:
            break
    return per.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(max(rate or 0.0, level)))))


def chance(seed: int, *parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest(), "little") / 2.0**64


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities one against the next: (probabilities, of which all but one are 0 or 1; the index of that one, or -1).

    A trade moves d from one document and d * (its size) / (the other's size) to the other, so the expected size stays; both directions have
    the probabilities that keep each document's expectation.
    """
    p, size, u = p.tolist(), size.tolist(), u.tolist()
    open_ = -1
    for i in range(len(p)):
        if p[i] <= WHOLE or p[i] >= 1 - WHOLE:
            p[i] = round(p[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        j, a, b = open_, size[open_], size[i]
        up = min((1 - p[j]) * a, p[i] * b)  # size that may move from i to j
        down = min(p[j] * a, (1 - p[i]) * b)
        move = up if u[i] * (up + down) < down else -down
        p[j] += move / a
        p[i] -= move / b
        open_ = -1
        for k in (j, i):
            if p[k] <= WHOLE or p[k] >= 1 - WHOLE:
                p[k] = round(p[k])
            else:
                open_ = k
    return np.array(p), open_


def settle_last(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """0 or 1 for each of ``p``, sizes falling: what a document takes over or under its share is passed on to the smaller ones after it.

    Chance decides where the smaller ones can give back or take up what either outcome leaves; if they can only for one outcome, that one is
    taken, and the nearer one if for none. So expectations hold but for documents larger than all that is still open beside them.
    """
    out, owed = np.zeros(len(p)), 0.0
    give = np.append(np.cumsum((p * size)[::-1])[::-1][1:], 0.0)
    take = np.append(np.cumsum(((1 - p) * size)[::-1])[::-1][1:], 0.0)
    for i in range(len(p)):
        down = owed + p[i] * size[i]  # owed to the target if the document is left out
        up = down - size[i]
        if (down <= take[i] + WHOLE) == (up >= -give[i] - WHOLE):
            can = down <= take[i] + WHOLE
            out[i] = float(u[i] < min(1.0, max(0.0, down / size[i]))) if can else float(abs(up) < abs(down))
        else:
            out[i] = float(down > take[i] + WHOLE)
        owed = up if out[i] else down
    return out


def round_copies(docs: DataFrame, seed: int = 7, bucket_rows: int = 10_000, fan_in: int = 64, lanes: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """Add ``copies`` (long) to rows (doc_id, source, size, n_docs, expected), where expected copies are any numbers of at least 0.

    Rows of size 0 take no copy. Results depend on the rows alone, not on how they are dealt out. Ties in size go by a hash of the id, then by the id.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    rows = with_plain_ids(docs, *[c for c in names if c != "doc_id"]).withColumn("_base", F.floor("expected").cast("long")).withColumn("_p", F.col("expected") - F.floor("expected"))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), F.when(F.col("no_id"), -1).otherwise(F.col("doc_id")), "size"))
    buckets = F.ceil(F.col("n_docs") / bucket_rows).cast("long")
    rows = rows.withColumn("_bucket", F.pmod("_key", buckets)).withColumn("_open", F.lit(True))
    schema = rows.schema

    def chances(group: pd.DataFrame, level: int) -> np.ndarray:
        return np.array([chance(seed, level, k, s) for k, s in zip(group["_key"].tolist(), group["size"].tolist(), strict=True)])

    def settle(level: int):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            kind = (np.frexp(group["size"].to_numpy(float))[1] * lanes + group["_key"].to_numpy() % lanes).astype(np.int64)
            group = group.assign(_kind=kind).sort_values(["_kind", "size", "_key", "doc_id"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
            kind, p, size, u = group["_kind"].to_numpy(), group["_p"].to_numpy(float).copy(), group["size"].to_numpy(float), chances(group, level)
            left = np.zeros(len(group), bool)
            edge = np.append(np.flatnonzero(np.diff(kind, prepend=-1)), len(group))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                p[a:b], open_ = pivotal(p[a:b], size[a:b], u[a:b])
                if open_ >= 0:
                    left[a + open_] = True
            return group.drop(columns="_kind").assign(_p=p, _open=left)

        return one

    def last(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "_key", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        return group.assign(_p=settle_last(group["_p"].to_numpy(float), group["size"].to_numpy(float), chances(group, -1)), _open=False)

    most = docs.agg(F.max(buckets)).first()[0] or 1
    done, open_ = [rows.where("size = 0").withColumn("_p", F.lit(0.0)).withColumn("_base", F.lit(0).cast("long"))], rows.where("size > 0")
    level = 0
    while True:
        out = scratch.store(open_.groupBy("source", "_bucket").applyInPandas(settle(level), schema), f"rounding-{level}")
        done.append(out.where("NOT _open"))
        open_ = out.where("_open")
        if most <= 1:
            break
        most = -(-most // fan_in)
        open_ = open_.withColumn("_bucket", F.floor(F.col("_bucket") / fan_in).cast("long"))
        level += 1
    # each source still has one row for each lane of each size class at most
    every = open_.groupBy("source").applyInPandas(last, schema)
    for part in done:
        every = every.unionByName(part)
    return with_nulls(every).select(*names, (F.col("_base") + F.round("_p").cast("long")).alias("copies"))


def copies_of(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int) -> DataFrame:
    """doc_id, source, size, tag, source_size, target, copies of each row; ``tag`` tells rows without an id apart by text and source."""
    scratch = Scratch(docs.sparkSession)
    tag = F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source")).otherwise(0)
    sized = scratch.store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tag.alias("tag")), "sizes")
    targets = source_targets(sized, weights, share, max_epochs, scratch)
    t = targets.select(F.col("source").alias("_source"), "source_size", "n_docs", "target")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("expected", F.least("expected", F.lit(float(max_epochs))))
    return scratch.finish(round_copies(rows, seed, scratch=scratch).select("doc_id", "source", "size", "tag", "source_size", "target", "copies"), "copies")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, source): size in words, its source's size and target, copies, words taken.

    Null text has size 0; a null source is a source of its own; null ids are allowed; repeated rows count each; other columns are
    not read. Texts may be of any length, as only their sizes go on. An empty table gives no rows. Sources of size 0 have target 0.
    """
    out = copies_of(docs, weights, share, max_epochs, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the columns that it came with, whatever their names.

    Rows of size 0 stay out of a mix. Rows that repeat an id (or, without an id, text and source) share their copies evenly. An empty table gives no rows.
    """
    mix = copies_of(docs, weights, share, max_epochs, seed).where("size > 0")
    mix = mix.groupBy(F.col("doc_id").alias("mix_id"), F.col("tag").alias("mix_tag")).agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0")
    tag = F.when(F.col("row.doc_id").isNull(), F.xxhash64("row.text", "row.source")).otherwise(0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("tag", tag)
    # the mix has a row for each document, so it is never broadcast, however few there are
    rows = rows.join(mix.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("mix_id")) & (F.col("tag") == F.col("mix_tag"))).select("row", "tag", "total", "n")
    place = F.row_number().over(Window.partitionBy("row.doc_id", "tag").orderBy("row.source"))
    once = rows.where("n = 1").withColumn("times", F.col("total"))
    again = rows.where("n > 1").withColumn("times", F.floor(F.col("total") / F.col("n")) + (place <= F.col("total") % F.col("n")).cast("long"))
    every = once.unionByName(again).where("times > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
