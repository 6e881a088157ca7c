"""Near copies of documents by HyperMinHash.

A document's set holds its distinct word shingles, as 64-bit hashes. One pass makes of each set a digest and ``registers``
HyperMinHash registers: the hash's upper bits choose the register, and of the smallest remainder there the
number of leading zeros and the next ``mantissa`` bits are kept. Sets with equal digests are one class from then on.

Bands of ``rows`` registers, where empty ones borrow from others, give candidate pairs of classes. A pair is compared on
registers first: the share of equal ones, corrected for chance collisions, must not lie more than five standard errors under the threshold. What
remains is confirmed on the full sets, made anew from the texts of those classes only.

No band's pairs are ever rows. First every class is held against one other: of its bands' smallest members the one it
shares most bands with. Then only bands that hold several components are looked at, in blocks of bounded size: members outside
a band's largest component against those of all other components. Each component is linked with the most similar other one, if their sets
confirm it. After that, each block keeps the members that are still near one of another component; their full sets come
to the block, which confirms pair after pair, the most similar first, skips those that are connected by then, and gives its
links: fewer than it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .quality import as_bytes
from .shared import Scratch, by_bytes, mix, small_batches, store, with_nulls, with_plain_ids, word_hashes

SKETCH = "doc_id long, no_id boolean, n_shingles long, digest binary, registers binary, bands array<long>"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles of ``size`` words; a shorter text is one shingle, an empty one none."""
    h, first = word_hashes(texts)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j]
        grams[: n - size + 1] = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            total = np.uint64(b - a)
            for x in h[a:b]:
                total = np.uint64((int(total) * 0xD6E8FEB86659FD93 + int(x)) & (2**64 - 1))
            out.append(mix(np.array([total])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Sketcher:
    def __init__(self, registers: int, mantissa: int, rows: int):
        self.m, self.mantissa, self.rows = registers, mantissa, rows
        self.low = 64 - (registers.bit_length() - 1)  # bits below those that choose the register
        self.loans = np.random.default_rng(41).integers(0, registers, (registers, 48))  # from which registers an empty one borrows

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """uint16 registers [set, register]: 1 + leading zeros above the mantissa bits, 0 for empty ones."""
        out = np.zeros((len(sets), self.m), np.uint16)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        if len(h):
            at = (h >> np.uint64(self.low)).astype(np.int64) + np.repeat(np.arange(len(sets)) * self.m, [len(s) for s in sets])
            least = np.append(True, at[1:] != at[:-1])  # hashes ascend within a set, so the first of a register is its least
            rest = h[least] & np.uint64((1 << self.low) - 1)
            length = np.zeros(len(rest), np.int64)  # bits of the remainder
            left = rest.copy()
            for step in (32, 16, 8, 4, 2, 1):
                big = left >= np.uint64(1 << step)
                length += step * big
                left = np.where(big, left >> np.uint64(step), left)
            shift = length - self.mantissa  # ``length`` counts the bits below the leading one
            bits = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << self.mantissa) - 1)
            zeros = self.low - 1 - length
            out.reshape(-1)[at[least]] = ((1 + zeros) << self.mantissa) | bits.astype(np.int64)
        return out

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """int64 band hashes [set, band]. Empty registers first borrow from others in an order fixed for each (optimal densification), so that every band
        stands for ``rows`` shingles even of a short document."""
        full = registers != 0
        short = np.flatnonzero(full.any(1) & ~full.all(1))
        own = registers.astype(np.uint64)
        for i in range(0, len(short), 64):
            part = short[i : i + 64]
            there = full[part][:, self.loans]  # [set, register, attempt]
            first = self.loans[np.arange(self.m)[None, :], there.argmax(2)]
            # where no attempt meets a full register, the first full one lends
            first = np.where(there.any(2), first, full[part].argmax(1)[:, None])
            lent = np.take_along_axis(own[part], first, 1)
            own[part] = np.where(full[part], own[part], lent)
        own = own[:, : self.m // self.rows * self.rows].reshape(len(registers), -1, self.rows)
        total = np.broadcast_to(np.arange(own.shape[1], dtype=np.uint64) + np.uint64(1), own.shape[:2])
        for j in range(self.rows):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + own[:, :, j])
        return total.view(np.int64)

    def zero_shares(self, n: np.ndarray) -> np.ndarray:
        """Chances [set, leading zeros] of a register's leading zeros in sets of n elements."""
        z = np.arange(self.low)[None, :]
        load = np.maximum(n.astype(float), 1.0)[:, None] / self.m
        return np.exp(-load * 2.0 ** -(z + 1.0)) - np.exp(-load * 2.0**-z)

    def may_link(self, r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, chance: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(whether a pair is to be confirmed, its estimated similarity) for rows of registers and set sizes.

        ``chance``: that registers of unlike minima agree, by leading zeros and then by mantissa; the estimate is corrected for it.
        """
        valid = ((r1 != 0) | (r2 != 0)).sum(1)
        equal = ((r1 == r2) & (r1 != 0)).sum(1) / np.maximum(valid, 1)
        estimate = np.clip((equal - chance) / (1 - chance), 0, 1)
        margin = 5 * np.sqrt(least * (1 - least) / np.maximum(valid, 1)) + 0.01
        sizes = np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9  # intersection <= the smaller, union >= the larger
        return sizes & (estimate >= least - margin), estimate


def sketches(docs: DataFrame, words: int, sketcher: Sketcher) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            for a, b in by_bytes(texts):
                sets = shingle_sets(texts[a:b], words)
                r = sketcher.registers(sets)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = {"n_shingles": [len(s) for s in sets], "digest": digests, "registers": [x.tobytes() for x in r], "bands": list(sketcher.bands(r))}
                yield batch[["doc_id", "no_id"]].iloc[a:b].assign(**columns)

    return with_nulls(with_plain_ids(docs, "text").mapInPandas(make, SKETCH))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, set) of docs (node, text): the ascending shingle hashes as bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, nodes = as_bytes(batch["text"]), batch["node"].to_numpy()
            for a, b in by_bytes(texts):
                yield pd.DataFrame({"node": nodes[a:b], "set": [s.tobytes() for s in shingle_sets(texts[a:b], words)]})

    return docs.select("node", "text").mapInPandas(make, "node long, set binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two ascending sets."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 1000) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar. A node that is ``a`` of over ``most`` pairs is dealt out further."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("deals"))
    asked = pairs.select("a", "b").join(heads, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).drop("deals")
    heads = heads.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    rows = asked.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b").join(heads.select("a", "deal", "x").hint("merge"), ["a", "deal"])
    return rows.select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def estimated(pairs: DataFrame, classes: DataFrame, sketcher: Sketcher, least: float) -> DataFrame:
    """``pairs`` (a, b) that pass the register estimate."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r1, r2 = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("r1", "r2"))
                n1, n2 = batch["n1"].to_numpy(), batch["n2"].to_numpy()
                chance = (sketcher.zero_shares(n1) * sketcher.zero_shares(n2)).sum(1) / 2**sketcher.mantissa
                keep, _ = sketcher.may_link(r1, r2, n1, n2, chance, least)
                yield batch[["a", "b"]][keep]

    side = lambda k, c: classes.select(F.col("node").alias(c), F.col("registers").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}")).hint("merge")
    return pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").select("a", "b", "r1", "r2", "n1", "n2").mapInPandas(check, "a long, b long")


BLOCK = ["band", "place", "left", "right", "is_left", "node", "component", "registers", "n_shingles"]
BLOCK_ROWS = "band long, place int, left int, right string, is_left boolean, node long, component long, registers binary, n_shingles long"


def open_blocks(members: DataFrame, block: int, shingles: int = 1 << 20) -> DataFrame:
    """Rows BLOCK of ``members`` (band, place, node, component, registers, n_shingles): who meets whom in bands of several components.

    Members of a band's largest component meet the others, and these meet each other. Both are dealt into blocks of about ``block`` members and ``shingles`` shingles.
    """
    per = members.groupBy("band", "component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("load"))
    bands = per.groupBy("band").agg(F.count("*").alias("kinds"), F.max_by(F.struct("component", "count", "load"), F.struct("count", "component")).alias("main"), F.sum("count").alias("all"), F.sum("load").alias("load"))
    parts = lambda count, load: F.ceil(F.greatest(count / block, load / shingles)).cast("int")
    bands = bands.where("kinds > 1").select("band", F.col("main.component").alias("main_of"), parts(F.col("main.count"), F.col("main.load")).alias("n_main"), parts(F.col("all") - F.col("main.count"), F.col("load") - F.col("main.load")).alias("n_rest"))
    rows = members.join(bands, "band").withColumn("main", F.col("component") == F.col("main_of"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    rest = rows.where("NOT main")
    mains = rows.where("main").withColumn("left", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1))).withColumn("right", F.concat(F.lit("m"), "own")).withColumn("is_left", F.lit(False))
    # of two blocks of the others the smaller number is on the left
    named = lambda kind: lambda i: F.concat(F.lit(kind), i.cast("string"))
    left = rest.withColumn("right", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), named("m")), F.transform(F.sequence(F.col("own"), F.col("n_rest") - 1), named("r")))))
    left = left.withColumn("left", F.col("own")).withColumn("is_left", F.lit(True))
    right = rest.where("own > 0").withColumn("left", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn("right", named("r")(F.col("own"))).withColumn("is_left", F.lit(False))
    return mains.select(BLOCK).union(left.select(BLOCK)).union(right.select(BLOCK))


def near_in_blocks(group: pd.DataFrame, sketcher: Sketcher, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block in ``group``, sorted by block and size: places of pairs of different components above the estimate, and that.

    A pair is left to the first band that both surely share: where all registers of that band are equal and none is empty.
    """
    r = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(len(group), -1)
    component, n, is_left, place = (group[c].to_numpy() for c in ("component", "n_shingles", "is_left", "place"))
    shares, right = sketcher.zero_shares(n), group["right"].to_numpy()
    new = np.flatnonzero((np.diff(group["band"].to_numpy()) != 0) | (np.diff(group["left"].to_numpy()) != 0) | (right[1:] != right[:-1])) + 1
    for a, b in zip(np.append(0, new).tolist(), np.append(new, len(group)).tolist(), strict=True):
        one, two = a + np.flatnonzero(is_left[a:b]), a + np.flatnonzero(~is_left[a:b])
        if not len(two) and right[a] == f"r{group['left'].iat[a]}":
            two = one  # a block of the others against itself
        found = []
        if len(one) and len(two):
            first, last = np.searchsorted(n[two], np.ceil(n[one] * least - 1e-9), "left"), np.searchsorted(n[two], n[one] / least + 1e-9, "right")
            for k, i, j in zip(one.tolist(), first.tolist(), last.tolist(), strict=True):
                at = two[i:j][component[two[i:j]] != component[k]]
                if two is one:
                    at = at[at > k]
                if not len(at):
                    continue
                chance = shares[at] @ shares[k] / 2**sketcher.mantissa
                keep, estimate = sketcher.may_link(r[k : k + 1], r[at], n[k : k + 1], n[at], chance, least)
                at, estimate = at[keep], estimate[keep]
                if place[a] and len(at):
                    before = (r[k : k + 1, : place[a] * sketcher.rows] == r[at, : place[a] * sketcher.rows]) & (r[at, : place[a] * sketcher.rows] != 0)
                    alone = ~before.reshape(len(at), -1, sketcher.rows).all(2).any(1)
                    at, estimate = at[alone], estimate[alone]
                if len(at):
                    found.append((np.full(len(at), k), at, estimate))
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def in_buckets(rows: DataFrame, buckets: int):
    """Blocks grouped so that a task's groups are of fair size: per-group work in Spark costs more than a small block itself."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("band", "left", "right"), F.lit(buckets))).groupBy("bucket")


def by_block(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["band", "left", "right", "n_shingles", "node"], kind="stable").reset_index(drop=True)


def nearest_components(blocks: DataFrame, sketcher: Sketcher, least: float, buckets: int) -> DataFrame:
    """(a, b): for each component the pair with another one that has the largest estimate."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        group, out = by_block(group), []
        node, component = group["node"].to_numpy(), group["component"].to_numpy()
        for i, j, estimate in near_in_blocks(group, sketcher, least):
            pairs = pd.DataFrame({"component": np.concatenate([component[i], component[j]]), "a": np.tile(np.minimum(node[i], node[j]), 2), "b": np.tile(np.maximum(node[i], node[j]), 2), "estimate": np.tile(estimate, 2)})
            out.append(pairs.sort_values(["estimate", "a", "b"], ascending=[False, True, True], kind="stable").drop_duplicates("component"))
        out = pd.concat(out) if out else pd.DataFrame({"component": [], "a": [], "b": [], "estimate": []})
        out = out.sort_values(["estimate", "a", "b"], ascending=[False, True, True], kind="stable").drop_duplicates("component")
        return out.astype({"component": "int64", "a": "int64", "b": "int64", "estimate": "float64"})

    found = in_buckets(blocks, buckets).applyInPandas(best, "component long, a long, b long, estimate double")
    return found.groupBy("component").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()


def undecided(blocks: DataFrame, sketcher: Sketcher, least: float, buckets: int) -> DataFrame:
    """Rows BLOCK of the members that are near one of another component in their block."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = by_block(group)
        near = np.zeros(len(group), bool)
        for i, j, _ in near_in_blocks(group, sketcher, least):
            near[i] = near[j] = True
        return group.loc[near, BLOCK]

    return in_buckets(blocks, buckets).applyInPandas(keep, BLOCK_ROWS)


def links_in_blocks(rows: DataFrame, sets: DataFrame, sketcher: Sketcher, least: float, percent: int, buckets: int) -> DataFrame:
    """(a, b): links between components that the full sets of a block's members confirm, as a spanning forest of each block."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group, out = by_block(group), []
        node, component = group["node"].to_numpy(), group["component"].tolist()
        own = [np.frombuffer(x, np.uint64) for x in group["set"]]
        for i, j, estimate in near_in_blocks(group, sketcher, least):
            root: dict[int, int] = {}

            def top(c: int, root: dict[int, int] = root) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            order = np.argsort(-estimate, kind="stable")
            for k, m in zip(i[order].tolist(), j[order].tolist(), strict=True):
                x, y = top(component[k]), top(component[m])
                if x != y and similar(own[k], own[m], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[k], node[m]), max(node[k], node[m])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return in_buckets(rows.join(sets.hint("merge"), "node"), buckets).applyInPandas(link, "a long, b long").distinct()


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, registers: int = 128, mantissa: int = 10, rows: int = 4, block: int = 2000) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked with 100 * intersection >= ``percent`` * union; the component is the smallest id that links lead to. Null and empty texts
    have no shingles and are linked with nothing. Rows without an id are linked with nothing and not kept. Texts may be of any length: a
    set takes 8 bytes a shingle, and blocks are bounded by shingles too. Ties in the estimate go to the smaller ids and change no component.
    An id names one text: rows that repeat an id repeat its text, and are all marked kept if it is. Other columns are not read; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    least, sketcher = percent / 100, Sketcher(registers, mantissa, rows)
    sketched = scratch.store(sketches(docs, words, sketcher), "sketches")
    some = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    classes = scratch.store(classes, "classes")
    band = classes.select("node", F.posexplode("bands").alias("place", "band"))
    least_of = band.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = scratch.store(band.join(least_of, "band").select("band", "place", "node", "a"), "shared-bands")
    stars = shared.where("node <> a").groupBy("a", F.col("node").alias("b")).count()
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    nodes = scratch.store(shared.select("node").distinct(), "nodes")
    some_classes = scratch.store(classes.select("node", "registers", "n_shingles").join(nodes, "node", "left_semi"), "classes-sharing")
    best = scratch.store(estimated(stars, some_classes, sketcher, least), "stars")
    # texts cross the network once; the nodes grow with the corpus, so the join is the same at every size
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    sets = scratch.store(full_sets(texts.dropDuplicates(["node"]), words), "sets")
    edges = scratch.store(confirm(best, sets, percent), "links")
    found = scratch.store(components(edges), "components")

    def blocks(found: DataFrame, name: str) -> tuple[DataFrame, int]:
        known = shared.join(found, "node", "left").select("band", "place", "node", F.coalesce("component", "node").alias("component"))
        mixed = known.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
        members = scratch.store(known.join(mixed, "band").join(some_classes, "node"), f"open-bands-{name}")
        return open_blocks(members, block), max(1, members.count() // 1000)

    open_, buckets = blocks(found, "1")
    nearest = scratch.store(nearest_components(open_, sketcher, least, buckets), "nearest-components")
    edges = scratch.store(edges.union(confirm(nearest, sets, percent)), "links")
    found = scratch.store(components(edges), "components")
    open_, buckets = blocks(found, "2")
    rest = scratch.store(undecided(open_, sketcher, least, buckets), "undecided")
    size = rest.agg(F.sum("n_shingles")).first()[0] or 0
    more = scratch.store(links_in_blocks(rest, sets, sketcher, least, percent, max(1, size // (1 << 20))), "links-in-blocks")
    if more.limit(1).count():
        found = scratch.store(components(edges.union(more)), "components")
    # a class is named by its smallest id, so the smallest node of a component is the smallest id that links lead to
    owner = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "digest").join(owner, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return scratch.finish(out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near-copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, in its own columns, whatever their names.

    Null and empty texts and rows without an id all stay; of rows that repeat an id one stays; an empty table gives no rows.
    """
    kept = store(near_copies(docs, **options).where("kept").groupBy("doc_id").count(), "kept")
    named = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if kept.where("count > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where("doc_id IS NULL"))
