"""Quality metrics of the chunks of each document, their composite, gate and failure report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, strip

# fixed values: id pattern, junk ids, noise patterns, weights and bands
LEGAL_ID = r"(?i)^(\d{1,3}[A-Z]?|Rule\s+\d+[A-Z]?|ORDER\s+[IVXLCDM]+\s+RULE\s+\d+)$"
JUNK_IDS = ("N/A", "", "None", "Unknown", "0", "na", "n/a")
NOISE = (r"^\s*\d{1,4}\s*$", r"^[\s_\-=]+$", r"^.{1,25}$")
WEIGHTS = {"capture": 0.30, "coverage": 0.20, "length": 0.25, "noise": 0.15, "continuity": 0.10}
BANDS = ((0.85, "excellent"), (0.70, "pass"), (0.60, "near_pass"), (0.45, "weak"))
PASS, NEAR_PASS, SEVERE = 0.70, 0.66, 0.55
THRESHOLDS = {"capture": 0.50, "length": 0.50, "noise": 0.50, "continuity": 0.40, "coverage": 0.30}


def valid_legal_id(value: Column) -> Column:
    v = strip(F.coalesce(value.cast("string"), F.lit("")))
    return ~v.isin(*JUNK_IDS) & v.rlike(LEGAL_ID)


def is_noise(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return t.rlike(NOISE[0]) | t.rlike(NOISE[1]) | t.rlike(NOISE[2])


def duplicate_prefix(text: Column, size: int = 80) -> Column:
    return normalise(F.substring(F.coalesce(text, F.lit("")), 1, size))


def number_of(section: Column, rule: Column) -> Column:
    """The leading number of a chunk's section, or of its rule where it has no section at all; null without one."""
    number = F.regexp_extract(F.coalesce(section, rule, F.lit("")), r"^(\d+)", 1)
    return F.when(number != "", number.cast("long"))


def rises(by: Sequence[str], order: str | Sequence[str], path: str = "hierarchy_path") -> Column:
    """1.0 where a chunk's number is not under that of the numbered chunk before it in the same sequence, 0.0 where it is; null otherwise.

    A sequence ends where a numbered chunk's chapter or part (both known), or order ``path``, differs from those of the chunk just before it, numbered or not.
    All of it is one window, so the chunks are sorted once. The column _number has their numbers (see ``number_of``).
    """
    own = Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))
    reset = F.lit(False)
    for name in ("chapter", "part"):
        now, old = F.coalesce(name, F.lit("")), F.coalesce(F.lag(name).over(own), F.lit(""))
        reset = reset | ((now != "") & (old != "") & (now != old))
    now, old = F.coalesce(path, F.lit("")), F.coalesce(F.lag(path).over(own), F.lit(""))
    reset = reset | (now.contains("ORDER") & old.contains("ORDER") & (now != old))
    number = F.col("_number")
    before = F.last(number, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(number.isNotNull() & before.isNotNull() & ~reset, (number >= before).cast("double"))


def continuity(chunks: DataFrame, by: Sequence[str] = ("doc_id",), order: str = "chunk_index", path_reset: bool = True) -> DataFrame:
    """``by`` and continuity: the share of neighbouring numbers in a sequence that don't fall; 0.5 without any neighbours.

    ``path_reset`` False compares orders instead of whole paths, so that neighbouring rules of one order are compared.
    """
    rows = chunks.withColumn("_number", number_of(F.col("section_number"), F.col("rule")))
    rows = rows.withColumn("_rises", rises(by, order, "hierarchy_path" if path_reset else "order"))
    return rows.groupBy(*by).agg(F.coalesce(F.avg("_rises"), F.lit(0.5)).alias("continuity"))


def metrics(chunks: DataFrame, by: Sequence[str] = ("doc_id",), order: str | Sequence[str] = "chunk_index", parts: int | None = None) -> DataFrame:
    """``by``, n_chunks, the five metrics, duplicates, overall (0 to 1) and band.

    Chunks have section_number, rule, chapter, part, hierarchy_path, text. Capture reads the rule where there is no section number (null). What a metric needs
    of a chunk is worked out before the chunks are shuffled and sorted, so that texts stay behind; ``by`` and a prefix's digest are aggregated before ``by`` alone.
    ``parts`` is the number of partitions to deal them to (see ``parts_for``); without it the session decides.
    """
    text, names = F.coalesce("text", F.lit("")), [order] if isinstance(order, str) else list(order)
    flag = lambda c: c.cast("tinyint")
    told = {
        "_number": number_of(F.col("section_number"), F.col("rule")),
        "_size": F.length(text),
        "_valid": flag(valid_legal_id(F.coalesce("section_number", "rule"))),
        "_noise": flag(is_noise(F.col("text"))),
        "_known": flag(~F.coalesce("chapter", F.lit("Unknown")).contains("Unknown")),
        "_prefix": F.unhex(F.md5(duplicate_prefix(F.col("text")))),
    }
    # a shuffle of its own, as what is worked out would be put behind the window's
    rows = chunks.select(*dict.fromkeys((*by, *names)), "chapter", "part", "hierarchy_path", *[c.alias(k) for k, c in told.items()]).repartition(*([parts] if parts else []), *by)
    rows = rows.withColumn("_rises", rises(by, names))
    fits = ((F.col("_size") >= 50) & (F.col("_size") <= 3000)).cast("long")
    sums = {"_n": F.count("*"), "_valid": F.sum("_valid"), "_fits": F.sum(fits), "_size": F.max("_size"), "_noise": F.sum("_noise"), "_known": F.sum("_known"), "_rises": F.sum("_rises"), "_pairs": F.count("_rises")}
    each = rows.groupBy(*by, "_prefix").agg(*[c.alias(k) for k, c in sums.items()])
    n, valid = F.sum("_n"), F.sum("_valid")
    base = each.groupBy(*by).agg(
        n.alias("n_chunks"),
        F.least(valid / n * F.when(valid < 5, 0.5).otherwise(1.0), F.lit(1.0)).alias("capture"),
        F.greatest(F.sum("_fits") / n - F.when(F.max("_size") > 15000, 0.70).when(F.max("_size") > 8000, 0.40).otherwise(0.0), F.lit(0.0)).alias("length"),
        (1 - F.sum("_noise") / n).alias("noise"),
        (F.sum("_known") / n).alias("coverage"),
        F.when(n < 4, F.lit(0.0)).otherwise(F.least((n - F.count("*")) / n * 0.5, F.lit(0.25))).alias("duplicates"),
        F.coalesce(F.sum("_rises") / F.nullif(F.sum("_pairs"), F.lit(0)), F.lit(0.5)).alias("continuity"),
    )
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - F.col("duplicates")
    base = base.withColumn("overall", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    return base.withColumn("band", band(F.col("overall")))


def parts_for(n_chunks: int, least: int = 1, each: int = 250_000) -> int:
    """Partitions of about ``each`` chunks, so that a task's memory does not grow with the table."""
    return max(least, -(-n_chunks // each))


def band(overall: Column) -> Column:
    out = F.lit("fail")
    for least, name in reversed(BANDS):
        out = F.when(overall >= least, name).otherwise(out)
    return out


def passes(metrics_: DataFrame, least: float = PASS) -> DataFrame:
    return metrics_.withColumn("passed", (F.col("n_chunks") > 0) & (F.col("overall") >= least))


def is_severe() -> Column:
    return (F.col("capture") < 0.50) | (F.col("continuity") < 0.45) | (F.col("length") < 0.45) | (F.col("noise") < 0.50)


LISTED, SAMPLES = 5, 3  # fixed values: failures listed, texts shown


def failure_report(chunks: DataFrame, scored: DataFrame, by: Sequence[str] = ("doc_id",), order: str = "chunk_index", parts: int | None = None) -> DataFrame:
    """Counts of chunks without a section number and of short ones, messages for metrics under their thresholds, the
    first five of those chunks (unnumbered ones first) and the texts of three unnumbered ones.

    Here rules without a section number count as failures, other than in the capture metric. ``parts`` as in ``metrics``.
    """
    unnumbered = F.coalesce("section_number", F.lit("N/A")) == "N/A"
    short = F.length(F.coalesce("text", F.lit(""))) < 50
    place = F.col(order).cast("long")
    kinds = F.filter(F.array(F.when(unnumbered, F.lit(0)), F.when(short, F.lit(1))), lambda x: x.isNotNull())
    each = chunks.select(*by, place.alias("place"), F.substring("text", 1, 500).alias("text"), F.explode(kinds).alias("kind"))
    each = each.repartition(parts, *by) if parts else each
    # only the first of each kind are gathered, however many fail
    order_ = Window.partitionBy(*by, "kind").orderBy("place", "text")
    first = each.withColumn("_n", F.row_number().over(order_)).where(F.col("_n") <= LISTED)
    cut = lambda n: F.struct("kind", "place", F.substring("text", 1, n).alias("text"))
    listed = first.groupBy(*by).agg(
        F.slice(F.array_sort(F.collect_list(cut(300))), 1, LISTED).alias("failures"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 0, cut(500)))), lambda x: x["text"]), 1, SAMPLES).alias("samples"),
    )
    found = chunks.groupBy(*by).agg(F.count("*").alias("total"), F.sum(unnumbered.cast("int")).alias("n_unnumbered"), F.sum(short.cast("int")).alias("n_short"))
    same = [F.col(f"found.{c}").eqNullSafe(F.col(f"listed.{c}")) for c in by]
    found = found.alias("found").join(listed.alias("listed"), same, "left").select("found.*", *[F.coalesce(F.col(f"listed.{c}"), F.array().cast(listed.schema[c].dataType)).alias(c) for c in ("failures", "samples")])
    issues = F.filter(F.array(*[F.when(F.col(k) < t, F.lit(f"{k} below {t:g}")) for k, t in THRESHOLDS.items()]), lambda x: x.isNotNull())
    return found.join(scored.select(*by, issues.alias("issues"), "overall"), list(by))
