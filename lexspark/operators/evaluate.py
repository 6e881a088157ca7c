"""Retrieval and answer evaluation: hits, ranks, precision, coverage, breakdowns and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 10, 20)


def with_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``ranked`` (qid, rank, chunk_id, ...) with ``hit``: whether ``relevant`` (qid, chunk_id) holds the pair."""
    pairs = relevant.select("qid", "chunk_id").distinct().withColumn("_hit", F.lit(True))
    return ranked.join(pairs, ["qid", "chunk_id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def per_query(hits: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """First hit's rank (null: none), number of hits, and precision over the list."""
    return hits.groupBy(*by).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"), F.sum(F.col("hit").cast("int")).alias("n_hits"), F.avg(F.col("hit").cast("double")).alias("precision"), F.count("*").alias("n_results"))


def accuracy(per: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS) -> DataFrame:
    """Share of queries with a hit among the first k, mean precision and mean reciprocal rank."""
    tops = [F.avg((F.coalesce("first_hit", F.lit(1 << 30)) <= k).cast("double")).alias(f"top{k}") for k in ks]
    return per.groupBy(*by).agg(F.count("*").alias("n_queries"), *tops, F.avg("precision").alias("mean_precision"), F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def section_sets(results: DataFrame) -> DataFrame:
    """Per qid: expected sections, those found and those missing, and whether all or any were found (expected_sections, found_sections arrays)."""
    got, want = F.array_distinct("found_sections"), F.array_distinct("expected_sections")
    hit, missing = F.array_sort(F.array_intersect(want, got)), F.array_sort(F.array_except(want, got))
    return results.select("qid", hit.alias("hits"), missing.alias("missing"), (F.size(hit) == F.size(want)).alias("all_found"), F.arrays_overlap(want, got).alias("any_found"))


def keyword_score(answer: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the answer, whatever the case; 1 without keywords."""
    found = F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.when(F.size(keywords) > 0, F.size(found) / F.size(keywords)).otherwise(1.0)


def cites(answer: Column, sections: Column, whole_word: bool = False) -> Column:
    """Whether any expected section occurs in the answer; as a plain substring, or as a whole word."""
    if whole_word:
        return F.exists(sections, lambda s: F.regexp_instr(answer, F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E\b"))) > 0)
    return F.exists(sections, lambda s: F.contains(answer, s))


def judge(answers: DataFrame, least_keywords: float = 0.5, need_citation: bool = True, whole_word: bool = False) -> DataFrame:
    """``answers`` (qid, answer, expected_sections, expected_keywords) with keyword_score, cited, passed."""
    out = answers.withColumn("keyword_score", keyword_score(F.col("answer"), F.col("expected_keywords"))).withColumn("cited", cites(F.col("answer"), F.col("expected_sections"), whole_word))
    good = F.col("keyword_score") >= least_keywords
    return out.withColumn("passed", good & F.col("cited") if need_citation else good)


def suite(cases: DataFrame, ranked: DataFrame, answers: DataFrame, k: int = 20, least_keywords: float = 0.5, need_citation: bool = True) -> DataFrame:
    """A whole evaluation: per case (qid, expected_sections, expected_keywords, category) of its first ``k`` results (qid, rank, section_number) and its answer
    (qid, answer): first_hit, n_hits, hits, missing, keyword_score, cited, passed. ``breakdown`` by category gives the totals.

    A case without results has no hit, and one without an answer is judged on an empty one. Missing lists are empty.
    """
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("expected_sections", "expected_keywords")]
    cases = cases.select("qid", "category", *lists)
    top = ranked.where(F.col("rank") <= k).select("qid", "rank", "section_number")
    seen = F.filter(F.array_sort(F.collect_list(F.struct("rank", "section_number"))), lambda r: r["section_number"].isNotNull())
    rows = cases.join(top.groupBy("qid").agg(seen.alias("seen")), "qid", "left").join(answers.select("qid", "answer"), "qid", "left")
    rows = rows.withColumn("answer", F.coalesce("answer", F.lit("")))
    found = F.transform(F.coalesce("seen", F.array()), lambda r: r["section_number"])
    good = F.filter("seen", lambda r: F.array_contains("expected_sections", r["section_number"]))
    rows = rows.withColumn("found_sections", found.cast("array<string>")).withColumn("first_hit", F.get(good, F.lit(0))["rank"]).withColumn("n_hits", F.size(F.coalesce(good, F.array())))
    sets = F.array_sort(F.array_intersect("expected_sections", "found_sections")), F.array_sort(F.array_except("expected_sections", "found_sections"))
    rows = rows.withColumn("hits", sets[0]).withColumn("missing", sets[1])
    return judge(rows, least_keywords, need_citation).drop("seen", "found_sections")


def coverage(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Per qid over its relevant results: whether definitions and punishments are mentioned, their number, and their joined length."""
    t = F.lower(F.col(text_col))
    rows = hits.where("hit")
    size = F.sum(F.length(text_col)) + F.count("*") - 1
    return rows.groupBy("qid").agg(F.max(t.rlike("means|defined|definition|includes")).alias("has_definition"), F.max(t.rlike("punish|imprisonment|fine|penalty")).alias("has_punishment"), F.count("*").alias("chunks_found"), size.alias("combined_length"))


def breakdown(judged: DataFrame, by: str) -> DataFrame:
    """Passed, failed and total by a column, with the overall row (null) by rollup."""
    return judged.rollup(by).agg(F.sum(F.col("passed").cast("int")).alias("passed"), F.sum((~F.col("passed")).cast("int")).alias("failed"), F.count("*").alias("total"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of two per-query relations (qid, first_hit) by first hit; no hit is worse than any."""
    miss = 1 << 30
    x, y = a.select("qid", F.coalesce("first_hit", F.lit(miss)).alias("x")), b.select("qid", F.coalesce("first_hit", F.lit(miss)).alias("y"))
    both = x.join(y, "qid", "full_outer").select(F.coalesce("x", F.lit(miss)).alias("x"), F.coalesce("y", F.lit(miss)).alias("y"))
    return both.agg(F.count_if(F.col("y") < F.col("x")).alias("wins"), F.count_if(F.col("y") > F.col("x")).alias("losses"), F.count_if(F.col("y") == F.col("x")).alias("ties"))


def deltas(accuracy_: DataFrame, base: str, other: str, by: str = "retriever") -> DataFrame:
    """(metric, base, other, delta, sign) of two retrievers' rows in an accuracy relation."""
    names = [c for c in accuracy_.columns if c not in (by, "n_queries")]
    long = accuracy_.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(by, "m.*")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(by) == base, F.col("value"))).alias("base"), F.max(F.when(F.col(by) == other, F.col("value"))).alias("other"))
    d = F.col("other") - F.col("base")
    return wide.withColumn("delta", d).withColumn("sign", F.when(d > 0, "+").when(d < 0, "-").otherwise("="))
