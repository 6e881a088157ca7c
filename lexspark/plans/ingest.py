"""From text to stored chunks: parse, judge, route to refinement or fallback, split, identify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import chunk_id, with_storage_metadata
from ..functions.text import clean_text, filter_blank, remove_toc
from ..operators import detect, parse, quality, split
from ..sources.tables import stage
from . import schema

FAST_PATH, MARGIN, LOW = 0.82, 0.05, 0.70  # fixed values of the arbitration


@dataclass
class Settings:
    chunk_size: int = 800
    overlap: int = 100
    stored_at: str = "1970-01-01 00:00:00"
    model: str = "none"
    heading_scope: str = "eager"


def prepare(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with clean text that begins after any table of contents."""
    # a column for each step: as one expression the text would be cleaned anew for every anchor that is looked for
    for step in (clean_text, remove_toc, filter_blank):
        docs = docs.withColumn("text", step(F.col("text")))
    return docs


def detected(docs: DataFrame) -> DataFrame:
    """With doc_type, confidence, features, strategy and section pattern."""
    return detect.with_section_pattern(detect.detect(docs).withColumn("strategy", detect.strategy(F.col("confidence"))))


def tried_patterns(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks by each of the fixed patterns, doc_id with the pattern_no that scores best by (overall, number of chunks with a section number, order of patterns), and its tier_score).

    Of patterns that split a document alike only the first is tried, as it wins over the others in any case.
    """
    patterns = (*detect.SECTION_PATTERNS, detect.RULE_PATTERN)
    cuts = docs.withColumns({f"_cut{i}": F.split("text", p) for i, p in enumerate(patterns)})
    new = [reduce(lambda a, b: a & b, [~F.col(f"_cut{i}").eqNullSafe(F.col(f"_cut{j}")) for j in range(i)], F.lit(True)) for i in range(len(patterns))]
    ways = F.filter(F.array(*[F.when(own, F.struct(F.lit(i).alias("pattern_no"), F.lit(p).alias("_pattern"))) for i, (p, own) in enumerate(zip(patterns, new, strict=True))]), lambda x: x.isNotNull())
    tried = cuts.select(*docs.columns, F.explode(ways).alias("_way")).select(*docs.columns, "_way.pattern_no", "_way._pattern")
    scored = stage(parse.parse(tried, F.col("_pattern"), ("doc_id", "pattern_no")), "tried")
    found = quality.metrics(scored, ("doc_id", "pattern_no"))
    named = scored.groupBy("doc_id", "pattern_no").agg(F.count(F.when(~F.coalesce("section_number", F.lit("")).isin("N/A", ""), 1)).alias("named"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("overall"), F.desc("named"), "pattern_no")
    best = found.join(named, ["doc_id", "pattern_no"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "pattern_no", F.col("overall").alias("tier_score"))
    return scored, stage(best, "best-patterns")


def best_pattern(docs: DataFrame) -> DataFrame:
    """Chunks by the best of the fixed patterns, with its tier_score: the first fallback tier."""
    scored, best = tried_patterns(docs)
    return scored.join(best, ["doc_id", "pattern_no"])


def arbitrate(regex: DataFrame, schema: DataFrame) -> DataFrame:
    """Which of two parses' metrics (doc_id, overall, capture, continuity, coverage) wins: doc_id, winner, regex_score, schema_score, low_confidence.

    Regex wins outright from 0.82 on or without a rival; a lead over 0.05 decides; else capture, continuity and coverage in turn, and regex at last.
    """
    names = ("overall", "capture", "continuity", "coverage")
    a = regex.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in names])
    b = schema.select("doc_id", *[F.col(c).alias(f"s_{c}") for c in names])
    both = a.join(b, "doc_id", "full_outer")
    r, s = F.coalesce("r_overall", F.lit(0.0)), F.coalesce("s_overall", F.lit(0.0))
    tie = F.lit("regex")
    for c in reversed(names[1:]):
        x, y = F.coalesce(f"r_{c}", F.lit(0.0)), F.coalesce(f"s_{c}", F.lit(0.0))
        tie = F.when(x > y, "regex").when(y > x, "schema").otherwise(tie)
    fast = (r >= FAST_PATH) | F.col("s_overall").isNull()
    winner = F.when(fast, "regex").when(r - s > MARGIN, "regex").when(s - r > MARGIN, "schema").otherwise(tie)
    competed = ~fast
    return both.select("doc_id", winner.alias("winner"), F.when(competed, F.round(r, 4)).alias("regex_score"), F.when(competed, F.round(s, 4)).alias("schema_score"), (competed & (r < LOW) & (s < LOW)).alias("low_confidence"))


def route(overall: Column, n_chunks: Column, has_model: bool) -> Column:
    """What happens to a parse: store, store near the threshold, refine, or fall back. With a model, all that is not near the threshold is refined first."""
    n, o = F.coalesce(n_chunks, F.lit(0)), F.coalesce(overall, F.lit(0.0))
    rest = F.lit("refine") if has_model else F.when((n == 0) | (o < quality.SEVERE), "fallback").otherwise("store")
    return F.when((n > 0) & (o >= quality.PASS), "store").when((n > 0) & (o >= quality.NEAR_PASS), "near_pass").otherwise(rest)


def cascade(docs: DataFrame, model_chunks: DataFrame | None = None) -> DataFrame:
    """Fallback chunks of documents (doc_id, doc_title, doc_type, text): best pattern from 0.70 on, else a model's chunks, else plain windows; never none.

    ``model_chunks`` (doc_id, chunk_index, section_number, section_title, text) come from a pluggable model (see ``extract``); those of under three chunks, or
    with fewer distinct sections than half their number, are not used. The plain windows behind the share that the model's sample has of all windows' characters
    are added, at least one being left out.
    """
    tried, best = tried_patterns(docs)
    best = best.where(F.col("tier_score") >= quality.PASS)
    names = ["doc_id", "chunk_index", "section_number", "section_title", "chapter", "text", "fallback_tier"]
    out = tried.join(best, ["doc_id", "pattern_no"]).withColumn("fallback_tier", F.lit(1)).select(*names)
    rest = docs.join(best, "doc_id", "left_anti")
    plain = split.generic_chunks(rest)
    blank = lambda c: F.lit(None).cast("string").alias(c)
    two = plain.select("doc_id", "chunk_index", blank("section_number"), blank("section_title"), blank("chapter"), "text", F.lit(2).alias("fallback_tier"))
    if model_chunks is None:
        return out.unionByName(two)
    good = model_chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("section_number").alias("kinds")).where((F.col("n") >= 3) & (F.col("kinds") * 2 >= F.col("n")))
    three = model_chunks.join(rest.select("doc_id"), "doc_id", "left_semi").join(good.select("doc_id"), "doc_id", "left_semi")
    three = three.select("doc_id", "chunk_index", "section_number", "section_title", blank("chapter"), "text", F.lit(3).alias("fallback_tier"))
    total = two.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n2"))
    skip = F.greatest(F.lit(1), F.floor(F.col("n2") * F.least(F.lit(12000.0) / F.col("chars"), F.lit(0.85))))
    behind = two.join(total, "doc_id").join(three.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("chunk_index") > skip).select(*names)
    alone = two.join(three.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.unionByName(three).unionByName(behind).unionByName(alone)


def refine(scored: DataFrame, better: DataFrame) -> DataFrame:
    """(doc_id, accepted): a refined parse's metrics are taken only if strictly better."""
    a, b = scored.select("doc_id", F.col("overall").alias("old")), better.select("doc_id", F.col("overall").alias("new"))
    return a.join(b, "doc_id", "left").select("doc_id", F.coalesce(F.col("new") > F.col("old"), F.lit(False)).alias("accepted"))


def replaced(chunks: DataFrame, scored: DataFrame, rival: DataFrame, rival_scored: DataFrame, won: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and metrics, those of the rival for the documents in ``won`` (doc_id)."""

    def pick(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return stage(a.join(won, "doc_id", "left_anti").unionByName(b.join(won, "doc_id", "left_semi"), allowMissingColumns=True), name)

    return pick(chunks, rival, "picked"), pick(scored, rival_scored.select(*scored.columns), "picked-metrics")


def compete(parts: DataFrame, chunks: DataFrame, scored: DataFrame, complete: Callable[[str], str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, metrics, schemas) after the schema parse of segments whose strategy asks for one.

    HYBRID segments whose regex parse does not win outright get one schema, and both parses are arbitrated; their chunks carry how, and both scores. SCHEMA
    segments get a schema that is tried on a sample first; without a usable one the regex parse stays. ``scored`` has a row for every segment.
    """
    kinds = parts.select("doc_id", "strategy")
    hybrid = scored.join(kinds.where("strategy = 'HYBRID'"), "doc_id", "left_semi")
    if complete is None:
        made = rival = rival_scored = None
        arbitrated = arbitrate(hybrid, hybrid.limit(0))
    else:
        weak = parts.join(hybrid.where(F.col("overall") < FAST_PATH), "doc_id", "left_semi").withColumn("sample", schema.stratified_sample(F.col("text")))
        one = schema.answers(weak.drop("text"), complete)
        made = stage(one.unionByName(schema.validated(parts.where("strategy = 'SCHEMA'"), complete)), "schemas")
        rival, rival_scored = schema.judged(parts, made, "schema")
        arbitrated = arbitrate(hybrid, rival_scored.join(hybrid, "doc_id", "left_semi"))
    arbitrated = stage(arbitrated, "arbitrated")
    if complete is not None:
        won = arbitrated.where("winner = 'schema'").select("doc_id").union(made.join(kinds.where("strategy = 'SCHEMA'"), "doc_id", "left_semi").select("doc_id"))
        chunks, scored = replaced(chunks, scored, rival, rival_scored, won)
    regex_score = F.round("overall", 4)
    how = F.when(F.col("overall") >= FAST_PATH, "hybrid_regex_fastpath").when(F.col("schema_score").isNull(), "hybrid_regex_only")
    how = how.when(F.col("low_confidence"), "hybrid_low_confidence").otherwise(F.concat(F.lit("hybrid_"), F.col("winner")))
    told = arbitrated.join(hybrid.select("doc_id", "overall"), "doc_id").select("doc_id", how.alias("_how"), regex_score.alias("hybrid_regex_score"), F.col("schema_score").alias("hybrid_schema_score"))
    chunks = chunks.join(told, "doc_id", "left").withColumn("parse_strategy", F.coalesce("_how", "parse_strategy")).drop("_how")
    return chunks, scored, made


def refined(parts: DataFrame, chunks: DataFrame, scored: DataFrame, made: DataFrame, complete: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Chunks and metrics after one more try for segments that neither pass nor come near.

    Each is parsed in full by its schema (a new one where it has none); a parse that still fails badly gets one patch, made from its failures and
    both ends of the text. The better of these two is taken where it beats the parse that is there.
    """
    ways = scored.select("doc_id", route(F.col("overall"), F.col("n_chunks"), True).alias("route"))
    open_ = stage(parts.join(ways.where("route = 'refine'"), "doc_id", "left_semi"), "open")
    fresh = open_.join(made, "doc_id", "left_anti").withColumn("sample", schema.stratified_sample(F.col("text")))
    first = stage(made.join(open_, "doc_id", "left_semi").unionByName(schema.answers(fresh.drop("text"), complete)), "first-schemas")
    one, one_scored = schema.judged(open_, first, "first")
    bad = one_scored.where((F.col("overall") < quality.PASS) & ((F.col("overall") < quality.NEAR_PASS) | quality.is_severe()))
    asked = open_.withColumn("sample", schema.head_and_tail(F.col("text"))).drop("text").join(bad.select("doc_id", "schema", "report", *schema.METRICS), "doc_id")
    two, two_scored = schema.judged(open_, stage(schema.answers(asked, complete), "patched-schemas"), "patched")
    one, one_scored = replaced(one, one_scored, two, two_scored, refine(one_scored, two_scored).where("accepted").select("doc_id"))
    return replaced(chunks, scored, one, one_scored, refine(scored, one_scored).where("accepted").select("doc_id"))


def ingest(docs: DataFrame, settings: Settings = Settings(), model: Callable[[DataFrame], DataFrame] | None = None, complete: Callable[[str], str] | None = None) -> DataFrame:
    """Stored chunks of ``docs`` (doc_id, text): segments, parse, competition, refinement, fallback, split, ids.

    ``complete`` answers prompts for parse schemas; ``model`` turns segments (doc_id, doc_title, doc_type, text) into chunks for the third tier. None: there
    is no such model.
    """
    typed = stage(detected(stage(prepare(docs), "prepared")), "detected")
    kinds = typed.drop("text")
    parts = detect.segments(typed.select("doc_id", "text")).join(kinds, "doc_id")
    unit = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("segment_index").cast("string"))
    parts = parts.withColumn("source_id", F.col("doc_id")).withColumn("doc_id", unit).withColumnRenamed("title", "doc_title")
    parts = stage(parts, "segments")
    chunks = stage(parse.parse(parts, F.col("section_pattern"), heading_scope=settings.heading_scope), "parsed")
    names = ("n_chunks", *quality.WEIGHTS, "overall")
    scored = stage(parts.select("doc_id").join(quality.metrics(chunks), "doc_id", "left").select("doc_id", *names).fillna(0, names), "metrics")
    chunks, scored, made = compete(parts, chunks, scored, complete)
    near = scored.select("doc_id", (route(F.col("overall"), F.col("n_chunks"), True) == "near_pass").alias("_near"))
    if complete is not None:
        chunks, scored = refined(parts, chunks, scored, made, complete)
    routed = scored.select("doc_id", route(F.col("overall"), F.col("n_chunks"), False).alias("route"))
    # what a segment gives to its chunks is put together first, so that chunks are shuffled once
    own = parts.select("doc_id", "source_id", "segment_index", "doc_title", "doc_type")
    stored = routed.where("route <> 'fallback'").drop("route").join(near, "doc_id").join(own.drop("doc_title", "doc_type"), "doc_id")
    direct = chunks.join(stored, "doc_id").withColumn("fallback_tier", F.lit(None).cast("int"))
    direct = direct.withColumn("parse_strategy", F.when(F.col("_near"), "accepted_near_threshold").otherwise(F.col("parse_strategy"))).drop("_near")
    back_ids = routed.where("route = 'fallback'").select("doc_id")
    failed = stage(parts.join(back_ids, "doc_id", "left_semi"), "failed")
    back = cascade(failed, model(failed) if model else None).join(own.join(back_ids, "doc_id", "left_semi"), "doc_id")
    every = direct.unionByName(stage(back, "fallback"), allowMissingColumns=True)
    out = split.split_chunks(every, settings.chunk_size, settings.overlap)
    key = chunk_id(F.col("doc_title"), F.col("section_number"), F.col("chunk_index"), F.col("sub_chunk"), F.col("segment_index"), F.col("text"), F.col("source_id").cast("string"))
    return with_storage_metadata(out.withColumn("chunk_id", key), settings.stored_at, settings.model).drop("doc_id").withColumnRenamed("source_id", "doc_id")


def job_summary(chunks: DataFrame, scored: DataFrame) -> DataFrame:
    """Totals of a run: chunks, mean score to three places, whether any fallback was used, segments."""
    a = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.max(F.col("fallback_tier").isNotNull()), F.lit(False)).alias("used_fallback"))
    b = scored.agg(F.round(F.avg("overall"), 3).alias("avg_score"), F.count("*").alias("segments"))
    return a.crossJoin(b)
