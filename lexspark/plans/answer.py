"""Question answering as a plan: cache, rewrite, expansion, hybrid retrieval, rerank, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import asof, retrieve
from ..sources.tables import stage


def cache_key(session, question):
    return F.concat(F.lit("llm_cache:"), F.sha2(F.concat(session, F.lit(":"), question), 256))


def split_by_cache(questions: DataFrame, cache: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(hits with answer and empty context, misses) of questions (qid, session, question) by a cache (key, value, expires_at)."""
    live = cache if now is None else cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    keyed = questions.withColumn("key", cache_key(F.col("session"), F.col("question")))
    hits = keyed.join(live.select("key", F.col("value").alias("answer")), "key").withColumn("context", F.array().cast("array<string>"))
    return hits, keyed.join(live.select("key"), "key", "left_anti")


def history(messages: DataFrame, session: str = "session", order: str = "turn") -> DataFrame:
    """(session, history): each session's messages as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return messages.groupBy(session).agg(F.array_join(F.transform(rows, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("history"))


def with_history(messages: DataFrame, most: int = 20, session: str = "session", order: tuple[str, ...] = ("turn",), segment: int = 10_000) -> DataFrame:
    """``messages`` with ``history``: up to ``most`` messages (role, text) before each one in its session, oldest first. A long session is worked off by ``segment`` turns."""
    return asof.preceding(messages, session, order, F.struct("role", "text"), F.floor(F.col(order[0]) / segment), most, "history")


def follow_up(question: Column, history: Column) -> Column:
    """Deterministic stand-in for a model that makes a question stand alone: one of under eight words is put after the user's question before it."""
    asked = F.filter(history, lambda m: m["role"] == "user")
    last = F.when(F.size(asked) > 0, F.element_at(asked, -1)["text"])
    return F.when(last.isNotNull() & (F.size(tokens(question)) < 8), F.concat(last, F.lit("\n"), question)).otherwise(question)


def contextualise(questions: DataFrame, rewrite: Callable[[str], str] | None = None) -> DataFrame:
    """``questions`` (question, history) with ``question`` made to stand alone by a model; one without history stays as it is."""
    if rewrite is None:
        return questions.withColumn("question", follow_up(F.col("question"), F.col("history")))
    told = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    ask = F.concat(F.lit("Put the last question so that it can be understood without the talk before it. Do not answer it.\n\n"), told, F.lit("\n\nQuestion: "), F.col("question"))
    alone = F.size("history") == 0
    new = F.pandas_udf(lambda p: p.map(lambda x: None if x is None else rewrite(x)), "string")(F.when(~alone, ask))
    return questions.withColumn("question", F.when(alone, F.col("question")).otherwise(new))


def expansions(questions: DataFrame, rewrite: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(qid, rewrite_no, question): the question itself first, then up to four rewrites of a pluggable model."""
    if rewrite is None:
        return questions.select("qid", F.lit(0).alias("rewrite_no"), "question")

    @F.pandas_udf("array<string>")
    def four(q: pd.Series) -> pd.Series:
        return q.map(lambda x: [x, *rewrite(x)[:4]])

    return questions.select("qid", F.posexplode(four("question")).alias("rewrite_no", "question"))


def hybrid(index: retrieve.Index, corpus: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Fused ranks of questions (qid, question, vector) over a corpus (chunk_id, embedding); without any text in the index the dense order."""
    return retrieve.fuse(retrieve.dense_top(corpus, questions, k), retrieve.bm25_top(index, questions, k), questions, k)


def prompts(reranked: DataFrame, questions: DataFrame, template: str = "Answer from the context only.\n\n{context}\n\nQuestion: {question}") -> DataFrame:
    """(qid, prompt, context): the texts by rank stuffed into a template; no text is an empty context."""
    rows = F.array_sort(F.collect_list(F.struct("rerank_rank", "text")))
    context = reranked.groupBy("qid").agg(F.transform(rows, lambda r: r["text"]).alias("context"))
    both = questions.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    text = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.array_join("context", "\n\n")), F.lit("{question}"), F.col("question"))
    return both.select("qid", text.alias("prompt"), "context")


def complete(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``asked`` (prompt) with the answer of a pluggable model, by batches."""
    return asked.withColumn("answer", F.pandas_udf(lambda p: p.map(model), "string")("prompt"))


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with updated_at of their last message, newest first by ``place``."""
    last = messages.groupBy("conv_id").agg(F.max("ts").alias("last"))
    out = conversations.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("created_at", F.coalesce("last", F.col("created_at")))).drop("last")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id")))


def ask(
    questions: DataFrame,
    messages: DataFrame,
    cache: DataFrame,
    index: retrieve.Index,
    corpus: DataFrame,
    complete: Callable[[str], str],
    embed: Callable[[pd.Series], pd.Series] = retrieve.hashed_embedding,
    score: Callable[[pd.Series, pd.Series], pd.Series] = retrieve.overlap_scorer,
    rewrite: Callable[[str], str] | None = None,
    expand: Callable[[str], list[str]] | None = None,
    k: int = 20,
    n: int = 5,
) -> DataFrame:
    """(qid, answer, context, from_cache) of questions (qid, session, turn, question): the whole chain over tables.

    What the cache (key, value, expires_at) answers takes no further part. The others are made to stand alone by their session's earlier ``messages`` (session, turn,
    role, text), expanded, searched by both retrievers over the corpus (chunk_id, text, embedding), fused, united, reranked to ``n`` texts, and put to the
    model with the question as it was asked. Searches and answers are kept as tables, so no model is asked twice.
    """
    hits, misses = split_by_cache(questions, cache)
    known = messages.select("session", "turn", "role", "text", F.lit(None).cast("string").alias("qid"))
    asked = misses.select("session", "turn", F.lit("user").alias("role"), F.col("question").alias("text"), F.col("qid").cast("string").alias("qid"))
    kind = questions.schema["qid"].dataType
    open_ = with_history(known.unionByName(asked)).where("qid IS NOT NULL").select(F.col("qid").cast(kind).alias("qid"), F.col("text").alias("question"), "history")
    alone = stage(contextualise(open_, rewrite), "standalone")
    forms = stage(expansions(alone, expand).withColumn("_form", F.struct("qid", "rewrite_no")), "expansions")
    by_form = retrieve.embed(forms.select(F.col("_form").alias("qid"), "question"), embed, "question").withColumnRenamed("embedding", "vector")
    found = hybrid(index, corpus, stage(by_form, "questions"), k)
    united = stage(retrieve.union_expansions(found.select("qid.qid", "qid.rewrite_no", "rank", "chunk_id")), "united")
    texts = united.join(corpus.select("chunk_id", "text"), "chunk_id").join(alone.select("qid", "question"), "qid")
    best = retrieve.rerank(texts, score, n)
    told = complete_all(prompts(best, misses.select("qid", "question")), complete)
    cached = hits.select("qid", "answer", "context", F.lit(True).alias("from_cache"))
    return cached.unionByName(told.select("qid", "answer", "context", F.lit(False).alias("from_cache")))


def complete_all(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    return stage(complete(asked, model), "answers")
