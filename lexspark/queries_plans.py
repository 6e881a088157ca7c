"""Queries of plans over several operators: nested JSON, model replies, histories, the answer chain, caches, the store.

They are registered with those of ``queries`` when this module is imported.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import retrieve
from .plans import answer, extract
from .queries import query, table
from .sources import nested, store
from .sources.tables import new_folder, stage
from .streaming import cache

# ---- nested JSON and replies --------------------------------------------------------------------------------------

@query("s13_nested_cases", """SELECT o_custkey AS file, (o_orderkey % 4 + 1)::INT AS depth, 'order ' || o_orderkey AS query, o_orderstatus || '/' || o_orderpriority AS sections FROM orders""")
def nested_cases(spark, sf_dir):
    """Test cases of a file, in lists nested to different depths among numbers and nulls, taken apart in the JVM."""
    case = F.to_json(F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("query"), F.array("o_orderstatus", "o_orderpriority").alias("expected_sections")))
    depth = (F.col("o_orderkey") % 4).cast("int")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", F.concat(F.repeat(F.lit("["), depth), case, F.repeat(F.lit("]"), depth)).alias("item"))
    files = items.groupBy("file").agg(F.concat(F.lit("[1, null, [], "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]), ", "), F.lit("]")).alias("json"))
    cases = nested.objects(files.select("file", F.try_parse_json("json").alias("v")))
    return cases.select("file", F.size("path").alias("depth"), F.variant_get("v", "$.query", "string").alias("query"), F.array_join(F.variant_get("v", "$.expected_sections", "array<string>"), "/").alias("sections"))


@query("p17_model_replies", """
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_orderkey % 7 = 0 THEN '1' ELSE l_linenumber || l_returnflag END AS number, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'of ' || l_linestatus END AS title,
           CASE WHEN l_quantity < 4 THEN ' ' ELSE 'body ' || l_partkey END AS content FROM lineitem),
o AS (SELECT doc_id, count(*) AS items, count(DISTINCT number) AS kinds, count_if(trim(content) <> '') AS usable FROM i GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no array' WHEN doc_id % 11 = 1 THEN 'not JSON' WHEN items < 3 THEN 'too few items' WHEN kinds < greatest(1, items // 2) THEN 'repeated numbers' WHEN usable < 3 THEN 'too few usable items' END AS reason FROM o)
SELECT doc_id, reason, NULL::INT AS chunk_index, NULL AS section_number, NULL AS text FROM r WHERE reason IS NOT NULL
UNION ALL SELECT doc_id, NULL, place, number, '[Act] Section ' || number || ' — ' || title || chr(10) || content FROM (SELECT i.*, reason, row_number() OVER (PARTITION BY doc_id ORDER BY n, number, content, title)::INT AS place FROM i JOIN r USING (doc_id)) WHERE reason IS NULL AND trim(content) <> ''""")
def model_replies(spark, sf_dir):
    """A model's lists of sections, checked and made into chunks; broken ones by their reasons."""
    n, blank = F.col("l_linenumber"), F.lit(None).cast("string")
    number = F.when(F.col("l_orderkey") % 7 == 0, "1").otherwise(F.concat(n.cast("string"), "l_returnflag"))
    content = F.when(F.col("l_quantity") < 4, " ").otherwise(F.concat(F.lit("body "), F.col("l_partkey").cast("string")))
    item = F.to_json(F.struct(number.alias("section"), F.when(n % 3 == 0, blank).otherwise(F.concat(F.lit("of "), "l_linestatus")).alias("title"), content.alias("content")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(n, number, content, item.alias("item")).alias("i"))
    items = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["item"]), ", ").alias("items"))
    kind = F.col("doc_id") % 11
    reply = F.when(kind == 0, "There is no list.").when(kind == 1, F.concat(F.lit('[{"section": ['), "items", F.lit("]"))).otherwise(F.concat(F.lit("Here it is: ["), "items", F.lit("] That is all.")))
    good, bad = extract.read_replies(items.select("doc_id", F.lit("Act").alias("doc_title"), reply.alias("reply")))
    return bad.select("doc_id", "reason").unionByName(good.select("doc_id", "chunk_index", "section_number", "text"), allowMissingColumns=True)


# ---- histories and answers ----------------------------------------------------------------------------------------


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", "role", "text")


@query("v10_history_rewrite", r"""
WITH h AS (SELECT conv_id::VARCHAR AS session, turn, role, text, list((role, text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations),
q AS (SELECT session, turn, text, coalesce(len(h), 0)::INT AS n_history, list_filter(h, lambda m: m[1] = 'user')[-1][2] AS last FROM h WHERE role = 'user')
SELECT session, turn, n_history, sha256(CASE WHEN last IS NOT NULL AND len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) < 8 THEN last || chr(10) || text ELSE text END) AS question FROM q""")
def history_rewrite(spark, sf_dir):
    """Each question with the six messages before it, and as a question of its own."""
    asked = answer.with_history(_messages(spark, sf_dir), 6, order=("turn", "role", "text")).where("role = 'user'").withColumn("question", F.col("text"))
    return answer.contextualise(asked).select("session", "turn", F.size("history").alias("n_history"), F.sha2("question", 256).alias("question"))


def short_answer(prompt: str) -> str:
    """Stand-in for a model: the length of what it was told."""
    return f"{len(prompt)} characters"


@query("v11_answer_chain")
def answer_chain(spark, sf_dir):
    """The last question of each conversation through cache, history, expansion, hybrid search, rerank, prompt and model."""
    messages = _messages(spark, sf_dir)
    last = messages.where("role = 'user'").groupBy("session").agg(F.max_by(F.struct("turn", "text"), F.struct("turn", "text")).alias("m"))
    questions = stage(last.select(F.col("session").alias("qid"), "session", F.col("m.turn").alias("turn"), F.col("m.text").alias("question")), "asked")
    earlier = messages.join(questions.select("session", F.col("turn").alias("_last")), "session").where("turn < _last").drop("_last")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    corpus = stage(retrieve.embed(docs, retrieve.hashed_embedding), "corpus")
    known = questions.where(F.crc32("session") % 5 == 0).select(answer.cache_key(F.col("session"), F.col("question")).alias("key"), F.lit("known").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    out = answer.ask(questions, earlier, known, retrieve.build_index(docs), corpus, short_answer, k=10)
    return out.select("qid", F.size("context").alias("n_context"), "answer", "from_cache")


@query("x5_cache_answers", """
WITH e AS (SELECT user_id::VARCHAR AS key, ts, event_id AS seq, event_id % 3 = 0 AS is_set, CASE WHEN event_id % 3 = 0 THEN event_type END AS value, CASE event_id % 9 WHEN 0 THEN NULL WHEN 3 THEN 0 ELSE value * 3600 END AS ttl FROM events),
h AS (SELECT *, last_value(CASE WHEN is_set THEN {'ts': ts, 'value': value, 'ttl': ttl} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS held FROM e),
a AS (SELECT key, ts, seq, held, held IS NOT NULL AND (coalesce(held.ttl, 0) = 0 OR epoch_us(ts) - epoch_us(held.ts) < held.ttl * 1000000) AS hit FROM h WHERE NOT is_set)
SELECT key, seq, hit, CASE WHEN hit THEN held.value END AS value FROM a""")
def cache_answers(spark, sf_dir):
    """Calls of a cache with times to live; ``streaming.cache`` has the same as a stream with keyed state."""
    is_set, kind = F.col("event_id") % 3 == 0, F.col("event_id") % 9
    ttl = F.when(kind == 0, F.lit(None)).when(kind == 3, 0.0).otherwise(F.col("value") * 3600)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(is_set, "set").otherwise("get").alias("op"), F.when(is_set, F.col("event_type")).alias("value"), ttl.alias("ttl_s"))
    return cache.answers(rows).drop("ts")


# ---- store and delivery -------------------------------------------------------------------------------------------


def _store(spark, name: str, buckets: int = 16) -> store.ChunkStore:
    """A store of its own under the shared folder."""
    return store.ChunkStore(spark, new_folder(spark, name), "doc_id", buckets)


@query("k1_store", """
WITH n AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000 END AS doc_id, source || '*' AS source FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, source FROM n""")
def stored(spark, sf_dir):
    """All documents put into a store, then a third of them again, half of these under new ids; twice, as a batch that is tried again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1000000)).alias("doc_id"), F.concat("source", F.lit("*")).alias("source"))
    s = _store(spark, "store")
    s.upsert(docs)
    for _ in range(2):
        s.upsert(new)
    return s.read().select("doc_id", "source")


@query("k4_delete", "SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' OR source IS NULL GROUP BY source")
def delete(spark, sf_dir):
    """K4: a source deleted from a store."""
    s = _store(spark, "delete")
    s.overwrite(table(spark, sf_dir, "documents").select("doc_id", "source"))
    s.delete(F.col("source") == "src0")
    return s.read().groupBy("source").agg(F.count("*").alias("n"))


def refuse(part) -> None:
    """Stand-in for a service that takes no batch with an order divisible by 97."""
    if (part["o_orderkey"] % 97 == 0).any():
        raise ValueError("order refused")


@query("k2_delivery", "SELECT o_orderkey % 97 <> 0 AS stored, CASE WHEN o_orderkey % 97 = 0 THEN 'order refused' END AS error, count(*) AS n FROM orders GROUP BY ALL")
def delivery(spark, sf_dir):
    """K2: batches that a service refuses are halved until the bad rows stand alone."""
    sent = store.deliver(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", refuse, 1000)
    return sent.groupBy("stored", "error").agg(F.count("*").alias("n"))
