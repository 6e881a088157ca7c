"""One query per operator of the survey on the driver's tables, with the SQL that DuckDB runs for the same rows.

Structured chunks are derived from lineitem, orders and part by SQL that both engines read alike (CHUNKS, STATUTES).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identity, text, vectors
from .operators import detect, evaluate, explore, pages, parse, quality, retrieve, schema_parse, split
from .plans import answer, ingest
from .sources import files, store
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Chunk-shaped rows, in SQL of both engines.
CHUNKS = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS chunk_id,
       l_orderkey AS doc_id, l_linenumber AS chunk_index,
       CASE WHEN l_partkey % 11 = 0 THEN 'N/A' WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 60 AS STRING) || CASE WHEN l_partkey % 7 = 0 THEN 'A' ELSE '' END END AS section_number,
       CAST(NULL AS STRING) AS rule_none,
       CASE WHEN l_partkey % 13 = 0 THEN CAST(l_partkey % 9 AS STRING) END AS rule,
       CASE WHEN l_partkey % 13 = 0 THEN 'rule' ELSE 'section' END AS type,
       CASE WHEN l_partkey % 13 = 0 THEN 'ORDER ' || l_returnflag END AS "order",
       CASE WHEN l_returnflag = 'N' THEN 'Unknown Chapter' ELSE 'CHAPTER ' || l_returnflag END AS chapter,
       'PART ' || l_linestatus AS part,
       CASE WHEN l_partkey % 13 = 0 THEN 'CHAPTER > ORDER ' || l_returnflag || ' > Rule ' || CAST(l_partkey % 9 AS STRING) ELSE 'CHAPTER > Section' END AS hierarchy_path,
       'Act ' || CAST(o_custkey % 25 AS STRING) AS doc_title, o_orderpriority AS doc_type,
       CASE WHEN l_partkey % 3 = 0 THEN 'BNS' ELSE 'CPC' END AS law_code, CAST(1900 + l_suppkey % 7 AS STRING) AS year,
       '/data/raw/' || CASE WHEN l_partkey % 3 = 0 THEN 'BNS_2023.pdf' ELSE 'CPC_1908.pdf' END AS source,
       CASE WHEN l_quantity < 5 THEN 'page ' || CAST(l_linenumber AS STRING)
            ELSE p_name || ' shall be read with ' || p_type || ', w.e.f. ' || p_brand || repeat(' and the schedule', CAST(l_linenumber AS INT)) END AS text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_views(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """``query`` over the tables that it names between blanks; nothing is left registered."""
    used = [t for t in TABLES if f" {t} " in query.replace("\n", " ") + " "]
    named = query
    for t in used:
        named = named.replace(f" {t} ", " {" + t + "} ").replace(f" {t}\n", " {" + t + "}\n")
    return spark.sql(named.replace('"', "`"), **{t: table(spark, sf_dir, t) for t in used})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_views(spark, sf_dir, CHUNKS + " ").drop("rule_none")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, with_chunks: bool = False):
    """Register a query; ``oracle`` may read c, the derived chunks."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"WITH c AS ({CHUNKS})\n{oracle}" if with_chunks else oracle
        return f

    return register


# ---- retrieval ----------------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f"""
words AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS n FROM words),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM words) GROUP BY ALL),
stat AS (SELECT count(*) AS nd, avg(n) AS mean FROM dl),
df AS (SELECT token, ln(any_value(nd) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stat GROUP BY token),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
asked AS (SELECT item_id AS qid, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, doc_id AS chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score
           FROM asked JOIN post USING (token) JOIN idf USING (token) JOIN dl USING (doc_id), stat GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE score > 0),
lexical AS (SELECT qid, rank, chunk_id, score FROM ranked WHERE rank <= 20)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.stored_index(table(spark, sf_dir, "documents"), "doc_id")
    return retrieve.bm25_top(index, _questions(spark, sf_dir), 20)


@query("v2_v4_bm25_top20", f"WITH {_BM25} SELECT qid, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM lexical")
def bm25(spark, sf_dir):
    """BM25 of benchmark passages over documents, 20 best."""
    return _lexical(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("a16_lexical_accuracy", f"""WITH {_BM25},
hit AS (SELECT l.qid, min(CASE WHEN contains(d.text, b.text) THEN rank END) AS first_hit, avg(contains(d.text, b.text)::INT) AS p
        FROM lexical l JOIN documents d ON d.doc_id = l.chunk_id JOIN benchmark b ON b.item_id = l.qid GROUP BY l.qid)
SELECT count(*) AS n_queries, avg((coalesce(first_hit, 999) <= 1)::INT) AS top1, avg((coalesce(first_hit, 999) <= 3)::INT) AS top3,
       avg((coalesce(first_hit, 999) <= 10)::INT) AS top10, avg((coalesce(first_hit, 999) <= 20)::INT) AS top20, round(avg(p), 9) AS mean_precision, round(avg(coalesce(1.0 / first_hit, 0)), 9) AS mrr FROM hit""")
def lexical_accuracy(spark, sf_dir):
    """A document is relevant if it holds the passage; judged on the ranked pairs only."""
    ranked = _lexical(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = ranked.join(docs, "chunk_id").join(_questions(spark, sf_dir), "qid").withColumn("hit", F.contains("text", "question"))
    out = evaluate.accuracy(evaluate.per_query(hits.select("qid", "rank", "hit")))
    return out.withColumn("mean_precision", F.round("mean_precision", 9)).withColumn("mrr", F.round("mrr", 9))


_DENSE = """
q AS (SELECT vec_id AS qid, embedding AS v, label FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id AS chunk_id, list_sum(list_transform(list_zip(embedding, v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score, q.label AS ql, e.label AS el
      FROM embeddings e, q WHERE vec_id <> qid),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, chunk_id) AS rank FROM d QUALIFY rank <= 20)"""


def _dense(spark: SparkSession, sf_dir: str, metric: str = "l2") -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    q = e.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    return retrieve.dense_top(e, q, 20, metric, exclude_self=True)


@query("v1_dense_top20", f"WITH {_DENSE} SELECT qid, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM dense")
def dense(spark, sf_dir):
    """Exact nearest neighbours by squared L2."""
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("a22_dense_breakdown", f"""WITH {_DENSE},
per AS (SELECT qid, any_value(ql) AS label, min(CASE WHEN ql = el THEN rank END) AS first_hit FROM dense GROUP BY qid)
SELECT label, count_if(coalesce(first_hit, 99) <= 3)::BIGINT AS passed, count_if(coalesce(first_hit, 99) > 3)::BIGINT AS failed, count(*) AS total FROM per GROUP BY ROLLUP (label)""")
def dense_breakdown(spark, sf_dir):
    """Passed if a vector of the same label is among the first three; by label and overall."""
    e = table(spark, sf_dir, "embeddings")
    labels = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
    hits = _dense(spark, sf_dir).join(labels("qid"), "qid").join(labels("chunk_id"), "chunk_id").withColumn("hit", F.col("qid_label") == F.col("chunk_id_label"))
    per = evaluate.per_query(hits.withColumnRenamed("qid_label", "label"), ("qid", "label"))
    return evaluate.breakdown(per.withColumn("passed", F.coalesce(F.col("first_hit") <= 3, F.lit(False))), "label")


@query("a23_compare_metrics", f"""WITH {_DENSE},
d2 AS (SELECT qid, vec_id AS chunk_id, list_sum(list_transform(list_zip(embedding, v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS s, q.label AS ql, e.label AS el FROM embeddings e, q WHERE vec_id <> qid),
ip AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS rank FROM d2 QUALIFY rank <= 20),
a AS (SELECT qid, min(CASE WHEN ql = el THEN rank END) AS x FROM dense GROUP BY qid), b AS (SELECT qid, min(CASE WHEN ql = el THEN rank END) AS y FROM ip GROUP BY qid)
SELECT count_if(coalesce(y, 99) < coalesce(x, 99))::BIGINT AS wins, count_if(coalesce(y, 99) > coalesce(x, 99))::BIGINT AS losses, count_if(coalesce(y, 99) = coalesce(x, 99))::BIGINT AS ties FROM a JOIN b USING (qid)""")
def compare_metrics(spark, sf_dir):
    """First hits by squared L2 against inner product."""
    e = table(spark, sf_dir, "embeddings")

    def first(metric):
        labels = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
        return evaluate.per_query(_dense(spark, sf_dir, metric).join(labels("qid"), "qid").join(labels("chunk_id"), "chunk_id").withColumn("hit", F.col("qid_label") == F.col("chunk_id_label")))

    return evaluate.compare(first("l2"), first("ip"))


@query("v5_fusion", f"""WITH {_BM25},
near AS (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score
         FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings e),
other AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score, chunk_id) AS rank FROM near),
w AS (SELECT item_id AS qid, CASE WHEN regexp_matches(text, '(?i)(section\\s+\\d+[A-Z]?|order\\s+[IVXLCDM]+)') THEN 0.3 ELSE 0.5 END AS wd FROM benchmark),
f AS (SELECT coalesce(o.qid, l.qid) AS qid, coalesce(o.chunk_id, l.chunk_id) AS chunk_id, o.rank AS dense_rank, l.rank AS bm25_rank
      FROM (SELECT * FROM other WHERE rank <= 12) o FULL JOIN (SELECT * FROM lexical WHERE rank <= 12) l ON o.qid = l.qid AND o.chunk_id = l.chunk_id),
s AS (SELECT f.*, coalesce(wd / (60 + dense_rank), 0) + coalesce((1 - wd) / (60 + bm25_rank), 0) AS score FROM f JOIN w USING (qid))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST)::INT AS rank, chunk_id, round(score, 9) AS score,
       dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank FROM s QUALIFY rank <= 20""")
def fusion(spark, sf_dir):
    """The 12 best by BM25, and the 12 vectors nearest to that of the passage's number, fused by weighted reciprocal ranks."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.join(_questions(spark, sf_dir), F.col("chunk_id") == F.col("qid")).select("qid", F.col("embedding").alias("vector"))
    out = retrieve.fuse(retrieve.dense_top(e, asked, 12), _lexical(spark, sf_dir).where("rank <= 12"), _questions(spark, sf_dir), 20)
    return out.withColumn("score", F.round("score", 9))


@query("v8_expansion_union", f"""WITH {_BM25},
r AS (SELECT qid // 2 AS qid, qid % 2 AS rewrite_no, rank, chunk_id FROM lexical WHERE rank <= 5),
f AS (SELECT qid, chunk_id, min((rewrite_no, rank)) AS seen FROM r GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seen)::INT AS rank, chunk_id FROM f""")
def expansion_union(spark, sf_dir):
    """V8: neighbouring passages as rewrites of one question; each result once, where it is seen first."""
    ranked = _lexical(spark, sf_dir).where("rank <= 5").select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).alias("rewrite_no"), "rank", "chunk_id")
    return retrieve.union_expansions(ranked)


@query("v9_rerank", f"""WITH {_BM25},
w AS (SELECT item_id AS qid, text AS question, list_distinct({_TOKENS.format("text")}) AS qw FROM benchmark), d AS (SELECT doc_id AS chunk_id, text, list_distinct({_TOKENS.format("text")}) AS dw FROM documents),
s AS (SELECT l.qid, l.rank, question, d.text, len(list_intersect(qw, dw)) AS hits FROM lexical l JOIN w USING (qid) JOIN d USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, rank) AS place FROM s)
SELECT w.qid, count(r.qid)::INT AS n_context, (any_value(length('Answer from the context only.') + 2 + 2 + length('Question: ') + length(w.question)) + coalesce(sum(length(r.text)) + 2 * (count(r.qid) - 1), 0))::INT AS prompt_chars
FROM w LEFT JOIN r ON r.qid = w.qid AND place <= 5 GROUP BY w.qid""")
def reranked(spark, sf_dir):
    """Rerank the 20 lexical results by a pluggable scorer, stuff the five best into a prompt."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    best = retrieve.rerank(_lexical(spark, sf_dir).join(docs, "chunk_id").join(_questions(spark, sf_dir), "qid"), retrieve.overlap_scorer)
    return answer.prompts(best, _questions(spark, sf_dir)).select("qid", F.size("context").alias("n_context"), F.length("prompt").alias("prompt_chars"))


@query("v13_embedding")
def embedding(spark, sf_dir):
    """Documents through a pluggable embedding model, nearest to each passage."""
    docs = retrieve.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), retrieve.hashed_embedding)
    asked = retrieve.embed(_questions(spark, sf_dir), retrieve.hashed_embedding, "question").withColumnRenamed("embedding", "vector")
    return retrieve.dense_top(docs, asked, 3, "cosine").withColumn("score", F.round("score", 6))


@query("v12_cache_misses", """
WITH q AS (SELECT conv_id AS session, turn, text AS question, 'llm_cache:' || sha256(conv_id::VARCHAR || ':' || text) AS key FROM conversations WHERE role = 'user')
SELECT session, turn, key, turn % 3 = 0 AS hit FROM (SELECT session, turn, key, turn FROM q) t""")
def cache_misses(spark, sf_dir):
    """Cache keys; what the cache of every third turn answers, and what is left by an anti-join."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), F.col("conv_id").cast("string").alias("session"), F.col("conv_id"), "turn", F.col("text").alias("question"))
    have = q.where("turn % 3 = 0").select(F.concat(answer.cache_key(F.col("session"), F.col("question")), F.lit("/"), "qid").alias("key"), F.lit("x").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    cache = have.withColumn("key", F.regexp_extract("key", r"^([^/]+)/", 1)).dropDuplicates(["key"])
    hits, misses = answer.split_by_cache(q, cache)
    both = hits.select("conv_id", "turn", "key", F.lit(True).alias("hit")).union(misses.select("conv_id", "turn", "key", F.lit(False).alias("hit")))
    return both.select(F.col("conv_id").alias("session"), "turn", "key", "hit")


# ---- text ---------------------------------------------------------------------------------------------------------


@query("t10_tokens", f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n_tokens, len(list_distinct({_TOKENS.format('text')}))::INT AS n_terms FROM documents")
def token_counts(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@query("t4_clean_text", r"""
WITH a AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, chr(249), ' '), chr(61623), ' '), chr(8211), '-'), chr(8212), '--'), chr(8217), ''''), chr(8220), '"'), chr(8221), '"') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\n\s*\d{1,4}\s*\n', chr(10), 'g'), '_+', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?im)^.*THE GAZETTE OF INDIA.*$', '', 'g'), '(?im)^.*MINISTRY OF LAW AND JUSTICE.*$', '', 'g'), '(?i)SEC\.\s*\d+[A-Z]?(\(\w+\))?\]?', '', 'g') AS t FROM b)
SELECT page_id, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS n, sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS sha FROM d""")
def cleaned(spark, sf_dir):
    """T4: cleaning chain on pages, which hold no embedded footnotes (those need look-ahead, which the other engine lacks)."""
    t = text.clean_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha"))


@query("t5_filter_blank", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\n\s*\d{1,4}\s*\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS sha FROM documents")
def blank_filtered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.filter_blank(F.col("text")), 256).alias("sha"))


@query("t11_footer_leaks", r"""SELECT doc_id, chunk_index, regexp_matches(text, '(?i)(Subs\.|Ins\.|Omitted|w\.e\.f\.|ibid\.|A\.O\.|Rep\.)') AS leak,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)(Subs\.|Ins\.|Omitted|w\.e\.f\.|ibid\.|A\.O\.|Rep\.)')))::INT AS n_lines FROM c""", True)
def footer_leaks(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", text.has_footer_leak(F.col("text")).alias("leak"), F.size(text.leaking_lines(F.col("text"))).alias("n_lines"))


@query("t12_html_escape", "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS sha FROM pages")
def escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("sha"))


@query("t13_t15_sections", r"""
, s AS (SELECT chunk_id, section_number, 'Section ' || coalesce(section_number, 'x') || ': text, Section 7: end' AS t FROM c)
SELECT chunk_id, list_sort(list_distinct(regexp_extract_all(t, 'Section (\d+[A-Z]?):', 1))) AS mentions,
       coalesce(nullif(regexp_extract(section_number, '(\d+)', 1), ''), trim(replace(replace(lower(section_number), 'section', ''), ' ', ''))) AS base,
       regexp_matches(t, '(?i)(section\s+\d+[A-Z]?|order\s+[IVXLCDM]+)') AS specific FROM s""", True)
def sections(spark, sf_dir):
    t = F.concat(F.lit("Section "), F.coalesce("section_number", F.lit("x")), F.lit(": text, Section 7: end"))
    return chunks(spark, sf_dir).select("chunk_id", F.array_sort(text.section_mentions(t)).alias("mentions"), text.base_section(F.col("section_number")).alias("base"), text.is_specific_query(t).alias("specific"))


@query("t16_t18_titles", r"""SELECT doc_id, 'BNS' AS law_code, '2023' AS law_year, 'BNS 2023 ' || (doc_id % 9)::VARCHAR AS title_from_path,
 coalesce(list_filter(list_transform(string_split(left(text, 500), chr(10)), lambda x: trim(x)), lambda x: length(x) > 10)[1], 'Unknown Document') AS title FROM documents""")
def titles(spark, sf_dir):
    path = F.concat(F.lit("/data/raw/BNS_2023_"), (F.col("doc_id") % 9).cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", text.law_code(path).alias("law_code"), text.law_year(path).alias("law_year"), text.title_from_path(path).alias("title_from_path"), text.document_title(F.col("text")).alias("title"))


@query("t19_json", """SELECT event_id, json_extract_string(props, '$.page') AS page, regexp_extract('note ' || props || ' end', '(?s)(\\{.*\\})', 1) AS body FROM events""")
def json_bodies(spark, sf_dir):
    body = text.json_object(F.concat(F.lit("note "), F.col("props"), F.lit(" end")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.page").alias("page"), body.alias("body"))


@query("p23_p24_ids", r"""
, n AS (SELECT *, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g') AS norm, regexp_replace(regexp_replace(lower(left(text, 120)), '\s+', ' ', 'g'), '^ | $', '', 'g') AS head FROM c)
SELECT chunk_id AS source_key, left(sha256(concat_ws('|', doc_title, coalesce(section_number, ''), chunk_index::VARCHAR, '', '0', head)), 32) AS chunk_id,
       left(sha256(norm), 16) AS text_hash, left(coalesce(section_number, 'N/A'), 500) AS section FROM n""", True)
def ids(spark, sf_dir):
    """P22-P24, T9 (ASCII texts)."""
    missing = F.lit(None).cast("string")
    c = chunks(spark, sf_dir)
    key = identity.chunk_id(F.col("doc_title"), F.col("section_number"), F.col("chunk_index"), missing, F.lit("0"), F.col("text"))
    return c.select(F.col("chunk_id").alias("source_key"), key.alias("chunk_id"), identity.text_hash(F.col("text")).alias("text_hash"), identity.sanitised(F.col("section_number")).alias("section"))


@query("t9_normalised_hash")
def normalised(spark, sf_dir):
    """T9, P24 on all documents, with compatibility decomposition."""
    return table(spark, sf_dir, "documents").select("doc_id", identity.text_hash(F.col("text")).alias("text_hash"))


# ---- pages --------------------------------------------------------------------------------------------------------

#: Documents of some fifty orders each, so that they grow in number with the table and not in size.
_LINES = """SELECT CAST(l_orderkey - l_orderkey % 50 AS STRING) AS doc_id, CAST(l_suppkey % 10 AS INT) AS page_num, l_orderkey * 10 + l_linenumber AS line_no, CAST(l_quantity * 16 AS DOUBLE) AS y0,
 CASE WHEN l_linenumber = 7 THEN '3. Subs. by Act' WHEN l_linenumber = 6 THEN '* Omitted' ELSE 'line ' || CAST(l_linenumber AS STRING) END AS text, CAST(5 + l_discount * 100 AS DOUBLE) AS size FROM lineitem """
_DRAWINGS = """SELECT CAST(o_orderkey - o_orderkey % 50 AS STRING) AS doc_id, CAST(o_custkey % 10 AS INT) AS page_num, CAST(200 + o_orderkey % 600 AS DOUBLE) AS y0, CAST(200 + o_orderkey % 600 AS DOUBLE) + 1 AS y1,
 CAST(o_custkey % 400 AS DOUBLE) AS width, 600.0D AS page_width, 800.0D AS page_height FROM orders """
_DUCK_DRAWINGS = _DRAWINGS.replace("600.0D", "600.0").replace("800.0D", "800.0")
_SEPARATORS = f"""draw AS ({_DUCK_DRAWINGS}), sep AS (SELECT doc_id, page_num, min(y0) AS sep_y FROM draw WHERE abs(y0 - y1) < 2 AND width > 50 AND y0 > page_height * 0.3 AND width < page_width * 0.45 GROUP BY ALL HAVING count(*) <= 2)"""


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_views(spark, sf_dir, _LINES)
    return rows.select("doc_id", "page_num", "line_no", "y0", F.array(F.struct("text", "size")).alias("spans"))


@query("t1_separators", f"WITH {_SEPARATORS} SELECT * FROM sep")
def separators(spark, sf_dir):
    return pages.separators(_with_views(spark, sf_dir, _DRAWINGS))


@query("t2_t3_footers", f"""WITH {_SEPARATORS}, l AS ({_LINES}),
cut AS (SELECT doc_id, page_num, line_no, CASE WHEN size >= 8 THEN text ELSE '' END AS text FROM l LEFT JOIN sep USING (doc_id, page_num) WHERE sep_y IS NULL OR y0 < sep_y),
m AS (SELECT *, max(CASE WHEN NOT (trim(text) = '' OR (regexp_matches(trim(text), '^\\d{{1,2}}\\.\\s') AND regexp_matches(text, '(?i)Subs\\.|Omitted')) OR (starts_with(trim(text), '*') AND regexp_matches(text, '(?i)Subs\\.|Omitted'))) THEN line_no END)
      OVER (PARTITION BY doc_id, page_num) AS last FROM cut)
SELECT doc_id, page_num, count(*) AS n_lines, max(line_no) AS last_line, sha256(string_agg(text, chr(10) ORDER BY line_no, text)) AS sha FROM m WHERE line_no <= last GROUP BY ALL""")
def footers(spark, sf_dir):
    """Footer rules, small spans, trailing footnotes; the page's text as a hash."""
    lines = pages.cut_footers(_page_lines(spark, sf_dir), pages.separators(_with_views(spark, sf_dir, _DRAWINGS)))
    kept = pages.strip_trailing_footnotes(lines)
    n = kept.groupBy("doc_id", "page_num").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"))
    return n.join(pages.page_text(kept).withColumn("sha", F.sha2("text", 256)).drop("text"), ["doc_id", "page_num"])


@query("s5_page_ranges", """WITH r(name, a, b) AS (VALUES ('one', 0, 2), ('two', 3, 3), ('three', 4, 8)) SELECT name, count(*) AS n_lines, min(page_num)::INT AS first, max(page_num)::INT AS last
 FROM (SELECT l_suppkey % 10 AS page_num FROM lineitem) l JOIN r ON page_num BETWEEN a AND b GROUP BY name""")
def page_ranges(spark, sf_dir):
    """Range join of pages with a compendium's parts."""
    ranges = spark.createDataFrame([("one", 0, 2), ("two", 3, 3), ("three", 4, 8)], "name string, first_page int, last_page int")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("page_num"))
    return pages.slice_pages(rows, ranges).groupBy("name").agg(F.count("*").alias("n_lines"), F.min("page_num").alias("first"), F.max("page_num").alias("last"))


@query("s8_urls", r"""SELECT page_id, regexp_matches(lower(url), '\.pdf(?:$|\?)|pdf') AS is_pdf, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)', 1), ''), 'download.pdf') AS file_name FROM pages""")
def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.is_pdf_url(F.col("url")).alias("is_pdf"), files.url_file_name(F.col("url")).alias("file_name"))


# ---- statutes: detection and parsing ------------------------------------------------------------------------------

#: One statute per order, in both engines' SQL: a title, a chapter for each return flag, a section per line.
_STATUTE_LINES = """SELECT l_orderkey AS doc_id, l_linenumber AS n, p_partkey AS k,
 CASE WHEN l_returnflag = 'R' THEN CHR(10) || 'CHAPTER ' || CASE WHEN l_linenumber % 2 = 0 THEN 'II' ELSE 'IV' END || CHR(10) || 'OF ' || upper(l_shipmode_) || CHR(10) ELSE '' END
 || CHR(10) || CAST(l_linenumber AS STRING) || '. Of ' || p_name || '.' || CHR(10) || 'Whoever shall mean ' || p_type || ' notwithstanding ' || p_brand || CHR(10) AS line
 FROM (SELECT *, l_linestatus || ' matters' AS l_shipmode_ FROM lineitem ) l JOIN part ON l_partkey = p_partkey """
_TITLE = "'THE ' || CASE WHEN doc_id % 3 = 0 THEN 'GAZETTE OF INDIA' ELSE 'LAND' END || CHR(10) || 'THE LAND REVENUE ACT, 1967' || CHR(10) || CASE WHEN doc_id % 2 = 0 THEN 'Be it enacted by' ELSE 'In exercise of the powers conferred' END"


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _with_views(spark, sf_dir, _STATUTE_LINES)
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "line"))), lambda r: r["line"]), "").alias("body"))
    return whole.select("doc_id", F.concat(F.expr(_TITLE), "body").alias("text"))


_STATUTES = f"l AS ({_STATUTE_LINES}), st AS (SELECT doc_id, {_TITLE} || string_agg(line, '' ORDER BY n, k, line) AS text FROM l GROUP BY doc_id)"


def _duck(pattern: str, ignore_case: bool = True) -> str:
    flags = "(?im)" if ignore_case else "(?m)"
    return f"regexp_matches(text, '{flags}{pattern.replace('(?m)', '').replace(chr(39), chr(39) * 2)}')"


def _score_sql(doc_type: str) -> str:
    """The template score of a window in SQL, from the same rules."""
    own = [r for r in detect.rules() if r[0] == doc_type]
    def share(kind):
        rows = [(p, w) for _, k, p, w in own if k == kind]
        return "(" + " + ".join(f"(CASE WHEN {_duck(p)} THEN {w} ELSE 0 END)" for p, w in rows) + f") / {sum(w for _, w in rows)}"
    anti = [_duck(p) for _, k, p, _ in own if k == "anti"]
    mean = f"({share('title')} + {share('structure')} + {share('tail')}) / 3.0"
    return f"CASE WHEN {' OR '.join(anti)} THEN 0.0 ELSE {mean} END" if anti else mean


@query("r4_template_scores", f"WITH {_STATUTES} SELECT doc_id, " + ", ".join(f"round({_score_sql(t)}, 9) AS {t.lower()}" for t in detect.TYPES) + " FROM st")
def template_scores(spark, sf_dir):
    """Marker templates over one window, which is the whole short statute."""
    return detect.with_template_scores(statutes(spark, sf_dir)).select("doc_id", *[F.round(t, 9).alias(t.lower()) for t in detect.TYPES])


@query("r9_features", f"""WITH {_STATUTES} SELECT doc_id, {_duck(r'CHAPTER\s+[IVXLCDM]+')} AS has_chapters, {_duck(r'PART\s+[IVXLCDM]+')} AS has_parts,
 len(regexp_extract_all(text, '\\n\\s*\\d{{1,3}}[A-Z]?\\.\\s'))::INT AS section_count, length(text)::INT AS char_count FROM st""")
def features(spark, sf_dir):
    f = detect.features(F.col("text"))
    return statutes(spark, sf_dir).select("doc_id", *[f[c].alias(c) for c in ("has_chapters", "has_parts", "section_count", "char_count")])


@query("r8_detect")
def detected(spark, sf_dir):
    """Windows, scores, penalties and boosts, type, strategy and section pattern."""
    return ingest.detected(statutes(spark, sf_dir)).select("doc_id", "doc_type", F.round("confidence", 9).alias("confidence"), "strategy", "section_pattern")


_ACTS = """SELECT o_custkey AS doc_id, o_orderkey AS n, CHR(10) || 'THE ' || CASE o_orderstatus WHEN 'F' THEN 'LAND REVENUE' WHEN 'O' THEN 'COURTS, FEES' ELSE 'PUBLIC-ROADS' END || ' ACT, 19' || CAST(10 + o_orderkey % 90 AS STRING) || CHR(10) || '1. Of order '
 || CAST(o_orderkey AS STRING) || '.' || CHR(10) AS act FROM orders WHERE o_orderkey % 3 > 0 """


def _types_sql() -> str:
    """Types of short statutes, of which all windows are the whole: template scores, profiles, penalties and boosts in turn, in SQL."""
    has = lambda p: _duck(p)
    exactly = lambda p: _duck(p, False)
    score = {t: _score_sql(t) for t in detect.TYPES}
    for t, own in detect.PROFILES.items():
        n = " + ".join(f"({has(p)})::INT" for p in own["signs"])
        whole = f" + CASE WHEN {' OR '.join(has(p) for p in own['whole'])} THEN {own['bonus']} ELSE 0 END" if own["whole"] else ""
        profile = f"CASE WHEN {n} > 0 THEN least(1.0, ({n}) / {float(len(own['signs']))}{whole}) ELSE 0.0 END"
        if own["anti"]:
            profile = f"CASE WHEN {' OR '.join(has(p) for p in own['anti'])} THEN 0.0 ELSE {profile} END"
        score[t] = f"CASE WHEN {score[t]} < 0.10 THEN greatest({score[t]}, 0.5 * {profile}) ELSE {score[t]} END"
    facts = {
        "gazette": has(detect.GAZETTE), "sections": exactly(detect.SECTION_LINE), "rule_lines": has(detect.RULE_LINE), "chapters": has(detect.CHAPTER_LINE), "parts": has(detect.PART_LINE), "notes": exactly(detect.ANNOTATION),
        "orders": exactly(detect.ORDER_LINE), "enacted": has(detect.ENACTED), "act_title": has(detect.ACT_TITLE), "rules_title": has(detect.RULES_TITLE), "exercise": has(detect.IN_EXERCISE),
        "forms": has(detect.FORMS),
        "titles": "len(list_distinct(list_transform(regexp_extract_all(text, '(?im)" + detect.ACT_OR_CODE_TITLE.replace("(?m)", "").replace("'", "''") + "'), lambda x: upper(trim(x)))))",
    }
    changes = [
        ("COMPENDIUM", "titles < 2", -0.80), ("GAZETTE_ACT", "gazette AND NOT sections", -0.25), ("BARE_ACT", "act_title AND NOT chapters AND NOT parts", -0.25), ("SCHEDULE_RULES", "rules_title AND NOT rule_lines AND NOT orders", -0.25),
        ("GAZETTE_ACT", "gazette AND enacted AND sections", 0.20), ("CODIFIED_ACT", "notes AND chapters", 0.20), ("CODIFIED_ACT", "notes AND NOT chapters", 0.06), ("SCHEDULE_RULES", "exercise", 0.12),
        ("SCHEDULE_RULES", "forms AND (rule_lines OR orders)", 0.12), ("BARE_ACT", "chapters AND sections AND NOT notes AND NOT gazette", 0.06),
    ]
    final = {t: t.lower() for t in detect.TYPES}
    for t, when, by in changes:
        final[t] = f"CASE WHEN {when} THEN greatest(0.0, least(1.0, {final[t]} + {by})) ELSE {final[t]} END"
    best = "greatest(" + ", ".join(f"f{t.lower()}" for t in detect.TYPES) + ")"
    kind = "CASE " + " ".join(f"WHEN f{t.lower()} = {best} THEN '{t}'" for t in detect.TYPES) + " END"
    return f"""sc AS (SELECT doc_id, {", ".join(f"({q})::DOUBLE AS {t.lower()}" for t, q in score.items())}, {", ".join(f"{q} AS {k}" for k, q in facts.items())} FROM st),
fi AS (SELECT doc_id, {", ".join(f"({q})::DOUBLE AS f{t.lower()}" for t, q in final.items())} FROM sc)
SELECT doc_id, CASE WHEN {best} > 0 THEN {kind} ELSE 'GENERIC' END AS doc_type, round(least({best}, 1.0), 9) AS confidence, CASE WHEN {best} >= 0.60 THEN 'REGEX' WHEN {best} >= 0.30 THEN 'HYBRID' ELSE 'SCHEMA' END AS strategy FROM fi"""


@query("r8_types", f"WITH {_STATUTES}, {_types_sql()}")
def types(spark, sf_dir):
    """Type, confidence and strategy of short statutes."""
    found = detect.detect(statutes(spark, sf_dir))
    return found.select("doc_id", "doc_type", F.round("confidence", 9).alias("confidence"), detect.strategy(F.col("confidence")).alias("strategy"))


@query("r10_segments", f"""WITH a AS ({_ACTS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place, count(*) OVER (PARTITION BY doc_id) AS acts FROM a),
t AS (SELECT doc_id, (place - 1)::INT AS segment_index, CASE WHEN acts = 1 THEN 'A table of contents' || act ELSE trim(act, chr(10)) END AS text FROM k)
SELECT doc_id, segment_index, regexp_extract(text, '(THE [^\\n]*ACT, \\d{{4}})', 1) AS title, sha256(text) AS sha FROM t""")
def segments(spark, sf_dir):
    """A customer's acts in one text are a segment each; a single act is the whole text."""
    acts = _with_views(spark, sf_dir, _ACTS)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "act"))), lambda x: x["act"]), "")
    docs = acts.groupBy("doc_id").agg(F.concat(F.lit("A table of contents"), body).alias("text"))
    return detect.segments(docs).select("doc_id", "segment_index", "title", F.sha2("text", 256).alias("sha"))


_CHAPTER_OF = "CASE WHEN l_returnflag = 'R' THEN 'CHAPTER ' || CASE WHEN l_linenumber % 2 = 0 THEN 'II' ELSE 'IV' END || ' - OF ' || upper(l_linestatus || ' matters') END"


@query("p1_p6_parse", f"""WITH {_STATUTES}, h AS (SELECT *, CASE WHEN contains(line, 'CHAPTER ') THEN regexp_extract(line, '(CHAPTER [IV]+)', 1) || ' - ' || regexp_extract(line, '\\n(OF [^\\n]*)\\n', 1) END AS head FROM l),
c AS (SELECT doc_id, 1 + row_number() OVER w AS chunk_index, 'section' AS type, n::VARCHAR AS section_number, regexp_extract(line, '[0-9]+\\. (Of [^\\n]*)\\.\\n', 1) AS section_title,
  coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n, k, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING), 'Unknown Chapter') AS chapter, regexp_extract(line, '(Whoever[^\\n]*)', 1) AS content
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n, k, line)
  UNION ALL SELECT doc_id, 1, 'raw', 'N/A', 'N/A', coalesce(head, 'Unknown Chapter'), {_TITLE} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, k, line) AS place FROM h) WHERE place = 1)
SELECT doc_id, chunk_index::INT AS chunk_index, type, section_number, section_title, chapter,
 length('[Act] [' || chapter || ']' || CASE WHEN type = 'section' THEN ' Section ' || section_number || ' — ' || section_title ELSE '' END || chr(10) || content)::INT AS chars FROM c""")
def parsed(spark, sf_dir):
    """Section chunks with their running chapters."""
    docs = statutes(spark, sf_dir).withColumn("doc_title", F.lit("Act")).withColumn("doc_type", F.lit("BARE_ACT"))
    return parse.parse(docs, detect.SECTION_PATTERNS[1]).select("doc_id", "chunk_index", "type", "section_number", "section_title", "chapter", F.length("text").alias("chars"))


@query("p7_schema_parse", f"""WITH {_STATUTES}, h AS (SELECT *, CASE WHEN contains(line, 'CHAPTER ') THEN regexp_extract(line, '(CHAPTER [IV]+)', 1) || ' - ' || regexp_extract(line, '\\n(OF [^\\n]*)\\n', 1) END AS head FROM l),
c AS (SELECT doc_id, 1 + row_number() OVER w AS chunk_index, n::VARCHAR AS section_number, regexp_extract(line, '[0-9]+\\. (Of [^\\n]*)', 1) AS section_title,
  coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n, k, line ROWS UNBOUNDED PRECEDING), 'Unknown Chapter') AS chapter, regexp_extract(line, '(Whoever[^\\n]*)', 1) AS content
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n, k, line)
  UNION ALL SELECT DISTINCT doc_id, 1, 'N/A', '', 'Unknown Chapter', {_TITLE} FROM l)
SELECT doc_id, chunk_index::INT AS chunk_index, section_number, section_title, chapter, '[Act 1967] [' || chapter || '] Section ' || section_number || ' — ' || section_title || chr(10) || content AS text FROM c""")
def schema_parsed(spark, sf_dir):
    """Chunks by a schema of its own for each document."""
    docs = statutes(spark, sf_dir).withColumn("doc_title", F.lit("Act"))
    none = F.lit(None).cast("string")
    head = F.when(F.col("doc_id") % 2 == 0, F.lit(r"^(\d+)\.\s*([^\n]*)"))
    own = docs.select("doc_id", none.alias("section_pattern"), F.lit(r"(CHAPTER\s+[IVX]+)\s*\n+([^\n]*)").alias("chapter_pattern"), none.alias("part_pattern"), head.alias("title_extract_pattern"), F.lit("1967").alias("year"), none.alias("doc_type"))
    return schema_parse.parse_by_schema(docs, own).select("doc_id", "chunk_index", "section_number", "section_title", "chapter", "text")


@query("w1_running_state", f"""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey, l_suppkey, {_CHAPTER_OF} AS h FROM lineitem)
SELECT doc_id, pos, l_partkey AS k, l_suppkey AS k2, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 'Unknown Chapter') AS eager,
 coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Unknown Chapter') AS deferred FROM l""")
def running_state(spark, sf_dir):
    """Headings carried forward at once, or from the next block on."""
    own = Window.partitionBy("doc_id").orderBy("pos", "k", "k2")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("k2"), F.expr(_CHAPTER_OF).alias("h"))
    return rows.select("doc_id", "pos", "k", "k2", parse.running(F.col("h"), own, "Unknown Chapter").alias("eager"), parse.running(F.col("h"), own, "Unknown Chapter", True).alias("deferred"))


@query("p12_p14_split")
def split_documents(spark, sf_dir):
    """Documents split recursively, fragments merged, context lines on continuations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("chunk_index"), F.lit(None).cast("string").alias("section_number"), F.col("source").alias("section_title"), F.lit(None).cast("string").alias("chapter"), "text")
    return split.split_chunks(docs).select("doc_id", "sub_chunk", "total_chunks", "chunk_source_strategy", "chunk_char_length")


@query("p16_generic_chunks")
def generic(spark, sf_dir):
    """Plain windows under their title, never none."""
    return split.generic_chunks(table(spark, sf_dir, "documents").withColumn("doc_title", F.col("source"))).select("doc_id", "chunk_index", F.length("text").alias("chars"))


@query("p19_ingest")
def ingested(spark, sf_dir):
    """Statutes through detection, parse, routing, fallback, split, ids."""
    out = ingest.ingest(statutes(spark, sf_dir))
    return out.select("doc_id", "chunk_index", "sub_chunk", "fallback_tier", "section_number", "chunk_char_length")


# ---- quality ------------------------------------------------------------------------------------------------------

_ORDERED = "(PARTITION BY doc_id ORDER BY chunk_index, chunk_id)"
_METRICS = rf"""
v AS (SELECT *, length(text) AS n, row_number() OVER {_ORDERED} AS place,
  regexp_matches(coalesce(section_number, rule, 'N/A'), '(?i)^(\d{{1,3}}[A-Z]?|Rule\s+\d+[A-Z]?|ORDER\s+[IVXLCDM]+\s+RULE\s+\d+)$') AND coalesce(section_number, rule, 'N/A') NOT IN ('N/A', '', 'None', 'Unknown', '0', 'na', 'n/a') AS valid,
  regexp_matches(trim(text, E' \t\n\r'), '^(\d{{1,4}}|[\s_\-=]+|.{{1,25}})$') AS noisy,
  regexp_replace(regexp_replace(lower(left(text, 80)), '\s+', ' ', 'g'), '^ | $', '', 'g') AS prefix,
  try_cast(nullif(regexp_extract(coalesce(section_number, rule, ''), '^(\d+)', 1), '') AS BIGINT) AS num,
  (lag(chapter) OVER {_ORDERED} <> chapter) OR (lag(part) OVER {_ORDERED} <> part) OR
  (contains(hierarchy_path, 'ORDER') AND contains(lag(hierarchy_path) OVER {_ORDERED}, 'ORDER') AND hierarchy_path <> lag(hierarchy_path) OVER {_ORDERED}) AS reset FROM c),
s AS (SELECT *, sum(coalesce(reset, false)::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS seq FROM v WHERE num IS NOT NULL),
r AS (SELECT *, lag(num) OVER (PARTITION BY doc_id, seq ORDER BY place) AS before FROM s),
cont AS (SELECT doc_id, coalesce(avg(CASE WHEN before IS NOT NULL THEN (num >= before)::INT END), 0.5) AS continuity FROM r GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_chunks, least(sum(valid::INT) / count(*) * CASE WHEN sum(valid::INT) < 5 THEN 0.5 ELSE 1 END, 1.0) AS capture,
  greatest(avg((n BETWEEN 50 AND 3000)::INT) - CASE WHEN max(n) > 15000 THEN 0.7 WHEN max(n) > 8000 THEN 0.4 ELSE 0 END, 0) AS length,
  1 - avg(noisy::INT) AS noise, avg((NOT contains(chapter, 'Unknown'))::INT) AS coverage,
  CASE WHEN count(*) < 4 THEN 0 ELSE least((count(*) - count(DISTINCT prefix)) / count(*) * 0.5, 0.25) END AS duplicates FROM v GROUP BY doc_id),
q AS (SELECT m.*, coalesce(continuity, 0.5) AS continuity FROM m LEFT JOIN cont USING (doc_id)),
o AS (SELECT *, least(greatest(0.30 * capture + 0.20 * coverage + 0.25 * length + 0.15 * noise + 0.10 * continuity - duplicates, 0), 1) AS overall FROM q)"""


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the chunks, of which there is at most one a line; lines are counted from the files' footers."""
    return quality.parts_for(table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metrics(chunks(spark, sf_dir), order=("chunk_index", "chunk_id"), parts=_parts(spark, sf_dir))


@query("a1_a8_quality", f""", {_METRICS} SELECT doc_id, n_chunks, round(capture, 9) AS capture, round(length, 9) AS length, round(noise, 9) AS noise, round(coverage, 9) AS coverage, round(duplicates, 9) AS duplicates,
 round(continuity, 9) AS continuity, round(overall, 9) AS overall, CASE WHEN round(overall, 9) >= 0.85 THEN 'excellent' WHEN round(overall, 9) >= 0.7 THEN 'pass' WHEN round(overall, 9) >= 0.6 THEN 'near_pass' WHEN round(overall, 9) >= 0.45 THEN 'weak' ELSE 'fail' END AS band FROM o""", True)
def quality_metrics(spark, sf_dir):
    """The five metrics, penalty, composite and band per document."""
    m = _metrics(spark, sf_dir)
    numbers = ("capture", "length", "noise", "coverage", "duplicates", "continuity", "overall")
    m = m.select("doc_id", "n_chunks", *[F.round(c, 9).alias(c) for c in numbers])
    return m.withColumn("band", quality.band(F.col("overall")))


@query("a8_f12_gate", f""", {_METRICS} SELECT (round(overall, 9) >= 0.7) AS passed, (capture < 0.5 OR continuity < 0.45 OR length < 0.45 OR noise < 0.5) AS severe, count(*) AS documents FROM o GROUP BY ALL""", True)
def gate(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("overall", F.round("overall", 9))
    return quality.passes(m).groupBy("passed", quality.is_severe().alias("severe")).agg(F.count("*").alias("documents"))


@query("a9_failures", f""", {_METRICS} SELECT doc_id, n_chunks AS total, (SELECT count(*) FROM v WHERE v.doc_id = o.doc_id AND coalesce(section_number, 'N/A') = 'N/A') AS n_unnumbered,
 (SELECT count(*) FROM v WHERE v.doc_id = o.doc_id AND n < 50) AS n_short, (capture < 0.5)::INT + (length < 0.5)::INT + (noise < 0.5)::INT + (continuity < 0.4)::INT + (coverage < 0.3)::INT AS n_issues FROM o""", True)
def failures(spark, sf_dir):
    c = chunks(spark, sf_dir)
    out = quality.failure_report(c, _metrics(spark, sf_dir), parts=_parts(spark, sf_dir))
    return out.select("doc_id", "total", "n_unnumbered", "n_short", F.size("issues").alias("n_issues"))


@query("f13_failed", f", {_METRICS} SELECT doc_id, round(overall, 6) AS overall FROM o WHERE round(overall, 9) < 0.7", True)
def failed_outcomes(spark, sf_dir):
    """the failed ones of judged documents."""
    judged = quality.passes(_metrics(spark, sf_dir).withColumn("overall", F.round("overall", 9)))
    return explore.outcome(judged, "Failed").select("doc_id", F.round("overall", 6).alias("overall"))


@query("p8_arbitration", f""", {_METRICS}, a AS (SELECT *, round(overall, 9) AS r, round(1 - abs(overall - 0.6), 9) AS s FROM o)
SELECT doc_id, CASE WHEN r >= 0.82 THEN 'regex' WHEN r - s > 0.05 THEN 'regex' WHEN s - r > 0.05 THEN 'schema' ELSE 'regex' END AS winner, (r < 0.82 AND r < 0.7 AND s < 0.7) AS low_confidence FROM a""", True)
def arbitration(spark, sf_dir):
    """Two parses' metrics; the rival differs in its overall score only."""
    m = _metrics(spark, sf_dir).withColumn("overall", F.round("overall", 9))
    rival = m.withColumn("overall", F.round(1 - F.abs(F.col("overall") - 0.6), 9))
    return ingest.arbitrate(m, rival).select("doc_id", "winner", "low_confidence")


# ---- explorer -----------------------------------------------------------------------------------------------------

_VIEW = """
x AS (SELECT chunk_id AS id, coalesce(section_number, 'Unknown') AS section, chapter, doc_title, doc_type, law_code, year, source, type, coalesce("order", 'Unknown') AS "order", coalesce(rule, 'Unknown') AS rule, chunk_index, text,
  length(text) AS length, regexp_matches(text, '(?i)(Subs\\.|Ins\\.|Omitted|w\\.e\\.f\\.|ibid\\.|A\\.O\\.|Rep\\.)') AS has_footer FROM c),
e AS (SELECT *, CASE WHEN type = 'rule' THEN 'Order ' || "order" || ' Rule ' || rule ELSE 'Section ' || section END AS display_id, doc_title || ' [' || regexp_extract(source, '([^/]+)$', 1) || ']' AS law FROM x)"""


def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.project(chunks(spark, sf_dir))


@query("f1_f3_projection", f", {_VIEW} SELECT id, section, display_id, law, length::INT AS length, has_footer FROM e", True)
def projection(spark, sf_dir):
    return explorer(spark, sf_dir).select("id", "section", "display_id", explore.law_label().alias("law"), "length", "has_footer")


@query("f4_f5_filters", f", {_VIEW} SELECT id, display_id FROM e WHERE law = 'Act 3 [BNS_2023.pdf]' AND chapter = 'CHAPTER R' AND (contains(lower(text), 'shall') OR contains(lower(id), 'shall'))", True)
def filters(spark, sf_dir):
    return explore.search(explore.cascade(explorer(spark, sf_dir), "Act 3 [BNS_2023.pdf]", "CHAPTER R"), "Shall").select("id", "display_id")


@query("f6_f7_units", f", {_VIEW} SELECT id FROM e WHERE lower(display_id) = 'section 7a' UNION ALL SELECT id FROM e WHERE has_footer AND law = 'Act 5 [CPC_1908.pdf]'", True)
def units(spark, sf_dir):
    rows = explorer(spark, sf_dir)
    return explore.unit(rows, "SECTION 7A").select("id").union(explore.flagged(rows, "Act 5 [CPC_1908.pdf]").select("id"))


@query("a11_f8_statistics", f", {_VIEW} SELECT count(*) AS chunks, count(DISTINCT section) AS sections, floor(avg(length))::BIGINT AS mean_length, count_if(has_footer)::BIGINT AS footers, count_if(section IN ('Unknown', 'N/A'))::BIGINT AS unnumbered FROM e", True)
def statistics(spark, sf_dir):
    return explore.statistics(explorer(spark, sf_dir))


@query("a12_law_counts", f", {_VIEW} SELECT law AS value, count(*) AS chunks FROM e GROUP BY law", True)
def law_counts(spark, sf_dir):
    return explore.counts(explorer(spark, sf_dir), explore.law_label())


@query("a13_type_counts", f", {_VIEW} SELECT type AS value, count(*) AS chunks FROM e GROUP BY type", True)
def type_counts(spark, sf_dir):
    return explore.counts(explorer(spark, sf_dir), "type")


@query("a14_histogram", f", {_VIEW} SELECT length::INT AS length, count(*) AS chunks FROM e GROUP BY length", True)
def histogram(spark, sf_dir):
    return explore.length_histogram(explorer(spark, sf_dir))


@query("a15_u2_tagged", f", {_VIEW} SELECT DISTINCT 'law_code' AS tag, law_code AS value FROM e UNION SELECT DISTINCT 'doc_title', doc_title FROM e", True)
def tagged(spark, sf_dir):
    return explore.tagged_values(explorer(spark, sf_dir))


@query("o1_l1_pages", f""", {_VIEW}, k AS (SELECT id, display_id, row_number() OVER (ORDER BY (type = 'rule')::INT, CASE WHEN type = 'rule' THEN "order" END NULLS FIRST,
 CASE WHEN type = 'rule' THEN coalesce(try_cast(nullif(regexp_extract(rule, '^(\\d+)', 1), '') AS BIGINT), 999) ELSE coalesce(try_cast(nullif(regexp_extract(section, '^(\\d+)', 1), '') AS BIGINT), 9999) END,
 CASE WHEN type <> 'rule' THEN section END NULLS FIRST, chunk_index, id) AS n FROM e) SELECT id, display_id FROM k WHERE n BETWEEN 21 AND 30""", True)
def third_page(spark, sf_dir):
    """O1, O2, L1: the third page of ten in the explorer's order."""
    return explore.page(explorer(spark, sf_dir), 3, explore.sort_keys()).select("id", "display_id")


@query("l1_page_count", "SELECT greatest(1, ceil(count(*) / 10))::BIGINT AS pages FROM lineitem")
def page_count(spark, sf_dir):
    return explore.n_pages(table(spark, sf_dir, "lineitem"))


@query("l2_o4_latest_jobs", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def latest_jobs(spark, sf_dir):
    return explore.latest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", 50, "event_id")


@query("l4_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id LIMIT 100")
def sample(spark, sf_dir):
    return explore.sample(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query("u1_first_seen", f", {_VIEW} SELECT chapter, min(id) AS first_place FROM e GROUP BY chapter", True)
def first_seen(spark, sf_dir):
    return explore.first_seen(explorer(spark, sf_dir), "chapter", "id")


# ---- evaluation of sets and answers -------------------------------------------------------------------------------

_SETS = """w AS (SELECT l_orderkey AS qid, list(DISTINCT (l_partkey % 8)::VARCHAR) AS expected, list(DISTINCT (l_suppkey % 5)::VARCHAR) AS found FROM lineitem GROUP BY l_orderkey)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"))
    return rows.agg(F.collect_set((F.col("l_partkey") % 8).cast("string")).alias("expected_sections"), F.collect_set((F.col("l_suppkey") % 5).cast("string")).alias("found_sections"))


@query("j4_j5_sections", f"""WITH {_SETS} SELECT qid, list_sort(list_intersect(expected, found)) AS hits, list_sort(list_filter(expected, lambda x: NOT list_contains(found, x))) AS missing,
 len(list_intersect(expected, found)) = len(expected) AS all_found, len(list_intersect(expected, found)) > 0 AS any_found FROM w""")
def section_sets(spark, sf_dir):
    """J4, J5, U3, A20, A24."""
    return evaluate.section_sets(_cases(spark, sf_dir))


@query("a21_answers", f"""WITH {_SETS}, a AS (SELECT qid, expected, 'Section ' || array_to_string(list_sort(found), ', Section ') AS answer FROM w),
j AS (SELECT qid, len(list_filter(['Section 1', 'SECTION 2', 'x'], lambda k: contains(lower(answer), lower(k)))) / 3 AS keyword_score, len(list_filter(expected, lambda s: contains(answer, s))) > 0 AS cited FROM a)
SELECT qid, round(keyword_score, 9) AS keyword_score, cited, cited AND keyword_score >= 0.5 AS passed FROM j""")
def answers(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("qid", "expected_sections", F.array(F.lit("Section 1"), F.lit("SECTION 2"), F.lit("x")).alias("expected_keywords"), F.concat(F.lit("Section "), F.array_join(F.array_sort("found_sections"), ", Section ")).alias("answer"))
    return evaluate.judge(rows).select("qid", F.round("keyword_score", 9).alias("keyword_score"), "cited", "passed")


@query("a19_coverage", """SELECT doc_id AS qid, bool_or(regexp_matches(lower(text), 'means|defined|definition|includes')) AS has_definition, bool_or(regexp_matches(lower(text), 'punish|imprisonment|fine|penalty')) AS has_punishment,
 count(*) AS chunks_found, (sum(length(text)) + count(*) - 1)::BIGINT AS combined_length FROM c WHERE type = 'section' GROUP BY doc_id""", True)
def coverage(spark, sf_dir):
    return evaluate.coverage(chunks(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text", (F.col("type") == "section").alias("hit")))


# ---- store, jobs, history -----------------------------------------------------------------------------------------


@query("k1_j11_upsert", """WITH n AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000 END AS doc_id, source || '*' AS source FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, source FROM n""")
def upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1000000)).alias("doc_id"), F.concat("source", F.lit("*")).alias("source"))
    return store.merge_upsert(docs, new, "doc_id")


@query("k2_bad_rows", "SELECT coalesce(CASE WHEN NOT (n_chars > 40) THEN 'short' END, CASE WHEN NOT contains(text, 'the') THEN 'foreign' END, 'good') AS reason, count(*) AS n FROM documents GROUP BY ALL")
def bad_rows(spark, sf_dir):
    good, bad = store.split_bad_rows(table(spark, sf_dir, "documents"), {"short": F.col("n_chars") > 40, "foreign": F.contains("text", F.lit("the"))})
    every = good.select(F.lit("good").alias("reason")).union(bad.select("reason"))
    return every.groupBy("reason").agg(F.count("*").alias("n"))


@query("x3_job_states", """WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END AS status FROM events)
SELECT job_id, coalesce(arg_min(status, seq) FILTER (WHERE status IN ('done', 'failed')), arg_max(status, seq)) AS status, count(*) AS log_lines, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY job_id""")
def job_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return jobs.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status")))


@query("x5_ttl_cache", """WITH e AS (SELECT user_id AS key, ts, value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 86400 END AS ttl_s FROM events),
n AS (SELECT key, arg_max((value, ttl_s, ts), (ts, value)) AS e FROM e GROUP BY key)
SELECT key, round(e[1], 6) AS value FROM n WHERE e[2] IS NULL OR epoch((SELECT max(ts) FROM events)) // 1 - epoch(e[3]) // 1 < e[2]""")
def ttl_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "value", F.when(F.col("user_id") % 3 == 0, None).otherwise(86400).alias("ttl_s"))
    now = e.agg(F.max("ts").alias("now"))
    return jobs.live_entries(e.crossJoin(F.broadcast(now)), F.col("now")).select("key", F.round("value", 6).alias("value"))


@query("x6_o3_history", "SELECT conv_id AS session, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS history FROM conversations GROUP BY conv_id")
def histories(spark, sf_dir):
    return answer.history(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")).select("session", F.sha2("history", 256).alias("history"))


@query("x8_f10_titles", "SELECT conv_id, coalesce(arg_max(left(text, 20), turn) FILTER (WHERE role = 'user' AND turn < 2), 'New Chat') AS title, max(turn) AS updated_at FROM conversations GROUP BY conv_id")
def conversation_titles(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ts"), F.when((F.col("role") == "user") & (F.col("turn") < 2), F.substring("text", 1, 20)).alias("title"))
    return jobs.titles(log)


@query("x_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windows(spark, sf_dir):
    """Extension: tumbling windows of the event stream's plan, run as a batch."""
    out = jobs.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


# ---- operators on rows of known answers ---------------------------------------------------------------------------

_NUMBERED = """SELECT CAST(l_orderkey - l_orderkey % 50 AS STRING) AS doc_id, CAST(l_suppkey % 10 AS INT) AS page_num, l_discount, l_returnflag, l_suppkey, l_partkey, l_quantity,
 row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 50, l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS block_no FROM lineitem """
_NOTE = "CASE WHEN block_no % 7 = 0 THEN '(3. Subs. by Act' ELSE '3 lines of text' END"


@query("s3_span_footnotes", f"""WITH b AS ({_NUMBERED}), n AS (SELECT *, max((5 + l_discount * 100 <= 9.5 AND regexp_matches({_NOTE}, '^\\W*\\d+\\.'))::INT) OVER (PARTITION BY doc_id, page_num ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS seen FROM b)
SELECT doc_id, page_num, count(*) AS n_blocks, max(block_no) AS last_block FROM n WHERE seen = 0 GROUP BY ALL""")
def span_footnotes(spark, sf_dir):
    """S3: from the first block that begins with a small numbered span, a page's blocks go."""
    rows = _with_views(spark, sf_dir, _NUMBERED)
    spans = F.array(F.struct(F.expr(_NOTE).alias("text"), (5 + F.col("l_discount") * 100).cast("double").alias("size")))
    kept = pages.drop_after_footnote_span(rows.withColumn("spans", spans))
    return kept.groupBy("doc_id", "page_num").agg(F.count("*").alias("n_blocks"), F.max("block_no").alias("last_block"))


@query("s4_crop", """SELECT l_orderkey - l_orderkey % 50 AS doc_id, count(*) AS n_lines FROM lineitem WHERE l_suppkey % 100 >= 50 AND 480 + l_partkey % 100 <= 550 AND l_quantity * 16 >= 72 AND l_quantity * 16 + 10 <= 728 GROUP BY ALL""")
def cropped(spark, sf_dir):
    """Lines inside a page's margins."""
    at = {"x0": F.col("l_suppkey") % 100, "x1": 480 + F.col("l_partkey") % 100, "y0": F.col("l_quantity") * 16, "y1": F.col("l_quantity") * 16 + 10, "page_width": F.lit(600), "page_height": F.lit(800)}
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") - F.col("l_orderkey") % 50).alias("doc_id"), *[c.cast("double").alias(k) for k, c in at.items()])
    return pages.crop(rows).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("s6_document_text", "SELECT o_custkey AS doc_id, sha256(string_agg(o_orderpriority || ' of ' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS sha FROM orders GROUP BY o_custkey")
def document_texts(spark, sf_dir):
    """A document's pages joined in order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"), F.concat("o_orderpriority", F.lit(" of "), "o_orderstatus").alias("text"))
    return pages.document_text(rows).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("s7_present", "SELECT p_partkey AS doc_id, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS present FROM part")
def present(spark, sf_dir):
    """Which of the wanted files are there."""
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("doc_id"))
    return files.present_and_missing(there, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id")))


@query("t7_headers", "SELECT doc_id, sha256(CASE WHEN title = '' THEN text ELSE regexp_replace(text, title, '', 'gi') END) AS sha FROM (SELECT doc_id, text, regexp_extract(text, '[a-z]{3,6}') AS title FROM documents)")
def headers(spark, sf_dir):
    """Every occurrence of a literal title goes, whatever its case."""
    title = F.regexp_extract("text", "[a-z]{3,6}", 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.remove_headers(F.col("text"), title), 256).alias("sha"))


@query("t19_json_array", r"SELECT event_id, json_extract_string(regexp_extract('list ' || '[' || event_id || ', ' || user_id || ']' || ' end', '(?s)(\[.*\])', 1), '$[1]') AS second FROM events")
def json_arrays(spark, sf_dir):
    """The array in free text."""
    body = text.json_array(F.concat(F.lit("list ["), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("] end")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$[1]").alias("second"))


@query("p9_definitions", """SELECT o_orderkey AS doc_id, clause, term, content FROM (SELECT o_orderkey, '1' AS clause, o_orderpriority AS term, 'means the clerk ' || CAST(o_custkey AS STRING) || ';' AS content FROM orders
 UNION ALL SELECT o_orderkey, '2', 'state', 'includes ' || o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) WHERE o_orderkey % 3 > 0""")
def defined_terms(spark, sf_dir):
    """Defined terms of definition sections; other sections give none."""
    body = F.expr("""CASE WHEN o_orderkey % 3 = 0 THEN '(1) Nothing here.' ELSE 'In this Act,' || CHR(10) || '(1) "' || o_orderpriority || '" means the clerk ' || CAST(o_custkey AS STRING) || ';'
      || CASE WHEN o_orderkey % 2 = 0 THEN CHR(10) || '(2) "state" includes ' || o_orderstatus ELSE '' END END""")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text"), F.lit("section").alias("type"))
    return parse.definitions(rows).select("doc_id", "clause", "term", F.col("text").alias("content"))


@query("p10_order_rules", """SELECT o_orderkey AS doc_id, "order", rule, content FROM (SELECT o_orderkey, 'I' AS "order", '1' AS rule, '1. Parties of ' || CAST(o_custkey AS STRING) || '.' AS content FROM orders
 UNION ALL SELECT o_orderkey, 'I', '2A', '2A. Orders ' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'II', '1', '1. Frame of suit' FROM orders) WHERE o_orderkey % 3 > 0""")
def rules_of_orders(spark, sf_dir):
    """P10: rules in the orders of a schedule, which ends before its appendix."""
    body = F.expr("""'1. A section' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CHR(10) || 'THE FIRST SCHEDULE' || CHR(10) || 'ORDER I' || CHR(10) || '1. Parties of ' || CAST(o_custkey AS STRING) || '.' || CHR(10) || '2A. Orders ' || o_orderstatus
      || CHR(10) || 'ORDER II' || CHR(10) || '1. Frame of suit' || CHR(10) || 'APPENDIX A' || CHR(10) || 'ORDER III' || CHR(10) || '7. Not a rule' END""")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))
    return parse.order_rules(rows).select("doc_id", "order", "rule", F.col("text").alias("content"))


@query("f9_newest", "SELECT o_custkey, place::INT AS place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def newest(spark, sf_dir):
    """the newest rows of each group."""
    return explore.newest_per_group(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 3, "o_orderkey").select("o_custkey", "place", "o_orderkey")


@query("f10_persisted", "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id % 4 > 1 GROUP BY conv_id")
def persisted_sessions(spark, sf_dir):
    """messages of guests and tests are not kept."""
    session = F.concat(F.when(F.col("conv_id") % 4 == 0, "guest_").when(F.col("conv_id") % 4 == 1, "test_").otherwise("user_guest_"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").where(jobs.persisted(session)).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("a10_job_summary", f""", {_METRICS} SELECT (SELECT count(*) FROM c) AS total_chunks, (SELECT bool_or(chunk_index = 7) FROM c) AS used_fallback, round(avg(round(overall, 9)), 3) AS avg_score, count(*) AS segments FROM o""", True)
def summary(spark, sf_dir):
    """A10: totals of a run."""
    c = chunks(spark, sf_dir).withColumn("fallback_tier", F.when(F.col("chunk_index") == 7, 2))
    return ingest.job_summary(c, _metrics(spark, sf_dir).withColumn("overall", F.round("overall", 9)))


@query("a26_deltas", """WITH a AS (SELECT l_returnflag AS r, avg(l_quantity) AS top1, avg(l_discount) AS mrr FROM lineitem GROUP BY 1), x AS (SELECT 'top1' AS metric, r, top1 AS v FROM a UNION ALL SELECT 'mrr', r, mrr FROM a)
SELECT metric, round(max(v) FILTER (r = 'A'), 9) AS base, round(max(v) FILTER (r = 'R'), 9) AS other, CASE WHEN max(v) FILTER (r = 'R') > max(v) FILTER (r = 'A') THEN '+' WHEN max(v) FILTER (r = 'R') < max(v) FILTER (r = 'A') THEN '-' ELSE '=' END AS sign FROM x GROUP BY metric""")
def metric_deltas(spark, sf_dir):
    """Metric by metric, one retriever against another."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("retriever")).agg(F.avg("l_quantity").alias("top1"), F.avg("l_discount").alias("mrr"))
    return evaluate.deltas(a, "A", "R").select("metric", F.round("base", 9).alias("base"), F.round("other", 9).alias("other"), "sign")


@query("x7_drift", """WITH r AS (SELECT o_orderpriority AS doc_type, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS run, o_totalprice / 1000000 AS s FROM orders),
m AS (SELECT doc_type, run, avg(s) AS mean, count(*) AS n FROM r GROUP BY ALL) SELECT doc_type, run, n, round(mean, 9) AS mean_score, round(mean - lag(mean) OVER (PARTITION BY doc_type ORDER BY run), 9) AS change FROM m""")
def quality_drift(spark, sf_dir):
    """Mean score of each hundred chunks and its change."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("doc_type"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000000).alias("overall"))
    return jobs.drift(rows).select("doc_type", "run", "n", F.round("mean_score", 9).alias("mean_score"), F.round("change", 9).alias("change"))


@query("w_sessions", """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, event_id FROM events), g AS (SELECT *, (t >= lag(t, 1, -10000000000) OVER w + 1800)::INT AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(t) AS first, max(t) + 1800 AS until, count(*) AS n FROM s GROUP BY user_id, no""")
def event_sessions(spark, sf_dir):
    """Session windows: what follows within half an hour belongs together."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts"))
    return jobs.sessions(e).select("user_id", F.unix_timestamp("session_window.start").alias("first"), F.unix_timestamp("session_window.end").alias("until"), "n")



def entry(spark: SparkSession) -> DataFrame:
    """BM25 search of benchmark passages, with its accuracy, on the smallest tables."""
    return lexical_accuracy(spark, "/root/testdata/sf0.001")
