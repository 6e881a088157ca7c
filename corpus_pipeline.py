"""A training corpus from raw documents: filter by quality, delete repeated lines, drop near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``documents``. A
stage's output is written as Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import lines, mixing, nearcopies, packing, quality
from lexspark.llm.queries import word_tokenizer
from lexspark.llm.shared import new_path

#: No stage but line dedup and packing could be written as SQL: models, sketches and seeded rounding are fitted and drawn.
ORACLE_SQL = None


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier runs; those of which nothing is left go."""
    out = lines.dedup_lines(docs)
    emptied = F.col("removed_runs").isNotNull() & (F.trim("text") == "")
    return out.where(~emptied).select(*docs.columns)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles and a similarity of 0.8."""
    return nearcopies.keep_one(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, word_tokenizer)


STAGES = [
    ("quality", good_text),
    ("line dedup", new_lines),
    ("near copies", one_of_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
