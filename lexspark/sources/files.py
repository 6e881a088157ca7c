"""Reading documents, layouts and test sets; writing reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, law_code, law_year, title_from_path
from ..schema import PAGES
from . import nested


def pdf_files(spark: SparkSession, folder: str, name_has: str = "") -> DataFrame:
    """(path, content, length, doc_id, doc_title, law_code, year) of the PDF files under a folder, whatever the case of their ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder)
    path = F.col("path")
    files = files.select("path", "content", "length", file_stem(path).alias("doc_id"), title_from_path(path).alias("doc_title"), law_code(path).alias("law_code"), law_year(path).alias("year"))
    return files.where(F.contains(F.lower("doc_id"), F.lit(name_has.lower()))) if name_has else files


def extract(files: DataFrame, extractor: Callable[[bytes], list[dict]], schema: str = PAGES) -> DataFrame:
    """Rows that a pluggable extractor gives for each file's bytes, with doc_id and ``error``.

    A file that it fails on by a ValueError has one row with the error and nothing else (for ``store.split_bad_rows``); a file without pages has none.
    """
    names = [*[c.split()[0] for c in schema.split(", ")], "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = extractor(content)
                except ValueError as e:
                    rows = [{"error": str(e) or type(e).__name__}]
                yield pd.DataFrame([[({"doc_id": doc_id} | r).get(c) for c in names] for r in rows], columns=names)

    return files.select("doc_id", "content").mapInPandas(read, f"{schema}, error string")


def present_and_missing(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id) with ``present``."""
    have = files.select("doc_id").distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, "doc_id", "left").select("doc_id", F.coalesce("_have", F.lit(False)).alias("present"))


def is_pdf_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.pdf(?:$|\?)|pdf")


def url_file_name(url: Column) -> Column:
    """Last part of the path without the query; download.pdf if it is empty."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)", 1), F.lit("")), F.lit("download.pdf"))


def flat_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases (query, expected_sections) of JSON files whose lists may be nested to any depth."""
    return nested.test_cases(spark, path).select("query", "expected_sections")


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition of ``rows``."""
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; quotes inside values are doubled, as other readers of CSV expect."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)
