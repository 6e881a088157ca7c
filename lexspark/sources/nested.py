"""JSON of unknown shape as VARIANT: parsed and taken apart in the JVM, level by level, whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stage


def kind(v: Column) -> Column:
    """array, object, null or value; null where there is no JSON."""
    of = F.schema_of_variant(v)
    return F.when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").when(of == "VOID", "null").otherwise(F.when(v.isNotNull(), "value"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def objects(rows: DataFrame, column: str = "v") -> DataFrame:
    """The objects in the arrays of ``column`` (a variant), however deep these are nested, one a row; lists of numbers and the like are passed over.

    Each round explodes what is still an array, so there are as many rounds as levels; the driver only learns whether any is left. Columns ``path``
    (array<long>, the positions on the way) and the others of ``rows`` come along.
    """
    level = rows.withColumn("path", F.array().cast("array<bigint>"))
    found = None
    while True:
        level = stage(level.withColumn("_kind", kind(F.col(column))).where("_kind IN ('array', 'object')"), "variants")
        own = level.where("_kind = 'object'").drop("_kind")
        found = own if found is None else found.unionByName(own)
        arrays = level.where("_kind = 'array'").drop("_kind")
        if arrays.isEmpty():
            return found
        level = elements(arrays, column)


def elements(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with each element of the array in ``column`` in its place, and its position added to ``path``."""
    others = [c for c in rows.columns if c not in (column, "path")]
    spread = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer()))
    return spread.select(*others, F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"), F.col("value").alias(column))


def text_of(v: Column, field: str, missing: str | None) -> Column:
    """A field's value as text; ``missing`` where there is none, and None for a null, as Python would write it."""
    # as text, a null is null as well; only then is it looked for once more
    return F.coalesce(F.variant_get(v, f"$.{field}", "string"), F.when(F.variant_get(v, f"$.{field}", "variant").isNull(), missing).otherwise("None"))


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases (file, path, query, expected_sections) of JSON files whose lists may be nested to any depth. A file that is no JSON gives none."""
    read = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    cases = objects(read)
    return cases.select("file", "path", F.try_variant_get("v", "$.query", "string").alias("query"), F.try_variant_get("v", "$.expected_sections", "array<string>").alias("expected_sections"))
