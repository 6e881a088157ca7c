"""As-of joins within one relation: what was last said of a key before each row, with hot keys split by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: str, order: tuple[str, ...], what: Column, segment: Column, name: str = "carried", strictly: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``what`` of the same ``by`` at or before each row in ``order`` (only before it, if ``strictly``).

    ``segment`` never falls along ``order``, as a day does along a time. A task holds one segment of one key, never all of a hot key: inside segments a running
    window carries on, and into each segment comes the last value of those before it, from an aggregate of one row for each key and segment.
    """
    at = F.struct(*order)
    cut = rows.withColumn("_segment", segment).withColumn("_what", what)
    seen = cut.groupBy(F.col(by).alias("_by"), F.col("_segment").alias("_of")).agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), at)).alias("_last"))
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    into = seen.select("_by", "_of", F.last("_last", ignorenulls=True).over(before).alias("_into"))
    own = Window.partitionBy(by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    out = cut.withColumn("_own", F.last("_what", ignorenulls=True).over(own))
    out = out.join(into, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_segment") == F.col("_of")), "left")
    return out.select(*rows.columns, F.coalesce("_own", "_into").alias(name))


def preceding(rows: DataFrame, by: str, order: tuple[str, ...], what: Column, segment: Column, most: int, name: str = "preceding") -> DataFrame:
    """``rows`` with ``name``: the array of ``what`` of the up to ``most`` rows before each row, of the same ``by`` and in ``order``.

    ``segment`` as in ``carried``: a task holds one segment of one key, and the last ``most`` rows before it, which come from the ends of earlier segments.
    """
    cut = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(by).alias("_by"), F.struct(*order).alias("_at"), segment.alias("_segment"), what.alias("_what"))
    ends = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_by", "_segment").orderBy(F.desc("_at")))).where(F.col("_n") <= most)
    ends = ends.select("_by", "_segment", "_at", "_what", F.row_number().over(Window.partitionBy("_by").orderBy("_segment", "_at")).alias("_place"))
    asked = ends.groupBy(F.col("_by").alias("_of"), "_segment").agg(F.min("_place").alias("_first")).where("_first > 1")
    asked = asked.select("_of", "_segment", F.explode(F.sequence(F.greatest(F.col("_first") - most, F.lit(1)), F.col("_first") - 1)).alias("_asked"))
    before = asked.join(ends.drop("_segment"), F.col("_of").eqNullSafe(F.col("_by")) & (F.col("_asked") == F.col("_place")))
    both = cut.unionByName(before.select("_by", "_segment", "_at", "_what"), allowMissingColumns=True)
    own = Window.partitionBy("_by", "_segment").orderBy("_at").rowsBetween(-most, -1)
    return both.withColumn(name, F.collect_list("_what").over(own)).where("row IS NOT NULL").select("row.*", name)
