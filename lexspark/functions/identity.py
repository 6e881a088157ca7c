"""Deterministic ids, content hashes and storage metadata of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalise

PIPELINE_VERSION = "2.0"
MOST_CHARS = 500


def text_hash(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(normalise(text), 256), 1, size)


def chunk_id(title: Column, section: Column, chunk_index: Column, sub_chunk: Column, segment: Column, text: Column, path: Column | None = None) -> Column:
    """32 hex digits of the SHA-256 over the parts joined by bars; missing parts are empty. The text's part is its first 120 characters, normalised after the cut."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (title, section, chunk_index, sub_chunk, segment)]
    parts.append(normalise(F.substring(F.coalesce(text, F.lit("")), 1, 120)))
    if path is not None:
        parts.append(F.substring(F.sha2(path, 256), 1, 8))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def sanitised(value: Column, most: int = MOST_CHARS) -> Column:
    """Metadata as stored: text of at most ``most`` characters, N/A for null."""
    return F.coalesce(F.substring(value.cast("string"), 1, most), F.lit("N/A"))


def sanitise(rows: DataFrame, columns: list[str], most: int = MOST_CHARS) -> DataFrame:
    """``rows`` with the named metadata columns as stored: arrays, maps and structs as JSON, numbers and truth values as they are, N/A for null text."""
    out = {}
    for name in columns:
        kind = rows.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            out[name] = sanitised(F.to_json(name), most)
        elif not isinstance(kind, (T.NumericType, T.BooleanType)):
            out[name] = sanitised(F.col(name), most)
    return rows.withColumns(out) if out else rows


def legacy_chunk_id(act: Column, chapter: Column, section: Column, chunk_index: Column, text: Column) -> Column:
    """The older id: all 64 hex digits of the SHA-256 over the parts joined by underscores."""
    return F.sha2(F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("")) for c in (act, chapter, section, chunk_index, text)]), 256)


def with_storage_metadata(chunks: DataFrame, stored_at: str, model: str = "none", version: str = PIPELINE_VERSION) -> DataFrame:
    """Add stored_at, pipeline_version and embedding_model where they are missing; one time stamp for a whole run."""
    for name, value in (("stored_at", F.lit(stored_at).cast("timestamp")), ("pipeline_version", F.lit(version)), ("embedding_model", F.lit(model))):
        chunks = chunks.withColumn(name, F.coalesce(F.col(name), value) if name in chunks.columns else value)
    return chunks.withColumn("normalized_text_hash", text_hash(F.col("text")))
