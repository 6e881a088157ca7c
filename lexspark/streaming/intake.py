"""Documents from files that arrive in a folder: the file is the unit of work, of failure and of retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..operators import pages
from ..schema import PAGES
from ..sources import files
from ..sources.store import ChunkStore
from ..sources.tables import stage

ERRORS = "doc_id string, path string, error string"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]", at_once: int = 100) -> DataFrame:
    """(path, content, length, doc_id) of the files that arrive in ``folder``, at most ``at_once`` in a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(folder)
    return found.select("path", "content", "length", file_stem(F.col("path")).alias("doc_id"))


def documents_of(found: DataFrame, extractor: Callable[[bytes], list[dict]], schema: str = PAGES, to_pages: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id and text, rows ERRORS) of files (doc_id, path, content).

    The extractor gives rows of ``schema``; ``to_pages`` makes pages (doc_id, page_num, text) of them where they are not pages already. A file that it can't
    read, or that has no text, has a row with the reason and no document; the others of its batch are not held up.
    """
    read = stage(files.extract(found, extractor, schema), "extracted")
    broken = read.where("error IS NOT NULL").select("doc_id", "error")
    rows = read.where("error IS NULL").drop("error")
    docs = pages.document_text(to_pages(rows) if to_pages else rows).where(F.trim("text") != "")
    paths = found.select("doc_id", "path")
    empty = paths.join(docs, "doc_id", "left_anti").join(broken, "doc_id", "left_anti").withColumn("error", F.lit("no text"))
    return docs, broken.join(paths, "doc_id").select("doc_id", "path", "error").unionByName(empty.select("doc_id", "path", "error"))


def ingest_files(spark: SparkSession, folder: str, extractor: Callable[[bytes], list[dict]], plan: Callable[[DataFrame], DataFrame], store: ChunkStore, errors: str, checkpoint: str, name: str | None = None, at_once: int = 100, **extraction):
    """Stream the files of ``folder`` through ``plan`` (documents to chunks) into ``store``; rows ERRORS are written under ``errors``, a folder for each batch.

    A batch that is tried again gives the same chunks, whose ids are deterministic, and overwrites its own folder of errors. Files that
    have been worked off are remembered by the checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        docs, bad = documents_of(batch, extractor, **extraction)
        store.upsert(plan(docs))
        bad.write.mode("overwrite").json(f"{errors}/batch={number}")

    writer = file_stream(spark, folder, at_once=at_once).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def new_chunks(chunks: DataFrame, late: str = "1 hour", key: str = "chunk_id", at: str = "stored_at") -> DataFrame:
    """A stream of ``chunks`` without those whose key came before within the watermark: a replayed batch adds no row, and keys leave the state once the watermark passes them."""
    return chunks.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
