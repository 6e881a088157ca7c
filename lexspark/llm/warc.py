"""WARC archives as a chunked record table.

A payload is never handled as one value between Spark and the archives: it travels as rows of (record, chunk number,
at most ``chunk_bytes`` bytes). The writer streams chunk rows into gzip members, one member per record; the reader
streams an archive through a fixed buffer and gives chunk rows again, each with the digest of the payload up to its end.
So the last chunk of a record carries the digest of the whole payload, and a record needs no more memory than a chunk.

Archives are written under names of their own per task attempt and take part only if their attempt's manifest row was
committed; a lost executor leaves at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, store

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = (
    "path string, record_no long, chunk_no int, chunk binary, digest_so_far string, bytes_so_far long, last boolean, "
    "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_length long, extra map<string,string>"
)


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def filesystem(path: str):
    """(file system, path inside it) for any URI that pyarrow knows; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+://|file:/", path) else (fs.LocalFileSystem(), path)


# ---- responses and revisits ---------------------------------------------------------------------------------------


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0, hot_share: int = 1000) -> DataFrame:
    """Add payload (binary, null text: empty), payload_bytes, sha1 (hex), record_type and refers_to to each row.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest id is the response.
    Digests with over 1/``hot_share`` of the rows, of which there can be no more than ``hot_share``, are joined by
    broadcast and dealt out by row; the others by a shuffle on the digest.
    Null ids: such rows are responses only where no row with an id has that payload. Of rows that share the smallest id all are responses.
    """
    named = {"payload", "payload_bytes", "sha1", "record_type", "refers_to", "_key", "_hot", "_often", "_rest"} & set(pages.columns)
    if named:
        raise ValueError(f"columns that this operator adds are there already: {sorted(named)}")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload", payload)
    digests = rows.select(F.sha1("payload").alias("_sha1"), F.col(id_col).alias("_id"))
    first = digests.groupBy("_sha1").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    first = store(first, "payload-digests")
    total = first.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") > max(total // hot_share, 1)
    often, rest = first.where(hot), first.where(~hot)
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.join(F.broadcast(often.select(F.col("_sha1").alias("sha1"), F.col("_first").alias("_often"), F.lit(True).alias("_hot"))), "sha1", "left")
    # rows of hot digests need no second partner: their key is unlike any digest and spreads them
    key = F.when(F.col("_hot"), F.concat(F.lit("-"), F.xxhash64(id_col).cast("string"))).otherwise(F.col("sha1"))
    rows = rows.withColumn("_key", key).join(rest.select(F.col("_sha1").alias("_key"), F.col("_first").alias("_rest")), "_key", "left")
    origin = F.when(F.col("_hot"), F.col("_often")).otherwise(F.col("_rest"))
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & origin.isNotNull() & ~F.col(id_col).eqNullSafe(origin)
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, origin)).drop("_key", "_often", "_rest", "_hot")


# ---- writing ------------------------------------------------------------------------------------------------------


def record_uri(value) -> str:
    return f"<urn:page:{value}>"


def header(record_type: str, record_id, uri: str | None, length: int, sha1_hex: str, refers_to, extra: dict[str, str]) -> bytes:
    lines = [
        VERSION.decode(),
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_uri(record_id)}",
        f"Content-Length: {length}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(bytes.fromhex(sha1_hex))}",
        "Content-Type: text/html",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"{k}: {v}" for k, v in extra.items()]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class MemberWriter:
    """Gzip members into one open stream; ``write`` may be called with pieces of any size."""

    def __init__(self, out, level: int):
        self.out, self.level, self.size = out, level, 0

    def begin(self) -> None:
        self.gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.gz.compress(data))

    def end(self) -> None:
        self._put(self.gz.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)


def write_archives(records: DataFrame, folder: str, id_col: str = "page_id", uri_col: str | None = "url", chunk_bytes: int = 1 << 20, archive_bytes: int = 1 << 28, level: int = 1) -> DataFrame:
    """Write classified records into gzip WARC files under ``folder``; give the committed manifest (path, n_records, n_bytes).

    A revisit holds no payload block; its digest and full length stay in its header. A new archive begins after
    ``archive_bytes``. The manifest is stored, so that later reads don't write again.
    """
    spark = records.sparkSession
    n = F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes), F.lit(1))
    chunks = records.select(
        F.col(id_col).cast("string").alias("id"),
        (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"),
        "record_type",
        F.col("refers_to").cast("string").alias("refers_to"),
        "payload_bytes",
        "sha1",
        "payload",
        F.explode(F.when(F.col("record_type") == "revisit", F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))).alias("chunk_no"),
    )
    piece = F.when(F.col("record_type") == "response", F.substring(F.col("payload"), (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)))
    chunks = chunks.withColumn("chunk", piece).drop("payload")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        out, done = None, []

        def close(out, name, records):
            out.out.close()
            done.append((name, records, out.size))

        name, n_records = "", 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.chunk_no == 0:
                    if out is not None and out.size >= archive_bytes:
                        close(out, name, n_records)
                        out = None
                    if out is None:
                        name, n_records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = MemberWriter(fs.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None), level)
                    out.begin()
                    revisit = r.record_type == "revisit"
                    out.write(header(r.record_type, r.id, r.uri, 0 if revisit else r.payload_bytes, r.sha1, r.refers_to if revisit else None, {"X-Payload-Length": str(r.payload_bytes)}))
                    n_records += 1
                if r.chunk is not None:
                    out.write(r.chunk)
                if r.record_type == "revisit" or (r.chunk_no + 1) * chunk_bytes >= r.payload_bytes:
                    out.write(b"\r\n\r\n")
                    out.end()
        if out is not None:
            close(out, name, n_records)
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    return store(chunks.mapInPandas(write, MANIFEST), "warc-manifest")


# ---- reading ------------------------------------------------------------------------------------------------------


class Unzipped:
    """The bytes of concatenated gzip members (or of a plain file), through a bounded buffer."""

    def __init__(self, stream, buffer: int = 1 << 18):
        self.stream, self.buffer, self.held, self.raw = stream, buffer, b"", b""
        self.raw = stream.read(buffer)
        self.gz = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.buffer)
                if not self.raw:
                    return False
            if self.gz is None:
                data, self.raw = self.raw, b""
            else:
                if self.gz.eof:
                    self.gz = zlib.decompressobj(31)
                data = self.gz.decompress(self.raw, self.buffer)
                self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What stands before ``mark``, which is skipped; None at the end of the file."""
        while (i := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise ValueError("a WARC header is too long")
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def record_chunks(stream, path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive; a wrong payload digest in a record that has a payload is an error."""
    data, no = Unzipped(stream), 0
    while (block := data.until(b"\r\n\r\n")) is not None:
        h = parse_header(block)
        left = length = int(h["content-length"])
        sha, done, k = hashlib.sha1(), 0, 0
        want = h.get("warc-payload-digest", "").removeprefix("sha1:")
        base = (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), want or None)
        while True:
            chunk = data.take(min(left, chunk_bytes))
            left, done = left - len(chunk), done + len(chunk)
            sha.update(chunk)
            so_far = sha1_base32(sha.copy().digest())
            if not left and length and want and so_far != want:
                raise ValueError(f"{path}: payload digest of {base[0]} is {so_far}, not {want}")
            yield (path, no, k, chunk, so_far, done, not left, *base, int(h.get("x-payload-length", length)), {x: v for x, v in h.items() if x.startswith("x-")})
            k += 1
            if not left:
                break
        if data.take(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: no end mark after {base[0]}")
        no += 1


def read_chunks(manifest: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` (column path) names; see CHUNKS for its columns."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, place = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for row in record_chunks(stream, path, chunk_bytes):
                        rows.append(row)
                        held += len(row[3]) + 500
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = manifest.select("path")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInPandas(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, without its bytes: that chunk carries the digest and length of all of them."""
    page = F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1)
    target = F.regexp_extract("refers_to_id", r"<urn:page:(-?\d+)>", 1)
    return chunks.where("last").select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        F.when(target != "", target.cast("long")).alias("refers_to"),
        F.col("target_uri").alias("url"),
        F.col("bytes_so_far").alias("stored_bytes"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read the records back.

    Null html is an empty payload; null page ids come back null; a null url has no target line; other columns are not
    archived. Of equal payloads the smallest id is the response; rows that repeat that id are responses each. Payloads of any length travel in
    chunks. An empty table writes no archive and gives no rows.
    """
    manifest = write_archives(classify(pages.select("page_id", "url", "html")), new_path(spark, "warc"), chunk_bytes=chunk_bytes)
    return records(read_chunks(manifest, chunk_bytes))
