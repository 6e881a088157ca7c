"""Files by URL as a data source: ``spark.read.format("urls")``, a task for each block of URLs, a row for each file or failure."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import is_pdf_url, url_file_name

FILES = "url string, file_name string, content binary, error string, tries int"


def fetch(url: str, tries: int, timeout: float, most_bytes: int, wait: float = 0.5) -> tuple[bytes | None, str | None, int]:
    """(content, error, tries) of a URL. What may pass (no connection, server errors) is tried again; what will not (no such file, refused) is not."""
    error = None
    for n in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                content = r.read(most_bytes + 1)
            return (content, None, n) if len(content) <= most_bytes else (None, f"over {most_bytes} bytes", n)
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code < 500 and e.code not in (408, 429):
                return None, error, n
        except (urllib.error.URLError, OSError) as e:
            error = str(getattr(e, "reason", e))
            if isinstance(getattr(e, "reason", e), FileNotFoundError | IsADirectoryError | PermissionError):
                return None, error, n
        except ValueError as e:
            return None, str(e), n
        if n < tries:
            time.sleep(wait * 2 ** (n - 1))
    return None, error, tries


class Block(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class UrlReader(DataSourceReader):
    """Options: ``urls``, one a line; ``block`` URLs a task; ``tries``, ``timeout`` and ``maxBytes`` for each."""

    def __init__(self, options):
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.block, self.tries = max(1, int(options.get("block", "20"))), max(1, int(options.get("tries", "3")))
        self.timeout, self.most = float(options.get("timeout", "60")), int(options.get("maxbytes", str(256 << 20)))

    def partitions(self) -> list[Block]:
        return [Block(self.urls[i : i + self.block]) for i in range(0, len(self.urls), self.block)]

    def read(self, partition: Block) -> Iterator[tuple]:
        for url in partition.urls:
            content, error, n = fetch(url, self.tries, self.timeout, self.most)
            yield url, None, content, error, n


class UrlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> UrlReader:
        return UrlReader(self.options)


def read_urls(spark: SparkSession, urls: list[str], only_pdf: bool = True, **options) -> DataFrame:
    """FILES of ``urls``, each once. With ``only_pdf`` a URL that does not look like one is not fetched and has a row with that error."""
    spark.dataSource.register(UrlSource)
    every = spark.createDataFrame([(u,) for u in dict.fromkeys(u.strip() for u in urls)], "url string")
    ok = is_pdf_url(F.col("url")) if only_pdf else F.lit(True)
    wanted = [r[0] for r in every.where(ok).collect()]
    reader = spark.read.format("urls").option("urls", "\n".join(wanted))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    none = every.where(~ok).select("url", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("binary").alias("content"), F.lit("not a PDF by its URL").alias("error"), F.lit(0).alias("tries"))
    return reader.load().unionByName(none).withColumn("file_name", url_file_name(F.col("url")))


#: Official texts of acts, by the names of their files.
ACTS = {
    "BNS_2023": "https://mha.gov.in/sites/default/files/250883_english_01042024.pdf",
    "BNSS_2023": "https://mha.gov.in/sites/default/files/250880_english_01042024.pdf",
    "BSA_2023": "https://mha.gov.in/sites/default/files/250882_english_02042024.pdf",
    "CPC_1908": "https://www.indiacode.nic.in/bitstream/123456789/13813/1/the_code_of_civil_procedure%2C_1908.pdf",
    "RTI_2005": "https://rti.gov.in/rti-act.pdf",
    "Consumer_Protection_2019": "https://consumeraffairs.nic.in/sites/default/files/CP%20Act%202019.pdf",
    "IT_Act_2000": "https://www.meity.gov.in/writereaddata/files/itbill2000.pdf",
    "Code_on_Wages_2019": "https://labour.gov.in/sites/default/files/Code_on_Wages_2019.pdf",
    "Industrial_Relations_Code_2020": "https://labour.gov.in/sites/default/files/IR_Code_2020.pdf",
    "Social_Security_Code_2020": "https://labour.gov.in/sites/default/files/SS_Code_2020.pdf",
    "OSH_Code_2020": "https://labour.gov.in/sites/default/files/OSH_Code_2020.pdf",
}


def download(wanted: DataFrame, folder: str, tries: int = 3, timeout: float = 60.0, most_bytes: int = 256 << 20) -> DataFrame:
    """Save files of ``wanted`` (name, url) as ``folder``/name.pdf where they are not there yet: (name, url, status there, saved or failed, error, tries).

    ``folder`` is one that all executors share, in any file system that Arrow opens. A file appears under its name when it is complete, so tasks
    may be tried again; rows that repeat a name are fetched once.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            rows = []
            for name, url in zip(batch["name"], batch["url"], strict=True):
                at = f"{place}/{name}.pdf"
                if system.get_file_info(at).type == fs.FileType.File:
                    rows.append((name, url, "there", None, 0))
                    continue
                content, error, n = fetch(url, tries, timeout, most_bytes)
                if error is None:
                    part = f"{place}/.{name}-{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as f:
                        f.write(content)
                    system.move(part, at)
                rows.append((name, url, "saved" if error is None else "failed", error, n))
            yield pd.DataFrame(rows, columns=["name", "url", "status", "error", "tries"])

    return wanted.dropDuplicates(["name"]).select("name", "url").mapInPandas(save, "name string, url string, status string, error string, tries int")
