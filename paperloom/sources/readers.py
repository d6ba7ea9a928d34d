"""Where pages come from. Readers of binary documents, OCR engines and models are providers: objects with one method that
run on executors, batch by batch. Their stand-ins here are deterministic, as the formats and engines need software of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Settings
from ..functions.text import char_count, needs_ocr

PAGES = "doc_id string, page_no int, text string, source string, headings array<string>, error string"


class PageReader(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class Ocr(Protocol):
    """An engine that reads page by page."""

    name: str

    def text(self, doc_id: str, page_no: int) -> str | None: ...


class FileOcr(Protocol):
    """An engine that reads a document at once: texts by page number."""

    name: str

    def texts(self, doc_id: str) -> dict[int, str]: ...


class PlainTextReader:
    """Pages of UTF-8 text, parted by form feeds. Undecodable content is an error of that file alone."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class LayoutOcr:
    """A whole-file engine over a service that answers with lines, words and content for each page: lines, else words, else content, is the
    text of a page."""

    def __init__(self, call: Callable[[str], list[dict]], name: str = "layout"):
        self.call, self.name = call, name

    def texts(self, doc_id: str) -> dict[int, str]:
        text = lambda p: "\n".join(p.get("lines") or ()) or " ".join(p.get("words") or ()) or p.get("content") or ""
        return {int(p["page"]): text(p) for p in self.call(doc_id)}


class NoOcr:
    name = "empty"

    def text(self, doc_id: str, page_no: int) -> str | None:
        return None


def files(spark: SparkSession, folder: str, glob: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, name, content and length of the files of a folder."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return read.load(folder).withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_pages(found: DataFrame, reader: PageReader, settings: Settings) -> DataFrame:
    """PAGES of files (path, content, length). A file that is too large or can't be read is one row with an error."""
    limit = settings.max_upload_mb * (1 << 20)
    large = found.where(F.col("length") > limit).select(
        F.col("path").alias("doc_id"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), F.lit("empty").alias("source"),
        F.array().cast("array<string>").alias("headings"), F.lit(f"file is larger than the {settings.max_upload_mb} MB limit").alias("error"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts = [t.strip() for t in reader.pages(bytes(content))]
                    rows += [(path, n, t, "text" if t else "empty", [], None) for n, t in enumerate(texts, 1)]
                except Exception as e:  # one bad file must not stop the others
                    rows.append((path, None, None, "empty", [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "source", "headings", "error"])

    read = found.where(F.col("length") <= limit).select("path", "content").mapInPandas(run, PAGES)
    return read.unionByName(large)


def fill_by_ocr(pages: DataFrame, engine: Ocr, settings: Settings, first: FileOcr | None = None) -> DataFrame:
    """pages with texts of engines where there is too little text, in one pass over them.

    Only documents with such pages reach an engine, and only such pages change. `first` reads a document at once and counts if it
    fills any of them; otherwise, and without it, `engine` reads them one by one. What no engine reads stays as it is; an engine that fails reads nothing.
    """
    poor = needs_ocr(F.col("text"), settings.ocr_min_chars) & F.col("error").isNull()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[str, dict[int, str]] = {}

        def of_file(doc_id: str) -> dict[int, str]:
            if doc_id not in whole:
                whole.clear()  # pages of a document follow each other
                try:
                    whole[doc_id] = {n: t.strip() for n, t in first.texts(doc_id).items() if t and t.strip()}
                except Exception:  # the next engine has its turn
                    whole[doc_id] = {}
            return whole[doc_id]

        def read(doc_id: str, page_no: int, wanted: Sequence[int]) -> tuple[str, str] | None:
            found = of_file(doc_id) if first else {}
            if any(n in found for n in wanted):
                return (found[page_no], first.name) if page_no in found else None
            try:
                text = engine.text(doc_id, page_no)
            except Exception:
                return None
            return (text.strip(), engine.name) if text and text.strip() else None

        for batch in batches:
            got = [read(d, int(n), list(w)) if p else None for d, n, p, w in zip(batch["doc_id"], batch["page_no"].fillna(0), batch["_poor"], batch["_wanted"], strict=True)]
            batch["text"] = [g[0] if g else old for g, old in zip(got, batch["text"], strict=True)]
            batch["source"] = [g[1] if g else old for g, old in zip(got, batch["source"], strict=True)]
            yield batch.drop(columns=["_poor", "_wanted"])

    x = pages.withColumn("_poor", F.coalesce(poor, F.lit(False)))
    if first:  # whether a whole-file answer counts depends on all poor pages of a document
        wanted = x.where("_poor").groupBy("doc_id").agg(F.collect_list("page_no").alias("_wanted"))
        x = x.join(wanted, "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "page_no").select(*pages.columns, "_poor", F.coalesce("_wanted", F.array().cast("array<int>")).alias("_wanted"))
    else:
        x = x.withColumn("_wanted", F.array().cast("array<int>"))
    return x.mapInPandas(run, pages.schema)


def paged(table: DataFrame, doc: str, page: str, text: str, first: int = 0) -> DataFrame:
    """A table that holds texts already, as pages."""
    return table.select(F.col(doc).alias("doc_id"), (F.col(page) + (1 - first)).cast("int").alias("page_no"), F.col(text).alias("text"), F.array().cast("array<string>").alias("headings"))


def document_totals(pages: DataFrame) -> DataFrame:
    """By document of pages (doc_id, text, source): n_chars without white space, the engines that read it, and whether any read a picture."""
    own = F.col("source").isin("text", "empty")
    return pages.groupBy("doc_id").agg(
        F.sum(char_count(F.col("text")).cast("bigint")).alias("n_chars"), F.array_sort(F.collect_set("source")).alias("engines"), F.coalesce(F.bool_or(~own), F.lit(False)).alias("ocr_used")
    )
