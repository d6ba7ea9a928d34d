"""Manifests of what goes where, and partitioned tables of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Settings
from ..functions.text import folder_name
from ..operators.naming import client_key, file_name, numbered
from ..operators.review import page_label


def split_manifest(segments: DataFrame, page_counts: DataFrame, stem: str = "doc_id") -> DataFrame:
    """A part for each segment (doc_id, seg_no, start_page, end_page, seg_type): range within the document, name, and whether it is a copy of the whole."""
    x = segments.join(page_counts, "doc_id").withColumn("start_page", F.greatest("start_page", F.lit(1))).withColumn("end_page", F.least("end_page", "page_count"))
    x = x.where("start_page <= end_page")
    whole = (F.col("start_page") == 1) & (F.col("end_page") == F.col("page_count"))
    name = F.concat(F.col(stem).cast("string"), F.lit("_part"), F.lpad(F.col("seg_no").cast("string"), 2, "0"), F.lit("_"), F.col("seg_type"), F.lit(".pdf"))
    return x.select("doc_id", "seg_no", "start_page", "end_page", whole.alias("is_copy"), name.alias("part_name"), page_label().alias("page_label"))


def export_manifest(rows: DataFrame, settings: Settings, there: DataFrame | None = None, review_by_client: bool = True) -> DataFrame:
    """rows with client_key, target_dir and unique_name; what needs a review goes to its own tree, failed rows nowhere.

    there: (folder, name) of what is stored already, which nothing overwrites. review_by_client: the review tree has client folders too.
    """
    x = rows.where(F.col("error").isNull()).withColumns({"client_key": client_key(settings), "file_name": file_name(settings)})
    client = folder_name(F.col("client_key"))
    parked = F.concat_ws("/", F.lit("review"), client) if review_by_client else F.lit("review")
    x = x.withColumn("target_dir", F.when(F.col("requires_review"), parked).otherwise(F.concat_ws("/", F.lit("Clients"), client)))
    return numbered(x, "target_dir", "file_name", "doc_ordinal", there)


def stored_names(spark: SparkSession, folder: str) -> DataFrame | None:
    """(folder, name) of a manifest table that `write` made; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).select(F.col("target_dir").alias("folder"), F.col("unique_name").alias("name"))


def archive_manifest(manifest: DataFrame, client: str | None = None) -> DataFrame:
    """Entries of an archive: of all clients, a folder each, or of one client, flat. Only what is filed counts, in order of the entries.

    A client without documents, or no document at all, is an error.
    """
    filed = manifest.where(F.col("target_dir").startswith("Clients/"))
    if client is not None:
        filed = filed.where(F.col("client_key") == client)
    entry = F.col("unique_name") if client is not None else F.concat_ws("/", "client_key", "unique_name")
    if filed.isEmpty():
        raise LookupError("There are no processed documents to export" if client is None else f"No documents to export for {client}")
    return filed.select("client_key", entry.alias("entry"))


def listed_paths(listing: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of a listing (path, name) that are asked for by path and exist."""
    return listing.join(paths.select("path").distinct(), "path", "left_semi")


def archive_name(name: str) -> str:
    return name if name.endswith(".zip") else f"{name}.zip"


def archive_of_all(manifest: DataFrame, at: datetime) -> DataFrame:
    """The entries of all clients' archive, with its name: AllClients_, the day and the minute."""
    return archive_manifest(manifest).withColumn("archive", F.lit(archive_name(f"AllClients_{at:%Y%m%d_%H%M}")))


def export_status(rows: DataFrame) -> DataFrame:
    """rows (error, target_dir, exported_path) with exported_path and failure: what failed earlier stays out, what was exported
    before keeps its place, the rest goes to its target."""
    failed = F.col("error").isNotNull()
    path = F.coalesce("exported_path", F.concat_ws("/", "target_dir", "unique_name"))
    why = F.concat(F.col("source_name"), F.lit(" failed earlier: "), F.col("error"))
    return rows.withColumns({"exported_path": F.when(~failed, path), "failure": F.when(failed, why)})


def tally_columns(failure: Column) -> dict[str, Column]:
    """What was exported and what was not, as aggregates by name."""
    return {"exported": F.count_if(failure.isNull()), "failures": F.count_if(failure.isNotNull())}


def export_tally(status: DataFrame) -> DataFrame:
    return status.agg(*(c.alias(k) for k, c in tally_columns(F.col("failure")).items()))


def write(manifest: DataFrame, folder: str) -> None:
    """The manifest as a table by status and client; nothing that is there is overwritten."""
    manifest.write.mode("append").partitionBy("status", "client_key").parquet(folder)
