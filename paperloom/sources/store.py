"""What lies in folders: listings as rows, uploads by their content, what may be purged, and the end of a log."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.text import folder_name
from ..operators.naming import numbered
from .ledger import Log

# --- listings ---


def listed(spark: SparkSession, folder: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, name, length and modified of the files of a folder and those within. Their content is not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return read.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def in_order(found: DataFrame) -> DataFrame:
    """A listing with place, from 1 in the order of folders and names, without a sort in one task."""
    x = found.withColumn("_parts", F.split("path", "/"))
    return ranked(x, [], ["_parts"], "place").drop("_parts")


def by_client(found: DataFrame) -> DataFrame:
    """Files (path, name) by the folder that they are in: client_key, place (from 1 in the order of names), name, n_documents. A row for each file, so that a client with
    many files spreads."""
    keyed = found.select(F.element_at(F.split("path", "/"), -2).alias("client_key"), "name", "path")
    placed = ranked(keyed, ["client_key"], ["name", "path"], "place")
    counts = placed.groupBy("client_key").agg(F.count("*").alias("n_documents"))
    return placed.drop("path").join(counts.withColumnRenamed("client_key", "_c"), F.col("client_key").eqNullSafe(F.col("_c"))).drop("_c")


# --- uploads ---

LANDED = "digest string, name string, landed_name string, content binary"


def landing_name(stamp: str, name: Column) -> Column:
    """<stamp>_<safe name>.pdf"""
    return F.concat(F.lit(f"{stamp}_"), folder_name(F.regexp_replace(name, r"\.[^.]*$", ""), "upload"), F.lit(".pdf"))


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All uploads that were committed."""
    paths = [e["path"] for e in Log(spark, folder).entries()]
    return spark.read.schema(LANDED).parquet(*paths) if paths else spark.createDataFrame([], LANDED)


def land(uploads: DataFrame, folder: str, stamp: str, attempts: int = 100) -> DataFrame:
    """Store uploads (name, content) under the SHA-256 of their content, and return the rows that are new, of LANDED.

    Content that is stored already, under whatever name, or that comes twice, is stored once, under the first of its names. Names get the first free number. A landing counts
    once its commit is there; if another was faster, what it stored counts too and this one begins anew.
    """
    spark, log = uploads.sparkSession, Log(uploads.sparkSession, folder)
    x = uploads.select("name", "content").withColumn("digest", F.sha2("content", 256))
    for _ in range(attempts):
        entries = log.entries()
        there = landed(spark, folder)
        fresh = x.groupBy("digest").agg(F.min("name").alias("name")).join(there.select("digest"), "digest", "left_anti")
        named = fresh.withColumns({"_folder": F.lit(""), "landed_name": landing_name(stamp, F.col("name"))})
        named = numbered(named, "_folder", "landed_name", "digest", there.select(F.lit("").alias("folder"), F.col("landed_name").alias("name")))
        named = named.select("digest", "name", F.col("unique_name").alias("landed_name"))
        path = f"{folder}/landing-{uuid.uuid4().hex}"
        content = x.select("digest", "name", "content").dropDuplicates(["digest", "name"])
        content.join(named, ["digest", "name"]).select("digest", "name", "landed_name", "content").write.parquet(path)
        if log.commit(len(entries) + 1, {"path": path}):
            return spark.read.schema(LANDED).parquet(path)
        log.delete(path)
    raise RuntimeError(f"other landings were faster {attempts} times")


# --- purging ---


def lease(spark: SparkSession, folder: str, holder: str, paths: list[str]) -> None:
    """Note that a running batch reads these children of a folder: a purge leaves them alone until `release`."""
    log = Log(spark, f"{folder}/_leases/{holder}")
    log.commit(len(log.entries()) + 1, {"paths": paths})


def release(spark: SparkSession, folder: str, holder: str) -> None:
    Log(spark, folder).delete(f"{folder}/_leases/{holder}")


def _leased(spark: SparkSession, folder: str) -> list[str]:
    log, out = Log(spark, folder), []
    fs, at = log._fs(), log._path("_leases")
    if fs.exists(at):
        for status in fs.listStatus(at):
            out += [p for e in Log(spark, status.getPath().toString()).entries() for p in e["paths"]]
    return out


def stale(spark: SparkSession, folder: str, as_of: datetime, hours: float = 24, live: DataFrame | None = None) -> DataFrame:
    """(child) of a folder whose files are all older than so many hours before as_of, and that nothing live (child) names. Names with an underscore first are the
    folder's own."""
    files = listed(spark, folder, "*")
    inside = F.regexp_extract(F.col("path"), r"/?" + _quoted(folder.split(":")[-1].rstrip("/")) + r"/+([^/]+)/", 1)
    found = files.withColumn("child", inside).where("child <> '' and not startswith(child, '_')").groupBy("child").agg(F.max("modified").alias("modified"))
    old = found.where(F.col("modified") < F.lit(as_of - timedelta(hours=hours))).select("child")
    return old.join(live.select("child").distinct(), "child", "left_anti") if live is not None else old


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def purge(spark: SparkSession, folder: str, as_of: datetime, hours: float = 24, live: DataFrame | None = None) -> dict[str, list[str]]:
    """Delete stale children of a folder in two phases, and return those that were marked and removed.

    What is stale and not leased is marked; what an earlier purge marked and is stale still is deleted. So a batch that takes a lease between the two keeps what it reads. The names of
    stale children come to the driver, which deletes them.
    """
    log = Log(spark, f"{folder}/_purge")
    entries = log.entries()
    held = spark.createDataFrame([(p,) for p in _leased(spark, folder)], "child string")
    now = sorted(r.child for r in stale(spark, folder, as_of, hours, held if live is None else live.select("child").unionByName(held)).collect())
    before = set(entries[-1]["marked"]) if entries else set()
    gone = [c for c in now if c in before]
    for child in gone:
        log.delete(f"{folder}/{child}")
    marked = [c for c in now if c not in before]
    log.commit(len(entries) + 1, {"marked": marked, "removed": gone, "at": as_of.isoformat()})
    return {"marked": marked, "removed": gone}


# --- logs ---


def log_tail(spark: SparkSession, path: str, lines: int = 40) -> DataFrame:
    """The last lines of a rotated log (name, name.1 before it, name.2 before that), in order: place, line.

    The order of lines is that of files, then of the blocks of a file, then of rows in a block. Each task keeps `lines` rows at most, and what is sorted in the end are
    those of all tasks: no log is sorted whole.
    """
    read = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    number = F.coalesce(F.try_to_number(F.regexp_extract("file_path", r"\.(\d{1,9})(?:/|$)", 1), F.lit("999999999")).cast("int"), F.lit(0))
    last = read.withColumn("_age", number).orderBy(F.col("_age").asc(), F.col("file_path").desc(), F.col("file_block_start").desc(), F.col("_at").desc()).limit(lines)
    numbered_ = last.select(F.struct((-F.col("_age")).alias("a"), "file_path", "file_block_start", "_at").alias("o"), "value").agg(F.sort_array(F.collect_list(F.struct("o", "value"))).alias("a"))
    return numbered_.select(F.posexplode("a").alias("n", "x")).select((F.col("n") + 1).alias("place"), F.col("x.value").alias("line"))


def settings_file(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=VALUE lines of an environment file; comments and what is no such line do not count, quotes around a value go."""
    out = {}
    for (line,) in spark.read.text(path).collect():
        key, sign, value = line.strip().partition("=")
        if sign and key and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out

