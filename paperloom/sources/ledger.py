"""Ledgers in a shared folder: what one run settled holds for runs that are repeated, or run beside it.

A ledger is a log of numbered commits, each a small file that only one run can create, and tables that commits name. A table without a commit does not count, so a
run that dies before its commit leaves nothing behind that others see.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Settings
from .sinks import export_manifest


class Log:
    """Commits in order. `commit` writes the next one if nobody was faster."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark._jvm

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        fs, at = self._fs(), self._path("log")
        if not fs.exists(at):
            return []
        out = []
        for name in sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")):
            stream = fs.open(self._path("log", name))
            try:
                out.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def commit(self, version: int, entry: dict) -> bool:
        """Create commit number `version`, whole and at once; False if it is there already."""
        fs, name = self._fs(), f"{version:012d}.json"
        draft, final = self._path("log", f".{uuid.uuid4().hex}"), self._path("log", name)
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            place = fs.makeQualified(draft).toUri()
            if place.getScheme() == "file":  # a link to the draft: the file system refuses a second one
                os.link(place.getPath(), fs.makeQualified(final).toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place, self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
                options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
                context.rename(draft, final, options)
            return True
        except Exception:
            if fs.exists(final):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def delete(self, path: str) -> None:
        self._fs().delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


# --- names that exports claim ---


def claimed(spark: SparkSession, folder: str) -> DataFrame | None:
    """All manifests that were committed to a ledger, with batch; None if there are none."""
    paths = [e["path"] for e in Log(spark, folder).entries()]
    return spark.read.option("basePath", folder).parquet(*paths) if paths else None


def export(rows: DataFrame, settings: Settings, folder: str, batch: str, write: Callable[[DataFrame, str], None] | None = None, attempts: int = 100) -> DataFrame:
    """The manifest of a batch, with names that no other batch of the ledger has or will have.

    A batch that was exported before, as by a run that is repeated, gets the manifest of then. Otherwise names are numbered beside all that is committed, the manifest is
    written, and committed if no other export was faster; else its names count too and the numbering begins anew. write: how a manifest goes to a folder.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, folder)
    write = write or (lambda manifest, path: manifest.write.parquet(path))
    for _ in range(attempts):
        entries = log.entries()
        mine = [e["path"] for e in entries if e["batch"] == batch]
        if mine:
            return spark.read.parquet(mine[0])
        there = claimed(spark, folder)
        there = None if there is None else there.select(F.col("target_dir").alias("folder"), F.col("unique_name").alias("name"))
        path = f"{folder}/batch={uuid.uuid4().hex}"
        write(export_manifest(rows, settings, there), path)
        if log.commit(len(entries) + 1, {"batch": batch, "path": path}):
            return spark.read.parquet(path)
        log.delete(path)
    raise RuntimeError(f"batch {batch}: other exports were faster {attempts} times")


# --- answers that models gave ---


def question_key(model: str, system: str, question) -> F.Column:
    """SHA-256 of what an answer depends on: the model's name, the system prompt and the question, each with its length before it."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(F.lit(model)), part(F.lit(system)), part(question)), 256)


def answered(rows: DataFrame, folder: str, model: str, system: str, call: Callable[[DataFrame], DataFrame], waves: int = 1) -> DataFrame:
    """rows (with question) with answer and failure, from a ledger of answers.

    call gets (question, key) rows of the keys that have no answer yet, one each, and adds answer and failure. Its rows are committed before any is used, in `waves`
    steps: a run that dies and is repeated asks again only what the step that died asked. Failures are kept, and asked again by later runs.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, folder)
    keyed = rows.withColumn("_key", question_key(model, system, F.col("question")))

    def known() -> DataFrame | None:
        paths = [e["path"] for e in log.entries()]
        if not paths:
            return None
        x = spark.read.schema("key string, answer string, failure string").parquet(*paths)
        return x.groupBy("key").agg(F.min("answer").alias("answer"), F.max("failure").alias("failure"))

    before = known()
    todo = keyed.select(F.col("_key").alias("key"), "question").where("question is not null").dropDuplicates(["key"])
    if before is not None:
        todo = todo.join(before.where("answer is not null"), "key", "left_anti")
    for wave in range(waves):
        part = todo.where(F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(waves)) == wave) if waves > 1 else todo
        path = f"{folder}/answers-{uuid.uuid4().hex}"
        call(part.select("question", "key")).select("key", "answer", "failure").write.parquet(path)
        while not log.commit(len(log.entries()) + 1, {"path": path}):
            pass  # another run's answers came between
    found = known()
    got = found.select(F.col("key").alias("_key"), "answer", F.when(F.col("answer").isNull(), F.col("failure")).alias("failure"))
    return keyed.drop("answer", "failure").join(got, "_key", "left").drop("_key", "question")

