"""How far a run is: stages that count their rows as they write them, and streams that tell what they have taken in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.rules import CATALOGUE, DocType, Settings
from ..operators.extract import extract
from ..operators.score import score
from ..operators.validate import count_columns
from ..sources.sinks import tally_columns
from .analyse import finished, segmented

Report = Callable[[str, float], None]


def nobody(message: str, fraction: float) -> None:
    """Where no one asks."""


class Stages:
    """A run of named stages, each written to a table. After each the report gets what was counted and the fraction of stages done; what is
    counted is observed in the pass that writes."""

    def __init__(self, spark: SparkSession, folder: str, names: Sequence[str], report: Report = nobody):
        self.spark, self.folder, self.names, self.report, self.done, self.counts = spark, folder, list(names), report, 0, {}
        report(f"{self.names[0]}: begins", 0.0)

    def run(self, rows: DataFrame, **measures: Column) -> DataFrame:
        """Write the next stage's rows and read them back."""
        name = self.names[self.done]
        seen = Observation(name)
        path = f"{self.folder}/{self.done + 1:02d}-{name}"
        every = {"rows": F.count(F.lit(1))} | measures
        rows.observe(seen, *(c.alias(k) for k, c in every.items())).write.mode("overwrite").parquet(path)
        self.counts[name] = seen.get
        self.done += 1
        self.report(f"{name}: {self.counts[name]['rows']} rows", self.done / len(self.names))
        return self.spark.read.schema(rows.schema).parquet(path)


def analysed_by_stages(pages: DataFrame, batches: DataFrame, settings: Settings, folder: str, report: Report = nobody, catalogue: tuple[DocType, ...] = CATALOGUE) -> tuple[DataFrame, dict[str, dict]]:
    """The analysis with a table for each stage, and the counts of each: of the last one those of its gate and of its export, from the pass that writes it."""
    run = Stages(pages.sparkSession, folder, ("segments", "fields", "manifest"), report)
    found = run.run(segmented(pages, catalogue), documents=F.approx_count_distinct("doc_id"))
    found = run.run(score(extract(found, settings), settings).join(batches, "doc_id"))
    found = found.withColumn("doc_ordinal", F.struct("upload_no", "seg_no")).withColumn("error", F.lit(None).cast("string"))
    failure = F.when(F.col("error").isNotNull(), F.col("error"))
    out = run.run(finished(found, settings), **count_columns(), **tally_columns(failure))
    return out, run.counts


class StreamProgress(StreamingQueryListener):
    """Reports a stream's batches: rows so far, and their fraction of `total` where that is known; 1 when the stream ends well."""

    def __init__(self, report: Report, total: int | None = None, name: str | None = None):
        self.report_, self.total, self.name, self.rows, self.ids = report, total, name, 0, set()

    def onQueryStarted(self, event) -> None:
        if self.name is None or event.name == self.name:
            self.ids.add(str(event.runId))
            self.report_("stream: begins", 0.0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.ids and p.numInputRows:
            self.rows += p.numInputRows
            self.report_(f"batch {p.batchId}: {self.rows} rows", min(1.0, self.rows / self.total) if self.total else 0.0)

    def onQueryIdle(self, event) -> None:
        """Nothing came."""

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ids:
            self.report_(f"stream: {event.exception}" if event.exception else "stream: done", self.rows / self.total if event.exception and self.total else 1.0)
