"""Streams of pages: each micro-batch is a batch of its own for whatever looks across documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import Settings
from ..plans.analyse import analysed
from ..plans.progress import Report, StreamProgress


def ingest(pages: DataFrame, target: str, checkpoint: str, settings: Settings, once: bool = True, report: Report | None = None, total: int | None = None) -> StreamingQuery:
    """Analyse a stream of pages into a table. A batch that runs again replaces its own rows, so each is there exactly once.

    report: gets messages and the fraction of `total` rows that were taken in, 1 at the end.
    """

    def batch(rows: DataFrame, number: int) -> None:
        docs = rows.select("doc_id").distinct().select("doc_id", F.lit(number).alias("batch_id"), F.col("doc_id").alias("upload_no"))
        found = analysed(rows, docs, settings).select("doc_id", "seg_no", "start_page", "end_page", "document_type", "confidence", "status", "target_dir", "unique_name")
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    if report:
        pages.sparkSession.streams.addListener(StreamProgress(report, total, name := f"ingest-{uuid.uuid4().hex}"))
    stream = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    stream = stream.queryName(name) if report else stream
    return (stream.trigger(availableNow=True) if once else stream).start()
