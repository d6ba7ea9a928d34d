"""The analysis of a batch as one lazy plan: pages to named, validated, routed documents.

Everything up to the scores is by document: one shuffle on doc_id. Only `propagate` looks across documents, by batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import settled
from ..functions.rules import CATALOGUE, DocType, Settings
from ..operators.classify import classify
from ..operators.extract import extract
from ..operators.score import propagate, score
from ..operators.segment import reclassified, segments
from ..operators.validate import normalise, validate
from ..sources.models import Model, with_model
from ..sources.sinks import export_manifest


def segmented(pages: DataFrame, catalogue: tuple[DocType, ...] = CATALOGUE) -> DataFrame:
    """Segments of pages (doc_id, page_no, text, headings) with their second classification and headings."""
    return reclassified(segments(classify(pages, catalogue)), catalogue)


def finished(found: DataFrame, settings: Settings) -> DataFrame:
    """Scored segments of whole batches: tidied, completed within their batch, validated and named, in this order, so that two spellings that
    tidying makes one count as one. Rows with an error stay out of the counts and of the manifest. What was extracted is settled, without the
    texts, before it is used for several aggregates, and once more before the names."""
    tidy = settled(normalise(settled(found.drop("text", "headings"))))
    return export_manifest(settled(validate(propagate(tidy, settings), settings)), settings)


def analysed(
    pages: DataFrame, batches: DataFrame, settings: Settings, catalogue: tuple[DocType, ...] = CATALOGUE, *,
    segmenter: Callable[[DataFrame, tuple[DocType, ...]], DataFrame] = segmented, ocr: Callable[[DataFrame], DataFrame] | None = None,
    model: Model | None = None, system: str = "", model_first: bool = False, ledger: str | None = None, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Documents of pages. batches: doc_id, batch_id, upload_no.

    segmenter: pages to segments; ocr: pages to pages, before everything else; model, system, model_first, ledger and wait: as `with_model` has them.
    """
    pages = ocr(pages) if ocr else pages
    found = score(extract(segmenter(pages, catalogue), settings), settings)
    if model is not None:
        found = with_model(settled(found), pages, model, settings, system, wait, model_first, ledger)
    found = found.join(batches, "doc_id")
    found = found.withColumn("doc_ordinal", F.struct("upload_no", "seg_no")).withColumn("error", F.lit(None).cast("string"))
    return finished(found, settings)
