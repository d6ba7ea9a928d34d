"""Keyword scores, the best type, and its confidence. All of it is one expression for each row: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords
from ..functions.rules import AMBIGUOUS, AMBIGUOUS_TOP, CATALOGUE, CONFIDENCE, CONFIDENCE_TOP, DocType
from ..functions.text import haystack


def scores(text: Column, catalogue: tuple[DocType, ...] = CATALOGUE) -> Column:
    """Structs (score2, rank, type_key) of the types with hits, best first; score2 is in half points.

    A keyword counts twice at most. Equal scores follow the catalogue. All keywords are looked for in one pass (`functions.keywords`).
    """
    return keywords.scores(haystack(text), catalogue)


def confidence(best2: Column, second2: Column, cap: float = 0.55) -> Column:
    """Confidence of the best score: a table, as rounding differs between engines."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    close = second2 * 10 > best2 * 8
    value = F.when(close, F.coalesce(F.try_element_at(table(AMBIGUOUS), best2), F.lit(AMBIGUOUS_TOP))).otherwise(
        F.coalesce(F.try_element_at(table(CONFIDENCE), best2), F.lit(CONFIDENCE_TOP))
    )
    return F.when(best2.isNull(), 0.10).when(best2 < 5, F.least(F.lit(cap), 0.20 + best2 / 50)).otherwise(F.least(F.lit(cap), value))


def classify(pages: DataFrame, catalogue: tuple[DocType, ...] = CATALOGUE, text: str = "text") -> DataFrame:
    """pages with page_type, best2, second2 and page_confidence."""
    pages = pages.withColumn("_scores", scores(F.col(text), catalogue))
    at = lambda n: F.try_element_at("_scores", F.lit(n))["score2"]
    pages = pages.withColumns({"best2": at(1), "second2": F.coalesce(at(2), F.lit(0)), "_top": F.try_element_at("_scores", F.lit(1))["type_key"]})
    kind = F.when(F.col("best2") >= 5, F.col("_top")).otherwise("unknown")
    return pages.withColumns({"page_type": kind, "page_confidence": confidence(F.col("best2"), F.col("second2"))}).drop("_scores", "_top")
