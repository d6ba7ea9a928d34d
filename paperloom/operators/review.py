"""What a reviewer sees: the table, its order, the parts of a batch, and rows of files that failed."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.rules import CATALOGUE, DESCRIPTIONS, OTHER, UNKNOWN, DocType, Settings
from ..functions.text import percent
from .naming import client_key
from .validate import validate

SCHEMA = ("first_name", "last_name", "company", "document_type", "valid_until", "city", "relationship", "confidence", "dependent_name", "child_index", "period", "title")


def page_label(long: bool = False) -> Column:
    """p1 or p1-2; long: page 1 or pages 1-2."""
    one, more = ("page ", "pages ") if long else ("p", "p")
    start, end = F.col("start_page").cast("string"), F.col("end_page").cast("string")
    return F.when(F.col("start_page") == F.col("end_page"), F.concat(F.lit(one), start)).otherwise(F.concat(F.lit(more), start, F.lit("-"), end))


def table(rows: DataFrame) -> DataFrame:
    """The review table of validated, named rows."""
    return rows.select(
        F.when(F.col("error").isNotNull(), "FAILED").otherwise(F.col("status")).alias("Status"), F.col("source_name").alias("Source"), page_label().alias("Pages"),
        F.col("document_type").alias("Type"), percent(F.col("confidence")).alias("Confidence"), F.col("file_name").alias("File name"), F.col("summary").alias("Issues"),
    )


def order() -> list[Column]:
    """What the review list sorts by: not yet exported first, then what needs a review, then what is ready, then the name."""
    urgency = F.when(F.col("error").isNotNull(), 2).when(F.col("status") == "REVIEW REQUIRED", 0).when(F.col("status") == "READY", 1).otherwise(2)
    return [F.col("exported_path").isNotNull(), urgency, F.col("file_name")]


def derived(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with is_exported, client_key and type_label, the description of their type; that of unknown where the catalogue has none."""
    known = F.from_json(F.lit(json.dumps(DESCRIPTIONS)), "map<string,string>")
    label = F.coalesce(F.try_element_at(known, F.col("document_type")), F.lit(DESCRIPTIONS["unknown"]))
    return rows.withColumns({"is_exported": F.col("exported_path").isNotNull(), "client_key": client_key(settings), "type_label": label})


def part() -> Column:
    """Which part of a batch a row is in: failed, exported, pending (needs a review) or exportable."""
    return F.when(F.col("error").isNotNull(), "failed").when(F.col("exported_path").isNotNull(), "exported").when(F.col("requires_review"), "pending").otherwise("exportable")


def type_choices(spark: SparkSession, catalogue: Sequence[DocType] = CATALOGUE) -> DataFrame:
    """(place, type_key): unknown, other, then the catalogue by its labels."""
    keys = [UNKNOWN.key, OTHER.key, *(t.key for t in sorted(catalogue, key=lambda t: t.label))]
    return spark.createDataFrame(list(enumerate(keys)), "place int, type_key string")


def as_json() -> Column:
    """The extraction schema as a JSON object; missing texts are empty, the confidence has four places."""
    value = {f: F.coalesce(F.col(f), F.lit("")) for f in SCHEMA} | {"confidence": F.round("confidence", 4), "child_index": F.col("child_index")}
    return F.to_json(F.struct(*(value[f].alias(f) for f in SCHEMA)), {"ignoreNullFields": "false"})


def failed(errors: DataFrame, settings: Settings) -> DataFrame:
    """A row, of unknown type and with all its issues, for each file (source_name, error) that could not be processed, so that failures stay visible."""
    none = F.lit(None).cast("string")
    texts = ("first_name", "last_name", "company", "valid_until", "city", "relationship", "dependent_name", "period", "title")
    x = errors.select("source_name", "error", F.lit("unknown").alias("document_type"), *(none.alias(f) for f in texts), F.lit(None).cast("int").alias("child_index"))
    x = x.withColumns({"confidence": F.lit(0.0), "start_page": F.lit(1), "end_page": F.lit(1), "file_name": F.lit(""), "exported_path": none})
    return validate(x, settings)


def with_progress(rows: DataFrame, order: str) -> DataFrame:
    """rows with their ordinal from 0 and the fraction of rows before them."""
    one = ranked(rows, [], [order], "_n")
    total = rows.agg(F.count("*").alias("_all"))  # one row
    x = one.crossJoin(F.broadcast(total)).withColumn("ordinal", F.col("_n") - 1)
    return x.withColumn("fraction", F.col("ordinal") / F.col("_all")).select(*rows.columns, "ordinal", "fraction")
