"""Confidence from evidence, and the propagation of companies within a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CATALOGUE, Settings

ANCHORED = ("anchor", "label", "heading", "first_lines", "legal_form", "postal_code", "guessed", "batch")
NAMES = {"validity": "valid_until", "period": "period", "city": "city", "title": "title"}


def needs(kind: Column, need: str) -> Column:
    keys = [t.key for t in CATALOGUE if need in t.needs] + (["other"] if need == "title" else [])
    return kind.isin(*keys)


def required(kind: Column) -> Column:
    """The fields that the file name of a type needs."""
    more = [F.when(needs(kind, n), F.lit(f)) for n, f in NAMES.items()]
    return F.filter(F.array(F.lit("first_name"), F.lit("last_name"), F.lit("company"), *more), lambda f: f.isNotNull())


def score(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with confidence: evidence first, then caps for what is unknown, missing or guessed."""
    kind = F.col("document_type")
    anchored = F.transform(F.filter("evidence", lambda e: e["kind"].isin(*ANCHORED)), lambda e: e["field"])
    filled = F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in ("first_name", "last_name", "company", *NAMES.values()))), lambda f: f.isNotNull())
    guessed = F.exists("evidence", lambda e: e["kind"] == "guessed")
    verified = F.exists("evidence", lambda e: e["kind"] == "verified")
    need = required(kind)
    complete = F.size(F.array_except(need, filled)) == 0
    below = settings.threshold - 0.02
    c = F.when(verified, settings.verified).when(F.size(F.array_except(need, anchored)) == 0, F.when(complete & ~guessed, settings.trusted).otherwise(F.least("keyword_confidence", F.lit(settings.cap)))).otherwise(F.least("keyword_confidence", F.lit(settings.cap)))
    c = F.when((kind == "unknown") | ((kind == "other") & F.col("title").isNull()), F.least(c, F.lit(0.30))).otherwise(c)
    c = F.when(~complete | guessed, F.least(c, F.lit(below))).otherwise(c)
    return rows.withColumn("confidence", F.round(F.greatest(F.lit(0.05), c), 3))


def propagate(rows: DataFrame, settings: Settings) -> DataFrame:
    """Fill missing companies from the same person's first document with one, else from the only company of a batch with one person.

    Columns batch_id and doc_ordinal; rows with an error neither give nor get. Persons and batches are aggregates that combine before
    their shuffle, joined back; rows without a name carry keys of their own, so that they do not meet in one task.
    A result that a model gave keeps its confidence if that is higher.
    """
    fine = F.col("error").isNull() if "error" in rows.columns else F.lit(True)
    named = F.col("last_name").isNotNull() & F.col("first_name").isNotNull()
    person = F.concat_ws("\x01", F.lower("last_name"), F.lower("first_name"))
    rows = rows.withColumn("_who", F.when(fine & named, person))
    given = rows.where(fine)
    batch = given.groupBy("batch_id").agg(F.count_distinct("company").alias("_companies"), F.count_distinct("_who").alias("_people"), F.min("company").alias("_only"))
    own = given.where(F.col("_who").isNotNull() & F.col("company").isNotNull()).groupBy("batch_id", F.col("_who").alias("_key")).agg(F.min_by("company", "doc_ordinal").alias("_own"))
    apart = F.concat(F.lit("\x02"), F.xxhash64("doc_ordinal").cast("string"))
    x = rows.withColumn("_key", F.coalesce("_who", apart)).join(own, ["batch_id", "_key"], "left").join(batch, "batch_id", "left")
    single = F.when((F.col("_companies") == 1) & (F.col("_people") <= 1), F.col("_only"))
    x = x.withColumn("_fill", F.when(F.col("_who").isNotNull() & F.col("company").isNull(), F.coalesce("_own", single)))
    note = F.array(F.struct(F.lit("company").alias("field"), F.lit("batch").alias("kind")))
    x = x.withColumn("evidence", F.when(F.col("_fill").isNotNull(), F.array_distinct(F.concat("evidence", note))).otherwise(F.col("evidence")))
    x = x.withColumn("company", F.coalesce("company", "_fill"))
    changed, before = F.col("_fill").isNotNull(), F.col("_before")
    x = score(x.withColumn("_before", F.col("confidence")), settings)
    kept = F.when(~changed, before).when(F.col("source") != "rules", F.greatest("confidence", before)).otherwise(F.col("confidence"))
    return x.withColumn("confidence", kept).drop("_who", "_key", "_own", "_companies", "_people", "_only", "_fill", "_before")
