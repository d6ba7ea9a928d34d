"""Normalised fields, issues, the gate, reviews and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalise_period, parse_date, show_date
from ..functions.rules import Settings
from ..functions.text import blank_to_null, percent, squeeze, strip, tidy_company, tidy_name
from .score import needs


def normalise(rows: DataFrame) -> DataFrame:
    child = F.coalesce(F.col("relationship") == "child", F.lit(False))
    return rows.withColumns({
        **{f: tidy_name(F.col(f)) for f in ("first_name", "last_name", "city")}, "company": tidy_company(F.col("company")),
        "title": blank_to_null(strip(squeeze(F.col("title")), " .:-_")), "valid_until": show_date(parse_date(F.col("valid_until"))),
        "period": normalise_period(F.col("period")), "dependent_name": F.when(child, tidy_name(F.col("dependent_name"))),
        "child_index": F.when(child, F.coalesce("child_index", F.lit(1))),
    })


def issues(settings: Settings) -> Column:
    """Structs (field_name, message, severity) in the order of the rules."""
    kind = F.col("document_type")

    def issue(when: Column, field: str, message: str | Column, severity: str = "error") -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.when(when, F.struct(F.lit(field).alias("field_name"), text.alias("message"), F.lit(severity).alias("severity")))

    missing = lambda f: F.col(f).isNull()
    expiry = parse_date(F.col("valid_until"))
    low = F.concat(percent(F.col("confidence")), F.lit(" is below the "), percent(F.lit(settings.threshold)), F.lit(" threshold"))
    every = F.array(
        issue(F.coalesce(kind == "unknown", F.lit(True)), "document_type", "document type could not be determined"),
        issue(missing("last_name"), "last_name", "missing"), issue(missing("first_name"), "first_name", "missing"),
        issue(missing("company"), "company", "missing", "warning"),
        issue(needs(kind, "validity") & missing("valid_until"), "valid_until", "validity date required for this document type"),
        issue(needs(kind, "validity") & (expiry < F.lit(settings.as_of).cast("date")), "valid_until", F.concat(F.lit("document expired on "), show_date(expiry)), "warning"),
        issue(needs(kind, "period") & missing("period"), "period", "payslip period (YYYY-MM) required"),
        issue(needs(kind, "city") & missing("city"), "city", "city required for town hall documents"),
        issue(needs(kind, "title") & missing("title"), "title", "this document is outside the naming convention and needs a title"),
        issue((F.col("relationship") == "child") & missing("dependent_name"), "dependent_name", "given name of the child required", "warning"),
        issue(F.col("confidence") < settings.threshold, "confidence", low, "warning"),
    )
    return F.filter(every, lambda i: i.isNotNull())


def summary(listed: Column) -> Column:
    return F.when(F.size(listed) == 0, "no issues").otherwise(F.array_join(F.transform(listed, lambda i: F.concat(i["field_name"], F.lit(": "), i["message"])), "; "))


def gate(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with requires_review and status; an approval lifts the gate."""
    review = F.exists("issues", lambda i: i["severity"] == "error") | (F.col("confidence") < settings.threshold)
    approved = F.coalesce("approved", F.lit(False)) if "approved" in rows.columns else F.lit(False)
    rows = rows.withColumn("requires_review", review & ~approved)
    return rows.withColumn("status", F.when(F.col("requires_review"), "REVIEW REQUIRED").otherwise("READY"))


def validate(rows: DataFrame, settings: Settings) -> DataFrame:
    rows = normalise(rows).withColumn("issues", issues(settings))
    return gate(rows.withColumn("summary", summary(F.col("issues"))), settings)


def review(rows: DataFrame, corrections: DataFrame, settings: Settings) -> DataFrame:
    """rows (with id) after corrections (id, changes map, approved): only keys that are present are set; confidence stays."""
    x = rows.drop("approved").join(corrections, "id", "left")
    given = lambda f: F.coalesce(F.map_contains_key("changes", F.lit(f)), F.lit(False))
    value = lambda f: F.try_element_at("changes", F.lit(f))
    fields = ("document_type", "first_name", "last_name", "company", "valid_until", "city", "relationship", "dependent_name", "period", "title")
    x = x.withColumns({f: F.when(given(f), blank_to_null(F.trim(value(f)))).otherwise(F.col(f)) for f in fields})
    x = x.withColumn("child_index", F.when(given("child_index"), F.nullif(F.trim(value("child_index")).try_cast("int"), F.lit(0))).otherwise(F.col("child_index")))
    x = x.withColumn("source", F.when(F.col("changes").isNotNull(), "manual").otherwise(F.col("source"))).drop("changes")
    return validate(x, settings)


def count_columns() -> dict[str, Column]:
    """What counts at the gate, as aggregates by name."""
    ok = F.col("error").isNull()
    return {
        "detected": F.count_if(ok), "ready": F.count_if(ok & (F.col("status") == "READY")),
        "review": F.count_if(ok & (F.col("status") == "REVIEW REQUIRED")), "failed": F.count_if(~ok),
    }


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(c.alias(k) for k, c in count_columns().items()))
