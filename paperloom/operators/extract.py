"""Fields from segment texts as ordered evidence: machine-readable zone, anchors of the type, labels, finders, positions.

Each field is one coalesce in that order. Beside it stands how it was found, which the confidence rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import find_expiry, find_period
from ..functions.mrz import parse_mrz
from ..functions.rules import ANCHORS, CATALOGUE, COMPANY, EMPLOYER_SECTIONS, LABELS, POSTCODE_CITY, Settings
from ..functions.text import drop_label_words, find, is_person, is_title_noise, let, normalise_title, split_name, squeeze, strip

FIELDS = ("last_name", "first_name", "company", "valid_until", "city", "period", "title")


def needing(field: str) -> tuple[str, ...]:
    return tuple(t.key for t in CATALOGUE if field in t.needs)


def anchor(text: Column, kind: Column, field: str) -> Column:
    """The value of a field's anchor for the segment's type."""
    out = F.lit(None).cast("string")
    for key, rules in ANCHORS.items():
        if field in rules:
            out = F.when(kind == key, drop_label_words(find(text, rules[field]))).otherwise(out)
    return out


def label(text: Column, field: str) -> Column:
    return drop_label_words(find(text, LABELS[field]))


def companies(text: Column) -> Column:
    """All names with a legal form, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?U)" + COMPANY), F.lit(1)), squeeze))


def company(text: Column, kind: Column) -> Column:
    """The first company; in a CV the first one soon after the heading of an employment section."""

    def after(marker: str) -> Column:
        at = F.instr(F.lower(text), marker)
        return F.when((at > 0) & (kind == "03_cv"), F.try_element_at(companies(F.substr(text, at, F.lit(600))), F.lit(1)))

    return F.coalesce(*map(after, EMPLOYER_SECTIONS), F.try_element_at(companies(text), F.lit(1)))


def first_lines(text: Column, n: int, breaks: str = r"\r\n|\n|\r") -> Column:
    return F.slice(F.split(text, breaks, -1), 1, n)


def person(headings: Column, text: Column) -> Column:
    """A struct (first, last, kind) from the headings, else from the first eight lines."""
    lines = F.transform(first_lines(text, 8), lambda x: strip(x, " \t|-"))
    pick = lambda a: F.try_element_at(F.filter(a, is_person), F.lit(1))
    return let(
        F.struct(pick(headings).alias("h"), pick(lines).alias("t")),
        lambda p: let(
            split_name(F.coalesce(p["h"], p["t"])),
            lambda n: F.struct(n["first"].alias("first"), n["last"].alias("last"), F.when(p["h"].isNotNull(), "heading").otherwise("first_lines").alias("kind")),
        ),
    )


def title(headings: Column, text: Column) -> Column:
    """A struct (value, kind): the first heading that is a title, else one of the first six lines."""
    fits = lambda x: ~is_person(x) & ~is_title_noise(x)
    words = lambda x: F.size(F.split(x, " "))
    of = lambda a, most: F.try_element_at(F.filter(F.transform(F.filter(a, fits), normalise_title), lambda x: x.isNotNull() & words(x).between(2, most)), F.lit(1))
    # in a lambda of its own, as F.trim would take the line's number for the characters to trim
    lines = F.filter(F.transform(first_lines(text, 6), lambda x: F.trim(x)), lambda x: x != "")
    return let(
        F.struct(of(headings, 1000).alias("h"), of(lines, 8).alias("t")),
        lambda p: F.struct(F.coalesce(p["h"], p["t"]).alias("value"), F.when(p["h"].isNotNull(), "heading").when(p["t"].isNotNull(), "first_lines").alias("kind")),
    )


def extract(found: DataFrame, settings: Settings) -> DataFrame:
    """Segments (document_type, keyword_confidence, text, headings) with FIELDS, dependent_name, relationship, child_index, evidence."""
    text, kind, heads = F.col("text"), F.col("document_type"), F.col("headings")
    x = found.withColumn("headings", F.coalesce("headings", F.array().cast("array<string>"))).withColumn("text", F.coalesce("text", F.lit("")))
    x = x.withColumns({
        "_mrz": parse_mrz(text, settings.as_of), "_full": split_name(anchor(text, kind, "full_name")),
        "_person": person(heads, text), "_title": title(heads, text), "_child": anchor(text, kind, "dependent_name"),
    })
    x = x.withColumns({
        "_expiry": F.when(kind.isin(*needing("validity")), find_expiry(text)), "_period": F.when(kind.isin(*needing("period")), find_period(text)),
    })
    postcode = F.when(kind.isin(*needing("city")), drop_label_words(find(text, POSTCODE_CITY, flags="(?U)")))
    mrz_kind = F.when(F.col("_mrz.verified"), "verified").otherwise("mrz_unverified")
    ways = {
        "last_name": [(F.col("_mrz.surname"), mrz_kind), (F.col("_full.last"), "anchor"), (label(text, "last_name"), "label"), (F.col("_person.last"), F.col("_person.kind"))],
        "first_name": [(F.col("_mrz.given_name"), mrz_kind), (F.col("_full.first"), "anchor"), (label(text, "first_name"), "label"), (F.col("_person.first"), F.col("_person.kind"))],
        "company": [(anchor(text, kind, "company"), "anchor"), (label(text, "company"), "label"), (company(text, kind), "legal_form")],
        "valid_until": [(F.col("_mrz.expiry_date"), mrz_kind), (F.col("_expiry.value"), F.col("_expiry.kind"))],
        "city": [(anchor(text, kind, "city"), "anchor"), (postcode, "postal_code"), (label(text, "city"), "label")],
        "period": [(anchor(text, kind, "period"), "anchor"), (F.col("_period.value"), F.col("_period.kind"))],
        "title": [(F.when(kind.isin("unknown", "other"), F.col("_title.value")), F.col("_title.kind"))],
    }
    named = {}
    for f, options in ways.items():
        named[f"_{f}"] = F.coalesce(
            *(F.when(v.isNotNull(), F.struct(v.alias("value"), (k if isinstance(k, Column) else F.lit(k)).alias("kind"))) for v, k in options)
        )
    x = x.withColumns(named)
    note = lambda f: F.when(F.col(f"_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"_{f}.kind").alias("kind")))
    evidence = F.filter(F.array(*map(note, FIELDS)), lambda e: e.isNotNull())
    child = F.col("_child")
    x = x.withColumns({f: F.col(f"_{f}.value") for f in FIELDS} | {"evidence": evidence, "dependent_name": F.coalesce(split_name(child)["first"], child)})
    named = [t.key for t in CATALOGUE if t.relationship_in_label]
    of_label = F.when(kind.isin(*named), F.when(kind.endswith("spouse"), "spouse").otherwise("child"))
    x = x.withColumns({
        "document_type": F.when((kind == "unknown") & F.col("title").isNotNull(), "other").otherwise(kind),
        "relationship": F.coalesce(of_label, F.when(F.col("dependent_name").isNotNull(), "child")),
        "child_index": F.lit(None).cast("int"), "source": F.lit("rules"),
    })
    return x.drop(*(c for c in x.columns if c.startswith("_")))
