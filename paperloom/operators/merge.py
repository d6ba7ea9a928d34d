"""What a model answers, and how it joins the rules' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CATALOGUE, RELATIONSHIPS, Settings
from ..functions.text import let

TEXTS = ("document_type", "first_name", "last_name", "company", "valid_until", "city", "relationship", "dependent_name", "period", "title")
ENTRY = "struct<" + ", ".join(f"{c}: string" for c in ("start_page", "end_page", *TEXTS, "child_index", "confidence")) + ">"
_NULLS = ("null", "none", "n/a", "unknown", "-", "")


def json_of(answer: Column) -> Column:
    """The JSON object in an answer: fences off, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def entries(answer: Column) -> Column:
    """The entries of an answer: its documents, or a bare object that names a type; null if it is neither."""
    body = json_of(answer)
    many = F.from_json(body, F.lit(f"struct<documents: array<{ENTRY}>>"))["documents"]
    one = F.from_json(body, F.lit(ENTRY))
    return F.coalesce(F.filter(many, lambda e: e.isNotNull()), F.when(one["document_type"].isNotNull(), F.array(one)))


def relationship(c: Column) -> Column:
    """spouse, child or null of a free text."""
    table = F.create_map(*(F.lit(x) for pair in RELATIONSHIPS.items() for x in pair))
    key = F.lower(F.trim(c))
    loose = F.when(F.contains(key, F.lit("child")), "child").when(F.contains(key, F.lit("spouse")), "spouse")
    return F.nullif(F.coalesce(F.try_element_at(table, key), loose), F.lit(""))


def result_of(entry: Column) -> Column:
    """An entry as a struct of clean fields: null words go, numbers are forced and clamped, types are checked."""
    text = lambda f: let(F.trim(entry[f]), lambda v: F.when(~F.lower(v).isin(*_NULLS), v))
    known = text("document_type").isin(*(t.key for t in CATALOGUE))
    other = text("document_type") == "other"
    kind = F.when(other | known, text("document_type")).otherwise(F.when(text("title").isNotNull(), "other").otherwise("unknown"))
    sure = F.least(F.greatest(F.coalesce(entry["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    doubt = F.coalesce(F.when(other, text("title").isNull()).otherwise(~known), F.lit(True))
    return F.struct(
        kind.alias("document_type"), *(text(f).alias(f) for f in TEXTS[1:6]), relationship(text("relationship")).alias("relationship"),
        *(text(f).alias(f) for f in TEXTS[7:]), entry["child_index"].try_cast("int").alias("child_index"),
        F.when(doubt, F.least(sure, F.lit(0.4))).otherwise(sure).alias("confidence"),
    )


def model_segments(answers: DataFrame) -> DataFrame:
    """Segments (doc_id, start_page, end_page, fields) of answers (doc_id, page_count, answer). Pages are forced into the document; the first
    one is the default of the last, and a range that runs backwards is turned round."""
    x = answers.select("doc_id", "page_count", F.explode(entries(F.col("answer"))).alias("e"))
    page = lambda c, default: F.greatest(F.least(F.coalesce(c.try_cast("int"), default), F.col("page_count")), F.lit(1))
    x = x.withColumn("_a", page(F.col("e.start_page"), F.lit(1))).withColumn("_b", page(F.col("e.end_page"), F.col("_a")))
    return x.select("doc_id", F.least("_a", "_b").alias("start_page"), F.greatest("_a", "_b").alias("end_page"), result_of(F.col("e")).alias("r")).select("doc_id", "start_page", "end_page", "r.*")


def verified_over(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Model segments with what verified rule segments of the same document that overlap them hold.

    rules: doc_id, start_page, end_page, document_type, last_name, first_name, valid_until, confidence, verified; evidence, if both have
    it, is united. The rule segments count in page order, each over those before it; the highest confidence stays. An
    equi-join on the document with the range as a residual condition; what is gathered are one document's segments.
    """
    fields = ("document_type", "last_name", "first_name", "valid_until")
    both = "evidence" in model.columns and "evidence" in rules.columns
    r = rules.where("verified").select("doc_id", F.struct("start_page", "end_page", *fields, "confidence", *(["evidence"] if both else [])).alias("v"))
    m = model.withColumn("_m", F.struct("start_page", "end_page"))
    hit = m.select("doc_id", "_m").distinct().join(r, "doc_id").where((F.col("_m.start_page") <= F.col("v.end_page")) & (F.col("v.start_page") <= F.col("_m.end_page")))
    x = m.join(hit.groupBy("doc_id", "_m").agg(F.array_sort(F.collect_list("v")).alias("_v")), ["doc_id", "_m"], "left")
    last = lambda f: F.try_element_at(F.filter(F.transform("_v", lambda v: v[f]), lambda c: c.isNotNull()), F.lit(-1))
    take = {f: F.coalesce(last(f), F.col(f)) for f in fields} | {"confidence": F.greatest("confidence", F.array_max(F.transform("_v", lambda v: v["confidence"])))}
    if both:
        take["evidence"] = F.when(F.col("_v").isNull(), F.col("evidence")).otherwise(F.array_distinct(F.concat("evidence", F.flatten(F.transform("_v", lambda v: v["evidence"])))))
    return x.withColumns(take).drop("_v", "_m")


def needs_help(rows: DataFrame, settings: Settings) -> Column:
    """Which rows a model should look at: unknown, below the threshold, or without a required field."""
    from .score import NAMES, required

    filled = F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in ("first_name", "last_name", "company", *NAMES.values()))), lambda f: f.isNotNull())
    return (F.col("document_type") == "unknown") | (F.col("confidence") < settings.threshold) | (F.size(F.array_except(required(F.col("document_type")), filled)) > 0)


def improve(weak: DataFrame, answers: DataFrame) -> DataFrame:
    """Weak rows with the model's fields over theirs; six fields fall back on the rules where the model is silent.

    What check digits have verified stays: type, names and validity, and the confidence if it is the higher one. A row
    whose answer has no entry stays as it is.
    """
    a = answers.select("id", result_of(F.try_element_at(entries(F.col("answer")), F.lit(1))).alias("r"), (F.size(entries(F.col("answer"))) > 0).alias("_ok"))
    x = weak.join(a, "id", "left")
    ok = F.coalesce("_ok", F.lit(False))
    sure = F.exists("evidence", lambda e: e["kind"] == "verified")
    of = lambda f: F.col(f"r.{f}")
    made = {f: of(f) for f in (*TEXTS, "child_index")}
    made |= {f: F.coalesce(of(f), F.col(f)) for f in ("first_name", "last_name", "company", "valid_until", "city", "period")}
    made |= {f: F.when(sure, F.coalesce(F.col(f), made[f])).otherwise(made[f]) for f in ("document_type", "first_name", "last_name", "valid_until")}
    note = F.array(F.struct(F.lit("fields").alias("field"), F.lit("model").alias("kind")))
    made |= {
        "confidence": F.when(sure, F.greatest(of("confidence"), F.col("confidence"))).otherwise(of("confidence")),
        "evidence": F.array_distinct(F.concat("evidence", note)), "source": F.lit("model"),
    }
    return x.withColumns({f: F.when(ok, v).otherwise(F.col(f)) for f, v in made.items()}).drop("r", "_ok")
