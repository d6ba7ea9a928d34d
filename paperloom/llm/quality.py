"""Operator 10: quality rules with adaptive thresholds; DataFrame functions only.

A text's measures (see `measures`) are compared with thresholds of its language and source. All of a threshold comes from
quantile sketches, which merge over partitions: a text fails where a measure lies above the upper quartile of its group by FENCE
deviations (the distance of the quartiles, as deviations of a normal distribution), or, if that is more, by what ALLOWED occurrences
are in a text of the group's median size. The latter holds for measures that are zero in most texts, whose quartiles coincide. Up
to a quarter of junk in a group moves neither much.

Groups are not cut by size. The sketched values of a group of n texts count with weight n / (n + PRIOR), the rest is those
of its language, which lean on all texts in the same way. The thresholds join the texts on language and source (nulls
are groups like others). Besides, texts of fewer than 50 words, or with over half of their words in repeated windows of three, always
fail, and do not enter the sketches. If all texts fail so, there is no threshold.

Results in special cases. Null or empty text: no words, fails. Empty table: no rows. Very long texts: whole, in time near linear.
Repeated rows and rows with equal or null doc_ids: each is judged, alike. Ties: a measure at its threshold passes. Extra columns,
also of names used here, are kept by `keep_good` and ignored by `quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, done_with, keeps_columns, split_words, stored, whole_text

FENCE, PRIOR = 8.0, 100.0
#: For each measure how many occurrences of what it counts are always allowed in a text of median size, and by which count it divides.
ALLOWED = {
    "symbol_rate": (8, "n_words"), "dup_line_rate": (3, "n_lines"), "repeat_rate": (48, "n_words"), "mark_rate": (8, "word_chars"),
    "capital_rate": (8, "word_chars"), "word_length": (8, "n_words"),
}
SIZES = ("n_words", "n_lines", "word_chars")
#: Quantiles that are sketched, and how many deviations of a normal distribution lie between the first and the last.
AT, QUARTILES = (0.25, 0.5, 0.75), 1.349


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = lambda s: F.filter(s, lambda x, k: equal(s, k - 1, x) | equal(s, k + 1, x))
        starts = bind(placed, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        return bind(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
            ),
        )

    counted = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < 4, 0).otherwise(counted)


def measures(text: Column) -> list[Column]:
    """A struct with the counts of the contract and what the rates need, computed from the words once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    of_words = bind(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [
        of_words.alias("_w"),
        of_lines.alias("_l"),
        size(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        size(r"[!-/:-@\[-`{-~]+").cast("long").alias("_marks"),
        size(r"[A-Z]+").cast("long").alias("_capitals"),
    ]


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, F.col("lang").alias("_lang"), F.col("source").alias("_source"), *measures(whole_text()))
    rows = rows.select(*keep, "_lang", "_source", "_w.*", "_l.*", "n_symbols", "_marks", "_capitals")
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        *keep, "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        part("n_symbols", "n_words").alias("symbol_rate"), part("n_dup_lines", "n_lines").alias("dup_line_rate"),
        part("n_repeat_words", "n_words").alias("repeat_rate"), part("_marks", "word_chars").alias("mark_rate"),
        part("_capitals", "word_chars").alias("capital_rate"), part("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def _mixed(n: Column, own: Column, rest: Column) -> Column:
    """The sketched values of n texts with those that they lean on."""
    w = n / (n + PRIOR)
    mix = lambda a, b: F.coalesce(w * a + (1 - w) * b, a, b)
    return F.when(own.isNull(), rest).when(rest.isNull(), own).otherwise(F.zip_with(own, rest, mix))


def thresholds(measured: DataFrame) -> DataFrame:
    """The highest values that pass, a row for each language and source."""
    # conditions within the aggregates: as a filter they would go down and compute the measures once more
    good = ~F.col("base_failed")
    sketched = [F.percentile_approx(F.when(good, F.col(m)).cast("double"), list(AT), 10_000).alias(m) for m in (*ALLOWED, *SIZES)]

    def of(*keys: str) -> DataFrame:
        return measured.groupBy(*keys).agg(F.count(F.when(good, 1)).alias("n"), *sketched)

    tag = lambda df, x: df.withColumnsRenamed({c: f"{x}{c}" for c in df.columns})
    fine, lang, top = tag(of("_lang", "_source"), "f"), tag(of("_lang"), "l"), tag(of(), "t")
    rows = fine.join(lang, F.col("f_lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(top))  # top is one row
    for m in (*ALLOWED, *SIZES):
        rows = rows.withColumn(f"q{m}", _mixed(F.col("fn"), F.col(f"f{m}"), _mixed(F.col("ln"), F.col(f"l{m}"), F.col(f"t{m}"))))

    def limit(m: str) -> Column:
        low, high = F.col(f"q{m}")[0], F.col(f"q{m}")[2]
        count, size = ALLOWED[m]
        return (high + F.greatest(FENCE * (high - low) / QUARTILES, count / F.greatest(F.col(f"q{size}")[1], F.lit(1.0)))).alias(m)

    return rows.select(F.col("f_lang").alias("_tl"), F.col("f_source").alias("_ts"), F.struct(*map(limit, ALLOWED)).alias("_t"))


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("_tl")) & F.col("_source").eqNullSafe(F.col("_ts")), "left")
    # a sum that needs both sides of the join, so that no part of it is computed again below the join
    faults = F.when(F.col("base_failed"), 1).otherwise(0)
    for m in ALLOWED:
        faults = faults + F.when(F.col(m) > F.col("_t")[m], 1).otherwise(0)
    return joined.withColumn("kept", faults == 0)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row."""
    measured = stored(_measured(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]), "quality")
    judged = _judged(measured, thresholds(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@keeps_columns
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass. Only the measures are stored, for their thresholds; each text is measured once more where it is judged, so no text is
    written or shuffled, and what stays behind is small."""
    measured = stored(_measured(docs.select("text", "lang", "source"), []), "quality")
    limits = stored(thresholds(measured), "quality-limits")
    done_with(measured)
    whole = docs.withColumn("_row", F.struct(*docs.columns)).select("text", "lang", "source", "_row")
    return _judged(_measured(whole, ["_row"]), limits).where("kept").select("_row.*")
