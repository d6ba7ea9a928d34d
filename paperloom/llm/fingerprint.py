"""Operator 3: one-permutation MinHash fingerprints; DataFrame functions only.

Each shingle of five lower-cased words (fewer words: all of them, none: the empty one) is hashed once. The top bits of
the hash choose one of 128 bins, and a bin keeps its least hash. An empty bin copies a filled one by optimal
densification: it tries bins by hashes of its own number and of the attempt, the same for all texts, so that
equal sets agree in every bin. A bin stores the low eight bits of a hash of its value and its number. Two
values agree by chance in 1 of 256 cases, for which `likeness` corrects.

Texts are hashed before the next text is looked up, so each is hashed once as it is and once as edited.

Results in special cases. Null or empty text: the fingerprint of the empty shingle; two texts without words have likeness 1. Empty table: no rows. Very
long texts: whole. Repeated rows: equal fingerprints. Rows with equal or null doc_ids are put in order by shared.with_row_ids (nulls first in
descending order); equal rows are neighbours in any order, which no result can tell apart. A single row is its own next. Extra columns,
also of names used here, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bind, partitions, split_words, whole_text, with_row_ids

WORDS, BIN_BITS, LOW_BITS, TRIES = 5, 7, 8, 12
BINS = 1 << BIN_BITS
#: Rows that are meant to stand in one stretch of ids, and how many stretches there may be beyond the shuffle partitions.
STRETCH, STRETCHES = 1024, 4096


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Hashes of all shingles of an array of words."""
    return F.when(F.size(words) <= size, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(words[i + k] for k in range(size))))
    )


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _densified(least: Column) -> Column:
    """The value of each bin from a map of the filled ones."""

    def value(b: Column) -> Column:
        at = lambda k: F.try_element_at(least, k)
        tries = [at(_bin(F.xxhash64(b, F.lit(t)))) for t in range(TRIES)]
        step = F.xxhash64(b).bitwiseOR(F.lit(1))  # odd, so that the steps reach every bin
        nth = lambda t: F.pmod(b + t * F.pmod(step, F.lit(BINS)), F.lit(BINS)).cast("int")
        rest = F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda t: F.map_contains_key(least, nth(t)))
        return F.coalesce(at(b), *tries, bind(rest, lambda r: at(nth(r[0]))))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.xxhash64(value(b), b).bitwiseAND((1 << LOW_BITS) - 1).cast("smallint"))


def codes(text: Column) -> Column:
    """The low bits of each bin, as an array of numbers."""
    return bind(
        split_words(F.lower(text)),
        lambda words: bind(
            F.sort_array(shingle_hashes(words)),
            lambda h: bind(
                F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.coalesce(F.get(h, i - 1), x)))),
                lambda first: bind(F.map_from_arrays(F.transform(first, _bin), first), _densified),
            ),
        ),
    )


def packed(bins: Column) -> Column:
    """Codes as a string of hex digits, two for each bin."""
    return F.lower(F.array_join(F.transform(bins, lambda c: F.lpad(F.hex(c.cast("bigint")), LOW_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two arrays of codes."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """rows, by descending _rid, with _next: the struct of `carried` columns of the next row; after the last: the first.

    Rows are dealt into stretches of ids by approximate quantiles, some for each shuffle partition. The first row of a stretch
    also goes to the stretch before it, so a window within each stretch sees all neighbours and one shuffle suffices.
    """
    spark = rows.sparkSession
    total, low, high = rows.agg(F.count("_rid"), F.min("_rid"), F.max("_rid")).first()
    if not total:
        return rows.withColumn("_next", F.struct(*carried))
    n = min(max(STRETCHES, partitions(spark)), -(-total // STRETCH), max(1, 8 * partitions(spark)))
    bounds = []
    if n > 1:
        bounds = rows.agg(F.percentile_approx("_rid", [i / n for i in range(1, n)], 10_000)).first()[0]
    cuts = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>")
    stretch = lambda c: F.size(F.filter(cuts, lambda x: x > c))
    firsts = rows.select("_rid", stretch(F.col("_rid")).alias("s")).groupBy("s").agg(F.max("_rid").alias("r")).orderBy("s").collect()
    before = {f["r"]: firsts[i - 1]["s"] for i, f in enumerate(firsts)}  # the first stretch follows the last one
    also = F.broadcast(spark.createDataFrame(list(before.items()), "_rid bigint, _also int"))  # one row for each stretch
    dealt = rows.join(also, "_rid", "left").withColumn("_s", stretch(F.col("_rid")))
    guest = F.struct(F.col("_also").alias("to"), F.lit(True).alias("guest"))
    own = F.struct(F.col("_s").alias("to"), F.lit(False).alias("guest"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("_also").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy(F.col("_to.to")).orderBy(F.col("_to.guest"), F.col("_rid").desc())
    dealt = dealt.select(*rows.columns, "_to").withColumn("_next", F.lead(F.struct(*carried)).over(order))
    return dealt.where(~F.col("_to.guest")).drop("_to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_row_ids(docs.drop("_rid").select("doc_id", "text")).select("_rid", "doc_id", whole_text().alias("_text"))
    rows = with_next(rows.withColumn("_codes", codes(F.col("_text"))), "_text", "_codes")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("_text"), F.lit(1), n - half), F.substr(F.col("_next._text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "_codes", F.col("_next._codes").alias("_after"), edited.alias("_edited"))
    rows = rows.select("doc_id", "n_chars", "_codes", "_after", F.sha2("_edited", 256).alias("edited_sha256"), codes(F.col("_edited")).alias("_changed"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("_codes")).alias("fingerprint"), packed(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_codes"), F.col("_changed")).alias("near_edited"), likeness(F.col("_codes"), F.col("_after")).alias("near_next"),
    )
