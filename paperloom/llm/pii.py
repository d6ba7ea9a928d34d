"""Operator 1: personal data, by rules and by bootstrapped contextual extraction; DataFrame functions only.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers. The units of a text are its words, and runs
of digit groups. A unit that holds a match of a rule is a seed, and seeds induce lexical patterns from what stands
around them (see `_patterns`). What fills the slots of these patterns elsewhere, identifier or word, makes a graph of
patterns and values:

1. *Induction.* A pattern with SUPPORT distinct seeds or more is promising.
2. *Gate.* All texts are counted for the promising patterns: at least one occurrence in FILL must hold a seed, which drops the
   contexts of ordinary words before their fillers are gathered, and at least one must hold none, as else there is nothing to find.
   The first value that becomes known needs a pattern that is confident by its seeds alone, which with s of them and one other value it is at best by
   `lower_bound(s, s + 1)`. Where no pattern reaches that, nothing can be found, and the search ends there: an exact end, before the texts are read again.
3. *Graph.* All fillers of the patterns left are gathered: (pattern, value, context).
4. *Scores.* A pattern's confidence in a kind is the lower bound (Wilson, Z deviations) of the share of its distinct values that are
   known to be of the kind. A value without a rule gets, for each kind, the noisy-or over its contexts of the best confident
   pattern in each; at ACCEPT it becomes known. This repeats until nothing new is known: known values stay, so it ends.
5. *Spans.* Known values with a digit or an @ are added wherever they stand, others only within a confident pattern, as
   kind ctx_<kind>. They never overlap spans of the rules, which all stay.

Passing the promising patterns to all texts takes a bitmap of a fixed 128 KB and an exact join after it, never a broadcast that
grows. Patterns, contexts and values meet in aggregates that combine before their shuffle.

Results in special cases. Null text: counts as empty, no spans. Empty table: no rows. Very long texts: whole, in time near linear.
Rows with equal or null doc_ids are told apart by shared.with_row_ids. Repeated rows: equal spans each; copies of a text add no
evidence, as values count once in a pattern and contexts once for a value (the gate alone counts occurrences). Ties between kinds go
to the first of KINDS. Extra columns, also of names used here, are ignored. Out of reach: identifiers of several words
without digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, kind_spans, match_spans, running_sums, span_list, stored, whole_text, with_row_ids

_LOCAL = "[A-Za-z0-9._%+-]"
#: The same matches as the plain patterns: a run is tried from its start only, and nothing is given back.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")

_GROUP = "[0-9][0-9().+/-]*+"
#: Groups of digits joined by single spaces, or what stands between white space.
UNIT = rf"[+(]*+{_GROUP}(?=\x20)(?:\x20\(?{_GROUP}(?=[\x20\x09-\x0D,;:!?]|\z))++[,;:!?]*+|[^\x20\x09-\x0D]++"
#: What a value does not have at its ends.
BEFORE, AFTER = r"""^(?:[\["'<{|*#$%&]|\((?![0-9]))+""", r"""[\])"'>},;:!?.|*#$%&]+$"""

SUPPORT, FILL, CONFIDENT, ACCEPT, Z = 3, 10, 0.5, 0.65, 2.0
#: Words of 64 bits of the bitmap, as a power of two.
MAP_BITS = 14


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(i: Column, s: Column) -> Column:
        d = F.substr(s, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return bind(
        F.reverse(digits),
        lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda a, i: a + term(i, s)) % 10 == 0,
    )


def base_spans(text: Column) -> Column:
    """All spans of the rules, sorted by start, then kind."""
    size = lambda m: F.length(_digits(m))
    some = F.when(text.rlike("[0-9]"), F.lit(True))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), match_spans(text, EMAIL)),
        "ip": F.when(some & F.contains(text, F.lit(".")), match_spans(text, IP, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
        "card": F.when(some, match_spans(text, CARD, lambda m: F.when(size(m).between(14, 19), luhn(_digits(m))).otherwise(False))),
        "phone": F.when(F.contains(text, F.lit("+")), match_spans(text, PHONE, lambda m: size(m).between(10, 15))),
    }
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>")
    return F.array_sort(F.concat(*(F.coalesce(kind_spans(found[k], k, n), empty) for n, k in enumerate(KINDS))))


def value_of(unit: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unit, BEFORE, ""), AFTER, "")


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _slots(texts: DataFrame) -> DataFrame:
    """A row for each unit of texts (_rid, _text): its number, its text, a hash of its context, and hashes of the patterns around it: the word on
    the left, two on the left, one on both sides, the word on the right, and the word on the left with the shape of the unit itself.

    Words are in lower case with zeros for digits, shapes have one letter for letters. Units are exploded, so that all of it is compiled.
    """
    flat = F.regexp_replace(F.lower("_text"), "[0-9]", "0")
    x = texts.select("_rid", _units(F.col("_text")).alias("_unit"), flat.alias("_flat"))
    x = x.select("_rid", "_unit", _units(F.col("_flat")).alias("_w"), _units(F.regexp_replace("_flat", r"\p{L}+", "a")).alias("_shape"))
    edge, size = F.lit("^"), F.size("_w")
    x = x.select(
        "_rid", "_unit", "_shape", F.slice(F.concat(F.array(edge, edge), "_w"), F.lit(1), size).alias("_b"), F.slice(F.concat(F.array(edge), "_w"), F.lit(1), size).alias("_a"),
        F.concat(F.slice("_w", F.lit(2), size), F.array(F.lit("$"))).alias("_c"), F.when(size > 0, F.sequence(F.lit(0), size - 1)).alias("_i"),
    )
    rows = x.select("_rid", F.inline(F.arrays_zip("_i", "_unit", "_shape", "_b", "_a", "_c"))).where("_i is not null")
    hashes = (F.xxhash64(F.lit(n), *columns) for n, columns in enumerate((("_a",), ("_b", "_a"), ("_a", "_c"), ("_c",), ("_a", "_shape"))))
    return rows.select("_rid", "_i", "_unit", F.xxhash64("_b", "_a", "_c").alias("context"), F.array(*hashes).alias("patterns"))


def _kind(value: Column) -> Column:
    """The kind of the first span of a rule in a value."""
    return F.when(value.rlike("[0-9@]"), F.try_element_at(base_spans(value), F.lit(1))["kind"])


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_BITS).cast("int")


def _bitmap(patterns: DataFrame) -> DataFrame:
    """One row with the bitmap of pattern hashes; what comes to the driver is at most 2^MAP_BITS rows."""
    words = [0] * (1 << MAP_BITS)
    for r in patterns.groupBy(_word(F.col("pattern")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pattern & 63 as int))")).alias("b")).collect():
        words[r["w"]] = r["b"]
    return F.broadcast(patterns.sparkSession.createDataFrame([(words,)], "_map array<bigint>"))


def _maybe(h: Column) -> Column:
    """Whether the bitmap may have a hash."""
    return F.getbit(F.get("_map", _word(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def promising(seeds: DataFrame) -> DataFrame:
    """(pattern, support, seeds): distinct seeds and occurrences with one, of the patterns that have SUPPORT distinct seeds."""
    by_value = seeds.select("value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"))
    return by_value.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("seeds")).where(F.col("support") >= SUPPORT)


def hopeless(patterns: DataFrame) -> bool:
    """Whether none of the patterns can be confident while it holds a value that is not known."""
    return patterns.where(lower_bound(F.col("support"), F.col("support") + 1) >= CONFIDENT).isEmpty()


def gated(slots: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those of the patterns whose occurrences hold a seed once in FILL at least, and not always."""
    # exploded first, so that the map is needed by the condition of the join alone, and no row carries it on
    every = slots.select(F.explode("patterns").alias("pattern")).crossJoin(_bitmap(patterns)).where(_maybe(F.col("pattern")))
    met = every.groupBy("pattern").agg(F.count("*").alias("all"))
    return patterns.join(met, "pattern").where((F.col("seeds") * FILL >= F.col("all")) & (F.col("seeds") < F.col("all"))).select("pattern", "support")


def fillers(slots: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_rid, _i, value, kind, mark, context, patterns) of the units that fill a pattern or have a digit or @ (mark).

    Their patterns may have a few hashes too many; kind is that of a seed, else null.
    """
    each = [F.col("patterns")[k] for k in range(5)]
    mark = F.col("_unit").rlike("[0-9@]")
    wanted = mark
    for h in each:
        wanted = wanted | _maybe(h)
    rows = slots.crossJoin(_bitmap(patterns)).where(wanted)  # the condition of the join itself, so that the map stays where it is
    rows = rows.withColumns({"mark": mark, "value": value_of(F.col("_unit")), "patterns": F.array_compact(F.array(*(F.when(_maybe(h), h) for h in each)))}).where(F.col("value") != "")
    return rows.select("_rid", "_i", "value", F.when(F.col("mark"), _kind(F.col("value"))).alias("kind"), "mark", "context", "patterns")


def placed(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(_rid, added): the spans of units hits (_rid, _i, kind) of texts."""
    wanted = hits.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("_i", "kind"))).alias("_s"))
    x = texts.join(wanted, "_rid").select("_rid", "_s", _units(F.col("_text")).alias("_u"), F.split("_text", UNIT, -1).alias("_gaps"))
    steps = F.zip_with("_gaps", "_u", lambda g, u: (F.length(g) + F.coalesce(F.length(u), F.lit(0))).cast("int"))
    starts = bind(steps, lambda st: bind(F.transform("_s", lambda s: s["_i"]), lambda at: running_sums(st, at)))

    def span(s: Column, start: Column) -> Column:
        unit = F.get(F.col("_u"), s["_i"])
        first = start + F.length(F.get(F.col("_gaps"), s["_i"])) + F.length(unit) - F.length(F.regexp_replace(unit, BEFORE, ""))
        return F.struct(
            first.cast("bigint").alias("start"), F.lit(len(KINDS)).alias("kind_no"), F.concat(F.lit("ctx_"), s["kind"]).alias("kind"),
            (first + F.length(value_of(unit))).cast("bigint").alias("end"), value_of(unit).alias("value"),
        )

    return x.select("_rid", F.zip_with("_s", starts, span).alias("added"))


def lower_bound(known: Column, n: Column) -> Column:
    """The least share, of n, that `known` stand for."""
    p, z2 = known / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def bootstrap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, kind) that are known without a rule, and (pattern) that are confident at the end.

    edges: distinct (pattern, value, context, kind), kind null where no rule holds. Each round is stored; there are as many as steps from
    seeds to the last value found.
    """
    values = stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-values")
    open_edges = edges.where("kind is null").select("value", "context", "pattern")
    found = values.select("value", "kind").where("false")
    while True:
        now = values.select("pattern", "value", F.col("kind").alias("own")).join(found, "value", "left").withColumn("kind", F.coalesce("own", "kind"))
        sums = now.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
        best = F.greatest(*(F.struct(F.col(k).alias("s"), F.lit(-n).alias("o"), F.lit(k).alias("kind")) for n, k in enumerate(KINDS)))
        scored = sums.select("pattern", best["kind"].alias("of"), best["s"].alias("s"), lower_bound(best["s"], F.col("n")).alias("conf"))
        scored = stored(scored.where((F.col("s") >= SUPPORT) & (F.col("conf") >= CONFIDENT)), "pii-patterns")
        fresh = open_edges.join(found.select("value"), "value", "left_anti").join(scored, "pattern")
        by_context = fresh.groupBy("value", "context", "of").agg(F.max("conf").alias("conf"))
        by_kind = by_context.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        first = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (k, -n)))
        of_value = by_kind.groupBy("value").agg(F.max(F.struct("score", first[F.col("of")].alias("o"), "of")).alias("b"))
        new = stored(of_value.where(F.col("b.score") >= ACCEPT).select("value", F.col("b.of").alias("kind")), "pii-found")
        if new.isEmpty():
            return found, scored.select("pattern")
        found = found.unionByName(new)


def find_pii(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, base and found, arrays of spans (start, kind_no, kind, end, value), of each row."""
    texts = with_row_ids(docs.drop("_rid").select("doc_id", "text")).select("_rid", "doc_id", whole_text().alias("_text"))
    base = stored(texts.select("_rid", "doc_id", base_spans(F.col("_text")).alias("base")), "pii")
    texts = texts.drop("doc_id")
    slots = _slots(texts)
    some = _slots(texts.where(F.col("_text").rlike("[0-9@]")))
    seeds = some.where(F.col("_unit").rlike("[0-9@]")).withColumn("value", value_of(F.col("_unit")))
    patterns = stored(promising(seeds.where(_kind(F.col("value")).isNotNull())), "pii-promising")
    if hopeless(patterns):
        return base.withColumn("found", F.col("base"))
    patterns = stored(gated(slots, patterns), "pii-gated")
    if hopeless(patterns):
        return base.withColumn("found", F.col("base"))
    patterns = patterns.select("pattern")
    units = stored(fillers(slots, patterns), "pii-units")
    every = units.select(F.explode("patterns").alias("pattern"), "value", "context", "kind").distinct()
    known, confident = bootstrap(stored(every.join(patterns, "pattern", "left_semi"), "pii-edges"))

    hits = units.where("kind is null").drop("kind").join(known, "value")
    plain = hits.where("not mark").select("_rid", "_i", F.explode("patterns").alias("pattern")).join(confident, "pattern", "left_semi").select("_rid", "_i").distinct()
    hits = hits.where("mark").unionByName(hits.where("not mark").join(plain, ["_rid", "_i"], "left_semi")).select("_rid", "_i", "kind")
    hits = stored(hits, "pii-hits")
    if hits.isEmpty():  # then no text needs to be read for places
        return base.withColumn("found", F.col("base"))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    whole = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return base.join(placed(texts, hits), "_rid", "left").select("_rid", "doc_id", "base", whole.alias("found"))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, a digest of the spans of the rules, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs).select("doc_id", *map(count, KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))
