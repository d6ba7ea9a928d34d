"""File names, client keys and numbers for names that meet."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import MOST_RULES
from ..functions.order import ranked, settled
from ..functions.rules import CATALOGUE, OTHER, UNKNOWN, DocType, Settings
from ..functions.text import file_part, let

_PLACES = {"validity": "valid_until", "period": "period", "city": "city", "title": "title"}
LONGEST = 180


def label_part(label: Column, unknown: str) -> Column:
    """A label with its placeholders filled: chunks whose placeholder is empty go. The expression is the same for all labels, which may be a column."""
    place = r"\{(\w+)\}"
    value = F.create_map(*(x for name, field in _PLACES.items() for x in (F.lit(name), file_part(F.col(field)))))

    def filled(chunk: Column) -> Column:
        found = F.try_element_at(value, F.regexp_extract(chunk, place, 1))
        whole = F.concat(F.regexp_extract(chunk, r"^([^{]*)\{", 1), found, F.regexp_extract(chunk, r"\}(.*)$", 1))
        return F.when(chunk.rlike(place), whole).otherwise(chunk)

    chunks = F.array_compact(F.transform(F.split(label, "_"), filled))
    first = F.substring_index(label, "_", 1)
    return F.coalesce(F.nullif(F.array_join(chunks, "_"), F.lit("")), F.when(first.contains("{"), F.lit(unknown)).otherwise(first))


def _whole_name(label: Column, inside: Column, unknown: str) -> Column:
    number = F.concat(F.lit("child "), F.when(F.col("child_index") > 0, F.col("child_index")).otherwise(1).cast("string"))
    relation = F.when(inside, None).when(F.col("relationship") == "spouse", "spouse").when(F.col("relationship") == "child", F.concat_ws("_", number, file_part(F.col("dependent_name"))))
    known = lambda f: F.coalesce(file_part(F.col(f)), F.lit(unknown))
    whole = F.concat(F.concat_ws("_", label_part(label, unknown), relation, known("last_name"), known("first_name"), known("company")), F.lit(".pdf"))

    def cut(name: Column) -> Column:
        short = F.concat(F.regexp_replace(F.substring(name, 1, LONGEST - 4), "[ _.]+$", ""), F.lit(".pdf"))
        return F.when(F.length(name) > LONGEST, short).otherwise(name)

    return let(whole, cut)


def file_name(settings: Settings, catalogue: tuple[DocType, ...] = (*CATALOGUE, OTHER, UNKNOWN)) -> Column:
    """Label, relationship, last name, first name and company, joined by underscores, at most 180 characters. A type that the catalogue has not is unknown."""
    types = {t.key: {"label": t.label, "inside": t.relationship_in_label} for t in catalogue}
    table = F.from_json(F.lit(json.dumps(types)), "map<string,struct<label:string,inside:boolean>>")
    default = F.struct(F.lit(UNKNOWN.label).alias("label"), F.lit(False).alias("inside"))
    return let(F.coalesce(F.try_element_at(table, F.col("document_type")), default), lambda t: _whole_name(t["label"], t["inside"], settings.unknown))


def named(rows: DataFrame, types: DataFrame, settings: Settings) -> DataFrame:
    """rows with file_name, by a table of types: type_key, label, relationship_in_label. Types that it has not take its row `unknown`, or that of the rules.

    The table is sent to all tasks, which its size must allow: more than MOST_RULES types are an error.
    """
    if types.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"a table of types has {MOST_RULES} rows at most")
    one = types.groupBy(F.col("type_key").alias("_key")).agg(F.min(F.struct(F.col("label").alias("label"), F.coalesce("relationship_in_label", F.lit(False)).alias("inside"))).alias("_type"))
    rest = one.where(F.col("_key") == UNKNOWN.key).agg(F.first("_type").alias("_rest"))
    x = rows.join(F.broadcast(one), rows["document_type"] == F.col("_key"), "left").crossJoin(F.broadcast(rest))
    default = F.struct(F.lit(UNKNOWN.label).alias("label"), F.lit(False).alias("inside"))
    kind = F.coalesce("_type", "_rest", default)
    return x.withColumn("file_name", let(kind, lambda t: _whole_name(t["label"], t["inside"], settings.unknown))).drop("_key", "_type", "_rest")


def client_key(settings: Settings) -> Column:
    part = lambda f: F.replace(F.coalesce(file_part(F.col(f)), F.lit(settings.unknown)), F.lit(" "), F.lit(""))
    return F.concat_ws("_", part("last_name"), part("first_name"))


def display_name(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("_")), F.concat_ws(", ", F.substring_index(key, "_", 1), F.regexp_extract(key, "^[^_]*_(.*)$", 1))).otherwise(key)


#: A number that numbering makes: at least 2, without leading zeros.
_NUMBER = r"(?:[2-9]|[1-9][0-9]{1,17})"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _end(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def with_number(name: Column, k: Column) -> Column:
    """The name itself for 1, else "name (k)" before its extension."""
    return F.when(k == 1, name).otherwise(F.concat(_stem(name), F.lit(" ("), k.cast("string"), F.lit(")"), _end(name)))


def _claim(name: Column) -> list[Column]:
    """Whose numbers a name that looks numbered is one of (`_of`, null for others), and which (`_m`)."""
    looks = rf"(?s)^(.*) \(({_NUMBER})\)$"
    numbered_ = _stem(name).rlike(looks)
    of = F.concat(F.regexp_extract(_stem(name), looks, 1), _end(name))
    return [F.when(numbered_, of).alias("_of"), F.when(numbered_, F.regexp_extract(_stem(name), looks, 2).cast("long")).alias("_m")]


def _settle_claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which names that look numbered get what they ask for. They come by family, then depth, then whose numbers they are, stored ones first, then in order.

    A name's rows take its free numbers upwards, so a claim on number m holds if there were so many free ones below that the rows before it did not reach m. What is
    remembered are the numbers of one name, and the names of one family whose claims failed, whose own first place is taken then.
    """
    family = of = None
    failed: set[str] = set()
    held: list[int] = []
    seen = first = 0
    for batch in batches:
        won = []
        for group, parent, name, m, place, stored, parent_stored in batch[["_family", "_of", "_nm", "_m", "_pos", "_old", "_of_old"]].itertuples(index=False):
            if group != family:
                family, of, failed = group, None, set()
            if parent != of:
                of, held, seen = parent, [], 0
                first = int(parent_stored or parent in failed)
            if stored:
                won.append(True)
            else:
                seen += 1
                won.append(m - 1 - bisect.bisect_left(held, m) - first >= place - seen)
            if won[-1]:
                bisect.insort(held, m)
            else:
                failed.add(name)
        yield batch[["_f", "_of", "_nm", "_m", "_old"]].assign(_won=won)


def numbered(rows: DataFrame, folder: str, name: str, order: str, there: DataFrame | None = None) -> DataFrame:
    """rows with unique_name: a name that its folder has already gets " (2)", " (3)" and so on, the first that is free, as if rows were named one by one in
    order, which is unique. there: (folder, name) of what is stored.

    The numbers of a name that other names hold are its taken ones. The k-th row of a name gets the k-th number that is free, which is its place among the name's
    rows and the taken numbers, these put where so many free ones lie below. Both ranks are range sorts, so no name's rows meet in one task. Only whether a name that looks
    numbered gets its own name depends on those before it: the first rows of such names, and no others, pass in order through a task for each family, that is
    names that are one without the numbers at their ends.
    """
    keep = rows.columns
    x = rows.withColumns({"_f": F.coalesce(F.col(folder).cast("string"), F.lit("")), "_nm": F.col(name), "_o": F.col(order)})
    x = ranked(x, ["_f", "_nm"], ["_o"], "_k")
    names = x.where("_k = 1").select("_f", "_nm", "_o", *_claim(F.col("_nm")))
    old = there.select(F.coalesce(F.col("folder").cast("string"), F.lit("")).alias("_f"), F.col("name").alias("_nm")).distinct() if there is not None else None
    asked = names.where("_of is not null")
    if old is not None:
        old = settled(old)
        names = names.join(old.withColumn("_old", F.lit(True)), ["_f", "_nm"], "left").withColumn("_old", F.col("_old").isNotNull())
        asked = names.where("_of is not null and not _old").drop("_old")
        asked = asked.withColumn("_old", F.lit(False)).unionByName(old.select("_f", "_nm", F.lit(None).cast(names.schema["_o"].dataType).alias("_o"), *_claim(F.col("_nm")), F.lit(True).alias("_old")).where("_of is not null"))
    else:
        names, asked = names.withColumn("_old", F.lit(False)), asked.withColumn("_old", F.lit(False))
    own = names.select("_f", F.col("_nm").alias("_of"), F.col("_old").alias("_of_old"))
    asked = settled(asked.join(own, ["_f", "_of"]))  # only of names that have rows
    taken = names.where("_old").select("_f", "_nm", F.lit(1).cast("long").alias("_t"))
    if not asked.isEmpty():
        counted = asked.select("_f", F.col("_of").alias("_nm")).distinct()
        line = x.join(counted, ["_f", "_nm"], "left_semi").select("_f", "_nm", "_o", F.lit(None).cast("string").alias("_c"))
        line = line.unionByName(asked.where("not _old").select("_f", F.col("_of").alias("_nm"), "_o", F.col("_nm").alias("_c")))
        place = ranked(line, ["_f", "_nm"], ["_o"], "_pos").where("_c is not null").select("_f", F.col("_c").alias("_nm"), "_pos")
        base = F.concat(F.regexp_replace(_stem(F.col("_nm")), rf"( \({_NUMBER}\))+$", ""), _end(F.col("_nm")))
        depth = F.size(F.regexp_extract_all(F.regexp_extract(_stem(F.col("_nm")), rf"((?: \({_NUMBER}\))+)$", 1), F.lit(r" \("), F.lit(0)))
        asked = asked.join(place, ["_f", "_nm"], "left").withColumns({"_family": F.concat_ws("\x01", "_f", base), "_depth": depth, "_pos": F.coalesce("_pos", F.lit(0))})
        asked = asked.repartition("_family").sortWithinPartitions("_family", "_depth", "_of", F.col("_old").desc(), "_o")
        passed = asked.select("_f", "_family", "_of", "_nm", "_m", "_pos", "_old", "_of_old").mapInPandas(_settle_claims, "_f string, _of string, _nm string, _m long, _old boolean, _won boolean")
        passed = settled(passed)
        taken = taken.unionByName(passed.where("_won").select("_f", F.col("_of").alias("_nm"), F.col("_m").alias("_t")))
        lost = passed.where("not _won").select("_f", "_nm", F.lit(1).cast("long").alias("_t"))
        taken = taken.unionByName(lost)
    elif old is None:
        return x.select(*keep, with_number(F.col(name), F.col("_k")).alias("unique_name"))
    taken = ranked(taken, ["_f", "_nm"], ["_t"], "_i")
    plain = x.join(taken.select("_f", "_nm").distinct(), ["_f", "_nm"], "left_anti").withColumn("_pos", F.col("_k"))
    mixed = x.join(taken.select("_f", "_nm").distinct(), ["_f", "_nm"], "left_semi")
    # a taken number stands after as many rows as there are free numbers below it
    line = mixed.select("_f", "_nm", F.struct(F.col("_k").cast("long").alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("t")).alias("_v"), F.struct(*keep).alias("_row"))
    gaps = taken.select("_f", "_nm", F.struct((F.col("_t") - F.col("_i")).cast("long").alias("v"), F.lit(1).alias("kind"), F.col("_t").alias("t")).alias("_v"), F.lit(None).cast(line.schema["_row"].dataType).alias("_row"))
    line = ranked(line.unionByName(gaps), ["_f", "_nm"], ["_v"], "_pos").where("_v.kind = 0").select("_row.*", "_pos")
    every = plain.select(*keep, "_pos").unionByName(line)
    return every.select(*keep, with_number(F.col(name), F.col("_pos")).alias("unique_name"))
