"""Column functions for the machine-readable zone of passports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MRZ_1, MRZ_2
from .text import blank_to_null, let

_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 over digits and letters (A is 10); anything else counts 0."""
    value = lambda i: F.greatest(F.instr(F.lit(_VALUES), F.substr(c, i, F.lit(1))) - 1, F.lit(0))
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), ((i - 1) % 3 + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), lambda a, i: a + value(i) * weight(i))
    return F.when(F.length(c) == 0, 0).otherwise(total % 10)


def _date(c: Column, as_of: str | None) -> Column:
    """DD.MM.YYYY of YYMMDD: of this century, or for births (as_of given) never after its year."""
    yy, mm, dd = (F.substring(c, k, 2).cast("int") for k in (1, 3, 5))
    past = F.when(yy > int(as_of[2:4]), "19").otherwise("20") if as_of else F.lit("20")
    shown = F.concat(F.substring(c, 5, 2), F.lit("."), F.substring(c, 3, 2), F.lit("."), past, F.substring(c, 1, 2))
    return F.when(mm.between(1, 12) & dd.between(1, 31), shown)


def parse_mrz(text: Column, as_of: str) -> Column:
    """A struct of the fields and the checks; null without a first line."""
    flat = F.regexp_replace(F.upper(text), "[ \t]", "")
    word = lambda g: F.initcap(F.replace(g, F.lit("<"), F.lit(" ")))

    def parsed(x: Column) -> Column:
        at = F.regexp_instr(x, F.lit(MRZ_1))
        after = F.substr(x, at + F.length(F.regexp_extract(x, MRZ_1, 0)))
        line = F.when(after.rlike(MRZ_2), after).otherwise(x)
        g = lambda n: F.regexp_extract(line, MRZ_2, n)
        ok = lambda value, digit: check_digit(value) == digit.cast("int")
        composite = F.concat(g(1), g(2), g(4), g(5), g(7), g(8), g(9), g(10))
        checks = F.when(
            line.rlike(MRZ_2),
            F.create_map(
                F.lit("document_number"), ok(g(1), F.nullif(g(2), F.lit(""))), F.lit("birth_date"), ok(g(4), F.nullif(g(5), F.lit(""))),
                F.lit("expiry_date"), ok(g(7), F.nullif(g(8), F.lit(""))), F.lit("composite"), ok(composite, F.nullif(g(11), F.lit(""))),
            ),
        )
        return F.when(
            at > 0,
            F.struct(
                blank_to_null(word(F.regexp_extract(x, MRZ_1, 1))).alias("surname"),
                blank_to_null(F.split(word(F.regexp_extract(x, MRZ_1, 2)), " ")[0]).alias("given_name"),
                blank_to_null(F.replace(g(1), F.lit("<"), F.lit(""))).alias("document_number"),
                blank_to_null(F.replace(g(3), F.lit("<"), F.lit(""))).alias("nationality"),
                F.when(line.rlike(MRZ_2), _date(F.nullif(g(7), F.lit("")), None)).alias("expiry_date"),
                F.when(line.rlike(MRZ_2), _date(F.nullif(g(4), F.lit("")), as_of)).alias("birth_date"),
                checks.alias("checks"),
                F.coalesce(F.forall(F.map_values(checks), lambda c: c), F.lit(False)).alias("verified"),
            ),
        )

    return let(flat, parsed)
