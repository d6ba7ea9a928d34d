"""Column functions on dates and periods in texts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DATES, EXPIRY_HINTS, MONTHS, PERIOD_HINTS
from .text import let, squeeze

_FORMATS = (
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2} \d{1,2} \d{4}$", "d M yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"), (r"^\p{L}{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}\.\p{L}{3}\.\d{4}$", "d.MMM.yyyy"), (r"^\d{8}$", "yyyyMMdd"),
)


def _short_year(v: Column) -> Column:
    """d.M.yy, where years from 69 on are of the last century."""
    yy = F.try_element_at(F.split(v, r"\."), F.lit(3)).cast("int")
    day_month = F.substring_index(v, ".", 2)
    year = (yy + F.when(yy >= 69, 1900).otherwise(2000)).cast("string")
    return F.when(v.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.to_date(F.try_to_timestamp(F.concat(day_month, F.lit("."), year), F.lit("d.M.yyyy"))))


def _months(v: Column) -> Column:
    """Month names, German or English, as English abbreviations; each word is taken by itself."""
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    parts = F.regexp_extract_all(v, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    # the month parser wants a capital and small letters
    return F.array_join(F.transform(parts, lambda p: F.initcap(F.coalesce(F.try_element_at(table, F.lower(p)), F.lower(p)))), "")


def parse_date(c: Column) -> Column:
    """The date of a string in the first format that fits, day first; null if none does."""

    def tried(v: Column) -> Column:
        return F.coalesce(*(F.when(v.rlike(r), F.to_date(F.try_to_timestamp(v, F.lit(f)))) for r, f in _FORMATS[:1]), _short_year(v),
                          *(F.when(v.rlike(r), F.to_date(F.try_to_timestamp(v, F.lit(f)))) for r, f in _FORMATS[1:]))

    # most values are short numbers: what only some need is done for those alone
    tidy = F.when(c.rlike(r"^[0-9./-]*$"), c).otherwise(squeeze(F.regexp_replace(c, r"[\x00-\x1f]", " ")))
    clean = let(tidy, lambda v: F.when(v.rlike(r"\p{L}"), _months(v)).otherwise(v))
    return let(clean, lambda v: F.coalesce(tried(v), F.when(F.contains(v, F.lit(",")), let(squeeze(F.replace(v, F.lit(","), F.lit(" "))), tried))))


def show_date(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


_WORD, _BLANK = "[0-9A-Za-z_]", r" \t\n\f\r"
_PERIODS = r"(0?[1-9]|1[0-2])\s?[./-]\s?(20\d{2})", r"(20\d{2})\s?[./-]\s?(0?[1-9]|1[0-2])"


def _plain(body: str) -> str:
    """A pattern between digits' ends, with classes of ASCII, as SQL engines read it."""
    return rf"(?<!{_WORD}){body.replace('/' + chr(92) + 's]', f'/{_BLANK}]').replace(chr(92) + 's?', f'[{_BLANK}]?')}(?!{_WORD})"


def parse_plain_date(c: Column) -> Column:
    """The date of three numbers as SQL's strptime reads it: years of fewer than four digits are taken as they stand, names of months are not read."""

    def of(shape: str, y: int, m: int, d: int, v: Column, n: Column) -> Column:
        return F.when(v.rlike(f"^{shape}$"), F.concat(F.lpad(n[y], 4, "0"), F.lit("-"), n[m], F.lit("-"), n[d]).try_cast("date"))

    short, year = r"\d{1,2}", r"\d{1,4}"
    last = lambda sep: sep.join((short, short, year))
    first = lambda sep: sep.join((year, short, short))
    read = lambda v, n: F.coalesce(
        of(last(r"\."), 2, 1, 0, v, n), of(first("-"), 0, 1, 2, v, n), of(last("/"), 2, 1, 0, v, n), of(last("-"), 2, 1, 0, v, n),
        of(first("/"), 0, 1, 2, v, n), of(last(f"[{_BLANK}]"), 2, 1, 0, v, n), of(last("/"), 2, 0, 1, v, n),
    )
    return let(c, lambda v: let(F.split(v, "[^0-9]"), lambda n: read(v, n)))


class Reading(NamedTuple):
    """How dates in texts are read."""

    dates: str
    parse: Callable[[Column], Column]
    #: Two characters, where cutting after the first one may make a date.
    cut: str
    periods: str
    lower: Callable[[Column], Column]


#: As the reference does: all scripts, names of months, years of two or four digits.
FULL = Reading("(?U)" + DATES, parse_date, r"(?U)^\d\w", "(?U)" + "|".join(rf"\b{p}\b" for p in _PERIODS), F.lower)
#: As the queries' SQL does; its lower case of a letter is one letter.
PLAIN = Reading(_plain(DATES[2:-2]), parse_plain_date, rf"^\d{_WORD}", "|".join(map(_plain, _PERIODS)), lambda c: F.lower(F.replace(c, F.lit("İ"), F.lit("i"))))


def find_dates(c: Column, reading: Reading = FULL) -> Column:
    """All dates in a text that parse, in order."""
    hits = F.regexp_extract_all(c, F.lit(reading.dates), F.lit(0))
    return F.filter(F.transform(hits, reading.parse), lambda d: d.isNotNull())


def _day_first(d: Column) -> Column:
    """Also of the year 0, which formats write as year 1 of an era."""
    return F.concat(F.date_format(d, "dd.MM."), F.lpad(F.year(d).cast("string"), 4, "0"))


def _year_first(d: Column) -> Column:
    return F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.date_format(d, "-MM"))


def normalise_period(c: Column, reading: Reading = FULL) -> Column:
    """YYYY-MM of a period or date."""

    def parts(y: Column, m: Column) -> Column:
        return F.when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0")))

    group = lambda n: F.regexp_extract(c, reading.periods, n)
    return F.coalesce(
        F.when(c.rlike(r"^20\d{2}-(0[1-9]|1[0-2])$"), c), F.when(~c.rlike(r"^\d{1,2}[./-]\d{4}$"), F.date_format(parse_date(c), "yyyy-MM")),
        parts(group(2), group(1)), parts(group(3), group(4)),
    )


def dates_at(text: Column, reading: Reading = FULL) -> Column:
    """What may be a date in a text, in order: structs (start, end, d) of 0-based positions and the date, null if it does not parse."""
    pattern = reading.dates

    def placed(hits: Column, pieces: Column) -> Column:
        # a hit starts after all pieces and hits before it
        before = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), lambda n, h: n + F.length(h))
        return F.transform(
            hits, lambda h, i: let(before(i), lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), reading.parse(h).alias("d")))
        )

    none = F.array().cast("array<struct<start:int,end:int,d:date>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(hits, pieces))).otherwise(none),
    )


def _places(text: Column, hints: tuple[str, ...], reading: Reading) -> Column:
    """Where the hints that a text holds first stand, 1-based, in the order of the hints."""
    return let(reading.lower(text), lambda low: F.filter(F.array(*(F.instr(low, h) for h in hints)), lambda at: at > 0))


def next_date(text: Column, found: Column, at: Column, size: int, reading: Reading = FULL) -> Column:
    """The first date that parses within `size` characters from a place on. found: dates_at(text, reading).

    The dates of the text serve, unless the window's ends cut one, or a run of digits that makes one when it is cut: then the window is read by itself.
    """
    low, high = at - 1, at - 1 + size
    cut = F.exists(found, lambda x: ((x["start"] < low) & (low < x["end"])) | ((x["start"] < high) & (high < x["end"])))
    cut = cut | F.substr(text, high, F.lit(2)).rlike(reading.cut)
    whole = F.get(F.filter(found, lambda x: (x["start"] >= low) & (x["end"] <= high) & x["d"].isNotNull()), F.lit(0))["d"]
    return F.when(cut, F.try_element_at(find_dates(F.substr(text, at, F.lit(size)), reading), F.lit(1))).otherwise(whole)


def find_expiry(text: Column, reading: Reading = FULL) -> Column:
    """A struct (value, kind): the first date after a hint, or the latest one as a guess. Each date of a text is parsed once."""

    def chosen(found: Column) -> Column:
        hinted = F.get(F.filter(F.transform(_places(text, EXPIRY_HINTS, reading), lambda at: next_date(text, found, at, 120, reading)), lambda d: d.isNotNull()), F.lit(0))
        late = F.array_max(F.filter(F.transform(found, lambda x: x["d"]), lambda d: F.year(d) >= 2000))
        return let(
            F.struct(hinted.alias("h"), late.alias("l")),
            lambda x: F.struct(_day_first(F.coalesce(x["h"], x["l"])).alias("value"), F.when(x["h"].isNotNull(), "label").when(x["l"].isNotNull(), "guessed").alias("kind")),
        )

    return let(dates_at(text, reading), chosen)


def find_period(text: Column, reading: Reading = FULL) -> Column:
    """A struct (value, kind): the first period after a hint, or that of the first date as a guess."""
    near = F.transform(_places(text, PERIOD_HINTS, reading), lambda at: normalise_period(F.substr(text, at, F.lit(60)), reading))
    hinted = F.get(F.filter(near, lambda p: p.isNotNull()), F.lit(0))
    first = let(F.try_element_at(find_dates(text, reading), F.lit(1)), _year_first)
    return let(
        hinted,
        lambda h: F.struct(F.coalesce(h, first).alias("value"), F.when(h.isNotNull(), "label").when(first.isNotNull(), "guessed").alias("kind")),
    )
