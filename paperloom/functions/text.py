"""Column functions on strings. Missing values are null throughout; blank results become null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import LABEL_WORDS, NOT_A_PERSON, TITLES

#: All white space, also the separators that a Unicode class leaves out.
_OTHER = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[ {_OTHER}]+"
#: Runs that are not one plain space: what squeezing has to change, which in most texts is little.
_UNEVEN = rf"[{_OTHER}][ {_OTHER}]*+|\x20[ {_OTHER}]++"
#: The spaces of all scripts, without line breaks and tabs: what SQL's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ANY = "(?iuU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def haystack(c: Column) -> Column:
    """The form in which keywords are looked for."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def strip(c: Column, chars: str) -> Column:
    """c without any of the characters at its ends."""
    quoted = "".join("\\" + x if x in r"\]^-[" else x for x in chars)
    return F.regexp_replace(c, f"^[{quoted}]+|[{quoted}]+$", "")


def char_count(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), WS, ""))


def needs_ocr(c: Column, least: int) -> Column:
    return char_count(c) < least


def drop_label_words(c: Column) -> Column:
    """c without trailing words that begin the next label."""
    words = "|".join(LABEL_WORDS)
    return blank_to_null(F.regexp_replace(squeeze(c), rf"{ANY}(?:(?:^|\s)[:,.]*(?:{words})[:,.]*)+$", ""))


def split_name(c: Column) -> Column:
    """A struct (first, last) from "First Last" or "Last, First"; a single word is a last name."""
    return let(
        drop_label_words(c),
        lambda v: let(
            F.split(v, " "),
            lambda w: F.when(
                F.contains(v, F.lit(",")),
                F.struct(
                    blank_to_null(F.split(F.trim(F.regexp_extract(v, ",(.*)$", 1)), " ")[0]).alias("first"),
                    blank_to_null(F.trim(F.substring_index(v, ",", 1))).alias("last"),
                ),
            ).otherwise(F.struct(F.when(F.size(w) > 1, w[0]).alias("first"), F.element_at(w, -1).alias("last"))),
        ),
    )


def is_person(c: Column) -> Column:
    """Two or three capitalised words without digits, none of which rules a name out."""
    token = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'\-]{1,20}$|^[A-ZÄÖÜ]{2,20}$"
    return let(
        F.split(squeeze(F.replace(c, F.lit(","), F.lit(" "))), " "),
        lambda w: F.coalesce(
            ~c.rlike(r"(?U)\d") & F.size(w).between(2, 3) & F.forall(w, lambda x: x.rlike(token))
            & ~F.arrays_overlap(F.transform(w, F.lower), F.array(*map(F.lit, NOT_A_PERSON))),
            F.lit(False),
        ),
    )


def normalise_title(c: Column) -> Column:
    """A heading as a title: known ones get their spelling, all-capital and all-small ones are capitalised."""
    small = F.array(*map(F.lit, ("of", "and", "the", "for", "in", "on", "zur", "der", "die", "das", "und")))
    known = F.create_map(*(F.lit(x) for t in TITLES for x in (t.lower(), t)))

    def capital(v: Column) -> Column:
        words = F.transform(F.split(F.lower(v), " "), lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.initcap(w)))
        one_case = ((v == F.upper(v)) | (v == F.lower(v))) & (F.upper(v) != F.lower(v))
        return F.when(one_case, F.array_join(words, " ")).otherwise(v)

    return let(
        blank_to_null(strip(squeeze(c), " :;.-_")),
        lambda v: F.coalesce(F.try_element_at(known, F.lower(v)), F.trim(F.substring(capital(v), 1, 60))),
    )


def is_title_noise(c: Column) -> Column:
    return c.rlike(r"(?iuU)^(?:page|seite)\s*\d+")


def tidy_name(c: Column) -> Column:
    clean = strip(squeeze(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]", " "), r"(?U)[^\w\s'\-.]", "")), " -.")
    one_case = ((clean == F.upper(clean)) | (clean == F.lower(clean))) & (F.upper(clean) != F.lower(clean))
    return blank_to_null(F.when(one_case, F.initcap(clean)).otherwise(clean))


def tidy_company(c: Column) -> Column:
    return blank_to_null(strip(squeeze(c), " ,;-."))


def file_part(c: Column) -> Column:
    """Safe within a file name: no illegal characters, no underscores."""
    return blank_to_null(strip(squeeze(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f_]', " ")), " ."))


def folder_name(c: Column, fallback: str = "UNKNOWN") -> Column:
    return F.coalesce(blank_to_null(strip(squeeze(F.regexp_replace(c, r"(?U)[^\w.\- ]+", "")), " .")), F.lit(fallback))


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def size_mb(n_bytes: Column) -> Column:
    """Megabytes with one decimal place; halves go to the even neighbour."""
    return F.concat(F.format_string("%.1f", F.bround(n_bytes / 1048576, 1)), F.lit(" MB"))


def size_kb(n_bytes: Column, places: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{places}f", F.bround(n_bytes / 1024, places)), F.lit(" KB"))


def find(c: Column, pattern: str, group: int = 1, flags: str = ANY) -> Column:
    """The group of the first match, trimmed; null without one."""
    return blank_to_null(F.trim(F.regexp_extract(c, flags + pattern, group)))
