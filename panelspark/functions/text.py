"""Text expressions: whitespace, place labels, join keys, slugs."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

_ASCII_SPACE = r"[\s\x1c-\x1f]+"
_SPACE = "(?U)" + _ASCII_SPACE


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def squash(c: Column) -> Column:
    """Runs of Unicode whitespace become one blank, ends trimmed."""
    plain = F.regexp_replace(c, _ASCII_SPACE, " ")
    return F.trim(F.when(_is_ascii(c), plain).otherwise(F.regexp_replace(c, _SPACE, " ")))


def flat(c: Column) -> Column:
    """Case- and space-insensitive form used to compare headers."""
    return F.lower(squash(F.coalesce(c, F.lit(""))))


@functools.lru_cache(maxsize=None)
def _folding_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility-decomposed letters and digits, derived from the Unicode data.

    Returns (from, to) for characters that fold to one of [a-z0-9] and the pairs
    for characters that fold to several.
    """
    single_from, single_to, several = [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        ch = chr(point)
        if not unicodedata.decomposition(ch):
            continue
        base = "".join(k for k in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(k))
        folded = "".join(k for k in base.lower() if k.isascii() and k.isalnum())
        if len(folded) == 1:
            single_from.append(ch)
            single_to.append(folded)
        elif folded:
            several.append((ch, folded))
    return "".join(single_from), "".join(single_to), tuple(several)


def _char_class(chars: list[str]) -> str:
    """A regular-expression class of the characters, neighbours joined to ranges."""
    points = sorted(map(ord, chars))
    starts = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


@functools.lru_cache(maxsize=None)
def _digit_tables() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII twin, derived from the Unicode data."""
    points = [chr(p) for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Nd"]
    return "".join(points), "".join(str(unicodedata.decimal(ch)) for ch in points)


def ascii_digits(c: Column) -> Column:
    source, target = _digit_tables()
    return F.when(_is_ascii(c), c).otherwise(F.translate(c, source, target))


def norm_label(c: Column) -> Column:
    """Decompose (NFKD), drop marks, lower-case, keep [a-z0-9] only.

    Plain labels take the first branch; the folding tables are consulted only for
    labels that hold a non-ASCII character, and everything stays in the JVM.
    """
    text = F.coalesce(c, F.lit(""))
    source, target, several = _folding_tables()
    # One map literal; a text asks it once for each different rare character that it holds.
    meaning = F.create_map(*[F.lit(x) for pair in several for x in pair])
    rare = F.array_distinct(F.regexp_extract_all(text, F.lit(_char_class([a for a, _ in several])), 0))
    spread = F.aggregate(rare, text, lambda acc, ch: F.replace(acc, ch, F.element_at(meaning, ch)))
    folded = F.when(_is_ascii(text), text).otherwise(F.translate(spread, source, target))
    return F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "")


def join_key(place: Column) -> Column:
    """The only key two snapshots are joined on: the whole label, normalised."""
    return norm_label(place)


def split_place(label: Column) -> Column:
    """``struct(place, city, subdivision, country)``; the country is the last part.

    Separators are first brought to one form with empty parts dropped, so that the
    parts can be cut off by position without an array.
    """
    clean = squash(F.coalesce(label, F.lit("")))
    joined = F.regexp_replace(F.regexp_replace(clean, " ?,[ ,]*", ", "), "^[ ,]+|[ ,]+$", "")
    city = F.substring_index(joined, ", ", 1)
    country = F.when(F.contains(joined, F.lit(", ")), F.substring_index(joined, ", ", -1)).otherwise(F.lit(""))
    # What remains between ``city, `` and ``, country``.
    middle = F.char_length(joined) - F.char_length(city) - F.char_length(country) - 4
    return F.struct(
        F.when(joined == "", clean).otherwise(joined).alias("place"),
        city.alias("city"),
        F.when(middle > 0, F.substring(joined, F.char_length(city) + 3, middle)).otherwise(F.lit("")).alias("subdivision"),
        country.alias("country"),
    )


def slug_guess(name: Column, slug: Column, country: Column) -> Column:
    """A guessed page slug that the caller verifies by joining on it."""
    clean_name = squash(F.coalesce(name, F.lit("")))
    tail = F.concat(F.lit("-"), F.replace(F.lower(F.coalesce(country, F.lit(""))), F.lit(" "), F.lit("-")))
    stem = F.coalesce(slug, F.lit(""))
    stem = F.when(
        (F.length(tail) > 1) & F.endswith(stem, tail),
        F.substring(stem, F.lit(1), F.length(stem) - F.length(tail)),
    ).otherwise(stem)
    titled = F.initcap(squash(F.replace(stem, F.lit("-"), F.lit(" "))))
    words = squash(F.replace(F.when(clean_name != "", clean_name).otherwise(titled), F.lit("'"), F.lit("")))
    return F.replace(words, F.lit(" "), F.lit("-"))


def country_of_link(html: Column) -> Column:
    """Country named in the first ``country=`` link of a page, '' when there is none."""
    raw = F.regexp_extract(html, r"country=([A-Za-z%+\-']+)", 1)
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))
