"""Names, ids and free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell one watercourse from another. Fixed values.
GENERIC_WORDS = ("river", "stream", "brook", "the", "of", "and", "upper", "lower")


def norm_name(c: Column) -> Column:
    """Upper case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def words(c: Column, least: int = 2) -> Column:
    """Distinct lower-case ASCII words of at least `least` letters, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{%d,}" % least), F.lit(0)))


def distinctive_words(c: Column, generic: tuple[str, ...] = GENERIC_WORDS) -> Column:
    return F.array_except(words(c), F.array(*map(F.lit, generic)))


def tokens(c: Column, stop: tuple[str, ...]) -> Column:
    """Words of three letters or more outside parentheses, without stop words."""
    return F.array_except(words(F.regexp_replace(c, r"\(.*?\)", " "), 3), F.array(*map(F.lit, stop)))


def share_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(distinctive_words(a), distinctive_words(b))


def slug(c: Column, most_words: int = 4) -> Column:
    parts = F.split(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), "-")
    return F.concat_ws("-", F.slice(parts, 1, most_words))


def clean(c: Column, most: int = 200) -> Column:
    """Control characters and runs of white space are one space; at most `most` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x20]+", " ")), 1, most)


def content_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def detection_limit(c: Column) -> tuple[Column, Column]:
    """'<10' to (10, '<'): value and qualifier, null where it is no number."""
    return F.regexp_extract(c, "([0-9.]+)", 1).try_cast("double"), F.regexp_extract(c, "^([<>]?)", 1)


def connection_key(ip: Column) -> Column:
    """An IPv4 address whole, an IPv6 address by its first four groups."""
    return F.when(ip.contains(":"), F.concat_ws(":", F.slice(F.split(ip, ":"), 1, 4))).otherwise(ip)
