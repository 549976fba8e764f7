"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.split and str.strip take for white space, Java's Unicode class plus four separators.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FINAL_STEP = 143_000

_NUMBER = r"(-?\d[\d,]*(?:\.\d+)?)"


def byte_length(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text)


def words(text: Column) -> Column:
    """Words between white space of any kind, without empty ones; null stays null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.regexp_replace(text, f"{SPACE}+$", "")


def strip_punctuation(text: Column) -> Column:
    """Without ASCII punctuation at both ends."""
    return F.btrim(text, F.lit(PUNCTUATION))


def first_word(text: Column) -> Column:
    """The first word, or the empty string."""
    return F.coalesce(F.get(words(text), F.lit(0)), F.lit(""))


def last_word_split(text: Column) -> tuple[Column, Column]:
    """Context and target: the text parted at its last space; without a space the context is empty."""
    body = rstrip(text)
    target = F.substring_index(body, " ", -1)
    context = F.substring(body, F.lit(1), F.greatest(F.length(body) - F.length(target) - 1, F.lit(0)))
    return context, target


def truncate_at(text: Column, stops: list[str] | None) -> Column:
    """The text before the earliest stop; empty stops are ignored."""
    return reduce(lambda t, s: F.substring_index(t, s, 1), [s for s in stops or [] if s], text)


def extract_number(text: Column) -> Column:
    """The answer's number: after the last ``Final answer:``, else after the last ``####``, else the last number; null if there is none."""

    def last(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))

    found = F.coalesce(last(r"(?i)final answer:\s*" + _NUMBER), last(r"####\s*" + _NUMBER), last(_NUMBER))
    return F.replace(found, F.lit(","), F.lit("")).cast("double")


def gold_number(answer: Column) -> Column:
    """The number after the last ``####``; fails on text that holds none."""
    return F.replace(strip(F.substring_index(answer, "####", -1)), F.lit(","), F.lit("")).cast("double")


def revision_step(revision: Column) -> Column:
    """Training step of a revision label: ``main`` is the last, ``step<N>`` is N, any other null."""
    step = F.regexp_extract(revision, r"^step(\d+)$", 1)
    return F.when(revision == "main", FINAL_STEP).when(step != "", step.try_cast("int"))


def sha_prefix(text: Column, n: int = 16) -> Column:
    """The first hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def argmax_first(values: Column) -> Column:
    """Index from 0 of the greatest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def array_total(values: Column) -> Column:
    """Sum of an array's elements, 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def utc_iso(ts: Column) -> Column:
    """ISO 8601 in seconds, with offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
