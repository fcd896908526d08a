"""Text expressions: names, transcripts, pseudonyms, records, safe spreadsheet cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FIELD = 2000
PUNCTUATION = ".,?!;:"


def normalise_name(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def group_key(s: Column) -> Column:
    """Key of a free-text group name: trimmed, lower case, a fixed word when blank."""
    return F.coalesce(F.nullif(F.lower(F.trim(s)), F.lit("")), F.lit("(no village)"))


def group_display(s: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit("(no village)"))


def normalise_transcript(s: Column, letters: str = "a-zĩũ'") -> Column:
    kept = F.regexp_replace(F.lower(s), f"[^{letters} ]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def words(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def split_sentences(s: Column) -> Column:
    return F.filter(F.split(F.trim(s), r"(?<=[.?!])\s+"), lambda x: x != "")


def pseudonymise(value: Column, prefix: str = "member|", salt: str = "") -> Column:
    """SHA-256 under a domain prefix. Short numeric ids can be guessed without a secret `salt`: pass one."""
    return F.when(value.isNotNull(), F.sha2(F.concat(F.lit(salt + prefix), value), 256))


def guard_cell(s: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe; null becomes empty."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"^([=+\-@\t\r])", "'$1")


def csv_cell(s: Column) -> Column:
    """A guarded cell, quoted when it holds a comma, a quote or a line break."""
    safe = guard_cell(s)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[",\r\n]'), quoted).otherwise(safe)


def clean_fields(names: Sequence[str]) -> list[Column]:
    """The known fields as strings, each cut to the longest allowed length."""
    return [F.substring(F.col(n).cast("string"), 1, MAX_FIELD).alias(n) for n in names]


def required(names: Sequence[str]) -> Column:
    keep = F.lit(True)
    for n in names:
        keep = keep & F.coalesce(F.col(n) != "", F.lit(False))
    return keep


def out_of_vocabulary(text: Column, vocabulary: Sequence[str]) -> Column:
    """Sorted distinct characters that a vocabulary lacks, punctuation left out."""
    known = F.array(*[F.lit(c) for c in sorted(set(vocabulary) | set(PUNCTUATION))])
    return F.array_sort(F.array_except(F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c != "")), known))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over words: each distinct word of the pair becomes one code point, then `levenshtein`."""
    base = 0x10000
    table = F.array_distinct(F.concat(a, b))

    def encode(side: Column, known: Column) -> Column:
        points = F.transform(side, lambda w: F.lpad(F.hex(F.array_position(known, w) + base), 8, "0"))
        return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")

    return F.get(F.transform(F.array(table), lambda t: F.levenshtein(encode(a, t), encode(b, t))), F.lit(0))
