"""Text, postcode and identifier expressions. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three postcode patterns, the account pattern and the number pattern.
# All end in \z because a Java "$" also accepts a trailing newline.
POSTCODE_LOOSE = r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\z"
POSTCODE_UPPER = r"^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\z"
POSTCODE_ONE_SPACE = r"^[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\z"
ACCOUNT_REF = r"^CT\d{8}\z"
PLAIN_NUMBER = r"^\d+\.?\d*\z"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """NULL and the empty string both count as missing; never NULL itself."""
    return F.coalesce(col(c) == "", F.lit(True))


def is_present(c: str | Column) -> Column:
    return ~is_missing(c)


def matches(c: str | Column, pattern: str) -> Column:
    """Two-valued regular-expression match: NULL does not match."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def strip(c: str | Column) -> Column:
    """Trim every kind of white space from both ends, tabs and no-break spaces included."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def postcode_clean(c: str | Column, spaces_only: bool = False) -> Column:
    """Upper-case postcode without white space (or without plain spaces only)."""
    return F.upper(F.replace(col(c), F.lit(" ")) if spaces_only else F.regexp_replace(col(c), r"\s+", ""))


def postcode_formatted(c: str | Column, spaces_only: bool = False, always: bool = False) -> Column:
    """Outward and inward halves with one space between them.

    Values too short to hold both halves are returned unspaced for the quality
    rules to report; ``always`` spaces them as well.
    """
    clean = postcode_clean(c, spaces_only)
    spaced = F.regexp_replace(clean, r"^(.*?)(.{0,3})$", "$1 $2")
    return spaced if always else F.when(F.length(clean) < 5, clean).otherwise(spaced)


def postcode_area(c: str | Column) -> Column:
    """First four characters of the standard form, without a trailing space ("NE8", "NE16")."""
    return F.rtrim(F.left(postcode_formatted(c), F.lit(4)))


def pseudonym(c: str | Column, salt: str = "") -> Column:
    """SHA-256 as lower-case hex; a salt guards short identifiers against look-up tables."""
    value = col(c).cast("string")
    return F.sha2(F.concat(F.lit(salt), value) if salt else value, 256)


def last_word(c: str | Column) -> Column:
    return F.element_at(F.split(F.trim(col(c)), r"\s+"), -1)


def sounds_like(full_name: str | Column, surname: str | Column, whole_name: bool = False) -> Column:
    """Soundex equality of a surname with the last word of a full name (or with all of it)."""
    name = col(full_name) if whole_name else last_word(full_name)
    return F.coalesce(F.soundex(name) == F.soundex(col(surname)), F.lit(False))


def contains_folded(c: str | Column, needle: str) -> Column:
    """Case-insensitive substring test; NULL contains nothing."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lit(needle)), F.lit(False))


def header_name(raw: str) -> str:
    """Column name for a file header cell: trimmed, lower case, white space as underscores."""
    return re.sub(r"\s+", "_", raw.strip().lower())


def numeric_cell(c: str | Column) -> Column:
    """The cell as a double when it is a plain unsigned number, else NULL."""
    text = strip(c)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def shown_value(c: str | Column) -> Column:
    """How a checked value is printed in an issue list."""
    text = col(c).cast("string")
    return F.when(text.isNull(), "(null)").when(text == "", "(empty)").otherwise(text)
