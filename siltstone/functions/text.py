"""Text measures and normal forms as column expressions.

Lengths are code points. "Blank" is what Unicode and the C0 separators count as white space, since Java's
own white-space class is narrower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class of blanks, characters per token, and marks that a copy may lose.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
CHARS_PER_TOKEN = 1.6
COPY_MARKS = r"[*_`#]"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", "")


def content_len(text: Column) -> Column:
    """Characters that are not blank: the unit of material."""
    return F.length(without_blanks(text))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{BLANK[1:]}")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def one_spaced(text: Column) -> Column:
    """Runs of blanks and line-break signs as one space, trimmed."""
    return strip(F.regexp_replace(F.replace(text, F.lit(" ¶ "), F.lit(" ")), BLANK + "+", " "))


def copy_form(text: Column) -> Column:
    """What two copies of a text share whatever their blanks and Markdown marks."""
    return without_blanks(F.regexp_replace(text, COPY_MARKS, ""))


def estimate_tokens(*texts: Column) -> Column:
    """Tokens of texts together, a half rounded to even."""
    total = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    return F.bround(total / F.lit(CHARS_PER_TOKEN), 0).cast("long")


def heading_label(description: Column) -> Column:
    """A description up to its first colon of either width."""
    return strip(F.element_at(F.split(description, "[：:]", 2), 1))


def provenance(template: Column) -> Column:
    return F.when(template.isNull(), "default").otherwise(F.concat(F.lit("#"), F.substring(F.sha1(template), 1, 8)))


def unmarked(line: Column) -> Column:
    """A line without its list mark or number."""
    return strip(F.regexp_replace(line, rf"^(?:\p{{Nd}}+{BLANK}*[.、)]|[-*•]){BLANK}*", ""))
