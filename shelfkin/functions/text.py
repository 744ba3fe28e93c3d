"""Text expressions for item and interaction cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of Python's `str`, as characters and as a Java class (with the
# U flag `\s` is Unicode whitespace, which lacks only the four separators), and the patterns
# of the description clean-up in the order they apply.  (?iUd) = ignore case, Unicode
# classes and case folding, `\n` as the only line end.
WHITESPACE_CHARACTERS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85"
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = r"[\s\x1c\x1d\x1e\x1f]"
SOURCE_NOTE = rf"(?iUd)[(\[]{WHITESPACE}*Source:[^)\]]+[)\]]"
TRAILING_NOTE = r"(?iud)Note:[^.]*\.?$"
LINE_BREAK_TAG = rf"(?iUd)<br{WHITESPACE}*/?>"
WHITESPACE_RUN = rf"(?U){WHITESPACE}{{2,}}"

TITLE_KEYS = ("english", "romaji", "native")


def clean_title(title: Column) -> Column:
    """First non-empty of english, romaji, native, in lower case.

    `title` is a VARIANT: an object of names, or a plain string (which may be empty).
    Anything else gives null.  The named fields are tried first, so the type test, which
    walks the whole value, runs only for rows that have none of them.
    """
    names = [F.nullif(F.try_variant_get(title, f"$.{k}", "string"), F.lit("")) for k in TITLE_KEYS]
    plain = F.when(F.schema_of_variant(title) == "STRING", F.try_variant_get(title, "$", "string"))
    return F.lower(F.coalesce(*names, plain))


def clean_tags(tags: Column) -> Column:
    """Lower-case names of an array of tag objects; order and repeats kept, never null.

    A plain string becomes a one-element array; entries without a name are skipped.
    """
    entries = F.try_variant_get(tags, "$", "array<variant>")
    names = F.transform(entries, lambda v: F.try_variant_get(v, "$.name", "string"))
    names = F.transform(F.filter(names, lambda n: n != ""), F.lower)
    plain = F.when(
        F.schema_of_variant(tags) == "STRING",
        F.array(F.lower(F.try_variant_get(tags, "$", "string"))),
    )
    return F.coalesce(names, plain, F.array().cast("array<string>"))


def clean_description(text: Column) -> Column:
    """Drop source attributions, one trailing note and <br> tags, then tidy whitespace."""
    out = F.regexp_replace(text, SOURCE_NOTE, "")
    out = F.regexp_replace(out, TRAILING_NOTE, "")
    out = F.regexp_replace(out, LINE_BREAK_TAG, " ")
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, WHITESPACE_RUN, " ")
    return F.btrim(out, F.lit(WHITESPACE_CHARACTERS))


def upper_status(status: Column) -> Column:
    return F.upper(status)


def render_tags(tags: Column) -> Column:
    """Tags as display text."""
    return F.array_join(tags, ", ")
