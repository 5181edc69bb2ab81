"""String expressions with the white-space and formatting rules of invoice texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: Unicode's, and the four ASCII separators.
_WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, rf"(?U){_WS}+", " ")


def key(c: Column) -> Column:
    """Matching key: stripped, lower case, single spaces."""
    return collapse(F.lower(strip(c)))


def clean(c: Column) -> Column:
    """Stripped; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def fold_ocr(c: Column) -> Column:
    """Digits that OCR confuses with letters, as those letters (0 1 5 8)."""
    return F.translate(c, "0158", "olsb")


def xml_text(c: Column) -> Column:
    """Escaped for element text."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def xml_attribute(c: Column) -> Column:
    """Escaped for a double-quoted attribute."""
    c = F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))
    c = F.replace(c, F.lit("\r"), F.lit("&#13;"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#09;"))


def amount_text(c: Column) -> Column:
    """A double below 1e16 the way it is written in keys: shortest decimal form, with `.0` for whole numbers."""
    plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(plain, r"\.$", ".0")


def redact_xml(c: Column, most: int = 300) -> Column:
    """Element texts masked, first characters only: for logs."""
    return F.substring(F.regexp_replace(c, ">([^<]+)<", ">***<"), 1, most)


def clean_model_output(c: Column) -> Column:
    """A model's answer without a code fence around it."""
    t = strip(c)
    opened = strip(F.regexp_replace(t, "(?i)^```(?:json)?", ""))
    return F.when(t.startswith("```"), strip(F.regexp_replace(opened, "```$", ""))).otherwise(t)
