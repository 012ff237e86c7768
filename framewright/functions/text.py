"""Transcript text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]+"


def unicode_strip(text: Column) -> Column:
    """``text`` without Unicode white space at either end; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)^{SPACE}|{SPACE}\z", "")


def preview(text: Column, width: int = 120) -> Column:
    """The first ``width`` code points, followed by ``...`` if something was cut."""
    return F.concat(F.left(text, F.lit(width)), F.when(F.length(text) > width, "...").otherwise(""))


def seconds_label(n_samples: Column, rate: int = 16000) -> Column:
    """Seconds with two decimals. ``format_number`` rounds the exact binary value, unlike ``format_string``."""
    return F.regexp_replace(F.call_function("format_number", n_samples.cast("double") / F.lit(float(rate)), F.lit("0.00")), ",", "")
