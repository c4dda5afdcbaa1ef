"""String expressions shared by the label, prompt and answer operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode text processing strips as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def squash(c: Column) -> Column:
    """Lower case without blanks: the form in which class names are compared."""
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def normalise_label(c: Column) -> Column:
    """Lower case, stripped, without inner blanks."""
    return F.replace(strip(F.lower(c)), F.lit(" "), F.lit(""))


def slug(c: Column) -> Column:
    """File-safe name: blanks to underscores, then letters, digits, ``-`` and ``_`` only."""
    joined = F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_"))
    return F.regexp_replace(joined, r"[^\p{L}\p{N}_-]", "")


def slug_text(text: str) -> str:
    """``slug`` for a driver-side string."""
    return re.sub(r"[^\w-]", "", text.lower().strip().replace(" ", "_"))


def truncate_label(c: Column, limit: int = 15) -> Column:
    """Cut to ``limit`` characters and mark the cut with an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def escape_prompt(c: Column) -> Column:
    """Escape newlines and double quotes so that a prompt fits on one line of a config file."""
    one_line = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(one_line, F.lit('"'), F.lit('\\"'))
