"""Small column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v\u00a0"


def trimmed(c: Column) -> Column:
    """The text without outer blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Trimmed and in lower case, the form in which states are compared."""
    return F.lower(trimmed(c))
