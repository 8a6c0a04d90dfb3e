"""Column expressions used by several queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: str | Column) -> Column:
    """An amount as an exact decimal, so that sums do not depend on their order."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(12,2)")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Price after discount, exact."""
    return money(price) * (F.lit(1).cast("decimal(12,2)") - money(discount))


def url_host(url: str | Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


#: Fixed value: blanks between words.
BLANKS = " \t\n\x0b\x0c\r"
