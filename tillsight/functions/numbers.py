"""Numeric expressions: guarded parsing, money, ratios, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Money is carried as an exact decimal so that sums do not depend on the
# order rows arrive in; it is turned into DOUBLE only for output.
MONEY = DecimalType(24, 4)

# A plain decimal number with optional sign and exponent.  Strings such as
# "12d", "nan", "$1,234.5", "12%", "(5)", "1_000" or "0x10" are rejected.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(c: Column | str) -> Column:
    return _col(c).rlike(NUMBER_PATTERN)


def parse_double(c: Column | str) -> Column:
    """Text -> DOUBLE, NULL when the text is not a plain number."""
    col = _col(c)
    return F.when(is_number(col), F.trim(col).try_cast("double"))


def parse_money(c: Column | str) -> Column:
    """Text -> DECIMAL(24,4), NULL when not a plain number or out of range."""
    col = _col(c)
    return F.when(is_number(col), F.trim(col).try_cast(MONEY))


def money(c: Column | str) -> Column:
    """A typed numeric column as money."""
    return _col(c).try_cast(MONEY)


def money_out(c: Column | str, scale: int = 2) -> Column:
    """Round an exact decimal half-up and hand it out as DOUBLE."""
    return F.round(_col(c), scale).cast("double")


def as_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def safe_div(num: Column, den: Column, when_zero: Column | None = None) -> Column:
    """num / den as DOUBLE; ``when_zero`` (default NULL) if den is 0 or NULL."""
    n, d = as_double(num), as_double(den)
    result = F.when(d != 0, n / d)
    return result if when_zero is None else result.otherwise(when_zero)


def clip_nonnegative(c: Column | str) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def no_negative_zero(c: Column) -> Column:
    """Map -0.0 to 0.0 so that equal values also hash equally."""
    return c + F.lit(0.0)
