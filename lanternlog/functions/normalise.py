"""Value normalisers used by every extractor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_null(c: Column | str) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def cik(c: Column | str) -> Column:
    """A CIK as ten digits with leading zeros; null where there is none."""
    digits = text_or_null(c)
    return F.when(digits.isNotNull(), F.lpad(F.ltrim(digits, F.lit("0")), 10, "0"))


def number(c: Column | str, kind: str = "decimal(20,4)") -> Column:
    """A decimal without thousands separators; null where it is none."""
    return F.regexp_replace(F.trim(col(c)), ",", "").try_cast(kind)


def day(c: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """A date in the given pattern; null where it is none."""
    return F.try_to_timestamp(F.trim(col(c)), F.lit(pattern)).cast("date")


def eastern_to_utc(c: Column | str) -> Column:
    """fourteen digits of New York wall time as a UTC timestamp."""
    return F.to_utc_timestamp(F.try_to_timestamp(col(c), F.lit("yyyyMMddHHmmss")), "America/New_York")


def to_thousandths(c: Column | str) -> Column:
    """A double to three places as its binary value says, ties to even, and the double nearest to that decimal.

    The fraction is taken apart at 2**-26, so that a thousand times either part is exact, and what is over the last
    whole thousandth is held against the half without a rounded product.
    """
    x = col(c)
    whole = F.floor(F.abs(x))
    scaled = (F.abs(x) - whole) * F.lit(float(1 << 26))
    high = F.floor(scaled) * 1000
    below = F.shiftright(high, 26)
    over = (high - F.shiftleft(below, 26) - (1 << 25)).cast("double") + (scaled - F.floor(scaled)) * 1000.0
    up = (over > 0) | ((over == 0) & (below % 2 == 1))
    return F.signum(x) * (whole * 1000 + below + up.cast("long")).cast("double") / F.lit(1000.0)
