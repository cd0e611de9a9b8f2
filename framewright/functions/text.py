"""String and number helpers of the data model."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# How umlauts are written out in slugs.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def _slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(s: Column) -> Column:
    """Lower case, umlauts written out, everything else that is no letter or digit as single hyphens."""
    low = F.lower(s)
    for a, b in UMLAUTS:
        low = F.replace(low, F.lit(a), F.lit(b))
    return _slug(low)


def plain_slug(s: Column) -> Column:
    """As slug(), but an umlaut is no letter."""
    return _slug(F.lower(s))


def title(stem: Column) -> Column:
    """What stands before ' $'."""
    return F.split(stem, r" \$", 2)[0]


def shell_slug(s: Column) -> Column:
    """As slug(), but only A-Z become lower case, so a capital umlaut is no letter."""
    low = F.translate(s, string.ascii_uppercase, string.ascii_lowercase)
    for a, b in UMLAUTS:
        low = F.replace(low, F.lit(a), F.lit(b))
    return _slug(low)


def short_id(uuid: Column, n: int = 8) -> Column:
    return F.substring(uuid, 1, n)


def padded(s: Column, width: int) -> Column:
    """Cut or filled with spaces to a width."""
    return F.rpad(F.substring(s, 1, width), width, " ")


def stamp(unix_s: Column) -> Column:
    """As 20240131T235959."""
    return F.date_format(F.timestamp_seconds(unix_s), "yyyyMMdd'T'HHmmss")


def age_days(unix_s: Column, now_s: Column) -> Column:
    return (now_s - unix_s) / 86_400


def comma_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def rate(s: Column) -> Column:
    """'num/den' as a number; 0 for anything else."""
    parts = F.split(s, "/")
    num, den = (F.get(parts, i).try_cast("double") for i in (0, 1))
    return F.when(F.size(parts) == 2, F.coalesce(F.try_divide(num, den), F.lit(0.0))).otherwise(F.lit(0.0))


def minute_of_hour(unix_s: Column) -> Column:
    return F.floor(unix_s / 60) % 60


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
