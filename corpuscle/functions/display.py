"""Column functions that put values into words for reports and logs; null in gives the stated reading of a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
SECRET_HEADERS = ("authorization", "x-api-key", "api-key")
# -----------------------------------------------------------------------------


def moment(text: Column) -> Column:
    """An ISO timestamp as `Jan 11, 2026 at 3:23 PM`; text that is none as it is, null as ''."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "MMM dd, yyyy 'at' h:mm a"), text, F.lit(""))


def grouped_number(value: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(value, 0)


def fixed(number: Column, digits: int) -> Column:
    """A number with that many decimals, rounded by its exact binary value and half to even, as C and Python do.

    format_string rounds the shortest decimal half up, so 0.01855, a little less in
    binary, would gain. The product with 10 ** digits is taken exactly, as a sum of
    two doubles; from 2 ** 53 of its units on, format_string stays.
    """
    unit = 10**digits
    size = F.abs(number)
    near = size * float(unit)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    rest = (high * float(unit) - near) + (size - high) * float(unit)
    whole = F.floor(near)
    part = near - whole
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    text = F.concat(F.when(number < 0, "-").otherwise(""), ((n - n % unit) / unit).cast("long").cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(near < 2.0**53, text).otherwise(F.format_string(f"%.{digits}f", number))


def cost(usd: Column, fine: Column | None = None) -> Column:
    """Dollars: four decimals below a cent (or where fine is true, if given), else two; Free for nothing, Unknown for null."""
    usd = usd.cast("double")
    small, usual = F.concat(F.lit("$"), fixed(usd, 4)), F.concat(F.lit("$"), fixed(usd, 2))
    return F.when(usd.isNull(), "Unknown").when(usd == 0, "Free").when(usd < 0.01 if fine is None else fine, small).otherwise(usual)


def redacted(headers: Column) -> Column:
    """A map of headers in which secrets show four characters at most; null gives an empty map."""

    def shown(key: Column, value: Column) -> Column:
        hidden = F.when(F.length(value) > 8, F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), F.length(value) - 4))).otherwise("****")
        return F.when(F.lower(key).isin(*SECRET_HEADERS) & (value != ""), hidden).otherwise(value)

    return F.coalesce(F.transform_values(headers, shown), F.create_map().cast("map<string,string>"))


def truncated(body: Column, most: int = 500) -> Column:
    """The first `most` characters, with three dots if there are more; null gives ''."""
    text = F.coalesce(body, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
