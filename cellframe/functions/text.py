"""Text forms: booleans, timestamps, request keys, delimited rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cellframe import fixed


def first_of(*columns: Column) -> Column:
    """The first name that is present."""
    return F.coalesce(*columns)


def or_blank(column: Column) -> Column:
    """The value, or empty text where it is missing."""
    return F.coalesce(column, F.lit(""))


def joined(values: Column, separator: str = ";") -> Column:
    """Several values of one attribute as one text, in document order; missing ones print as empty."""
    return F.array_join(values, separator, "")


def short_boolean(flag: Column) -> Column:
    """``t``, ``f`` or empty."""
    return F.when(flag, "t").when(~flag, "f").otherwise("")


def long_boolean(flag: Column) -> Column:
    """``True``, ``False`` or empty."""
    return F.when(flag, "True").when(~flag, "False").otherwise("")


def delimited(*columns: Column, separator: str = "|") -> Column:
    """One staged row; missing values print as empty."""
    return F.concat_ws(separator, *(or_blank(c.cast("string")) for c in columns))


def parse_timestamp(text: Column) -> Column:
    """Read a version timestamp."""
    return F.to_timestamp(text, fixed.VERSION_TIMESTAMP)


def format_timestamp(moment: Column) -> Column:
    """Write a version timestamp."""
    return F.date_format(moment, fixed.VERSION_TIMESTAMP)


def seconds_between(start: Column, end: Column) -> Column:
    """Length of a time span in seconds, fractions kept."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)


def bundle_interval(bundles: Column) -> Column:
    """Label of the reporting interval a request size falls in, such as ``500-999``."""
    low = (F.floor(bundles / fixed.BUNDLE_INTERVAL) * fixed.BUNDLE_INTERVAL).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + fixed.BUNDLE_INTERVAL - 1).cast("string"))


def result_key(version: Column, fingerprint: Column, request: Column, format_: Column) -> Column:
    """Where the result of a request is stored."""
    suffix = F.when(format_.isin(*fixed.ZIPPED_FORMATS), ".zip").otherwise("")
    return F.concat(
        version.cast("string"), F.lit("/"), fingerprint, F.lit("/"), request, F.lit("."), format_, suffix
    )
