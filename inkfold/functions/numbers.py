"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1904-01-01 to 1970-01-01.
MAC_EPOCH = 2_082_844_800


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half goes up, also below zero: -0.5 gives 0. Spark's ``round`` goes away from zero."""
    factor = float(10**digits)
    return F.floor(x * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def rounded_text(text: Column, digits: int = 0) -> Column:
    """A number in text form, rounded half up; without a point for no digits, else with one digit after it at least. Other text gives null."""
    value = round_half_up(text.try_cast("double"), digits)
    return value.cast("bigint").cast("string") if digits == 0 else F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")


def mac_time(seconds: Column) -> Column:
    """Seconds since 1904 as a timestamp without zone."""
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds - F.lit(MAC_EPOCH)).cast("decimal(18,6)"))


def iso_time(seconds: Column) -> Column:
    return F.date_format(mac_time(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def bits(flags: Column, names: dict[str, int]) -> Column:
    """Struct of booleans, one a name, of the bits of an integer."""
    return F.struct(*[(F.getbit(flags, F.lit(bit)) == 1).alias(name) for name, bit in names.items()])


def as_double(text: Column) -> Column:
    """The number in a text, null if there is none."""
    return text.try_cast("double")
