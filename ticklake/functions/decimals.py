"""Exact decimal parsing, rescaling and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
WITH_EXPONENT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def parse_decimal(text: Column, *, exponent: bool = False, kind: str = "decimal(38,18)") -> Column:
    """Null where the text is no decimal number (spaces are refused) or doesn't fit ``kind``."""
    return F.when(text.rlike(WITH_EXPONENT if exponent else PLAIN), text.try_cast(kind))


def parse_error(text: Column, *, exponent: bool = False) -> Column:
    """Why ``parse_decimal`` gives null: Empty, InvalidSyntax or Overflow."""
    bad = ~text.rlike(WITH_EXPONENT if exponent else PLAIN)
    return F.when(F.coalesce(text, F.lit("")) == "", "Empty").when(bad, "InvalidSyntax").when(text.try_cast("decimal(38,18)").isNull(), "Overflow")


def split_decimal(text: Column) -> Column:
    """struct(coefficient decimal(38,0), scale int) of a decimal lexeme, trailing zeros kept."""
    mantissa = F.regexp_extract(text, r"^([^eE]*)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    shift = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1)) - power
    digits = F.concat(F.regexp_replace(mantissa, r"[+.]", ""), F.when(shift < 0, F.repeat(F.lit("0"), -shift)).otherwise(""))
    return F.when(text.rlike(WITH_EXPONENT), F.struct(digits.try_cast("decimal(38,0)").alias("coefficient"), F.greatest(shift, F.lit(0)).alias("scale")))


def from_parts(low: Column, high: Column, scale: Column) -> Column:
    """Value of a 128-bit coefficient (unsigned low and signed high 64-bit words) over 10^scale."""
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    word = F.when(low < 0, low.cast("decimal(20,0)") + two64).otherwise(low.cast("decimal(20,0)"))
    coefficient = (high.cast("decimal(17,0)") * two64 + word).cast("decimal(38,0)")
    text = F.lpad(F.abs(coefficient).cast("string"), F.greatest(F.length(F.abs(coefficient).cast("string")), scale + 1), "0")
    whole = F.substring(text, F.lit(1), F.length(text) - scale)
    plain = F.when(scale > 0, F.concat(whole, F.lit("."), F.right(text, scale))).otherwise(text)
    return F.concat(F.when(coefficient < 0, "-").otherwise(""), plain)


def rescale(value: Column, scale: int, mode: str = "exact") -> Column:
    """``value`` at a scale: exact (null on loss), toward_zero, away_from_zero, floor, ceil or half_away."""
    down, up = F.floor(value, F.lit(scale)), F.ceil(value, F.lit(scale))
    out = {
        "exact": F.when(down == value, down), "floor": down, "ceil": up, "half_away": F.round(value, scale),
        "toward_zero": F.when(value < 0, up).otherwise(down), "away_from_zero": F.when(value < 0, down).otherwise(up),
    }[mode]
    return out.cast(f"decimal(38,{scale})")


def checksum_lexeme(text: Column) -> Column:
    """Digits without the point and leading zeros; all zeros give "0"."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\.", ""), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def book_checksum(asks: Column, bids: Column, depth: int = 10) -> Column:
    """CRC-32 over the best asks low to high, then the best bids high to low; arrays of
    (price, quantity) strings in that order."""
    line = lambda side: F.array_join(F.transform(F.slice(side, 1, depth), lambda x: F.concat(checksum_lexeme(x["price"]), checksum_lexeme(x["quantity"]))), "")
    return F.crc32(F.concat(line(asks), line(bids)).cast("binary"))
