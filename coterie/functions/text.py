"""Text expressions: trimming, splitting, label characters, formats, casts.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from coterie.functions.fixed import TIMESTAMP_TEXT

# The code points that count as white space at the ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Digits outside the decimal number category (superscripts,
# subscripts, circled and similar), which also count as a leading digit.
OTHER_DIGITS = (
    r"\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)


def strip(text: Column) -> Column:
    """Text without white space at either end (all kinds, not only blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def fields(line: Column) -> Column:
    """Comma separated fields; a trailing comma yields a trailing empty field."""
    return F.split(line, ",", -1)


def field_count(line: Column) -> Column:
    """Number of comma separated fields, without building them."""
    commas = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(","), F.lit("")))
    return commas + 1


def has_csv_extension(filename: Column) -> Column:
    """The part after the last dot is ``csv`` in any case."""
    suffix = F.lower(F.substring_index(filename, ".", -1))
    return F.contains(filename, F.lit(".")) & (suffix == "csv")


def has_space(text: Column) -> Column:
    return F.contains(text, F.lit(" "))


def is_alphanumeric(text: Column) -> Column:
    """Letters and numbers of any script, at least one."""
    return text.rlike(r"\A[\p{L}\p{N}]+\z")


def starts_with_digit(text: Column) -> Column:
    return text.rlike(rf"\A[\p{{Nd}}{OTHER_DIGITS}]")


def parse_list(text: Column) -> Column:
    """A JSON list of strings; null when the text is not one."""
    return F.from_json(text, "array<string>")


def join_list(items: Column) -> Column:
    return F.array_join(items, ",")


def timestamp_text(at: Column) -> Column:
    return F.date_format(at, TIMESTAMP_TEXT)


def two_decimals(value: Column) -> Column:
    """Two decimals, rounded on the exact binary value with ties to even, for up
    to 15 digits.

    ``printf`` rounds the shortest decimal form half up, which differs for
    values such as 0.125 and 1.005.
    """
    return F.call_function("format_number", value, F.lit("0.00"))


def percent_text(share: Column) -> Column:
    return F.concat(two_decimals(share * 100), F.lit(" %"))


def to_int(text: Column) -> Column:
    """Whole number or null. White space around the digits is accepted."""
    return strip(text).try_cast("int")
