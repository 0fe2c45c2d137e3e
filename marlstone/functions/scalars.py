"""Scalar functions on columns: paths, parsing, sizes and durations, integer bits, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_index(text: Column, char: str) -> Column:
    """F-03: position of the last `char`, from 0; -1 if there is none."""
    back = F.locate(char, F.reverse(text))
    return F.when(back > 0, F.length(text) - back).otherwise(-1)


def clean_path(path: Column) -> Column:
    """F-04: forward slashes, one at the end."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def file_title(path: Column) -> Column:
    """F-05: between the last slash and the last dot; without a dot to the end."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def extension(path: Column) -> Column:
    """F-06: behind the last dot of the name; null if there is none."""
    got = F.regexp_extract(path, r"\.([^./\\]*)$", 1)
    return F.when(path.rlike(r"\.[^./\\]*$"), got)


def parse_uint(text: Column) -> Column:
    """F-07: leading digits behind white space; 0 if there are none, null if they pass 64 bits."""
    digits = F.regexp_extract(text, r"^\s*(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def parse_float(text: Column) -> Column:
    """F-07: digits with an optional fraction, no sign and no exponent."""
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+(\.\d*)?)", 1).try_cast("double"), F.lit(0.0))


def parse_until(text: Column, delimiter: str) -> Column:
    """F-08: up to the delimiter, without trailing blanks."""
    return F.rtrim(F.substring_index(text, delimiter, 1))


def duration_text(seconds: Column) -> Column:
    """F-11: days (if any), hours, minutes and seconds; days stay in front, as intended."""
    days, rest = F.floor(seconds / 86400), seconds % 86400
    clock = F.format_string("%02d-%02d-%09.6f", F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"), (rest % 60).cast("double"))
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("-"), clock)).otherwise(clock)


def scaled_size(size: Column) -> Column:
    """F-12: bytes scaled by 1024, four times at most, with the unit."""
    step = F.least(F.lit(4), F.floor(F.log2(F.greatest(size, F.lit(1))) / 10)).cast("int")
    return F.format_string("%.2f %s", F.bround(size / F.pow(F.lit(1024.0), step), 2), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1))


def floor_log2(v: Column) -> Column:
    """F-15: by the length of the binary text, exact for all longs; -1 for values under 1."""
    return F.when(v > 0, F.length(F.bin(v)) - 1).otherwise(-1)


def ceil_log2(v: Column) -> Column:
    return F.when(v > 1, F.length(F.bin(v - 1))).otherwise(0)


def lowest_bit(v: Column) -> Column:
    """F-15: index of the lowest set bit; -1 for 0."""
    return F.when(v != 0, F.length(F.bin(v)) - F.length(F.rtrim(F.bin(v), F.lit("0")))).otherwise(-1)


def zigzag(v: Column) -> Column:
    """F-18: 0, -1, 1, -2, 2 become 0, 1, 2, 3, 4."""
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 1, -((u + 1) / 2)).otherwise(u / 2).cast("long")


def median3(a: Column, b: Column, c: Column) -> Column:
    """F-19."""
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def placeholders(template: Column) -> Column:
    """D-11: the *.ext placeholders of a command template, in order."""
    return F.regexp_extract_all(template, F.lit(r"\*\.(\S+)"), F.lit(1))


def template_ok(encode: Column, decode: Column) -> Column:
    """P-13: both commands name a source and a coded placeholder, and the same two extensions in opposite order."""
    e, d = placeholders(encode), placeholders(decode)
    return F.coalesce((F.size(e) == 2) & (F.size(d) == 2) & (F.get(e, F.lit(0)) == F.get(d, F.lit(1))) & (F.get(e, F.lit(1)) == F.get(d, F.lit(0))), F.lit(False))


def fill_template(template: Column, source: Column, target: Column) -> Column:
    """P-14: the first placeholder becomes the quoted source, the second the quoted target."""
    parts = F.split(template, r"\*\.\S+", -1)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.get(parts, F.lit(0)), quoted(source), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), quoted(target), F.coalesce(F.get(parts, F.lit(2)), F.lit("")))


def log2_fix24(v: Column) -> Column:
    """F-17: log2 in 8.24 fixed point."""
    return F.floor(F.log2(v / F.lit(16777216.0)) * 16777216).cast("long")


def exp2_fix24(v: Column) -> Column:
    return F.floor(F.pow(F.lit(2.0), v / F.lit(16777216.0)) * 16777216).cast("long")
