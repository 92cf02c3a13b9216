"""Columns that read frame rates and times from folder and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fps(name: Column) -> Column:
    """The rate in the first piece (between `_`) that holds `fps`: `16v7fps` is 16.7, `22fps` is 22."""
    piece = F.element_at(F.filter(F.split(name, "_"), lambda p: F.contains(p, F.lit("fps"))), 1)
    digits = F.split(F.substring(piece, F.lit(1), F.length(piece) - 3), "v")
    whole = F.element_at(digits, 1).cast("double")
    return F.when(F.size(digits) > 1, whole + F.element_at(digits, 2).cast("double") / F.pow(F.lit(10.0), F.length(F.element_at(digits, 2)).cast("double"))).otherwise(whole)


def fps_tenths(name: Column) -> Column:
    """As fps(), but what follows `v` always counts as tenths."""
    piece = F.element_at(F.filter(F.split(name, "_"), lambda p: F.contains(p, F.lit("fps"))), 1)
    digits = F.split(F.substring(piece, F.lit(1), F.length(piece) - 3), "v")
    whole = F.element_at(digits, 1).cast("double")
    return F.when(F.size(digits) > 1, whole + F.element_at(digits, 2).cast("double") / 10.0).otherwise(whole)


def _clock(name: Column) -> tuple[Column, Column]:
    last = F.split(F.element_at(F.split(name, "_"), -1), " ")
    return F.element_at(last, 1), F.element_at(last, 2)


def minutes_legacy(name: Column) -> Column:
    """Minutes since midnight of the last piece (`10600 PM`), digits cut by fixed places: hours of six digits are taken
    as they are, those of five digits only after noon have one digit and twelve added."""
    digits, half = _clock(name)
    one = (half == "PM") & (F.length(digits) == 5)
    at = lambda a, n: F.substring(digits, a, n).cast("double")
    long = 60.0 * at(1, 2) + at(3, 2) + at(5, 2) / 60.0
    short = 60.0 * (at(1, 1) + 12.0) + at(2, 2) + at(4, 2) / 60.0
    return F.when(one, short).otherwise(long)


def minutes_12h(name: Column) -> Column:
    """Minutes since midnight of the last piece, read as a 12-hour clock."""
    digits, half = _clock(name)
    full = F.lpad(digits, 6, "0")
    at = lambda a: F.substring(full, a, 2).cast("double")
    return 60.0 * (at(1) % 12.0 + F.when(half == "PM", 12.0).otherwise(0.0)) + at(3) + at(5) / 60.0


def minutes_day_folder(name: Column) -> Column:
    """Whole minutes as day folders are read: of six digits after noon, the second and third are minutes past noon."""
    digits, half = _clock(name)
    at = lambda a, n: F.substring(digits, a, n).cast("int")
    pm = F.when(F.length(digits) == 5, 60 * at(1, 1) + at(2, 2) + 720).otherwise(at(2, 2) + 720)
    return F.when(half == "AM", 60 * at(1, 2) + at(3, 2)).otherwise(pm)


def frame_number(file: Column) -> Column:
    """The last run of digits before the extension; files sort by it, then by name."""
    return F.regexp_extract(file, r"(\d+)\.[A-Za-z]+$", 1).cast("long")


def extension(file: Column) -> Column:
    return F.regexp_extract(file, r"\.([^.]+)$", 1)


def root_of(track: Column) -> Column:
    """`1` of `Cell_1_0_1`."""
    return F.element_at(F.split(track, "_"), 2)


def fraction_limits(first: Column, last: Column, n: Column) -> Column:
    """The index pair at two fractions of a stack of n frames."""
    a = F.least(F.floor(first * n), n - 1).cast("long")
    b = F.least(F.floor(last * n - 1), n - 1).cast("long")
    return F.struct(a.alias("first"), b.alias("last"))
