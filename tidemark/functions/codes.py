"""Codes, ages, mortality and length-of-stay bins as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GENDER = {"F": 1, "M": 2, "OTHER": 3, "": 0}
ETHNICITY = {"ASIAN": 1, "BLACK": 2, "HISPANIC": 3, "WHITE": 4, "OTHER": 5, "UNABLE TO OBTAIN": 0, "PATIENT DECLINED TO ANSWER": 0, "UNKNOWN": 0, "": 0}
LOS_DAYS = [1, 2, 3, 4, 5, 6, 7, 8, 14]
LOS_MEANS = [11.450379, 35.070846, 59.206531, 83.382723, 107.487817, 131.579534, 155.643957, 179.660558, 254.306624, 585.325890]
LOG_MEANS = [0.611848, 2.587614, 6.977417, 16.465430, 37.053745, 81.816438, 182.303159, 393.334856, 810.964040, 1715.702848]


def mapped(value: Column, codes: Mapping[str, int], other: int) -> Column:
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), F.lit(other))


def gender_code(gender: Column) -> Column:
    return mapped(gender, GENDER, GENDER["OTHER"])


def ethnicity_code(ethnicity: Column) -> Column:
    """Of 'A OR B - C', 'A/B' and the like, the first part counts."""
    first = F.split_part(F.split_part(F.replace(F.coalesce(ethnicity, F.lit("")), F.lit(" OR "), F.lit("/")), F.lit(" - "), F.lit(1)), F.lit("/"), F.lit(1))
    return mapped(first, ETHNICITY, ETHNICITY["OTHER"])


def age(at: Column, born: Column) -> Column:
    """Difference of the years; births shifted into the future stand for the very old."""
    years = F.year(at) - F.year(born)
    return F.when(years < 0, 90).otherwise(years).cast("double")


def died_within(start: Column, end: Column, *deaths: Column) -> Column:
    """1 if one of the times of death lies within [start, end], else 0."""
    out = F.lit(False)
    for d in deaths:
        out = out | F.coalesce(d.between(start, end), F.lit(False))
    return out.cast("int")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def bin_index(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are at most the value."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= value))


def custom_bin(hours: Column) -> Column:
    """Length-of-stay bin of hours: below a day, single days up to 8, up to 14, more."""
    return F.when(hours.isNotNull(), bin_index(hours, [24 * d for d in LOS_DAYS]))


def log_bin(hours: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.bround(F.log1p(hours) / 8.0 * bins).cast("int")))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


def bin_mean(index: Column, means: Sequence[float] = LOS_MEANS) -> Column:
    return F.element_at(F.array(*(F.lit(m) for m in means)), index.cast("int") + 1)


def arg_max(scores: Column) -> Column:
    """Place of the first largest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def random_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random number of key and seed that other engines can compute, too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 7), 16, 10).cast("long")
