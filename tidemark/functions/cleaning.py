"""Cleaning of measured values, by variable: a registry of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (value, unit, label) as text to the clean value as double.
Cleaner = Callable[[Column, Column, Column], Column]

NUMBER = r"^(\d+(\.\d*)?|\.\d+)$"
PRESSURES = r"^(\d+)/(\d+)$"


def number(value: Column) -> Column:
    return value.try_cast("double")


def _has(text: Column, part: str) -> Column:
    return F.coalesce(F.contains(text, F.lit(part)), F.lit(False))


def height(value: Column, unit: Column, label: Column) -> Column:
    """Inches, by unit or label, to whole centimetres (half to even)."""
    v = number(value)
    return F.when(_has(F.lower(unit), "in") | _has(F.lower(label), "in"), F.bround(v * 2.54)).otherwise(v)


def _pressure(group: int) -> Cleaner:
    def clean(value: Column, unit: Column, label: Column) -> Column:
        return number(F.when(value.rlike(PRESSURES), F.regexp_extract(value, PRESSURES, group)).otherwise(value))

    return clean


systolic, diastolic = _pressure(1), _pressure(2)


def capillary_refill(value: Column, unit: Column, label: Column) -> Column:
    return F.when(value.isin("Normal <3 secs", "Brisk"), 0.0).when(value.isin("Abnormal >3 secs", "Delayed"), 1.0)


def inspired_oxygen(guard: bool = False) -> Cleaner:
    """Percent to a share unless the unit is torr; with guard only values above 1 are divided."""

    def clean(value: Column, unit: Column, label: Column) -> Column:
        v = number(value)
        percent = ~_has(F.lower(unit), "torr")
        return F.when(percent & (v > 1) if guard else percent, v / 100).otherwise(v)

    return clean


def laboratory(value: Column, unit: Column, label: Column) -> Column:
    """Numbers only; any other text is null."""
    return F.when(value.rlike(NUMBER), number(value))


def oxygen_saturation(value: Column, unit: Column, label: Column) -> Column:
    v = laboratory(value, unit, label)
    return F.when(v <= 1, v * 100).otherwise(v)


def temperature(value: Column, unit: Column, label: Column) -> Column:
    v = number(value)
    return F.when(_has(unit, "F") | _has(label, "F") | (v >= 79), (v - 32) * 5 / 9).otherwise(v)


def weight(value: Column, unit: Column, label: Column) -> Column:
    """Ounces and pounds to kilograms."""
    v, pound = number(value), 0.453592
    ounces = _has(unit, "oz") | _has(label, "oz")
    pounds = _has(unit, "lb") | _has(label, "lb")
    return F.when(ounces, v / 16 * pound).when(pounds, v * pound).otherwise(v)


def respiratory_rate(value: Column, unit: Column, label: Column) -> Column:
    return F.when(value.isin(">60/min retracts", ">60/minute"), 60.0).otherwise(number(value))


def cleaners(fio2_guard: bool = False) -> dict[str, Cleaner]:
    """The registry by variable; variables without an entry keep their text."""
    return {
        "Capillary refill rate": capillary_refill,
        "Diastolic blood pressure": diastolic,
        "Systolic blood pressure": systolic,
        "Fraction inspired oxygen": inspired_oxygen(fio2_guard),
        "Oxygen saturation": oxygen_saturation,
        "Glucose": laboratory,
        "pH": laboratory,
        "Temperature": temperature,
        "Weight": weight,
        "Height": height,
        "Respiratory rate": respiratory_rate,
    }


def clean(events: DataFrame, registry: dict[str, Cleaner] | None = None, variable: str = "VARIABLE", value: str = "VALUE", unit: str = "VALUEUOM", label: str = "MIMIC_LABEL") -> DataFrame:
    """events with value cleaned (as text), without the rows whose value is null before or after; a null unit is ''."""
    registry = cleaners() if registry is None else registry
    with_unit = events.where(F.col(value).isNotNull()).withColumn(unit, F.coalesce(F.col(unit), F.lit("")))
    text, uom, name = F.col(value), F.col(unit), F.col(label) if label in events.columns else F.lit("")
    out = text
    for variable_name, cleaner in registry.items():
        out = F.when(F.col(variable) == variable_name, cleaner(text, uom, name).cast("string")).otherwise(out)
    return with_unit.withColumn(value, out).where(F.col(value).isNotNull())
