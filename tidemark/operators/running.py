"""Running sums in a global order, without all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of the order value in each of two steps: their totals are summed up in one small window, rows within a range in a task of its own.
STEPS = 16


def prefix_sums(rows: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], tie: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """rows with cum_<c> for each of sums: its sum over the rows of by up to this one, in the order of (order, tie).

    Rows that are equal in order and tie share their sum. The order value is a number; it is cut at quantiles (from a
    sketch), so a task holds about as many rows of a group as any other, however the values crowd.
    """
    by = list(by)
    names = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    cuts = rows.groupBy(*names).agg(F.percentile_approx(F.col(order).cast("double"), [i / STEPS**2 for i in range(1, STEPS**2)], accuracy).alias("_cuts"))
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col(order)))
    coarse = below(F.transform(F.sequence(F.lit(STEPS), F.lit(STEPS * (STEPS - 1)), F.lit(STEPS)), lambda i: F.get(F.col("_cuts"), i - 1)))
    dealt = rows.join(cuts, names).withColumn("_coarse", coarse)
    fine = below(F.slice("_cuts", F.col("_coarse") * STEPS + 1, F.lit(STEPS - 1)))
    dealt = dealt.withColumn("_range", F.coalesce(F.col("_coarse") * STEPS + fine, F.lit(0))).drop("_cuts", "_coarse")
    totals = dealt.groupBy(*names, "_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*names, "_range", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*names, "_range").orderBy(order, *tie)  # by default up to the last equal row
    out = dealt.join(before, [*names, "_range"])
    out = out.withColumns({f"cum_{c}": F.col(f"_b_{c}") + F.sum(c).over(inside) for c in sums})
    return out.drop("_range", *(f"_b_{c}" for c in sums), *([] if by else ["_all"]))
