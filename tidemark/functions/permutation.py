"""Pseudo-random orders without a sort: a keyed permutation of 0 to n - 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the Feistel network, two for each half.
ROUNDS = 6
#: How often a number outside of the range is sent on at most. A share of about 1 / sqrt(n) of the numbers lies outside, and fewer than sqrt(n) + 1 numbers do.
WALKS = 64


def halves(n: int) -> tuple[int, int]:
    """(a, b), as near to each other as a * b >= n, less than n + a, allows."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int, epoch: Column) -> Column:
    """The place of a number, 0 to n - 1, in the epoch's order: each place is taken once.

    A number is split into a remainder of a and a quotient below b, and in turns one half is moved around by a digest of
    the other, the seed, the epoch and the round, which can be undone and so is a permutation of 0 to a * b - 1. What
    comes out at n or above is put in again. Digests are MD5, so that other engines give the same.
    """
    a, b = halves(n)

    def moved(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), i.cast("string"), half.cast("string"))), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left, right = s["left"], s["right"]
        first = F.struct(F.pmod(left + F.pmod(moved(i, right), F.lit(a)), F.lit(a)).alias("left"), right.alias("right"))
        second = F.struct(left.alias("left"), F.pmod(right + F.pmod(moved(i, left), F.lit(b)), F.lit(b)).alias("right"))
        return F.when(i % 2 == 0, first).otherwise(second)

    def once(x: Column) -> Column:
        start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("left"), F.floor(x / a).cast("long").alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["right"] * a + s["left"])

    walks = F.sequence(F.lit(1), F.lit(max(1, min(WALKS, a * b - n + 1))))
    return F.aggregate(walks, once(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
