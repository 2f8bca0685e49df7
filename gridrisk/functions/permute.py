"""Keyed pseudo-random permutations of 0..n-1 in column expressions.

A place is written as a pair (l, r) of Z_a x Z_b with a = ceil(sqrt n) and b = ceil(n / a).  Rounds add a keyed
function of one part to the other in turn, each of which can be undone, so together they permute the
a b >= n pairs.  A place that lands at n or behind walks on until it is under n (cycle walking), which
makes a permutation of 0..n-1.  Fewer than a pairs lie behind n, so a walk has at most a steps, and more than one
only rarely.

Nothing is stored or shuffled: every row computes its image alone, from n, the key and its place.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; squares below it fit a long.
P = (1 << 31) - 1
ROUNDS = 4
#: Steps of a walk after which a place not yet under n raises: a walk is no longer than a for n up to
#: 4096; above, more than 64 steps have a chance below 2**-384.
WALK = 64


def round_keys(seed: int, number: int) -> list[tuple[int, int, int, int]]:
    """Factors and offsets of the rounds of permutation ``number``."""
    rng = random.Random(f"{seed}/{number}")
    return [tuple(rng.randrange(1, P) for _ in range(4)) for _ in range(ROUNDS)]


def shape(n: int) -> tuple[int, int]:
    """a and b."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def image(place: int, n: int, keys: list[tuple[int, int, int, int]]) -> int:
    """The same permutation for one place, in plain Python (tests and small maps)."""
    a, b = shape(n)
    mix = lambda x, m, k: ((x % P * m + k) % P) ** 2 % P
    while True:
        left, right = divmod(place, b)
        for m1, k1, m2, k2 in keys:
            left = (left + mix(right, m1, k1)) % a
            right = (right + mix(left, m2, k2)) % b
        place = left * b + right
        if place < n:
            return place


def _mix(x: Column, m: Column, k: Column) -> Column:
    y = (x % P * m + k) % P
    return y * y % P


def _step(place: Column, a: int, b: int, keys: Column) -> Column:
    start = F.struct(F.call_function("div", place, F.lit(b)).alias("l"), (place % b).alias("r"))

    def half(s: Column, k: Column) -> Column:
        left = (s["l"] + _mix(s["r"], k["m1"], k["k1"])) % a
        return F.struct(left.alias("l"), s["r"].alias("r"))

    def other(s: Column, k: Column) -> Column:
        return F.struct(s["l"].alias("l"), ((s["r"] + _mix(s["l"], k["m2"], k["k2"])) % b).alias("r"))

    return F.aggregate(keys, start, lambda s, k: other(half(s, k), k), lambda s: s["l"] * F.lit(b) + s["r"])


def key_column(keys: list[tuple[int, int, int, int]]) -> Column:
    """Round keys as a literal array of structs."""
    names = ("m1", "k1", "m2", "k2")
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(names, key, strict=True)]) for key in keys])


def with_image(df: DataFrame, place: str, n: int, key: Column, out: str) -> DataFrame:
    """``df`` and ``out``, the image of the long ``place`` (0..n-1) under the permutation of ``key`` (see
    ``key_column``).

    Each round is a projection of its own, so its terms are computed once and in generated code; only rows that
    land behind n walk on, in a higher-order function."""
    a, b = shape(n)
    here = F.col(place).cast("long")
    x = df.withColumns({"_pm_l": F.call_function("div", here, F.lit(b)), "_pm_r": here % b})
    for i in range(ROUNDS):
        for to, by, size, m, k in (("_pm_l", "_pm_r", a, "m1", "k1"), ("_pm_r", "_pm_l", b, "m2", "k2")):
            x = x.withColumn("_pm_y", (F.col(by) % P * key[i][m] + key[i][k]) % P)
            x = x.withColumn(to, (F.col(to) + F.col("_pm_y") * F.col("_pm_y") % P) % size)
    x = x.withColumn("_pm_x", F.col("_pm_l") * F.lit(b) + F.col("_pm_r"))
    first = F.col("_pm_x")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(_step(v, a, b, key)))
    lost = F.raise_error(F.lit(f"permutation: a walk of more than {WALK} steps")).cast("long")
    x = x.withColumn("_pm_w", F.when(first < n, first).otherwise(walked))
    # never null, so that no join on it pushes a copy of the rounds down as a filter
    image = F.coalesce(F.when(F.col("_pm_w") < n, F.col("_pm_w")).otherwise(lost), F.lit(-1).cast("long"))
    return x.withColumn(out, image).drop("_pm_l", "_pm_r", "_pm_y", "_pm_x", "_pm_w")
