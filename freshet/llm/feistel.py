"""Keyed permutation of 0 .. n-1 as a column expression.

A number below ``n`` is split into a pair (l, r) with l < a and r < b, where a is
the rounded-up square root of n and b the rounded-up n / a.  Each round adds a
keyed hash of one half to the other, which can be undone.  Results of n or more
are permuted again (cycle walking); a * b exceeds n by less than a, so a walk of
more than a few steps is rare, and the walk's longest possible length is below a.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROUNDS = 6
#: Steps of the walk.  For n below 4096 no walk is longer; beyond it the chance of
#: a longer one is under (1/64) ** 64, and then the expression raises an error.
WALK = 64


def _once(x: Column, a: Column, b: Column, key: Column, undo: bool) -> Column:
    def step(s: Column, i: Column) -> Column:
        t = (ROUNDS - 1 - i) if undo else i
        sign = -1 if undo else 1
        left = F.pmod(s["l"] + sign * F.pmod(F.xxhash64(key, t, s["r"]), a), a)
        right = F.pmod(s["r"] + sign * F.pmod(F.xxhash64(key, t, s["l"]), b), b)
        even = t % 2 == 0
        return F.struct(
            F.when(even, left).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(right).alias("r"),
        )

    rest = F.pmod(x, b)
    start = F.struct(((x - rest) / b).cast("long").alias("l"), rest.alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: Column, key: Column, undo: bool = False) -> Column:
    """Image of ``x`` (long, 0 <= x < n) under the permutation of ``key``.

    ``undo`` gives the inverse.  ``n`` below 2 ** 52.  Null in, null out.
    """
    x, n = x.cast("long"), n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _once(x, a, b, key, undo),
        lambda y, _: F.when(y < n, y).otherwise(_once(y, a, b, key, undo)),
    )
    return F.when(walk < n, walk).when(walk.isNotNull(), F.raise_error(F.lit("cycle walk did not end")).cast("long"))
