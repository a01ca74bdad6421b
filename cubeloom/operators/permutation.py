"""Keyed permutations of numbers: a seeded shuffle in which the place of any item is computed from its number alone, by no
sort, window or exchange. Whole-number arithmetic, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the round function: multipliers, and what sets the rounds' and keys' offsets apart.
FIRST, SECOND, ROUND_STEP, KEY_STEP, WORD, ROUNDS = 2654435761, 1540483477, 40503, 7919, 1 << 32, 6
#: A walk of this many steps outside is an error. Fewer than 2 sqrt(n) + 1 places lie outside, so small sets never get here.
WALK = 64


def side(n: Column) -> Column:
    """The least ``a`` whose square holds ``n`` numbers."""
    return (F.floor(F.sqrt((n - 1).cast("double"))) + 1).cast("long")


def mixed(x: Column, a: Column, key: Column) -> Column:
    """A bijection of ``0 .. a² - 1``: a Feistel network of two digits to the base ``a``."""
    div = lambda u, v: F.call_function("div", u, F.lit(v).cast("long")) if isinstance(v, int) else F.call_function("div", u, v)
    left, right = div(x, a), x % a
    for k in range(ROUNDS):
        u = (right + (k + 1) * ROUND_STEP + key * KEY_STEP) * F.lit(FIRST).cast("long") % F.lit(WORD).cast("long")
        u = div(u, 256) * F.lit(SECOND).cast("long") % F.lit(WORD).cast("long")
        left, right = right, (left + div(u, 64)) % a
    return left * a + right


def place(number: Column, n: Column, key: Column) -> Column:
    """Where ``number`` of ``0 .. n - 1`` stands in the shuffle of ``key`` (0 to 100,000; ``n`` up to 2^52): a bijection of
    ``0 .. n - 1``. A place beyond ``n`` is mapped again until it is within; nearly all are at once. Null if any is null."""
    n, key = n.cast("long"), key.cast("long")
    a = side(n)
    once = mixed(number.cast("long"), a, key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < n, x).otherwise(mixed(x, a, key)))
    safe = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk outside the permutation's range did not end")).cast("long"))
    return F.when(once < n, once).when(once >= n, safe)
