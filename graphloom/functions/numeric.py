"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(a: Column, b: Column) -> Column:
    """The integer part of a / b, exact for bigints; null for b = 0 and for the one quotient that a bigint cannot hold."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when((b != 0) & ~((b == -1) & (a == F.lit(-(2**63)))), F.call_function("div", a, F.nullif(b, F.lit(0))))


def _rest(a: Column, b: Column) -> Column:
    return F.call_function("try_mod", a.cast("bigint"), b.cast("bigint"))


def ceil_div(a: Column, b: Column) -> Column:
    """a / b rounded up, for integers of any sign, exact; null for b = 0."""
    q, r = _whole(a, b), _rest(a, b)
    return q + ((r != 0) & ((r > 0) == (b > 0))).cast("bigint")


def floor_div(a: Column, b: Column) -> Column:
    """a / b rounded down, exact; null for b = 0."""
    q, r = _whole(a, b), _rest(a, b)
    return q - ((r != 0) & ((r > 0) != (b > 0))).cast("bigint")


def round_div(a: Column, b: Column) -> Column:
    """a / b rounded half up, exact; null for b = 0."""
    down = floor_div(a, b)
    # The rest towards b's sign, compared with what is left of b: no product can overflow.
    r = a.cast("bigint") - down * b.cast("bigint")
    return down + F.when(b > 0, (r >= b - r).cast("bigint")).otherwise((r <= b - r).cast("bigint"))


def upper_multiple(a: Column, m: int) -> Column:
    """The smallest multiple of m that is at least a."""
    return ceil_div(a, F.lit(m)) * m


def lower_multiple(a: Column, m: int) -> Column:
    """The largest multiple of m that is at most a."""
    return floor_div(a, F.lit(m)) * m


def multiplies(a: Column, b: Column) -> Column:
    """Whether a * b fits a bigint."""
    return F.call_function("try_multiply", a.cast("bigint"), b.cast("bigint")).isNotNull()


def factorial(a: Column) -> Column:
    """a! for 0 <= a <= 20, null beyond what a bigint holds."""
    return F.factorial(a.cast("int"))


def is_power2(a: Column) -> Column:
    return (a > 0) & (a.bitwiseAND(a - 1) == 0)


def floor_log2(a: Column) -> Column:
    """Position of the highest bit, exact for every positive bigint; null otherwise."""
    return F.when(a > 0, F.length(F.bin(a)) - 1)


def ceil_log2(a: Column) -> Column:
    """The smallest k with 2^k >= a; null for a < 1."""
    return F.when(a == 1, F.lit(0)).when(a > 1, F.length(F.bin(a - 1)))


def next_power2(a: Column) -> Column:
    """The smallest power of two that is at least a; null for a < 1."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), ceil_log2(a).cast("int"))


def read_bit(a: Column, k: Column) -> Column:
    return F.call_function("shiftright", a, k.cast("int")).bitwiseAND(F.lit(1)) == 1


def write_bit(a: Column, k: Column, on: bool = True) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))
    return a.bitwiseOR(bit) if on else a.bitwiseAND(F.bitwise_not(bit))


def per_cent(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.nullif(whole, F.lit(0))


def geometric_series(ratio: Column, n: Column) -> Column:
    """1 + ratio + ... + ratio^(n-1)."""
    return F.when(ratio == 1, n.cast("double")).otherwise((1 - F.pow(ratio, n)) / (1 - ratio))


def gcd(a: Column, b: Column, steps: int = 93) -> Column:
    """Greatest common divisor; 93 steps of Euclid reach the end for any two bigints."""
    pair = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, lambda p, _: F.when(p.y == 0, p).otherwise(F.struct(p.y.alias("x"), F.call_function("try_mod", p.x, p.y).alias("y"))), lambda p: p.x)
    return F.when(a.isNotNull() & b.isNotNull(), last)


def near(a: Column, b: Column, eps: float = 1e-6, relative: bool = False) -> Column:
    """Whether two numbers differ by at most eps, or eps times the larger of them."""
    d = F.abs(a - b)
    return d <= (F.lit(eps) * F.greatest(F.abs(a), F.abs(b)) if relative else F.lit(eps))


def bucket_hash(a: Column, buckets: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(a, F.lit(seed)), F.lit(buckets))
