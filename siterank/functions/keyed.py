"""Randomness as a pure function of a key.

A draw is the hash of (seed, stream, draw, key ...), so a lost executor, another
partitioning or another engine gives the same numbers again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 311
TWO_52 = 4503599627370496.0


def uniform(stream: str, *parts, seed: int = SEED) -> Column:
    """Uniform on [0, 1) with 52 random bits, keyed by the given columns."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def _text(part) -> Column:
    column = part if isinstance(part, Column) else F.col(part)
    return column.cast("string")


def exponential(stream: str, *parts, seed: int = SEED) -> Column:
    """Unit exponential; half a step keeps the logarithm finite."""
    return -F.log(uniform(stream, *parts, seed=seed) + F.lit(0.5 / TWO_52))


def symmetric_beta(alpha: float, stream: str, *parts, seed: int = SEED) -> Column:
    """Beta(alpha, alpha) by its closed-form inverse for alpha in {0.5, 1, 2}."""
    u = uniform(stream, *parts, seed=seed)
    if alpha == 1.0:
        return u
    if alpha == 0.5:
        return F.pow(F.sin(u * F.lit(1.5707963267948966)), F.lit(2.0))
    if alpha == 2.0:
        return F.lit(0.5) - F.sin(F.asin(F.lit(1.0) - u * 2) / 3)
    raise ValueError("closed form known for alpha 0.5, 1 and 2 only")


def pick(count: Column, stream: str, *parts, seed: int = SEED) -> Column:
    """Integer in [0, count)."""
    return F.floor(uniform(stream, *parts, seed=seed) * count).cast("bigint")


ROUNDS, WALKS = 4, 24


def permuted(index: Column, size: Column, stream: str, seed: int = SEED) -> Column:
    """A keyed permutation of 0 .. size - 1.

    The number is split into two digits below a = ceil(sqrt(size)) and b = ceil(size / a), and each in turn is shifted by a hash of the other,
    which can be undone. Of the a * b numbers less than a lie beyond the size; one that lands there goes on until it is inside. Each step
    does so with odds below 1 / sqrt(size), or, for a small size, after all numbers beyond; a number that is still outside is an error.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    b = F.ceil(size / a).cast("bigint")

    def once(v: Column) -> Column:
        left, right = v % a, F.floor(v / a)
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + pick(a, stream, F.lit(str(k)), right, seed=seed)) % a
            else:
                right = (right + pick(b, stream, F.lit(str(k)), left, seed=seed)) % b
        return right * a + left

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(index.cast("bigint")), lambda v, _: F.when(v >= size, once(v)).otherwise(v))
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("the permutation did not settle")).cast("bigint"))
