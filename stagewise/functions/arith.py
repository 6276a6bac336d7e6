"""Arithmetic hashing: the same numbers in every engine, in place of random draws."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed multiplier and modulus of the hash.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def hash32(key: Column | str, seed: int = 42) -> Column:
    """(key * multiplier + seed) mod 2^32."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(key.cast("long") * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def pair_hash32(user: Column | str, item: Column | str, seed: int = 42) -> Column:
    """Hash of a (user, item) pair."""
    user, item = (F.col(c) if isinstance(c, str) else c for c in (user, item))
    return hash32(F.pmod(user * F.lit(1_000_003) + item * F.lit(7919), F.lit(2_000_000_011)), seed)


def softmax(score: Column | str, temperature: float, *group: str) -> Column:
    """A row's share of its group: exp(score / temperature) over the group's sum, taken from the largest score so that it can't overflow."""
    score = F.col(score) if isinstance(score, str) else score
    own = Window.partitionBy(*group)
    power = F.exp((score - F.max(score).over(own)) / F.lit(float(temperature)))
    return power / F.sum(power).over(own)


def binary_round(x: Column | str, digits: int) -> Column:
    """Rounded as most SQL engines round doubles: the product with 10^digits to the next whole number, halves away from zero.

    Spark's ``round`` looks at the shortest decimal of a double instead, so that the two
    differ where it ends in a 5: 0.1261975 x 10^6 is 126197.49999999999.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
