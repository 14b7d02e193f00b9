"""Deterministic draws: the same in any engine, for they are slices of MD5 and SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def digest(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by bars."""
    return F.md5(_text(*parts))


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 1): the first 13 hex digits over 16^13, exact in a double."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("double") / float(16**13)


def pick(n: Column | int, *parts: Column | str | int) -> Column:
    """An integer from 0 to n - 1."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("long") % (n if isinstance(n, Column) else F.lit(n))


def sampled(rate: float, seed: int, *key: Column) -> Column:
    """Whether a key is in a sample: all at rate 1 and above, none at 0 and below."""
    return F.lit(True) if rate >= 1 else F.lit(False) if rate <= 0 else draw(seed, *key) < rate


def shard_of(key: Column, shards: int) -> Column:
    """Shard by the first 16 hex digits of SHA-256, unsigned."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards).cast("decimal(20,0)")).cast("long")


def stable_id(*parts: Column | str | int) -> Column:
    """24 hex digits of SHA-256 over the parts."""
    return F.substring(F.sha2(_text(*parts), 256), 1, 24)
