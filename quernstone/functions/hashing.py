"""Keyed hashes: deterministic splits, orders and draws at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(salt: str, *keys: Column | str) -> Column:
    """SHA-256 of salt:key:key... in lower-case hexadecimal."""
    return F.sha2(F.concat_ws(":", F.lit(salt), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)


def keyed(salt: str, *keys: Column | str) -> Column:
    """60-bit integer of salt:key:key..."""
    return F.conv(F.substring(digest(salt, *keys), 1, 15), 16, 10).cast("bigint")


def unit(salt: str, *keys: Column | str) -> Column:
    """keyed() as a double in [0, 1)."""
    return keyed(salt, *keys) / F.lit(float(1 << 60))


def content_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts, separated by a zero byte."""
    return F.sha2(F.concat_ws("\0", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def split_name(share: Column, shares: dict[str, float]) -> Column:
    """The name whose part of [0, 1), in order, holds share."""
    at, out = 0.0, None
    for name, s in list(shares.items())[:-1]:
        at += s
        out = F.when(share < at, name) if out is None else out.when(share < at, name)
    return out.otherwise(list(shares)[-1])
