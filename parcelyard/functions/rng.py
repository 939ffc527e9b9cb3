"""Keyed random numbers: the same for the same keys on any engine and in any order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def keyed(replicate: Column, item: Column) -> Column:
    """An integer below PRIME from two keys, by three rounds modulo it; every product stays under 2^63."""
    p, y = replicate.cast("long"), item.cast("long")
    u = (48271 * ((p * 1000003 + y) % PRIME) + 11) % PRIME
    u = (u * u + 69621 * (u % 30011) + 7) % PRIME
    return (u * u + 40692 * (u % 20011) + p) % PRIME


def keyed_sql(p: str, y: str) -> str:
    """The same as SQL text."""
    u1 = f"((48271 * (({p} * 1000003 + {y}) % {PRIME}) + 11) % {PRIME})"
    u2 = f"(({u1} * {u1} + 69621 * ({u1} % 30011) + 7) % {PRIME})"
    return f"(({u2} * {u2} + 40692 * ({u2} % 20011) + {p}) % {PRIME})"


def normal(replicate: Column, item: Column) -> Column:
    """About a standard normal: twelve uniforms less six."""
    total = None
    for k in range(12):
        u = keyed(replicate, item * 12 + k) / float(PRIME)
        total = u if total is None else total + u
    return total - 6
