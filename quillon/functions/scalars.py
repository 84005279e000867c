"""Integers as little-endian bytes and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(value: Column, size: int) -> Column:
    """An integer as `size` little-endian bytes (4 or 8)."""
    digits = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def from_bytes(data: Column, size: int) -> Column:
    """The integer of `size` little-endian bytes; four bytes are unsigned."""
    digits = F.hex(data)
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, -10).cast("long")
