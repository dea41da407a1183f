"""Bit-mask predicates over signed 64-bit masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def passes(bits: Column, on: int = 0, off: int = 0, any_of: Sequence[int] = ()) -> Column:
    """All bits of ``on`` are set, none of ``off`` is, and each mask of ``any_of`` that isn't 0 has one set."""
    ok = (bits.bitwiseAND(F.lit(on)) == F.lit(on)) & (bits.bitwiseAND(F.lit(off)) == 0)
    for mask in any_of:
        if mask:
            ok = ok & (bits.bitwiseAND(F.lit(mask)) != 0)
    return ok


#: The bit that a field's value stands for.
POSITIONS = {
    ("status", "active"): 0,
    ("status", "inactive"): 1,
    ("category", "A"): 2,
    ("category", "B"): 3,
    ("category", "C"): 4,
    ("type", "internal"): 5,
    ("type", "external"): 6,
}


def position(field: Column, value: Column, positions: dict[tuple[str, str], int] = POSITIONS) -> Column:
    """The bit of a field's value, -1 where it has none."""
    out = F.lit(-1)
    for (f, v), p in positions.items():
        out = F.when((field == f) & (value == v), p).otherwise(out)
    return out


def mask(field: Column, value: Column, positions: dict[tuple[str, str], int] = POSITIONS) -> Column:
    """The mask with the bit of a field's value, 0 where it has none."""
    at = position(field, value, positions)
    return F.when(at >= 0, F.expr("1L") * F.pow(F.lit(2.0), at).cast("long")).otherwise(F.lit(0).cast("long"))


def ranges_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two closed ranges share a point."""
    return (a_low <= b_high) & (b_low <= a_high)
