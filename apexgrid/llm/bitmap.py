"""A membership filter of fixed size, for lookups in the tasks that scan large tables."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_PAGE = 32768


def slot(value: Column, bits: int) -> Column:
    """The bit (from 1) that a 64-bit value sets; ``bits`` is a power of two."""
    return 1 + F.pmod(value, F.lit(bits))


def bitmap(values: DataFrame, value: Column, bits: int) -> np.ndarray:
    """Bits set by a column. At most ``bits / 8`` bytes reach the driver, however many rows there are."""
    pages = values.select(slot(value, bits).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("page")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in pages:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["page"] - 1) * (_PAGE // 8)
        out[at:at + len(own)] = own[:len(out) - at]
    return out


def holds(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set. False answers are sure, true ones may be due to another value."""
    at = slots - 1
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
