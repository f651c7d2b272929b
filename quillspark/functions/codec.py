"""Posting codecs as column functions: ascending integers to bytes and back.

``delta_vbyte``: gaps (the first value as it is) in groups of seven bits, high groups first, the top bit set on
all bytes but a gap's last. ``fixed``: four bytes each, high byte first. An empty list gives empty bytes, null
gives null; a falling value raises an error, as its gap has no code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gaps(values: Column) -> Column:
    """Differences of neighbours; the first value stays."""
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(values, i - 1).cast("long"))
    return F.transform(values, lambda x, i: x.cast("long") - before(i))


def _byte(b: Column) -> Column:
    return F.lpad(F.hex(b), 2, "0")


def vbyte_hex(gap: Column) -> Column:
    """The code of one gap as hexadecimal digits."""
    groups = [F.when(gap >= (1 << (7 * k)), _byte(F.shiftright(gap, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)))).otherwise("") for k in range(8, 0, -1)]
    return F.concat(*groups, _byte(gap.bitwiseAND(F.lit(127))))


def delta_vbyte_hex(values: Column) -> Column:
    code = lambda g: F.when(g < 0, F.raise_error(F.lit("values must not fall")).cast("string")).otherwise(vbyte_hex(g))
    return F.array_join(F.transform(gaps(values), code), "")


def delta_vbyte(values: Column) -> Column:
    return F.unhex(delta_vbyte_hex(values))


def _decoded(code: bytes) -> np.ndarray:
    data = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(data < 128)
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        raise ValueError("the code ends within a gap")
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(data))
    return np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _decode(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: None if c is None else _decoded(c), na_action=None)


def delta_vbyte_decode(code: Column, start: int | Column = 0, length: int | Column | None = None) -> Column:
    """Values behind ``code`` (binary), or behind its ``length`` bytes from byte ``start``, which must begin a gap: a slice
    decodes with its deltas starting anew. Time grows with the bytes; a fold of built-in functions would copy its list for
    each value."""
    if length is not None:
        code = F.substring(code, _plus_one(start), length)
    elif not isinstance(start, int) or start:
        code = F.substring(code, _plus_one(start), F.octet_length(code))
    return _decode(code)


def _plus_one(start: int | Column):
    return F.lit(start + 1) if isinstance(start, int) else start + 1


def fixed_hex(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fixed(values: Column) -> Column:
    return F.unhex(fixed_hex(values))


def fixed_decode(code: Column) -> Column:
    digits = F.hex(code)
    n = (F.length(digits) / 8).cast("int")
    value = lambda i: F.conv(F.substr(digits, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(value(i) >= (1 << 31), value(i) - (1 << 32)).otherwise(value(i)))).otherwise(F.array().cast("array<bigint>"))
