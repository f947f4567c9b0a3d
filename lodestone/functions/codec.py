"""Variable-byte and delta coding of posting lists.

Numbers are cut into groups of seven bits, the most significant group first; every byte but the last has its high bit
set. Short lists can be encoded by a built-in expression; whole posting lists go through Arrow batch functions that work on all
numbers of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_BITS = 7
GROUPS = 9  # 63 bits


def varbyte_length(n: Column) -> Column:
    """Bytes that ``n`` takes when coded; null for null, an error for negative numbers."""
    size = F.lit(1)
    for g in range(1, GROUPS):
        size = F.when(n >= F.lit(1 << (GROUP_BITS * g)), g + 1).otherwise(size)
    return F.when(n >= 0, size).when(n.isNotNull(), F.raise_error(F.lit("varbyte: negative number"))).cast("bigint")


def varbyte_hex(numbers: Column) -> Column:
    """Upper-case hexadecimal form of the coded array ``numbers`` (bigint); an empty array gives an empty string."""

    def one(n: Column) -> Column:
        parts = [
            F.when(n >= F.lit(1 << (GROUP_BITS * g)), F.lpad(F.hex(F.shiftright(n, GROUP_BITS * g).bitwiseAND(127).bitwiseOR(128)), 2, "0")).otherwise("")
            for g in range(GROUPS - 1, 0, -1)
        ]
        last = F.lpad(F.hex(n.bitwiseAND(127)), 2, "0")
        return F.when(n >= 0, F.concat(*parts, last)).otherwise(F.raise_error(F.lit("varbyte: negative number")))

    return F.array_join(F.transform(numbers, one), "")


def encode_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, ends)``: the code of all numbers in a row, and where each one ends. Negative numbers raise ValueError."""
    if (numbers < 0).any():
        raise ValueError("varbyte: negative number")
    size = np.ones(len(numbers), dtype=np.int64)
    for g in range(1, GROUPS):
        size += numbers >= (1 << (GROUP_BITS * g))
    ends = np.cumsum(size)
    place = np.repeat(ends, size) - np.arange(int(ends[-1]) if len(ends) else 0) - 1  # groups that follow in the number
    data = ((np.repeat(numbers, size) >> (GROUP_BITS * place)) & 127).astype(np.uint8) | np.where(place > 0, 128, 0).astype(np.uint8)
    return data, ends


def decode_numbers(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, counts)`` of codes that lie one after the other and end at ``stops``; a truncated last number of a code comes out as far as it goes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(stops), np.int64)
    last = data < 128
    last[stops[np.diff(stops, prepend=0) > 0] - 1] = True
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(data))
    numbers = np.add.reduceat((data & 127).astype(np.int64) << (GROUP_BITS * place), starts)
    return numbers, np.diff(np.searchsorted(ends, stops), prepend=0)


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(values, stops)`` of a list array; a null list is empty, a null number 0."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts)


def _lists(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(values, pa.int64()))


@F.arrow_udf(T.BinaryType())
def varbyte_encode(numbers: pa.Array) -> pa.Array:
    """Coded bytes of the arrays of a bigint array column; null and empty give no bytes."""
    values, stops = _numbers(numbers)
    data, ends = encode_numbers(values)
    offsets = np.concatenate(([0], np.concatenate(([0], ends))[stops])).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


@F.arrow_udf(T.ArrayType(T.LongType()))
def varbyte_decode(data: pa.Array) -> pa.Array:
    """Array of the numbers coded in a binary column; null and empty give an empty array."""
    data = pc.fill_null(data, b"")
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    numbers, counts = decode_numbers(raw, offsets[1:] - offsets[0])
    return _lists(numbers, np.cumsum(counts))


@F.arrow_udf(T.ArrayType(T.LongType()))
def delta_decode(gaps: pa.Array) -> pa.Array:
    """Running sums of arrays of gaps: the ascending lists that were delta coded; null gives an empty array."""
    values, stops = _numbers(gaps)
    total = np.concatenate(([0], np.cumsum(values)))
    starts = np.concatenate(([0], stops[:-1]))
    return _lists(total[1:] - np.repeat(total[starts], stops - starts), stops)


@F.arrow_udf(T.ArrayType(T.LongType()))
def delta_encode(ids: pa.Array, base: pa.Array) -> pa.Array:
    """Gaps of ascending lists, the first one from ``base``; null gives an empty array."""
    values, stops = _numbers(ids)
    starts = np.concatenate(([0], stops[:-1]))
    some = stops > starts
    before = np.concatenate(([0], values[:-1])) if len(values) else values
    before[starts[some]] = base.to_numpy(zero_copy_only=False)[some]
    return _lists(values - before, stops)


def list_header(doc_count: Column, doc_bytes: Column, tf_bytes: Column) -> Column:
    """The 12 bytes before a list: three little-endian 32-bit numbers, the entries and the bytes of both coded arrays. A number of 2**32 or more is an error."""

    def word(n: Column) -> Column:
        big = F.lpad(F.hex(n.cast("bigint")), 8, "0")
        little = F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])
        return F.when((n >= 0) & (n < 1 << 32), little).otherwise(F.raise_error(F.lit("header: number out of range")))

    return F.unhex(F.concat(word(doc_count), word(doc_bytes), word(tf_bytes)))
