import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import codec

VECTORS = {0: "00", 5: "05", 127: "7F", 128: "8100", 300: "822C", 16384: "818000"}


def test_vectors(spark):
    df = spark.createDataFrame([(list(VECTORS),), ([],)], "n array<bigint>")
    got = [r[0] for r in df.select(codec.varbyte_hex(F.col("n"))).collect()]
    assert got == ["".join(VECTORS.values()), ""]
    data, ends = codec.encode_numbers(np.array(list(VECTORS)))
    assert data.tobytes().hex().upper() == "".join(VECTORS.values()) and ends[-1] == len(data)


def decode(*codes):
    numbers, counts = codec.decode_numbers(np.frombuffer(b"".join(codes), dtype=np.uint8), np.cumsum([len(c) for c in codes]))
    return [x.tolist() for x in np.split(numbers, np.cumsum(counts)[:-1])]


def test_truncated():
    assert decode(b"\x82") == [[2]]
    assert decode(b"\x05\x82\x2c\x01", b"", b"\x81\x82", b"\x07") == [[5, 300, 1], [], [130], [7]]
    assert decode(b"") == [[]]


@given(st.lists(st.lists(st.integers(0, 2**62), max_size=40), min_size=1, max_size=8))
def test_round_trip(lists):
    codes = [codec.encode_numbers(np.array(x, dtype=np.int64))[0].tobytes() for x in lists]
    assert decode(*codes) == lists


def test_negative_numbers_raise(spark):
    with pytest.raises(ValueError):
        codec.encode_numbers(np.array([1, -1]))
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([([-1],)], "n array<bigint>").select(codec.varbyte_hex(F.col("n"))).collect()


def test_header(spark):
    df = spark.createDataFrame([(1, 300, 70_000)], "a bigint, b bigint, c bigint")
    assert bytes(df.select(codec.list_header(F.col("a"), F.col("b"), F.col("c"))).first()[0]).hex() == "010000002c01000070110100"
    with pytest.raises(Exception, match="out of range"):
        df.select(codec.list_header(F.lit(1 << 32), F.col("b"), F.col("c"))).collect()


def test_lists_through_spark(spark):
    df = spark.createDataFrame([([3, 70_000, 70_001],), ([],), (None,)], "n array<bigint>")
    gaps = codec.delta_encode(F.col("n"), F.lit(0))
    out = df.select(codec.delta_decode(codec.varbyte_decode(codec.varbyte_encode(gaps))).alias("n"), codec.varbyte_length(F.lit(300)).alias("k")).collect()
    assert [r["n"] for r in out] == [[3, 70_000, 70_001], [], []] and out[0]["k"] == 2
