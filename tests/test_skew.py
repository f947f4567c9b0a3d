import math
import random

from conftest import rows
from pyspark.sql import functions as F

from lodestone.operators import skew
from lodestone.operators.prefix import before


def exact(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1]


def test_quantiles_of_a_key_with_most_rows(spark):
    rng = random.Random(3)
    data = [("hot", rng.randrange(-(10**12), 10**12)) for _ in range(3000)] + [(f"k{i % 40}", rng.randrange(50)) for i in range(400)] + [("hot", None), (None, 4), ("one", -7)]
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(k, p): q for k, p, q in rows(skew.key_quantiles(spark.createDataFrame(data, "k string, v bigint"), "k", "v", probs))}
    groups = {}
    for k, v in data:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {(k, p): exact(v, p) for k, v in groups.items() for p in probs}


def test_quantiles_with_weights_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 5, 1), ("a", 9, 1), ("b", 3, 10), ("c", 1, 0)], "k string, v bigint, n bigint")
    got = rows(skew.key_quantiles(df, "k", "v", [0.5, 0.75], weight="n", digit_bits=2))
    assert got == [("a", 0.5, 1), ("a", 0.75, 5), ("b", 0.5, 3), ("b", 0.75, 3)]
    assert rows(skew.key_quantiles(df.where("false"), "k", "v", [0.5])) == []


def test_extreme_values(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([("a", low), ("a", 0), ("a", high)], "k string, v bigint")
    assert [q for _, _, q in rows(skew.key_quantiles(df, "k", "v", [0.1, 0.5, 1.0]))] == [low, 0, high]


def test_skew_join_is_a_join(spark):
    a = spark.createDataFrame([("h", i) for i in range(50)] + [("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("h", 10), ("x", 20), ("z", 30)], "k string, w int")
    assert rows(skew.skew_join(a, b, "k", ["h"])) == rows(a.join(b, "k"))
    assert rows(skew.skew_join(a, b, "k", ["h"], "left")) == rows(a.join(b, "k", "left"))


def test_term_totals(spark):
    data = [(0, "a", 0, "1:2,3:1"), (0, "a", 0, "1:2,3:1"), (1, "a", 0, "9:4"), (1, "b", 0, None), (0, None, 0, "1:1"), (0, "c", 0, "1:x"), (0, "d", None, "1:1")]
    df = spark.createDataFrame(data, "block_no int, term string, piece_no int, postings string").withColumn("n", F.lit(1)).withColumn("c", F.lit("x"))
    got = {r["term"]: (r["n_rows"], r["n_postings"], r["sum_tf"], r["tf_quantiles"]) for r in skew.term_totals(df, (0.5, 1.0)).collect()}
    assert got == {"a": (3, 3, 7, [2, 4]), "b": (1, 0, 0, None), None: (1, 0, 0, None), "c": (1, 0, 0, None), "d": (1, 0, 0, None)}
    assert {r["term"] for r in skew.hot_terms(df, 20).collect()} == {"a"}
    assert skew.term_totals(df.where("false")).count() == 0 and skew.hot_terms(df.where("false")).count() == 0


def test_salted_join_is_a_join(spark):
    a = spark.createDataFrame([("h", i) for i in range(50)] + [("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("h", i) for i in range(9)] + [("x", 20), ("z", 30), (None, 1)], "k string, w int")
    assert rows(skew.salted_join(a, b, "k", ["h"], "v")) == rows(a.join(b, "k")) == rows(skew.salted_join(a, b, "k", [], "v"))


def test_semi_join_is_a_semi_join(spark):
    a = spark.createDataFrame([(i % 7, i) for i in range(40)] + [(None, 1)], "k bigint, v int")
    b = spark.createDataFrame([(1, 0), (1, 0), (5, 0), (99, 0), (None, 0)], "k bigint, w int")
    want = rows(a.join(b, "k", "left_semi"))
    assert rows(skew.semi_join(a, b, "k")) == rows(skew.semi_join(a, b, "k", most=2)) == want


def test_running_sums(spark):
    data = [(i * i * 3001 % 40_000_003, i % 7) for i in range(900)]
    data = list({k: (k, v) for k, v in data}.values())
    got = rows(before(spark.createDataFrame(data, "id bigint, n bigint"), "id", "n", "first").select("id", "first"))
    total, want = 0, []
    for k, v in sorted(data):
        want.append((k, total))
        total += v
    assert got == want
