import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, tokens

TABLES = Path("/root/testdata/sf0.01")
needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="needs the vocabulary file")


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    bins, content = packing.best_fit(np.array(sizes, dtype=np.int64), 50)
    fill = Counter()
    for b, s in zip(bins.tolist(), sizes, strict=True):
        fill[b] += s
    assert [fill[i] for i in range(len(content))] == content.tolist() and all(0 < c <= 50 for c in content)
    assert all(a + b > 50 for i, a in enumerate(content.tolist()) for b in content.tolist()[:i])  # no two fit together
    assert len(content) <= math.ceil(11 / 9 * math.ceil(sum(sizes) / 50) + 6 / 9) + 1 or max(sizes) * 2 > 50


@pytest.mark.parametrize("leaves", [1, 3, 40])
def test_packing(spark, leaves):
    rng = random.Random(4)
    items = [(i, rng.randint(1, 700)) for i in range(600)] + [(7, 100), (7, 100), (1000, 0), (1001, None), (None, 5), (1002, 512), (1003, 100_000)]
    df = spark.createDataFrame(items, "item_id bigint, n_tokens bigint").withColumn("bin", F.lit("x")).repartition(leaves)
    got = packing.pack(df, [(1, 256), (2, 512), (2, 512), (3, None), (None, 4)]).collect()
    total = sum(n for i, n in items if i is not None and n)
    for spec, cap in ((1, 256), (2, 512)):
        own = [r for r in got if r["spec_id"] == spec]
        fill = Counter()
        for r in own:
            fill[r["container_id"]] += r["n_tokens"]
        assert sum(fill.values()) == total and max(fill.values()) <= cap
        assert len(fill) <= 1.03 * total / cap + 2
        parts = defaultdict(list)
        for r in own:
            parts[r["item_id"]].append((r["part_no"], r["start"], r["n_tokens"]))
        assert len(parts[1003]) == math.ceil(100_000 / cap) and all(len(parts[i]) == math.ceil(n / cap) for i, n in items[:600] if i != 7)
        at = 0
        for _, start, n in sorted(parts[1003]):
            assert start == at
            at += n
    assert packing.pack(df.where("false"), [(1, 256)]).count() == 0 and packing.pack(df, []).count() == 0


@needs_vocabulary
@pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")
def test_containers_of_the_middle_tables_come_from_several_levels(spark):
    from lodestone.llm import registry

    got = registry.p8_containers(spark, str(TABLES)).cache()
    assert {r[0] for r in got.select(F.shiftright("container_id", 58)).distinct().collect()} >= {0, 1}
    assert all(r["fill"] >= 0.99 for r in packing.summary(got, spark.read.parquet(f"{TABLES}/container_spec.parquet")).collect())


def test_two_capacities_for_one_spec(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "item_id bigint, n_tokens bigint"), [(1, 5), (1, 6)])


@needs_vocabulary
def test_token_counts(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(Path(tokens.VOCABULARY).with_suffix(".json")))
    whole.encode_special_tokens = True
    texts = ["Hello world", "  two  spaces\n\n", "été <|endoftext|> 12345", "x" * 5000, "日本 😀"]
    assert [tokens.count(t) for t in texts] == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(1, None), (2, ""), (3, texts[0])], "doc_id bigint, text string")
    assert [(r["doc_id"], r["n_tokens"]) for r in tokens.sized(df, ["doc_id"], "text").orderBy("doc_id").collect()] == [(1, 0), (2, 0), (3, 2)]


def test_routing():
    total, flow = mixing.route({("a",): 100, ("b",): 50, ("a", "b"): 40}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert total == pytest.approx(180, abs=20) and sum(v for (q, s), v in flow.items() if s == "a") == pytest.approx(total / 2, abs=1)
    total, flow = mixing.route({("a",): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.5, 3), "gone": (0.4, 2)})
    assert total == pytest.approx(60, abs=2) and flow[("b",), "b"] == pytest.approx(30, abs=1)
    assert mixing.route({("a",): 5}, {"z": (1.0, 1)}) == (0, {}) and mixing.route({}, {"z": (1.0, 1)}) == (0, {})
    assert mixing.route({("a",): 100, ("b",): 50}, {"a": (0.5, 0), "b": (0.5, 2)}) == (100, {(("b",), "b"): 100}) and mixing.route({("a",): 100}, {"a": (1.0, 0)}) == (0, {})
    assert mixing.route({("a",): 100}, {"a": (1.0, 1000)})[0] == pytest.approx(100_000, abs=1) and sum(w for _, w in mixing.steps(1000)) == 1000
    assert mixing.route({("a",): 100}, {"a": (1.0, 2)}, total=30)[0] == pytest.approx(30, abs=1)


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(6)
    words = ["lamp", "pump", "valve", "river", "stone", "cloud"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 40))) + f" {i}", "big" if i % 6 else "small") for i in range(900)]
    docs += [(2000 + i, docs[i * 6][1], "big") for i in range(20)] + [(3000, None, "big"), (3001, "", "big"), (3002, "no source", None), (3003, "extra " * 20, "other"), (1, docs[1][1], "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("uses", F.lit(1)).withColumn("set", F.lit("x"))
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.5, 3), (2, "small", 1.0, 2), (3, "gone", 1.0, 1), (4, "big", 0.9, None), (4, "gone", 0.1, 2), (None, "big", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets)
    shares = {(r["mix_id"], r["source"]): r for r in mixing.shares(got, targets).collect()}
    assert shares[1, "big"]["share"] == pytest.approx(0.5, abs=0.02) and shares[1, "small"]["share"] == pytest.approx(0.5, abs=0.02)
    assert shares[1, "small"]["most_uses"] == 3 and shares[1, "big"]["most_uses"] == 1 and shares[2, "small"]["most_uses"] == 2
    assert shares[3, "gone"]["tokens"] == 0 and shares[4, "big"]["share"] == 1.0
    used = Counter()
    text = {(i, s): x for i, x, s in docs}
    for m, i, s, uses, _ in rows(got):
        used[m, text[i, s]] += uses
    assert max(n for (m, _), n in used.items() if m == 1) == 3
    both = {docs[i * 6][1] for i in range(20)}
    assert all(n <= 1 for (m, x), n in used.items() if m == 1 and x in both)  # the strictest source's limit holds
    assert rows(mixing.mix(df, targets)) == rows(got)
    assert mixing.mix(df.where("false"), targets).count() == 0 and mixing.mix(df, targets.where("false")).count() == 0
