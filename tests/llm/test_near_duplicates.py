import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as nd
from lodestone.llm import shingles


def runs(text, width):
    import re

    k = [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if 2 <= len(t) <= 20]
    return {tuple(k[i : i + width]) for i in range(len(k) - width + 1)}


def brute(data, width, share, least):
    sets = [(i, s) for i, t in data if len(s := runs(t, width)) >= least]
    return {(min(a, b), max(a, b)) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a != b and len(s & t) >= share * len(s | t) - 1e-9}


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(n)]
    data = list(enumerate(base))
    for k in range(n):  # copies, edits, excerpts, other order
        w = base[rng.randrange(n)].split()
        kind = k % 4
        if kind == 1:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 2:
            w = w[: max(14, int(len(w) * 0.8))]
        elif kind == 3:
            h = len(w) // 2
            w = w[h:] + w[:h]
        data.append((n + k, " ".join(w)))
    return data


def test_tokens_equal_the_rule():
    texts = ["A1 x it's été " + "a" * 20 + " " + "b" * 21, None, "", "Kb İx foo_bar " * 3, "x" * 50_000 + " yy zz", "tail end"]
    row, h = shingles.token_hashes(pa.array(texts))
    import re

    want = [[t for t in re.findall("[a-z0-9]+", (x or "").lower()) if 2 <= len(t) <= 20] for x in texts]
    assert [sum(row == i) for i in range(len(texts))] == [len(k) for k in want]
    flat = [t for k in want for t in k]
    assert len(set(h.tolist())) == len(set(flat)) and len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat))
    sliced = shingles.token_hashes(pa.array(texts)[3:])
    assert sliced[1].tolist() == h[row >= 3].tolist()


@pytest.mark.parametrize(("width", "share", "least"), [(3, 0.6, 10), (5, 0.8, 1)])
def test_pairs_against_brute_force(spark, width, share, least):
    data = corpus() + [(500, None), (501, ""), (502, "too short"), (503, "Alpha beta")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id bigint, text string, cls string, key int")
    got = rows(nd.duplicate_pairs(df, width=width, share=share, min_runs=least))
    want = brute(data, width, share, least)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)


def test_groups(spark):
    data = corpus(30, 9)
    df = spark.createDataFrame([*data, (900, None), (None, data[0][1])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["group"] for r in nd.duplicate_groups(df, width=3, share=0.6, min_runs=10).collect()}
    pairs = rows(nd.duplicate_pairs(df, width=3, share=0.6, min_runs=10))
    root = {i: i for i, _ in data} | {900: 900}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for i in root}


def test_one_text_on_a_third_of_the_rows(spark):
    text = " ".join(f"same{i}" for i in range(30))
    data = [(i, text) for i in range(40)] + [(100 + i, f"other{i} " + " ".join(f"v{i}x{j}" for j in range(20))) for i in range(80)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert nd.duplicate_pairs(df, width=3, share=0.6, min_runs=10).count() == 40 * 39 // 2
    links = nd.class_pairs(df, "doc_id", "text", 3, 0.6, 10)[1]
    assert links.count() == 0  # copies are one class


def test_a_third_of_the_rows_are_edited_copies(spark):
    rng = random.Random(3)
    text = [f"same{i}" for i in range(98)]
    data = [(i, " ".join(f"own{i}x{j}" if j in edits else w for j, w in enumerate(text))) for i in range(120) for edits in [set(rng.sample(range(98), 4))]]
    data += [(1000 + i, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(240)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got, want = set(rows(nd.duplicate_pairs(df, width=3, share=0.6, min_runs=10))), brute(data, 3, 0.6, 10)
    assert len(want) > 7000 and got <= want and len(got) >= 0.99 * len(want)
    assert len({r["group"] for r in nd.duplicate_groups(df, width=3, share=0.6, min_runs=10).collect()}) == 241


def test_excerpts_are_no_cases(spark):
    words = [f"w{i}" for i in range(100)]
    data = [(1, " ".join(words)), (2, " ".join(words[:40])), (3, " ".join(words[:64])), (4, " ".join(words[:60]))]  # 38, 62 and 58 of 98 runs
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(nd.duplicate_pairs(df, width=3, share=0.6, min_runs=10)) == sorted(brute(data, 3, 0.6, 10)) == [(1, 3), (2, 3), (2, 4), (3, 4)]


def sketch_pairs(sketches, radius=nd.RADIUS):
    return {(i, j) for j, q in enumerate(sketches) for i, p in enumerate(sketches[:j]) if (p ^ q).bit_count() <= radius}


def test_trees_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    trees = [np.unique(rng.integers(0, 1 << nd.SYMBOLS, size=n, dtype=np.uint64)) for n in (1, 2, 40, 300)]
    tree = np.repeat(np.arange(4), [len(x) for x in trees])
    for radius in (0, 1, 3):
        forest = nd.Forest(tree, np.concatenate(trees))
        got = [(int(a), int(b)) for p, q in forest.within(radius, step=5000) for a, b in zip(np.minimum(p, q), np.maximum(p, q), strict=True)]
        first = np.cumsum([0, *[len(x) for x in trees]])
        want = {(a + f, b + f) for x, f in zip(trees, first, strict=False) for a, b in sketch_pairs(x.tolist(), radius)}
        assert len(got) == len(set(got)) and set(got) == want


def test_trees_leave_out_most_nodes():
    sketches = np.random.default_rng(2).permutation(1 << nd.SYMBOLS)[:2000].astype(np.uint64)
    forest = nd.Forest(np.zeros(2000, np.int64), sketches)
    found = sum(len(p) for p, _ in forest.within())
    assert found and forest.visits < 0.05 * 2000 * 2000


@pytest.mark.parametrize("part", [nd.PART, 3])
def test_candidates(spark, monkeypatch, part):
    """All pairs of a shard within the radius, also where groups are large; a class that comes from several tasks counts once."""
    monkeypatch.setattr(nd, "PART", part)
    rng = random.Random(2)
    data = [(key << nd.SYMBOLS | rng.choice([5, 7, 15, 1024, 1025, 60000]), c) for key in (-3, 4, 9) for c in rng.sample(range(1000), 40)]
    df = spark.createDataFrame([*data, *data[:30]], "k bigint, cls bigint")
    maps = spark.createDataFrame([(c, 50, 0, 0, 0, 0) for c in {c for _, c in data}], "id bigint, size bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    want = {(min(a, b), max(a, b)) for i, (k, a) in enumerate(data) for m, b in data[:i] if a != b and k >> nd.SYMBOLS == m >> nd.SYMBOLS and ((k ^ m) & 0xFFFF).bit_count() <= nd.RADIUS}
    assert rows(nd.group_pairs(nd.groups_of(df), maps, 0.6)) == sorted(want)


def test_many_small_sets_share_no_shard(spark):
    data = [(i, f"aa{i} bb{i} cc{i}") for i in range(3000)] + [(5000 + i, f"xx{i} yy{i} zz{i} uu{i}") for i in range(300)] + [(6000, "aa7 bb7 cc7"), (6001, "xx7 yy7 zz7 uu7 vv7")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(nd.duplicate_pairs(df, width=3, share=0.6)) == [(7, 6000), (5007, 6001)]
    texts = nd.prepared(df, "doc_id", "text")
    assert nd.groups_of(nd.shard_rows(texts, 3, 1, nd.key_counts(texts, 3, 1))).count() < 200


def test_maps_leave_out_no_case(spark):
    df = spark.createDataFrame(corpus(40, 8), "doc_id bigint, text string")
    maps = nd.class_maps(df, 3, 10)
    every = maps.selectExpr("1L as g", "id")
    kept = set(rows(nd.group_pairs(every, maps, 0.6)))
    ids = dict(rows(nd.memberships(df, 3, 10)))
    first = {i: int.from_bytes(bytes(c)[:8], "little", signed=True) for i, c in ids.items()}
    want = {tuple(sorted((first[a], first[b]))) for a, b in brute(corpus(40, 8), 3, 0.6, 10) if ids[a] != ids[b]}
    assert want <= kept and len(kept) < 3 * len(want) + 20


def test_hot_shards_are_split_before_the_shuffle():
    rng = np.random.default_rng(3)
    keys = np.full(5000, 77 << nd.SYMBOLS, dtype=np.uint64)
    sketch = rng.integers(0, 1 << nd.SYMBOLS, size=5000, dtype=np.uint64)
    sketch[:2] = (4, 6)
    row, key = nd.split_keys(keys, sketch, np.full(5000, 3, np.int8))
    assert len(row) == 8 * 5000
    shards = {k: set(row[key == k].tolist()) for k in np.unique(key).tolist()}
    assert max(map(len, shards.values())) < 0.25 * 5000
    together = lambda a, b: any(a in s and b in s for s in shards.values())
    assert together(0, 1) and all(together(i, i + 1) for i in range(200) if int(sketch[i] ^ sketch[i + 1]).bit_count() <= 1)
    counts = np.zeros(nd.CELLS, np.int64)
    counts[:3] = nd.HOT // 2, 2 * nd.HOT, 100 * nd.HOT
    assert nd.levels_of(counts)[:4].tolist() == [0, 1, 6, 0]


@pytest.mark.parametrize("part", [nd.PART, 2])
def test_expand(spark, monkeypatch, part):
    monkeypatch.setattr(nd, "PART", part)
    members = [(i, i % 3) for i in range(20)]
    links = spark.createDataFrame([(0, 1), (2, 2)], "a int, b int")
    got = {(min(r), max(r)) for r in rows(nd.expand(links, spark.createDataFrame(members, "id bigint, cls int")))}
    want = {(min(x, y), max(x, y)) for x, a in members for y, b in members if (a, b) == (0, 1) or (a == b == 2 and x < y)}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (4, 1), (20, 20)], "a bigint, b bigint")
    assert {(r["doc_id"], r["group"]) for r in nd.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.duplicate_pairs(df).count() == 0 and nd.duplicate_groups(df).count() == 0


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20)))] * 1 + [(2, " ".join(f"a{i}" for i in range(20)))], "doc_id bigint, text string")
    for c in ("a", "b", "rep", "runs", "group", "n"):
        df = df.withColumn(c, F.lit("z"))
    assert rows(nd.duplicate_pairs(df)) == [(1, 2)]
