"""Near-duplicate passages: token runs of which a share of the union is common.

1. Passages with the same set of runs form a class (128 bits of hash); one of them stands for it from here on.
2. A class gets BANDS triples of min-hashes of its runs, all of which weigh the same: in a group of edited copies the runs that all share
   decide. A band deals the runs to three parts, and each part has a min-hash, so no run decides twice. The first two of a triple are
   a shard key, the third gives a short sketch of SYMBOLS bits.
3. In every shard a BK-tree is built over the sketches. A child hangs under its parent at the integer Hamming distance of their sketches;
   a search follows only the edges within the small radius. Equal sketches share a node. Classes of a node, and of two nodes within the
   radius, are candidates of each other; they leave the trees as members of a group, not as pairs.
4. Shards that a table of counts tells to be hot are split before they are shuffled, by the tree's own rule: a virtual root is derived
   from the key, a class goes to the edge of its distance and to those below it within the radius, level by level.
5. The pairs of a group are left out where maps of 256 bits of their runs prove that they are no case. The others are compared by
   their whole sets of runs, and pairs of classes are carried over to their members.

A pair of classes with share s of the union in common is missed with chance (1 - s**3)**BANDS or so: 4e-4 at 0.6, 3e-5 at 0.65, 2e-6 at 0.7.
Shard trees are routed by key and never broadcast: all trees together grow with the collection.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import mix, run_sets
from lodestone.operators.skew import heavy_keys, skew_join
from lodestone.operators.storage import cut, release

BANDS = 32
SYMBOLS, RADIUS = 16, 1  # bits of a sketch; unrelated ones differ in 8 on average
CELLS = 1 << 20  # of the table that counts shard keys
HOT = 1 << 16  # classes under one key, more than a cell holds on average, beyond which the key's tree is split before the shuffle
PART = 4096  # members of a group beyond which its pairs are made by several tasks
ROWS, BLOCK = 8192, 1024  # passages worked on at once
BLOOM_BITS = (20, 26)  # least and most bits of a Bloom filter, as powers of two: 128 KB to 8 MB
_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, size=(BANDS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_LOW = np.uint64((1 << SYMBOLS) - 1)


def _sets(ids: np.ndarray, texts: pa.Array, width: int, min_runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc_ids, at, count, runs)``: for the passages with at least min_runs distinct runs, where their runs begin, how many, and all of these runs."""
    row, runs = run_sets(texts, width)
    count = np.bincount(row, minlength=len(ids))
    kept = count >= min_runs
    count, runs = count[kept], runs[kept[row]]
    return ids[kept], np.cumsum(count) - count, count, runs


def _minima(runs: np.ndarray, at: np.ndarray, parts: range) -> np.ndarray:
    """Min-hashes of each row, 32 bits each, BANDS x parts x rows: of the runs that a band deals to the part, of all runs where these are none.

    Rows whose other parts agree thus agree in an empty one too, and small sets do not all fall into one shard.
    """
    h, none = (mix(runs) >> np.uint64(16)).astype(np.uint32), np.uint32(0xFFFFFFFF)
    out = np.empty((BANDS, len(parts), len(at)), dtype=np.uint32)
    for lo in range(0, len(at), BLOCK):  # small enough for a core's own memory
        first = at[lo]
        x, rows = h[first : at[lo + BLOCK] if lo + BLOCK < len(at) else len(h)], at[lo : lo + BLOCK] - first
        for j in range(BANDS):
            u = x * _SEEDS[j, 0] + _SEEDS[j, 1]
            part = ((u & np.uint32(0xFFFF)) * np.uint32(3)) >> np.uint32(16)
            for i, k in enumerate(parts):
                np.minimum.reduceat(u | -(part != k).astype(np.uint32), rows, out=out[j, i, lo : lo + BLOCK])
            empty = (found := out[j, :, lo : lo + BLOCK]) == none
            if empty.any():
                np.copyto(found, np.minimum.reduceat(u, rows)[None, :], where=empty)
    return out


def _classes(runs: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The class of each row, two words: sums of two hashes of its runs."""
    one = mix(np.add.reduceat(mix(runs), at) + count.astype(np.uint64))
    two = mix(np.add.reduceat(mix(runs ^ np.uint64(0x5DEECE66D)), at) ^ one)
    return np.stack((one, two), axis=1)


def _first_of_class(cls: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the first passage of every class that this task has not met; ``seen`` grows with the task's part only."""
    _, first = np.unique(cls, return_index=True)
    first.sort()
    fresh = [i for i, c in zip(first.tolist(), cls[first].tolist(), strict=True) if c not in seen]
    seen.update(cls[fresh].tolist())
    return np.array(fresh, dtype=np.int64)


def _binary(cls: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(np.ascontiguousarray(cls))]).cast(pa.binary())


def _each(texts: DataFrame, width: int, min_runs: int, emit, schema: str) -> DataFrame:
    """``emit(doc_ids, cls, runs, at, count, seen)`` on every slice of at most ROWS passages."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in it:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                ids, at, count, runs = _sets(b.column(0).to_numpy(zero_copy_only=False), b.column(1), width, min_runs)
                if len(ids):
                    yield pa.RecordBatch.from_arrays(emit(ids, _classes(runs, at, count), runs, at, count, seen), names=names)

    return texts.mapInArrow(run, schema)


def memberships(texts: DataFrame, width: int, min_runs: int) -> DataFrame:
    """``(id, cls)``: the class of every passage, which stands for its set of runs."""
    emit = lambda ids, cls, *_: [pa.array(ids, pa.int64()), _binary(cls)]
    return _each(texts, width, min_runs, emit, "id bigint, cls binary")


def _keys(minima: np.ndarray) -> np.ndarray:
    """The shard keys of each row, BANDS x rows; the low bits are left free for the sketch."""
    return np.stack([mix(mix(m[0].astype(np.uint64) + np.uint64(j << 32)) + m[1].astype(np.uint64)) & ~_LOW for j, m in enumerate(minima)])


def _own(fresh: np.ndarray, runs: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(runs, at, count)`` of the rows ``fresh``, in ascending order, alone."""
    take = np.zeros(len(at), dtype=bool)
    take[fresh] = True
    own = count[take]
    return runs[np.repeat(take, count)], np.cumsum(own) - own, own


def _cell(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) & np.uint64(CELLS - 1)).astype(np.int64)


def key_counts(texts: DataFrame, width: int, min_runs: int) -> np.ndarray:
    """Classes by hash cell of their shard keys, an array of CELLS counts: no key has more classes than its cell.

    Each task counts its own part and sends compressed blocks; blocks are added up in groups of at most 64, in as many rounds as
    it takes, so that no task and not the driver holds more than a fixed amount.
    """
    block = CELLS // 16

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(CELLS, dtype=np.int64), set()
        for whole in it:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                ids, at, n, runs = _sets(b.column(0).to_numpy(zero_copy_only=False), b.column(1), width, min_runs)
                fresh = _first_of_class(_classes(runs, at, n)[:, 0], seen) if len(ids) else ids
                if len(fresh):
                    own, first, _ = _own(fresh, runs, at, n)
                    cells += np.bincount(_cell(_keys(_minima(own, first, range(2)))).reshape(-1), minlength=CELLS)
        src = np.random.default_rng().integers(0, 2**40)
        data = [zlib.compress(cells[i * block : (i + 1) * block].tobytes(), 1) for i in range(16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([src] * 16, pa.int64()), pa.array(data, pa.binary())], names=["block", "src", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.int64)
        for x in pdf["data"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "src": [int(pdf["src"].iloc[0])], "data": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, src bigint, data binary"
    parts = texts.mapInArrow(count, schema)
    left = texts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 64)
        parts = parts.groupBy("block", (F.pmod("src", F.lit(left))).alias("g")).applyInPandas(add, schema)
    table = np.zeros(CELLS, dtype=np.int64)
    for r in parts.collect():  # 16 blocks
        table[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["data"]), dtype=np.int64)
    return table


def levels_of(counts: np.ndarray) -> np.ndarray:
    """How many levels of the tree to split off before the shuffle, for each cell: a level leaves about 0.4 of a shard's classes together."""
    over = np.maximum(1.0, (counts - counts.mean()) / HOT)
    return np.minimum(8, np.ceil(np.log(over) / np.log(2.5))).astype(np.int8)


def split_keys(keys: np.ndarray, sketch: np.ndarray, levels: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: the shards of each row. A hot key's rows go down its ``levels``, to the edge at their sketch's distance from a
    virtual root and to the ``radius`` edges below it; two rows within the radius of each other thus meet on every level."""
    row, out, level = np.arange(len(keys)), keys, 0
    while (deep := levels[row] > level).any():
        k, s = out[deep], sketch[row[deep]]
        d = np.bitwise_count((mix(k + np.uint64(level)) & _LOW) ^ s).astype(np.int64)
        moved = [mix(k ^ ((d - o + 1 + (level << 8)).astype(np.uint64) << np.uint64(20))) & ~_LOW for o in range(radius + 1)]
        row = np.concatenate((row[~deep], *[row[deep]] * (radius + 1)))
        out = np.concatenate((out[~deep], *moved))
        level += 1
    return row, out


def shard_rows(texts: DataFrame, width: int, min_runs: int, counts: np.ndarray) -> DataFrame:
    """``(k, cls)``: a row for each band of each class; k has the shard key and, in its low bits, the sketch. A task sends a class once."""
    levels = texts.sparkSession.sparkContext.broadcast(levels_of(counts))  # CELLS bytes, whatever the collection

    def emit(ids, cls, runs, at, count, seen):
        fresh = _first_of_class(cls[:, 0], seen)
        if not len(fresh):
            return [pa.array([], pa.int64())] * 2
        own, first, _ = _own(fresh, runs, at, count)
        minima = _minima(own, first, range(3))
        keys, sketch = _keys(minima), (mix(minima[:, 2].astype(np.uint64)) & _LOW).reshape(-1)
        row, key = split_keys(keys.reshape(-1), sketch, levels.value[_cell(keys)].reshape(-1))
        return [pa.array((key | sketch[row]).view(np.int64)), pa.array(np.tile(cls[fresh, 0], BANDS)[row].view(np.int64))]

    return _each(texts, width, min_runs, emit, "k bigint, cls bigint")


class Forest:
    """BK-trees over sketches under integer Hamming distance, many at once: ``tree`` numbers the trees from 0, ascending; sketches of a tree differ.

    Trees are built level by level: the first sketch of a subtree is its root, and the others hang at the edge of their distance to it.
    """

    def __init__(self, tree: np.ndarray, sketch: np.ndarray) -> None:
        self.tree, self.sketch, self.visits = tree, sketch, 0
        wide = SYMBOLS + 1
        node, sub, n = np.arange(len(tree)), tree.astype(np.int64), int(tree[-1]) + 1 if len(tree) else 0
        roots, children, self.first = [], [], 0
        base = 0
        while len(node):
            start = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
            roots.append(node[start])
            place = np.cumsum(np.concatenate(([0], sub[1:] != sub[:-1])))
            table = np.full(len(start) * wide, -1, dtype=np.int64)
            rest = np.ones(len(node), dtype=bool)
            rest[start] = False
            node, place, root = node[rest], place[rest], node[start][place[rest]]
            edge = place * wide + np.bitwise_count(sketch[node] ^ sketch[root])
            order = np.argsort(edge, kind="stable")
            node, edge = node[order], edge[order]
            base += len(start)
            found = np.unique(edge)
            table[found] = base + np.arange(len(found))
            children.append(table)
            sub = edge
        self.roots = np.concatenate(roots) if roots else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        self.sizes = np.bincount(tree, minlength=n)

    def within(self, radius: int = RADIUS, step: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (p, q), p < q, of sketches of a tree within ``radius``: every sketch looks its tree up; by the triangle inequality
        edges further than the radius from its own distance to a node lead to none and are not followed."""
        load, wide = np.cumsum(self.sizes[self.tree]), SYMBOLS + 1
        at = 0
        while at < len(self.tree):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + step)))
            q = np.arange(at, to)
            sub = self.tree[q].astype(np.int64)
            while len(q):
                self.visits += len(q)
                root = self.roots[sub]
                d = np.bitwise_count(self.sketch[q] ^ self.sketch[root]).astype(np.int64)
                hit = (d <= radius) & (q < root)
                yield q[hit], root[hit]
                near = []
                for o in range(-radius, radius + 1):
                    ok = (d + o > 0) & (d + o <= SYMBOLS)
                    child = self.children[sub[ok] * wide + d[ok] + o]
                    near.append((q[ok][child >= 0], child[child >= 0]))
                q, sub = np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near])
            at = to


def shard_groups(k: np.ndarray, cls: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``(group, class)`` from whole shards, sorted by k: the members of each node that has several, and of both of any two nodes within the radius.

    A node of sketches is within the radius of few others, whatever the shard's size, which bounds how often a class comes out.
    """
    u = k.view(np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1], [True])))
    start, size = cuts[:-1], np.diff(cuts)
    key = u[start] >> np.uint64(SYMBOLS)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    tree = np.cumsum(new) - 1
    several = np.bincount(tree)[tree] > 1
    own = np.flatnonzero(size > 1)
    name, node = [u[start[own]]], [own]
    if several.any():
        at = np.flatnonzero(several)
        forest = Forest(np.cumsum(new[at]) - 1, u[start[at]] & _LOW)
        for p, q in forest.within(radius):
            p, q = at[p], at[q]
            both = mix(u[start[p]]) ^ mix(u[start[q]] + np.uint64(1))
            name += [both, both]
            node += [p, q]
    name, node = np.concatenate(name), np.concatenate(node)
    n = size[node]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(name, n).view(np.int64), cls[np.repeat(start[node], n) + inside]


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(x, y)``, x <> y: the members of both ends of the links ``(a, b)``, where members are ``(id, cls)``; of a link to itself each pair once.

    The members of a large group are dealt to parts of PART, and each pair of parts is a group of its own.
    """
    sized = members.groupBy("cls").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    large = sized.where(F.col("n") > PART).select("cls", parts.alias("s"))
    dealt = members.join(large, "cls", "left").select("id", "cls", F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("id"), F.col("s"))).otherwise(0).cast("int").alias("i"))
    each = lambda s: F.explode(F.sequence(F.lit(0), F.coalesce(s, F.lit(1)) - 1))
    left = links.join(large.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a", "left").join(large.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b", "left")
    tasks = left.select("a", "b", "sb", each(F.col("sa")).alias("ia")).select("a", "b", "ia", each(F.col("sb")).alias("ib"))
    first = tasks.join(dealt.select(F.col("id").alias("x"), F.col("cls").alias("a"), F.col("i").alias("ia")), ["a", "ia"])
    both = first.join(dealt.select(F.col("id").alias("y"), F.col("cls").alias("b"), F.col("i").alias("ib")), ["b", "ib"])
    return both.where("(a <> b and x <> y) or x < y").select("x", "y")


def _whole_keys(it: Iterator[pa.RecordBatch], key, least: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by a key, cut anew so that no key is in two; ``key(columns)`` is an array that tells keys apart."""
    held: list[list[np.ndarray]] = []
    n = 0
    for x in it:
        held.append([c.to_numpy(zero_copy_only=False) for c in x.columns])
        n += x.num_rows
        if n < least:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        of = key(cols)
        last = int(np.flatnonzero(of != of[-1])[-1]) + 1 if (of != of[-1]).any() else 0
        if last:
            yield [c[:last] for c in cols]
        held = [[c[last:] for c in cols]]
        n = len(cols[0]) - last
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def groups_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(g, id)``: groups of classes that are candidates of each other, from the shards of ``rows(k, cls)``.

    Rows of a key stand together in a partition that is sorted by key and sketch; its tree is built there.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cls in _whole_keys(it, lambda c: c[0] >> SYMBOLS):
            once = np.concatenate(([True], (k[1:] != k[:-1]) | (cls[1:] != cls[:-1])))  # a class comes once from each task
            g, c = shard_groups(k[once], cls[once], radius)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "id"])

    return rows.repartition(F.shiftright("k", SYMBOLS)).sortWithinPartitions("k", "cls").mapInArrow(run, "g bigint, id bigint")


def class_maps(texts: DataFrame, width: int, min_runs: int) -> DataFrame:
    """``(id, size, b0, b1, b2, b3)``: of each class its number of runs and a map of 256 bits of them."""

    def emit(ids, cls, runs, at, count, seen):
        fresh = _first_of_class(cls[:, 0], seen)
        if not len(fresh):
            return [pa.array([], pa.int64())] * 6
        own, first, n = _own(fresh, runs, at, count)
        h = mix(own) >> np.uint64(56)
        bit = np.uint64(1) << (h & np.uint64(63))
        maps = [np.bitwise_or.reduceat(np.where(h >> np.uint64(6) == w, bit, np.uint64(0)), first).view(np.int64) for w in range(4)]
        return [pa.array(cls[fresh, 0].view(np.int64)), pa.array(n.astype(np.int64)), *map(pa.array, maps)]

    return _each(texts, width, min_runs, emit, "id bigint, size bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint").dropDuplicates(["id"])


def group_pairs(groups: DataFrame, maps: DataFrame, share: float) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of each group, but for those whose maps prove that less than ``share`` of the union is common.

    The members of a large group are dealt to parts of PART, and each pair of parts is a task's work.
    """
    sized = groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("g", F.ceil(F.col("n") / PART).cast("int").alias("s"))
    dealt = groups.join(sized, "g", "left").withColumn("i", F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("id"), F.col("s"))).otherwise(0).cast("int"))
    placed = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)))
    task = F.when(F.col("s").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("i", "k"), F.greatest("i", "k")))
    rows = placed.select(task.alias("t"), F.when(F.col("i") == F.col("k"), 0).when(F.col("i") < F.col("k"), 1).otherwise(2).alias("side"), "id")
    per = round(share * 1000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, side, ids, size, *maps_ in _whole_keys(it, lambda c: c[0], 1 << 16):
            bits = [m.view(np.uint64) for m in maps_]
            cuts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
            follow = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(t)) - 1  # rows of the group after each
            load = np.cumsum(follow)
            at = 0
            while at < len(t):
                to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + (1 << 21))))
                n = follow[at:to]
                x = np.repeat(np.arange(at, to), n)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                ok = (ids[x] != ids[y]) & ((side[x] == 0) | (side[x] != side[y]))
                x, y = x[ok], y[ok]
                least = -(-per * (size[x] + size[y]) // (1000 + per))  # common runs of a case
                only_x, only_y = (sum(np.bitwise_count(w[p] & ~w[q]).astype(np.int64) for w in bits) for p, q in ((x, y), (y, x)))
                ok = (size[x] - only_x >= least) & (size[y] - only_y >= least)
                x, y = ids[x[ok]], ids[y[ok]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                at = to

    return rows.join(maps, "id").select("t", "side", "id", "size", "b0", "b1", "b2", "b3").repartition("t").sortWithinPartitions("t").mapInArrow(run, "a bigint, b bigint").distinct()


def _positions(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77))
    return [((mix(h + np.uint64(i)) >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64) for i in range(3)]


def bloom(ids: DataFrame) -> np.ndarray:
    """A packed Bloom filter of a column of ids, sized by their number within BLOOM_BITS; one that overflows only lets more rows pass."""
    bits = 1 << min(BLOOM_BITS[1], max(BLOOM_BITS[0], (12 * ids.count()).bit_length()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(bits, dtype=bool)
        for b in it:
            for p in _positions(b.column(0).to_numpy(zero_copy_only=False), bits):
                hit[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(hit).tobytes(), 1)], pa.binary())], names=["data"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in ids.coalesce(8).mapInArrow(run, "data binary").toLocalIterator():  # eight times 8 MB at most
        total |= np.frombuffer(zlib.decompress(r["data"]), dtype=np.uint8)
    return total


def _pack_runs(runs: np.ndarray) -> bytes:
    return np.ascontiguousarray(runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack_runs(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return wide.reshape(-1).view("<u8")



def runs_of(texts: DataFrame, wanted: np.ndarray, width: int, min_runs: int) -> DataFrame:
    """``(id, cls, runs)`` of the classes that may be in the Bloom filter, by the first word of their names: their sorted runs, six bytes each; a task sends a class once."""
    packed, bits = texts.sparkSession.sparkContext.broadcast(wanted), 8 * len(wanted)  # 8 MB at most

    def emit(ids, cls, runs, at, count, seen):
        hit, first = np.ones(len(cls), dtype=bool), cls[:, 0].view(np.int64)
        for p in _positions(first, bits):
            hit &= (packed.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        take = np.flatnonzero(hit)
        take = take[_first_of_class(cls[take, 0], seen)] if len(take) else take
        return [pa.array(first[take]), _binary(cls[take]), pa.array([_pack_runs(runs[at[i] : at[i] + count[i]]) for i in take.tolist()], pa.binary())]

    return _each(texts, width, min_runs, emit, "id bigint, cls binary, runs binary").dropDuplicates(["id", "cls"])


def verified(pairs: DataFrame, runs: DataFrame, share: float) -> DataFrame:
    """``(a, b)``, classes, of the pairs whose common runs are at least ``share`` of the runs in either or both."""
    side = lambda k: runs.select(F.col("id").alias(k), F.col("cls").alias(f"c{k}"), F.col("runs").alias(f"r{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("ca", "cb", "ra", "rb")
    per = round(share * 1000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (_unpack_runs(np.frombuffer(v.as_buffer(), dtype=np.uint8)) for v in (x, y))
                z = np.concatenate((p, q))
                z.sort()
                common = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(common * 1000 >= per * (len(z) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def prepared(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def class_pairs(table: DataFrame, id_col: str, text_col: str, width: int = 5, share: float = 0.8, min_runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members (id, cls) of the classes with equal sets of runs, links (a, b) between classes.

    A link joins two classes whose common runs are at least ``share`` of the runs in either or both. Passages with fewer than
    ``min_runs`` distinct runs, null or blank ones among them, are in no class. Null ids are dropped; several rows of one id
    are as many passages, which are never paired with each other. Other columns are ignored; an empty table gives empty results.
    """
    texts = prepared(table, id_col, text_col)
    counts = key_counts(texts, width, min_runs)
    groups = cut(groups_of(shard_rows(texts, width, min_runs, counts)))
    pairs = cut(group_pairs(groups, class_maps(texts, width, min_runs), share))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    runs = cut(runs_of(texts, bloom(ends), width, min_runs))
    links = cut(verified(pairs, runs, share))
    release(groups, pairs, runs)
    return memberships(texts, width, min_runs), links


def duplicate_pairs(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.8, min_runs: int = 1) -> DataFrame:
    """``(doc_id_a, doc_id_b)``: every pair found, expanded to all members of the classes, which the result's form demands.

    The members of a class with n passages make n * (n - 1) / 2 pairs; where that is too much, use duplicate_groups.
    """
    members, links = class_pairs(table, id_col, text_col, width, share, min_runs)
    members = cut(members)
    own = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = expand(links.unionByName(own), members)
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def components(links: DataFrame) -> DataFrame:
    """``(doc_id, group)``: the smallest doc_id that each end of the links ``(a, b)`` is connected to.

    Alternates linking every node's larger neighbours, then its smaller ones, to the smallest around it, until nothing changes;
    each step is written to the shared folder.
    """
    # the number of edges and the sum of their hashes, which tell whether a step changed anything
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        hubs = heavy_keys(low, "u", "n")
        large = skew_join(both, low.drop("n"), "u", hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, "u", hubs).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        release(edges, low)
        edges, last, seen = after, seen, digest(after)
        if seen == last:
            break
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group")).distinct())


def duplicate_groups(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.8, min_runs: int = 1) -> DataFrame:
    """``(doc_id, group, n_links)``, a row for each passage: the group it is connected to, named by its smallest doc_id, and its class's links.

    A passage with too few runs, or without text, is a group of its own. An id with several texts has the first of their groups and most links.
    """
    members, links = class_pairs(table, id_col, text_col, width, share, min_runs)
    groups = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    ids = table.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    placed = members.withColumnRenamed("id", "doc_id").join(groups.select(F.col("doc_id").alias("cls"), "group"), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    names = placed.groupBy("group").agg(F.min("doc_id").alias("name"))
    named = placed.join(names, "group").join(degree, "cls", "left").groupBy("doc_id").agg(F.min("name").alias("name"), F.max("n_links").alias("n_links"))
    out = ids.join(named, "doc_id", "left")
    return out.select("doc_id", F.coalesce("name", "doc_id").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
