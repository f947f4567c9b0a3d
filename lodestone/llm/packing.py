"""Filling containers of fixed capacity: hierarchical residual packing.

Partitions of items are packed by best fit, largest first. Containers that are full or nearly so are done; the others go on as
items whose size is their content, are merged into fewer partitions and packed again, FAN_IN partitions into one, until one is left or a
round no longer saves containers. The tree's leaves are the partitions that the items come in, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.operators.storage import cut

NEARLY_FULL = 0.99
FAN_IN = 8
MAX_CAPACITY = 1 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of each item, content of each bin)`` by best fit, largest first; ties go in the order of the items.

    Open bins are kept by their free space; the spaces in use are the bits of one integer, so the tightest one is its lowest bit above the size.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, content = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = used >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                used ^= 1 << r
            content[b] += s
            r -= s
        else:
            b = len(content)
            content.append(s)
            r = capacity - s
        bins[i] = b
        if r:
            free[r].append(b)
            used |= 1 << r
    return bins, np.array(content, dtype=np.int64)


def _pack(keys: np.ndarray, sizes: np.ndarray, capacity: int, level: int, task: int, spec: int) -> tuple[np.ndarray, np.ndarray]:
    """``(container id, content of that container)`` of each item."""
    bins, content = best_fit(sizes, capacity)
    ids = (np.int64(level) << 58) | (np.int64(spec) << 50) | (np.int64(task) << 30) | bins
    return ids, content[bins]


def pack(items: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """``(spec_id, container_id, item_id, part_no, start, n_tokens)`` for ``items(item_id, n_tokens)`` and ``specs`` (spec_id, capacity).

    An item of at most the capacity is one part, a larger one as many full containers as it fills and a rest, which is packed like an item.
    Items without tokens, null sizes and null ids are left out. Equal items and repeated ids are packed each for itself. An empty table or no specs give no rows;
    more than 200 specs, a capacity above MAX_CAPACITY or two for one spec_id raise ValueError.
    """
    specs = sorted({(int(s), int(c)) for s, c in specs if s is not None and c is not None and c > 0})
    if len(specs) > 200 or any(c > MAX_CAPACITY for _, c in specs):
        raise ValueError("at most 200 container sizes, of at most 2**20 tokens")
    order = {s: k for k, s in enumerate(dict.fromkeys(s for s, _ in specs))}
    if len(order) < len(specs):
        raise ValueError("a spec_id has two capacities")
    items = items.select(F.col("item_id").cast("bigint"), F.col("n_tokens").cast("bigint")).where("item_id is not null and n_tokens > 0")
    schema = "spec_id int, bin bigint, content bigint, item_id bigint, part_no bigint, start bigint, n_tokens bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 6]

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)  # the items of a split: their ids and sizes
        if not batches:
            return
        task = TaskContext.get().partitionId()
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
        size = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
        for spec, cap in specs:
            whole, rest = size // cap, size % cap
            exact = size == whole * cap
            # full containers of items that exceed the capacity, or fill it
            parts = np.repeat(np.arange(len(ids)), whole)
            no = np.arange(len(parts)) - np.repeat(np.cumsum(whole) - whole, whole)
            full = (np.int64(order[spec]) << 50) | (np.int64(task) << 30) | ((np.int64(1) << 29) + np.arange(len(parts), dtype=np.int64))
            left = np.flatnonzero(~exact)
            bins, content = _pack(ids[left], rest[left], cap, 0, task, order[spec]) if len(left) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cols = [
                np.full(len(parts) + len(left), spec, np.int32), np.concatenate((full, bins)), np.concatenate((np.full(len(parts), cap, np.int64), content)), np.concatenate((ids[parts], ids[left])),
                np.concatenate((no, whole[left])), np.concatenate((no * cap, whole[left] * cap)), np.concatenate((np.full(len(parts), cap, np.int64), rest[left])),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def again(level: int):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            batches = list(it)  # open containers
            if not batches:
                return
            pdf = pd.concat(batches, ignore_index=True)
            task = TaskContext.get().partitionId()
            for spec, cap in specs:
                own = pdf[pdf["spec_id"] == spec]
                if len(own):
                    old = own["bin"].to_numpy(dtype=np.int64)
                    bins, content = _pack(old, own["content"].to_numpy(dtype=np.int64), cap, level, task, order[spec])
                    yield pd.DataFrame({"spec_id": np.int32(spec), "old": old, "bin": bins, "content": content})

        return run

    placed = cut(items.mapInArrow(first, schema))
    tasks = 1 + (placed.agg(F.max(F.shiftright("bin", 30).bitwiseAND((1 << 20) - 1))).first()[0] or 0)
    caps = dict(specs)
    limit = F.coalesce(*[F.when(F.col("spec_id") == s, F.lit(int(NEARLY_FULL * c))) for s, c in caps.items()]) if caps else F.lit(0)
    open_ = placed.where(F.col("content") < limit)
    under = cut(open_.groupBy("spec_id", "bin").agg(F.max("content").alias("content")))
    moves: list[DataFrame] = []
    level, count = 1, under.count()
    while count:
        tasks = -(-tasks // FAN_IN)
        moved = cut(under.repartition(tasks, F.xxhash64("bin", F.lit(level))).mapInPandas(again(level), "spec_id int, old bigint, bin bigint, content bigint"))
        moves.append(moved)
        under = cut(moved.where(F.col("content") < limit).groupBy("spec_id", "bin").agg(F.max("content").alias("content")))
        before, count = count, under.count()
        if tasks == 1 or count > 0.98 * before:
            break
        level += 1
    final = placed.where(F.col("content") >= limit).select("spec_id", "bin", "item_id", "part_no", "start", "n_tokens")
    rest = open_.drop("content")
    for moved in moves:
        rest = rest.join(moved.select(F.col("old"), F.col("bin").alias("new")), F.col("bin") == F.col("old"), "left").withColumn("bin", F.coalesce("new", "bin")).drop("old", "new")
    return final.unionByName(rest).select("spec_id", F.col("bin").alias("container_id"), "item_id", "part_no", "start", "n_tokens")


def containers(docs: DataFrame, spec: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.VOCABULARY) -> DataFrame:
    """``pack`` of the texts of ``docs``, for every row of ``spec(spec_id, capacity_tokens)``; item_id is the document's id.

    The parts of a text are ranges of its tokens, [start, start + n_tokens). Null and empty texts take no space and no row.
    """
    sizes = tokens.sized(docs.where(F.col(text_col).isNotNull()), [id_col], text_col, path)
    rows = [(r[0], r[1]) for r in spec.select("spec_id", "capacity_tokens").limit(201).collect()]
    return pack(sizes.select(F.col(id_col).alias("item_id"), "n_tokens"), rows)


def summary(assigned: DataFrame, spec: DataFrame) -> DataFrame:
    """``(spec_id, n_containers, n_tokens, least, fill)``: least is the number of containers that the tokens would fill without loss."""
    per = assigned.groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    cap = F.col("capacity_tokens")
    return per.join(spec.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / cap).alias("least"), F.round(F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("fill")
    )
