"""Mixing sources to target shares by minimum-cost flow.

Texts are put together by the set of sources that they occur in. Tokens flow from these sets to the sources' quotas; the r-th use of a
set's tokens costs r - 1, so repetition is used where it is needed and spread evenly. The flow tells what part of each set, and
how many times, goes to each source; the documents are taken in the order of a seeded hash, cut at exact weighted quantiles.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.operators.skew import key_quantiles
from lodestone.operators.storage import cut

MAX_SOURCES = 16  # of one mix: its sets of sources number at most 2**16
MAX_TARGETS = 10_000  # rows of targets
HASH_BITS = 42
SEP = "\x1f"


@dataclass
class Arc:
    to: int
    capacity: int
    cost: int
    back: int


class Flow:
    """Minimum-cost flow by successive shortest paths, with integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(Arc(b, capacity, cost, len(self.arcs[b])))
        self.arcs[b].append(Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist: list[float] = [float("inf")] * len(self.arcs)
            via: list[tuple[int, int] | None] = [None] * len(self.arcs)
            queued = [False] * len(self.arcs)
            dist[s], queue = 0, deque([s])
            while queue:
                u = queue.popleft()
                queued[u] = False
                for i, e in enumerate(self.arcs[u]):
                    if e.capacity > 0 and dist[u] + e.cost < dist[e.to]:
                        dist[e.to], via[e.to] = dist[u] + e.cost, (u, i)
                        if not queued[e.to]:
                            queued[e.to] = True
                            queue.append(e.to)
            if via[t] is None:
                return total
            push, v = None, t
            while v != s:
                u, i = via[v]
                push = self.arcs[u][i].capacity if push is None else min(push, self.arcs[u][i].capacity)
                v = u
            v = t
            while v != s:
                u, i = via[v]
                e = self.arcs[u][i]
                e.capacity -= push
                self.arcs[v][e.back].capacity += push
                v = u
            total += push


def steps(uses: int) -> list[tuple[int, int]]:
    """``(cost, width)`` of the uses 1, 2, ...: single ones up to 16, then bands that double, so that many repeats need few arcs."""
    out, done = [], 0
    while done < uses:
        width = min(uses - done, 1 if done < 16 else done)
        out.append((done, width))
        done += width
    return out


def route(supply: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """``(total, flow)``: tokens from each set of sources to each source's quota.

    ``supply`` has the tokens of each set, ``targets`` the share and the most repeats of each source. Shares of sources without any text are
    given to the others in proportion. The total is the largest that can be met, or ``total`` if that is less. A set may be used
    at most as often as the strictest of its sources allows, which is not at all for 0.
    """
    sets = sorted({tuple(x for x in p if x in targets) for p in supply} - {()})
    uses = {q: min(max(0, targets[x][1]) for x in q) for q in sets}
    sets = [q for q in sets if uses[q]]
    tokens_of = {q: sum(n for p, n in supply.items() if tuple(x for x in p if x in targets) == q) for q in sets}
    present = sorted({x for q in sets for x in q if targets[x][0] > 0})
    share_sum = sum(targets[x][0] for x in present)
    if not present or not share_sum:
        return 0, {}

    def solve(t: int) -> tuple[bool, dict[tuple[tuple[str, ...], str], int]]:
        quota = {x: int(t * targets[x][0] / share_sum) for x in present}
        g = Flow(2 + len(sets) + len(present))
        place = {q: 2 + i for i, q in enumerate(sets)} | {x: 2 + len(sets) + i for i, x in enumerate(present)}
        out = {}
        for q in sets:
            for r, width in steps(uses[q]):
                g.arc(0, place[q], tokens_of[q] * width, r)
            for x in q:
                if x in quota:
                    out[q, x] = g.arc(place[q], place[x], 1 << 60, 0)
        for x in present:
            g.arc(place[x], 1, quota[x], 0)
        done = g.run(0, 1)
        flow = {k: (1 << 60) - g.arcs[a][i].capacity for k, (a, i) in out.items()}
        return done == sum(quota.values()), {k: v for k, v in flow.items() if v > 0}

    high = sum(tokens_of[q] * uses[q] for q in sets)
    low, high = 0, high if total is None else min(high, total)
    if solve(high)[0]:
        low = high
    while high - low > max(1, high // 1_000_000):
        mid = (low + high) // 2
        low, high = (mid, high) if solve(mid)[0] else (low, mid)
    return low, solve(low)[1]


def texts_by_sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, seed: int) -> DataFrame:
    """``(sources, owners, u, n_tokens)``: each distinct text with tokens, the sorted sources that it occurs in and a document of each.

    Counted per text and source first, so copies of one text are combined before they are shuffled.
    """
    rows = tokens.sized(docs.where(F.col(source_col).isNotNull() & F.col(text_col).isNotNull()), [id_col, source_col], text_col, path).where("n_tokens > 0")
    per = rows.groupBy("text_hash", "n_tokens", source_col).agg(F.min(id_col).alias("doc_id"))
    owner = F.struct(F.col(source_col).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"))
    each = per.groupBy("text_hash", "n_tokens").agg(F.array_sort(F.collect_list(owner)).alias("owners"))  # one entry a source
    u = F.shiftrightunsigned(F.xxhash64("text_hash", "n_tokens", F.lit(seed)), 64 - HASH_BITS)
    return each.select(F.transform("owners", lambda o: o.source).alias("sources"), "owners", u.alias("u"), "n_tokens")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, seed: int = 1, path: str = tokens.VOCABULARY) -> DataFrame:
    """``(mix_id, doc_id, source, uses, n_tokens)``: how often each selected document is used, and for which source.

    ``targets`` has mix_id, source, target_share and max_repeats (null: 1, 0: not to be used); more than MAX_TARGETS rows, or MAX_SOURCES in a mix, raise
    ValueError. Texts fetched several times are one
    text, counted for one of its sources at a time. Texts that are null or empty or whose source is null are not used; equal ids
    are different documents if their texts differ. A mix of which no source occurs gives no rows.
    """
    wanted: dict[int, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_id", "source", "target_share", "max_repeats").dropna(subset=["mix_id", "source", "target_share"]).limit(MAX_TARGETS + 1).collect():
        wanted.setdefault(r["mix_id"], {})[r["source"]] = (r["target_share"], 1 if r["max_repeats"] is None else r["max_repeats"])
    if sum(map(len, wanted.values())) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} targets")
    if any(len(t) > MAX_SOURCES for t in wanted.values()):
        raise ValueError(f"a mix may have {MAX_SOURCES} sources")
    spark = docs.sparkSession
    out = "mix_id int, doc_id bigint, source string, uses bigint, n_tokens bigint"
    if not wanted:
        return spark.createDataFrame([], out)
    texts = cut(texts_by_sources(docs, id_col, text_col, source_col, path, seed))
    # the sources that matter to each mix; a text's row is repeated for each mix that has one of them
    inside = lambda t: F.array_join(F.filter("sources", lambda s: s.isin(sorted(t))), SEP)
    each = F.array(*[F.struct(F.lit(m).cast("int").alias("mix_id"), inside(t).alias("set")) for m, t in sorted(wanted.items())])
    named = texts.select(F.explode(F.filter(each, lambda x: x.set != "")).alias("x"), "owners", "u", "n_tokens").select("x.mix_id", "x.set", "owners", "u", "n_tokens")
    supply: dict[int, dict[tuple[str, ...], int]] = {}
    for r in named.groupBy("mix_id", "set").agg(F.sum("n_tokens").alias("n")).collect():  # at most 2**MAX_SOURCES a mix
        supply.setdefault(r["mix_id"], {})[tuple(r["set"].split(SEP))] = r["n"]
    # lay the uses of a set one after the other: use r of a text at fraction x of the set is at r + x
    spans: list[tuple[int, str, str, float, float]] = []
    for m, t in sorted(wanted.items()):
        ends: dict[tuple[str, ...], float] = {}
        for (q, s), n in sorted(route(supply.get(m, {}), t, total)[1].items()):
            at = ends.get(q, 0.0)
            ends[q] = at + n / supply[m][q]
            spans.append((m, SEP.join(q), s, at, ends[q]))
    cuts = sorted({round(x % 1, 12) for *_, a, b in spans for x in (a, b)} - {0.0})
    marks: dict[tuple[str, float], int] = {}
    if cuts:
        keyed = named.select(F.concat_ws(SEP, "mix_id", "set").alias("key"), "u", "n_tokens")
        for r in key_quantiles(keyed, "key", "u", cuts, weight="n_tokens", digit_bits=14).collect():  # one for each set and cut
            marks[r["key"], r["prob"]] = r["quantile"]
    plan = []
    for m, q, s, a, b in spans:
        use = int(a)
        while use < b - 1e-12:
            lo, hi = max(a, use) - use, min(b, use + 1) - use
            x = 0 if lo <= 1e-12 else marks[f"{m}{SEP}{q}", round(lo % 1, 12)]
            y = 1 << HASH_BITS if hi >= 1 - 1e-12 else marks[f"{m}{SEP}{q}", round(hi % 1, 12)]
            plan.append((m, q, s, x, y))
            use += 1
    taken = named.join(F.broadcast(spark.createDataFrame(plan, "mix_id int, set string, source string, low bigint, high bigint")), ["mix_id", "set"]).where("u >= low and u < high")
    doc = F.filter("owners", lambda o: o.source == F.col("source"))[0].doc_id
    every = taken.select("mix_id", doc.alias("doc_id"), "source", "u", "n_tokens")
    return every.groupBy("mix_id", "doc_id", "source", "n_tokens", "u").agg(F.count("*").alias("uses")).select("mix_id", "doc_id", "source", "uses", "n_tokens")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source, target_share, tokens, share, documents, most_uses)``: the shares reached, zero for sources without text."""
    per = selected.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    totals = per.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    out = targets.select("mix_id", "source", "target_share").join(per, ["mix_id", "source"], "left").join(totals, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("mix_id", "source", "target_share", zero("tokens").alias("tokens"), F.round(zero("tokens") / F.col("total"), 6).alias("share"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"))
