"""The k best documents for many queries at once, without a row for each pair of query and document.

Queries come as arrays in parts of bounded size, documents are streamed past them, and only each task's k best of a query leave it: what is
written and shuffled grows with the queries and the documents, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DOCS, TOKENS = 1 << 15, 1 << 23  # documents and entries that are scored at once
BLOCK, CELLS = 256, 1 << 24  # queries that are scored at once, and cells of a table of queries by terms
DENSE_SHARE, MOST_DENSE = 0.008, 512  # a term in so many pairs of query and document costs less in a product of matrices than in lists
LONG = 1000  # terms of a query from which single precision is too coarse


def slices(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of all places from first to last, without it, of each pair."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + np.repeat(first - np.cumsum(n) + n, n)


@dataclass
class Queries:
    """Queries over a vocabulary: ``voc`` is sorted, query i has the terms ``term[ptr[i]:ptr[i + 1]]``, ascending places in voc."""

    voc: pa.Array
    idf: np.ndarray
    share: np.ndarray  # of the documents that have the term
    ptr: np.ndarray
    term: np.ndarray
    avgdl: float
    k: int
    k1: float
    b: float
    every: bool
    slot: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        both = np.bincount(self.term, minlength=len(self.voc)) / max(1, len(self)) * self.share
        order = np.argsort(-both, kind="stable")[:MOST_DENSE]
        dense = order[both[order] >= DENSE_SHARE]
        self.slot = np.full(len(self.voc), -1)
        self.slot[dense] = np.arange(len(dense))

    def __len__(self) -> int:
        return len(self.ptr) - 1


def split(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parts of ``values`` between the places ``at`` as an array of arrays."""
    out = np.empty(len(at) + 1, object)
    first = 0
    for i, last in enumerate([*at.tolist(), len(values)]):
        out[i], first = values[first:last], last
    return out


class Chunk:
    """Documents as entries sorted by (document, term), with their exact weights, and as lists by term."""

    def __init__(self, q: Queries, ids: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        v = max(1, len(q.voc))
        key = row * v + term
        if (tf == 1).all():
            key.sort()
            tf = None
        else:
            order = np.argsort(key)
            key, tf = key[order], tf[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        tf = (np.diff(np.r_[first, len(key)]) if tf is None else np.add.reduceat(tf, first)).astype(float)
        self.ids, self.n = ids, len(ids)
        self.row, self.term = key[first] // v, key[first] % v
        self.w = q.idf[self.term] * ((tf * (q.k1 + 1.0)) / (tf + q.k1 * ((1.0 - q.b) + q.b * length[self.row] / q.avgdl)))
        self.ptr = np.searchsorted(self.row, np.arange(self.n + 1))
        by_term = np.argsort(self.term * max(1, self.n) + self.row)
        self.list_row, self.list_w = self.row[by_term], self.w[by_term]
        self.list_ptr = np.r_[0, np.cumsum(np.bincount(self.term, minlength=v))]
        self.most = np.zeros(v)  # the largest weight of each term here, whatever its sign
        np.maximum.at(self.most, self.term, np.abs(self.w))


class Best:
    """The k best documents of each query so far: higher scores first, then smaller doc_ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.doc, self.k = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), k
        self.held = np.zeros(n, np.int64)

    def floor(self, at: slice) -> np.ndarray:
        return self.score[at, self.k - 1]

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        owner, place = slices(np.zeros(len(touched), np.int64), self.held[touched])
        old = touched[owner]
        query, doc, score = np.r_[old, query], np.r_[self.doc[old, place], doc], np.r_[self.score[old, place], score]
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        good = rank < self.k
        self.doc[query[good], rank[good]], self.score[query[good], rank[good]] = doc[good], score[good]
        self.held[touched] = np.minimum(self.k, np.bincount(np.searchsorted(touched, query), minlength=len(touched)))


def exact(q: Queries, c: Chunk, i: int, best: Best) -> None:
    """Query i against all documents of the chunk, by the lists of its terms in their order."""
    score, found = np.zeros(c.n), np.zeros(c.n, np.int64)
    terms = q.term[q.ptr[i] : q.ptr[i + 1]]
    for a, z in zip(c.list_ptr[terms].tolist(), c.list_ptr[terms + 1].tolist(), strict=True):
        at = c.list_row[a:z]
        score[at] += c.list_w[a:z]
        found[at] += 1
    hit = np.flatnonzero(found == len(terms) if q.every and len(terms) else found > 0)
    if len(hit) > q.k:  # ties with the last one stay
        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - q.k)[len(hit) - q.k]]
    best.add(np.full(len(hit), i), c.ids[hit], score[hit])


def sums(q: Queries, c: Chunk, first: int, has: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of query and document, summed in the order of terms. has: queries from ``first`` on by terms."""
    out = np.zeros(len(query))
    step = max(1, (1 << 22) // max(1, int(np.diff(c.ptr).max(initial=1))))
    for s in range(0, len(query), step):
        u, r = query[s : s + step], row[s : s + step]
        owner, place = slices(c.ptr[r], c.ptr[r + 1])
        kept = has[u[owner] - first, c.term[place]]
        out[s : s + step] = np.bincount(owner[kept], weights=c.w[place[kept]], minlength=len(u))  # adds up one after the other
    return out


def score_chunk(q: Queries, c: Chunk, best: Best) -> None:
    """Take the chunk's documents into ``best``.

    Scores of all documents come first in floating-point numbers whose error has a bound: terms that many queries and documents have by a
    product of matrices, the others by their lists. Documents that the bound can't rule out are scored exactly. A query whose k-th best
    score isn't known to be above that of a document without any of its terms, which is 0, is scored by its lists alone.
    """
    if q.every:
        for i in range(len(q)):
            exact(q, c, i, best)
        return
    kind = np.float32 if np.diff(q.ptr).max(initial=0) <= LONG else np.float64
    groups = max(1, min(32, c.n // (4 * q.k)))
    wide = -(-c.n // groups)
    n_dense = int(q.slot.max(initial=-1)) + 1
    dense = np.zeros((n_dense, groups * wide), kind)
    at = q.slot[c.term]
    dense[at[at >= 0], c.row[at >= 0]] = c.w[at >= 0]
    listed = (q.slot < 0) & (np.diff(c.list_ptr) > 0)
    weight, at = c.list_w.astype(kind), c.list_ptr[1:-1]
    lists = np.empty((2, len(q.voc)), object)  # documents and weights of each term
    lists[0], lists[1] = split(c.list_row, at), split(weight, at)
    block = max(1, min(BLOCK, CELLS // max(1, len(q.voc))))
    has, acc = np.zeros((block, len(q.voc)), bool), np.zeros((block, groups * wide), kind)
    for first in range(0, len(q), block):
        last = min(len(q), first + block)
        n = last - first
        terms = q.term[q.ptr[first] : q.ptr[last]]
        owner = np.repeat(np.arange(n), np.diff(q.ptr[first : last + 1]))
        has[owner, terms] = True
        table = np.zeros((n, n_dense), kind)
        in_table = q.slot[terms] >= 0
        table[owner[in_table], q.slot[terms[in_table]]] = 1
        scores = np.matmul(table, dense, out=acc[:n])
        in_list = listed[terms]
        docs, weights = lists[:, terms[in_list]].tolist()
        s = 0
        for i, e in enumerate(np.cumsum(np.bincount(owner[in_list], minlength=n)).tolist()):
            if e > s:
                np.add.at(scores[i], np.concatenate(docs[s:e]), np.concatenate(weights[s:e]))
            s = e
        error = np.bincount(owner, weights=c.most[terms], minlength=n) * (np.bincount(owner, minlength=n) + 4) * np.finfo(kind).eps
        cells = scores.reshape(n, groups, wide)
        top = cells.max(1)
        floor = best.floor(slice(first, last))
        new = np.flatnonzero(floor == -np.inf)
        if len(new) and wide >= q.k:
            floor = floor.copy()
            floor[new] = np.partition(top[new], wide - q.k, axis=1)[:, wide - q.k] - error[new]
        least = floor - error
        low = least <= 0
        for i in np.flatnonzero(low).tolist():
            exact(q, c, first + i, best)
        least[low] = np.inf
        u, x = np.nonzero(top >= least[:, None])
        near = cells[u, :, x]
        p, g = np.nonzero(near >= least[u][:, None])
        query, row = u[p] + first, g * wide + x[p]
        best.add(query, c.ids[row], sums(q, c, first, has, query, row))
        has[owner, terms] = False


def chunks(q: Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches ``(doc_id, length, terms[, tfs])`` as chunks. A term may be repeated in a document; without tfs each entry counts once."""
    held: list[tuple] = []
    n = entries = 0
    for whole in batches:
        for s in range(0, whole.num_rows, DOCS):
            batch = whole.slice(s, DOCS)
            names = batch.schema.names
            lists = batch.column("terms")
            term = pc.index_in(lists.flatten().cast(q.voc.type), value_set=q.voc)
            known = term.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[known]
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[known] if "tfs" in names else np.ones(len(row), np.int64)
            held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("length").to_numpy(zero_copy_only=False), row + n, term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), tf))
            n += batch.num_rows
            entries += len(row)
            if n >= DOCS or entries >= TOKENS:
                yield Chunk(q, *map(np.concatenate, zip(*held, strict=True)))
                held, n, entries = [], 0, 0
    if n:
        yield Chunk(q, *map(np.concatenate, zip(*held, strict=True)))


def best_of(q: Queries, batches: Iterator[pa.RecordBatch]) -> Best:
    best = Best(len(q), q.k)
    for c in chunks(q, batches):
        score_chunk(q, c, best)
    return best
