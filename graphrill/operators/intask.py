"""Loops over what one task can hold: NumPy over Arrow batches, for inputs that were counted before.

Each round of a loop over tables costs jobs, whatever it moves. Where all that is left fits a task, the task runs the rest.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.session import partitions

#: Links that a task may hold: some arrays of 8 bytes for each.
LINKS = 4_000_000
#: Arcs that every task may hold besides its own rows: 16 bytes for each, or 32 with those turned round.
ARCS = 8_000_000
#: Links that a task takes up at once where it keeps only a forest of them.
CHUNK = 1_000_000

# The functions travel to the tasks themselves, so that a worker needs no package of this name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, vertex) of each vertex of the links that is not itself the least of its component, the label."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        # A root joins the least root that it has a link to; the other links stay for the next round.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    member = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[member]], ids[member]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as fewer ones with the same components: the stars of the rows of this task. For mapInArrow."""
    a = b = np.empty(0, np.int64)
    more: list[pa.RecordBatch] = []
    for batch in batches:
        more.append(batch)
        if sum(x.num_rows for x in more) >= CHUNK:
            a, b = _joined(a, b, more)
            more = []
    a, b = _joined(a, b, more)
    yield from pa.table([a, b], schema=PAIRS).to_batches(100_000)


def _joined(a: np.ndarray, b: np.ndarray, more: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    column = lambda i, first: np.concatenate([first, *(x.column(i).to_numpy(zero_copy_only=False) for x in more)])
    return stars(column(0, a), column(1, b))


def by_head(tail: np.ndarray, head: np.ndarray, value: np.ndarray, n: int) -> SimpleNamespace:
    """Arcs between vertices 0 to n - 1, by their heads: ``tail`` of each, and where the arcs of each of ``heads`` begin."""
    order = np.argsort(head, kind="stable")
    heads, first = np.unique(head[order], return_index=True)
    return SimpleNamespace(n=n, tail=tail[order].astype(np.int32), value=value[order], heads=heads, first=first)


def parts(arcs: SimpleNamespace, width: int) -> Iterator[tuple[slice, slice]]:
    """Slices of ``heads`` and of their arcs, of about CELLS values for ``width`` values an arc; a head stays whole."""
    ends = np.append(arcs.first[1:], len(arcs.tail))
    at = 0
    while at < len(arcs.heads):
        to = max(at + 1, int(np.searchsorted(ends, arcs.first[at] + CELLS // width, "right")))
        yield slice(at, to), slice(arcs.first[at], ends[to - 1])
        at = to


#: Values of 8 bytes that a step of a search holds at once for the arcs, and for each array of a block of sources.
CELLS = 1 << 20


def hops(arcs: SimpleNamespace, sources: np.ndarray) -> tuple[int, int, int]:
    """Pairs of different vertices with a path from one of ``sources``, the sum of their hops and the greatest number of hops."""
    pairs = total = greatest = 0
    block = 64 * max(1, CELLS // max(1, arcs.n))
    for own in (sources[i : i + block] for i in range(0, len(sources), block)):
        at = np.arange(len(own))
        new = np.zeros((arcs.n, -(-len(own) // 64)), np.uint64)
        new[own, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        seen, level = new.copy(), 0
        while True:
            step = np.zeros_like(new)
            for heads, of in parts(arcs, new.shape[1]):
                step[arcs.heads[heads]] = np.bitwise_or.reduceat(new[arcs.tail[of]], arcs.first[heads] - of.start, axis=0)
            new = step & ~seen
            n = int(np.bitwise_count(new).sum(dtype=np.int64))
            if not n:
                break
            seen |= new
            level += 1
            pairs, total, greatest = pairs + n, total + level * n, max(greatest, level)
    return pairs, total, greatest


def dependencies(arcs: SimpleNamespace, back: SimpleNamespace, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vertex, its dependencies summed over ``sources`` and how many other sources reach it. The values of arcs say
    how many paths they are; ``back`` are the same arcs turned round."""
    bc, found = np.zeros(arcs.n), np.zeros(arcs.n, np.int64)
    block = max(1, CELLS // max(1, arcs.n))
    for own in (sources[i : i + block] for i in range(0, len(sources), block)):
        level = np.full((arcs.n, len(own)), -1, np.int32)
        sigma = np.zeros((arcs.n, len(own)))
        level[own, np.arange(len(own))], sigma[own, np.arange(len(own))] = 0, 1.0
        ahead, most = sigma, 0
        while True:
            step = _spread(arcs, ahead)
            new = (step > 0) & (level < 0)
            if not new.any():
                break
            most += 1
            level[new] = most
            ahead = np.where(new, step, 0.0)
            sigma += ahead
        delta = np.zeros_like(sigma)
        for k in range(most, 1, -1):
            after = np.divide(1 + delta, sigma, out=np.zeros_like(sigma), where=level == k)
            delta += np.where(level == k - 1, sigma * _spread(back, after), 0.0)
        bc += delta.sum(axis=1)
        found += (level > 0).sum(axis=1)
    return bc, found


def _spread(arcs: SimpleNamespace, rows: np.ndarray) -> np.ndarray:
    """For each vertex, the sum over its arcs of the value times the tail's row."""
    out = np.zeros_like(rows)
    for heads, of in parts(arcs, rows.shape[1]):
        out[arcs.heads[heads]] = np.add.reduceat(rows[arcs.tail[of]] * arcs.value[of, None], arcs.first[heads] - of.start, axis=0)
    return out


def of_pairs(ids, ahead, back, own):
    """The numbers of hops, as columns."""
    return [[x] for x in hops(ahead, own)]


def of_sources(ids, ahead, back, own):
    """The numbers of dependencies, as columns, for the vertices that were found."""
    bc, found = dependencies(ahead, back, own)
    some = found > 0
    return ids[some], bc[some], found[some]


class Shared:
    """The arcs (src, dst, c) of a graph for every task: at most ARCS rows, counted before."""

    def __init__(self, arcs: DataFrame, both: bool = False):
        rows = arcs.select("src", "dst", F.col("c").cast("double")).toArrow()
        src, dst = (rows.column(i).to_numpy() for i in (0, 1))
        ids = np.union1d(src, dst)
        at = lambda x: np.searchsorted(ids, x).astype(np.int32)
        c = rows.column(2).to_numpy()
        ahead = by_head(at(src), at(dst), c, len(ids))
        back = by_head(at(dst), at(src), c, len(ids)) if both else None
        self.held = arcs.sparkSession.sparkContext.broadcast((ids, ahead, back))

    def search(self, sources: DataFrame, body: Callable, schema: str) -> DataFrame:
        """``body(ids, arcs, arcs turned round, positions)`` for the sources (id) of each task that has any, as far as they
        have an arc: the columns of ``schema``."""
        held = self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
            if len(of):
                ids, ahead, back = held.value
                where = np.searchsorted(ids, of)
                own = where[ids[np.minimum(where, len(ids) - 1)] == of] if len(ids) else where[:0]
                yield pa.record_batch([pa.array(x) for x in body(ids, ahead, back, own)], names=[c.split()[0] for c in schema.split(", ")])

        return sources.select("id").repartition(partitions(sources.sparkSession)).mapInArrow(run, schema)


def matched(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The positions of a greedy maximal matching of the links above 0 by score, then the lower (i, j)."""
    order = np.lexsort((j, i, -score))
    order = order[score[order] > 0]
    # Rounds of links that are first of those left at both ends, as many as the greedy order needs.
    n = int(max(i.max(), j.max())) + 1 if len(i) else 0
    out = []
    a, b = i[order], j[order]
    while len(order):
        first = np.full(n, len(order))
        rank = np.arange(len(order))
        np.minimum.at(first, a, rank)
        np.minimum.at(first, b, rank)
        best = (first[a] == rank) & (first[b] == rank)
        out.append(order[best])
        gone = np.zeros(n, bool)
        gone[a[best]] = gone[b[best]] = True
        left = ~(gone[a] | gone[b])
        order, a, b = order[left], a[left], b[left]
    return np.concatenate([np.empty(0, np.int64), *out])


def merges(cnm: bool, drop: float | None, before: float | None, most: int | None) -> Callable:
    """For mapInArrow over the flows (i, j, w) between and within communities, i <= j, all in one task: (id, label) of those that
    have another label after the rounds of ``communities.agglomerate`` by matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        i, j, w = (np.concatenate([np.empty(0, np.int64), *(b.column(c).to_numpy() for b in held)]) for c in range(3))
        held.clear()
        ids = np.union1d(i, j)
        i, j = np.searchsorted(ids, i), np.searchsorted(ids, j)
        label, last, rounds = np.arange(len(ids)), before, most
        while rounds is None or rounds > 0:
            rounds = None if rounds is None else rounds - 1
            between = i != j
            a, b, x = i[between], j[between], w[between]
            if not len(a):
                break
            score = x.astype(float)
            if cnm:
                vol = np.zeros(len(ids), np.int64)
                np.add.at(vol, i, w)
                np.add.at(vol, b, x)
                total = float(int(w.sum()))
                share = vol.astype(float) / total
                score = 2 * (score / total - share[a] * share[b])
            if drop is not None:
                best = score.max()
                if last is not None and best < last / drop:
                    break
                last = best
            pairs = matched(a, b, score)
            if not len(pairs):
                break
            to = np.arange(len(ids))
            to[b[pairs]] = a[pairs]
            label = to[label]
            i, j = to[i], to[j]
            key, at = np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j), return_inverse=True)
            i, j = key // len(ids), key % len(ids)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, at, w)
            w = sums
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield from pa.table([ids[moved], ids[label[moved]]], names=["id", "label"]).to_batches(100_000)

    return run
