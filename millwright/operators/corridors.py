"""Corridors: how far open cells are from what blocks them, the thin centre line of open ground,
and that line as a graph of nodes and edges.

Each operator works on one region or tile at a time, so it needs as much halo as corridors are
wide; regions run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Nodes whose edges are walked at once, which bounds the memory of a large region.
NODES = 1 << 16


def clearance(open_cells: np.ndarray) -> np.ndarray:
    """Exact distance of every open cell to the nearest closed one (cells beyond the rim are
    closed): column distances first, then the lower envelope along rows."""
    padded = np.pad(open_cells, 1)
    rows, cols = padded.shape
    far = rows + cols
    up = np.zeros((rows, cols))
    for r in range(1, rows):
        up[r] = np.where(padded[r], up[r - 1] + 1, 0)
    for r in range(rows - 2, -1, -1):
        up[r] = np.minimum(up[r], np.where(padded[r], up[r + 1] + 1, 0))
    up = np.minimum(up, far)
    out = np.empty_like(up)
    shift = (np.arange(cols)[:, None] - np.arange(cols)[None, :]) ** 2
    for r in range(rows):
        out[r] = np.sqrt((shift + up[r][None, :] ** 2).min(axis=1))
    return out[1:-1, 1:-1]


def _ring(m: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every cell, clockwise from the one above."""
    p = np.pad(m, 1)
    at = lambda dr, dc: p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc]
    return [at(-1, 0), at(-1, 1), at(0, 1), at(1, 1), at(1, 0), at(1, -1), at(0, -1), at(-1, -1)]


def thinned(open_cells: np.ndarray) -> np.ndarray:
    """Centre line one cell wide, by alternate peeling from two sides; connection is kept."""
    m = open_cells.astype(np.uint8)
    while True:
        before = m.sum()
        for side in (0, 1):
            n = _ring(m)
            count = sum(x.astype(int) for x in n)
            turns = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            a, b = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if side == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            m = m & ~((m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)).astype(np.uint8)
        if m.sum() == before:
            return m.astype(bool)


def _walked(a: np.ndarray, step: np.ndarray, ahead: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, edge, size) of the walks from nodes `a` by their neighbours `step`, all at once: the
    cells of each in turn and how many they are. A walk that another one takes from its other end is
    kept once, as the one whose start and step come first. `ahead` has the sum of a cell's two
    neighbours, so less the one before it is the one after."""
    ids, before, now = np.arange(len(a)), a.copy(), step.copy()
    end, last = step.copy(), a.copy()
    cells, owner = [a, step], [ids, ids]
    while len(ids := ids[on := ~node[now]]):
        now, before = ahead[now[on]] - before[on], now[on]
        end[ids], last[ids] = now, before
        cells.append(now)
        owner.append(ids)
    kept = (a < end) | (a == end) & (step < last)
    number = np.cumsum(kept) - 1
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    cells, owner = cells[kept[owner]], number[owner[kept[owner]]]
    order = np.argsort(owner, kind="stable")
    return cells[order], owner[order], np.bincount(owner, minlength=int(kept.sum()))


def _runs(line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The edges of a centre line as `_walked` gives them, by node and step and rings last; cells
    are numbered by row in the line with a rim of one."""
    flat, width = np.pad(line, 1).ravel(), line.shape[1] + 2
    offsets = np.array([-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1])
    at = np.flatnonzero(flat)
    count, ahead = np.zeros(len(at), np.int8), np.zeros(len(flat), np.int64)
    for o in offsets:
        beside = flat[at + o]
        count += beside
        ahead[at] += np.where(beside, at + o, 0)
    node = np.zeros(len(flat), bool)
    node[at[count != 2]] = True
    left = flat & ~node
    nodes = np.flatnonzero(node)
    for k in range(0, len(nodes), NODES):
        i, j = np.nonzero(flat[nodes[k : k + NODES, None] + offsets])
        a = nodes[k : k + NODES][i]
        step = a + offsets[j]
        first = ~node[step] | (a < step)
        out = _walked(a[first], step[first], ahead, node)
        left[out[0]] = False
        yield out
    rings = []
    for a in np.flatnonzero(left):  # rings without a node start at their first cell
        if left[a]:
            node[a] = True
            before, now = a, a + next(o for o in offsets if flat[a + o])
            rings.append((a, now))
            while now != a:
                left[now] = False
                before, now = now, ahead[now] - before
    if rings:
        yield _walked(*np.array(rings).T, ahead, node)


def traced(line: np.ndarray) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """(nodes, edges) of a centre line: nodes are cells with other than two neighbours (of a
    bare ring its first cell), an edge is the run of cells from node to node."""
    width = line.shape[1] + 2
    place = lambda cells: [(int(r) - 1, int(c) - 1) for r, c in zip(*np.divmod(cells, width), strict=True)]
    edges = [place(run) for cells, _, size in _runs(line) for run in np.split(cells, np.cumsum(size))[:-1]]
    nodes = {(int(r), int(c)) for r, c in np.argwhere(line & (sum(x.astype(int) for x in _ring(line)) != 2))}
    return sorted(nodes | {e[0] for e in edges}), edges


def _measured(line: np.ndarray, wide: np.ndarray) -> Iterator[pd.DataFrame]:
    """edge, r0, c0, r1, c1, length, narrowest, median of the edges of a centre line in cells, part
    by part."""
    width, done = line.shape[1] + 2, 0
    wide = np.pad(wide, 1).ravel()
    for cells, edge, size in _runs(line):
        end = np.cumsum(size)
        start, middle = end - size, (size - 1) // 2
        ends = [x - 1 for k in (start, end - 1) for x in np.divmod(cells[k], width)]
        slant = (edge[1:] == edge[:-1]) & ~np.isin(np.abs(np.diff(cells)), (1, width))
        slants = np.bincount(edge[1:][slant], minlength=len(size))
        own = wide[cells]
        own = own[np.lexsort((own, edge))]
        columns = [np.arange(done, done + len(size)), *ends, size - 1 - slants + slants * np.sqrt(2), own[start], (own[start + middle] + own[start + size // 2]) / 2]
        yield pd.DataFrame(dict(zip(("edge", "r0", "c0", "r1", "c1", "length", "narrowest", "median"), columns, strict=True)))
        done += len(size)


def corridor_edges(cells: DataFrame, by: str, step: float = 1.0) -> DataFrame:
    """(by, edge, r0, c0, r1, c1, length, narrowest, median) for the corridors of each region's
    open cells (by, r, c); clearances and lengths in units of `step` cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[[by, "r", "c"]] for b in batches])
        key, r0, c0 = rows[by].iloc[0], rows["r"].min(), rows["c"].min()
        m = np.zeros((rows["r"].max() - r0 + 1, rows["c"].max() - c0 + 1), bool)
        m[rows["r"] - r0, rows["c"] - c0] = True
        del rows
        for out in _measured(thinned(m), clearance(m)):
            for k, shift in (("r0", r0), ("c0", c0), ("r1", r0), ("c1", c0)):
                out[k] += shift
            for k in ("length", "narrowest", "median"):
                out[k] *= step
            out.insert(0, by, key)
            yield out

    return cells.groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, edge long, r0 long, c0 long, r1 long, c1 long, length double, narrowest double, median double")
