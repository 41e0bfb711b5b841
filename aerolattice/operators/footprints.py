"""Footprints decided one after another within a tile of the map, on arrays; rows come in the order of decision."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from .batches import groups_of

#: What a row of a tile is: the first footprint of a run of open ones of a class and priority, the last one of a longer run,
#: the first open footprint of a class that another tile decides, an accepted footprint.
FIRST, LAST, ELSEWHERE, ACCEPTED = range(4)


def decide(kind: np.ndarray, of: np.ndarray, box: np.ndarray, rules: Mapping[str, object]) -> tuple[list[int], list[tuple[int, int]]]:
    """Decides the classes (``of``) of footprints with equal sides (``box``: x_min, x_max, y_min, y_max of each row) as far
    as the tile knows: rows that are accepted, and (a row of the class, row from which it is open) of the others that
    aren't done. A number of a row is its place in the order.

    A class is new while its best accepted neighbour says so, which changes only where a neighbour is accepted. One that
    meets an open footprint of another tile, or of a class that is open for that reason, is open behind it. Where a class
    becomes new between the first and the last row of a run, the rows between aren't known here, and it is open too."""
    low, high = rules["ratio"]
    firsts = np.flatnonzero(kind == FIRST)
    ids, at = np.unique(of[firsts], return_index=True)
    by_x = np.argsort(box[firsts[at], 0], kind="stable")
    row_of = firsts[at][by_x]
    place = np.empty(len(ids), int)
    place[by_x] = np.arange(len(ids))
    x0, x1, y0, y1 = box[row_of].T
    area, widest = (x1 - x0) * (y1 - y0), (x1 - x0).max(initial=0.0) * 1.000001
    # The runs of a class, from a first row to its last one or to itself, in order, and where those of each class begin.
    mine = np.flatnonzero((kind == FIRST) | (kind == LAST))
    owner = place[np.searchsorted(ids, of[mine])]
    mine, owner = mine[by := np.argsort(owner, kind="stable")], owner[by]
    begins = np.flatnonzero(kind[mine] == FIRST)
    starts, ends = mine[begins], mine[np.append(begins[1:], len(mine)) - 1]
    runs = np.searchsorted(owner[begins], np.arange(len(ids) + 1)).tolist()
    alive, stopped, new = np.ones(len(ids), bool), np.zeros(len(ids), bool), np.ones(len(ids), bool)
    best = np.full((4, len(ids)), -np.inf)  # IoU, own and other's share, distance below zero
    queue = [*zip(starts[runs[:-1]].tolist(), range(len(ids))), *((r, -1) for r in np.flatnonzero((kind == ELSEWHERE) | (kind == ACCEPTED)).tolist())]
    heapify(queue)
    accepted, left = [], []

    def met(b: np.ndarray, among: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(x0, b[0] - widest), np.searchsorted(x0, b[1])
        return i + np.flatnonzero(among[i:j] & (x1[i:j] > b[0]) & (y0[i:j] < b[3]) & (y1[i:j] > b[2]))

    def ask_behind(c: int, r: int) -> None:
        """``c`` is looked at again at its first row behind ``r``, or stops at once if that one isn't known."""
        if (g := bisect_right(ends, r, runs[c], runs[c + 1])) < runs[c + 1]:
            if starts[g] > r:
                heappush(queue, (int(starts[g]), c))
            else:
                stopped[c] = True
                heappush(queue, (r, c))

    def stop_near(r: int, b: np.ndarray) -> None:
        near = met(b, alive)
        near = near[~stopped[near]]
        stopped[near] = True
        for c in near.tolist():
            ask_behind(c, r)

    def tell_near(r: int, b: np.ndarray) -> None:
        c = met(b, alive)
        if not len(c):
            return
        inter = (np.minimum(x1[c], b[1]) - np.maximum(x0[c], b[0])) * (np.minimum(y1[c], b[3]) - np.maximum(y0[c], b[2]))
        whole = (b[1] - b[0]) * (b[3] - b[2])
        dx, dy = (x0[c] + x1[c]) / 2 - (b[0] + b[1]) / 2, (y0[c] + y1[c]) / 2 - (b[2] + b[3]) / 2
        m = np.stack([inter / (area[c] + whole - inter), inter / area[c], inter / whole, -np.sqrt(dx * dx + dy * dy)])
        more, tied = np.zeros(len(c), bool), np.ones(len(c), bool)
        for now, was in zip(m, best[:, c]):
            more |= tied & (now > was)
            tied &= now == was
        c, m = c[more], m[:, more]
        ratio = whole / area[c]
        same = (m[0] >= rules["iou"]) | ((m[1] >= rules["own"]) & (m[2] >= rules["other"])) | ((-m[3] <= rules["distance"]) & (ratio >= low) & (ratio <= high))
        best[:, c], new[c] = m, ~same & (m[1] < rules["new_below"])
        for k in c[new[c] & ~stopped[c]].tolist():
            ask_behind(k, r)

    while queue:
        r, c = heappop(queue)
        if c < 0:
            (tell_near if kind[r] == ACCEPTED else stop_near)(r, box[r])
        elif alive[c] and (stopped[c] or new[c]):
            alive[c] = False
            if stopped[c]:
                left.append((int(row_of[c]), r))
                stop_near(r, box[row_of[c]])
            else:
                accepted.append(r)
                tell_near(r, box[r])
    return accepted, left


def decide_tiles(batches: Iterator[pa.RecordBatch], rules: Mapping[str, object]) -> Iterator[pa.RecordBatch]:
    """``decide`` for each tile (``tx, ty``) of batches that are ordered by tile and footprint: ``_class`` with its box, the
    order ``o`` that is accepted or, where ``open``, from which its footprints are open."""
    box = ["x_min", "x_max", "y_min", "y_max"]
    for t in groups_of(batches, "tx", "ty"):
        accepted, left = decide(t["kind"].to_numpy(), t["_class"].to_numpy(), np.stack([t[c].to_numpy().astype(float) for c in box], axis=1), rules)
        rows, upto = accepted + [r for r, _ in left], accepted + [r for _, r in left]
        if rows:
            out = t.select(["_class", *box]).take(pa.array(rows)).append_column("o", t["o"].take(pa.array(upto)))
            yield from out.append_column("open", pa.array([False] * len(accepted) + [True] * len(left))).combine_chunks().to_batches()
