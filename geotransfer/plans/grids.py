"""Trees of one or two binned features on sums, so that a fit sees every row of a table of any size.

The loss is the squared error and rows with equal bins share a margin. So a tree needs, per
combination of bins, the count and the sum of ``y`` of its drawn rows, and nothing of the rows
themselves. Rows are dealt to ``GROUPS`` random groups by a hash of their id, and a tree draws
groups in place of single rows: boosting its share of them, a forest as many as there are, with
repeats. Every row is in one group, so each row is drawn as often as the learner says, and means
of drawn rows vary as they do under draws of single rows (a group is a random part of the table).

What a fit reads is bound by groups and combinations, never by rows: at most 0.8 MB per fold and
group. All candidates of a training set share its sums. A tree is grown on prefix sums over the
grid of combinations: a node is a box of it, and the work of a level is the length of its boxes'
sides. Splits, ties and leaf values are those of ``histograms.grow``. A model is the grid of its margins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geotransfer.plans.histograms import Learner, Trees, codes_in, share_of
from geotransfer.schemas import SEED
from geotransfer.session import materialize

FEATURES = 2  # features at most
GROUPS = 80
SIDE = 256  # bins of a feature
PART_ROWS = 1_000_000  # rows of a fold and group that are summed in one task
ROUNDS = 16  # rounds whose draws are summed at once


# ---------------------------------------------------------------- sums

def cells_of(codes: np.ndarray) -> np.ndarray:
    """Place on the grid of every row of codes."""
    out = np.zeros(len(codes), np.int64)
    for column in codes.T:
        out = out * SIDE + column
    return out


def sums(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Counts and sums of ``y`` per fold, group and combination of bins, packed and stored: ``fold``, ``g``, ``part``, ``n``
    (rows), ``at`` (places), ``counts`` and ``totals``. ``sizes`` are the rows per fold.

    Rows are added up in the order of their values, so a rerun gives the same bits.
    """
    parts = 1 + max(sizes.values(), default=0) // (GROUPS * PART_ROWS)
    dealt = rows.select("fold", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(GROUPS)).cast("int").alias("g"),
                        F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(parts)).cast("int").alias("part"), "y", "bins")

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        cell, y = cells_of(codes_in(t.column("bins"))), t.column("y").to_numpy()
        order = np.lexsort((y, cell))
        at, first, count = np.unique(cell[order], return_index=True, return_counts=True)
        packed = [at.astype(np.uint16), count.astype(np.uint32), np.add.reduceat(y[order], first)]
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([len(y)], pa.int64()),
                                          *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                                         ["fold", "g", "part", "n", "at", "counts", "totals"])

    keys = ["fold", "g", "part"]
    return materialize(dealt.groupBy(*keys).applyInArrow(
        task, "fold int, g int, part int, n long, at binary, counts binary, totals binary"))


# ---------------------------------------------------------------- one model

class Grid:
    """Box sums of values on the grid, from their prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        self.s = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
        values.cumsum(0).cumsum(1, out=self.s[1:, 1:])
        self.s = self.s.ravel()

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.s[place]


def _boxes(grids: Sequence[Grid], low: np.ndarray, high: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = high @ step, low @ step, low[:, 0] * step[0] + high[:, 1] * step[1], high[:, 0] * step[0] + low[:, 1] * step[1]
    return [x.at(a) - x.at(c) - x.at(d) + x.at(b) for x in grids]


def _values(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return np.divide(-g, h + penalty, out=np.zeros(len(g)), where=h + penalty > 0)


def tree(g: np.ndarray, h: np.ndarray, learner: Learner, columns: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Leaf value of every place of the grid: one tree on the sums of gradients and hessians (two axes) of a draw."""
    shape, step = g.shape, np.array([g.shape[1] + 1, 1])
    grids = Grid(g), Grid(h)
    low, high = np.zeros((1, 2), np.int64), np.array([shape], np.int64)
    leaves: list[tuple[np.ndarray, ...]] = []
    node_g, node_h = _boxes(grids, low, high, step)
    for depth in range(learner.depth + 1):
        split = np.zeros(len(low), bool)
        column, cut = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        if depth < learner.depth:
            mine = np.broadcast_to(columns, (len(low), len(columns)))
            if learner.node_columns != 1.0:
                mine = columns[np.sort(rng.random((len(low), len(columns))).argsort(1)[:, :width], 1)]
            node, c = np.repeat(np.arange(len(low)), mine.shape[1]), mine.ravel()
            start, cuts = low[node, c], high[node, c] - low[node, c] - 1
            pair = np.repeat(np.arange(len(node)), cuts)
            x = np.arange(len(pair)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + start[pair]
            along, across = step[c], step[1 - c]
            near, far = low[node, 1 - c] * across, high[node, 1 - c] * across
            edge, owner = (x + 1) * along[pair], node[pair]
            left, base = [], start * along
            for grid in grids:
                left.append(grid.at(edge + far[pair]) - grid.at(edge + near[pair]) - (grid.at(base + far) - grid.at(base + near))[pair])
            gl, hl = left
            gr, hr, p = node_g[owner] - gl, node_h[owner] - hl, learner.penalty
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl ** 2 / (hl + p) + gr ** 2 / (hr + p) - (node_g ** 2 / (node_h + p))[owner]
            gain = np.where((hl >= learner.least) & (hr >= learner.least), gain, -np.inf)
            if len(gain):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                top = np.maximum.reduceat(gain, first)
                best = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(gain))))
                best = best[np.diff(owner[best], prepend=-1) > 0]  # the first of equals
                best = best[gain[best] > 1e-12]
                split[owner[best]] = True
                column[owner[best]], cut[owner[best]] = c[pair[best]], x[best]
        done = ~split
        leaves.append((low[done], high[done], _values(node_g[done], node_h[done], learner.penalty)))
        if not split.any():
            break
        rows, column, cut = np.flatnonzero(split), column[split], cut[split] + 1
        left_high, right_low = high[rows].copy(), low[rows].copy()
        left_high[np.arange(len(rows)), column] = right_low[np.arange(len(rows)), column] = cut
        low, high = np.concatenate([low[rows], right_low]), np.concatenate([left_high, high[rows]])
        node_g, node_h = _boxes(grids, low, high, step)
    low, high, value = (np.concatenate(part) for part in zip(*leaves))
    corners = [(low @ step, value), (high @ step, value), (low[:, 0] * step[0] + high[:, 1], -value), (high[:, 0] * step[0] + low[:, 1], -value)]
    painted = np.bincount(np.concatenate([k for k, _ in corners]), np.concatenate([v for _, v in corners]), (shape[0] + 1) * (shape[1] + 1))
    return painted.reshape(shape[0] + 1, -1).cumsum(0).cumsum(1)[:-1, :-1]


def fit(at: np.ndarray, counts: np.ndarray, totals: np.ndarray, features: int, learner: Learner, seed: int = SEED) -> Trees:
    """A model of the rows whose counts and sums of ``y`` stand per group and place (``at``: the places that hold rows)."""
    shape = (SIDE, SIDE if features == 2 else 1)
    groups, n = len(counts), counts.sum()
    base = float(totals.sum() / n) if n else 0.0
    out = Trees(base, 1.0 / learner.rounds if learner.forest else learner.rate)
    margin = np.zeros(shape)
    centred = totals - base * counts
    rng, draws = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    every = np.arange(features)
    drawn = share_of(groups, learner.rows) if learner.rows < 1 else groups
    for r in range(learner.rounds if n else 0):
        if r % ROUNDS == 0:
            take = np.ones((min(ROUNDS, learner.rounds - r), groups))
            for weights in take:
                if learner.forest:
                    weights[:] = np.bincount(draws.integers(0, groups, groups), minlength=groups)
                elif drawn < groups:
                    weights[draws.permutation(groups)[drawn:]] = 0.0
            hessian, response = take @ counts, take @ centred
        g, h = np.zeros(shape), np.zeros(shape)
        columns = np.sort(rng.choice(features, share_of(features, learner.columns), replace=False)) if learner.columns < 1 else every
        width = share_of(len(columns), learner.node_columns)
        k = r % ROUNDS
        h.ravel()[at] = hessian[k]
        g.ravel()[at] = hessian[k] * (0.0 if learner.forest else learner.rate * margin.ravel()[at]) - response[k]
        margin += tree(g, h, learner, columns, width, rng)
    out.grid, out.rounds = margin.reshape((SIDE,) * features), learner.rounds if n else 0
    return out


# ---------------------------------------------------------------- all models of all training sets

def fit_sets(stored: DataFrame, sets: Sequence[tuple[Sequence[int], Sequence[tuple[str, str]]]], learners: dict, features: int) -> DataFrame:
    """Models of training sets, each given by its folds and the learners it wants: ``set`` (its place), ``model_family``,
    ``config``, ``model``, ``n``. A set's boosted models and its forests are a task each."""
    spark, work = stored.sparkSession, []
    for k, (folds, kinds) in enumerate(sets):
        for forest in (False, True):
            wanted = [kind for kind in kinds if learners[kind].forest == forest]
            if wanted and folds:
                work.append((k, list(folds), wanted))
    named = spark.createDataFrame([(t, f) for t, (_, folds, _) in enumerate(work) for f in folds], "task int, fold int")

    def fitted(t: int, counts: np.ndarray, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, _, wanted = work[t]
        at = np.flatnonzero(counts.any(0))
        if len(at) < counts.shape[1]:
            counts, totals = counts[:, at], totals[:, at]
        same: dict[Learner, bytes] = {}  # candidates that draw the same number of columns are one model
        for kind in wanted:
            own = learners[kind]
            alike = replace(own, node_columns=float(share_of(share_of(features, own.columns), own.node_columns)))
            if alike not in same:
                same[alike] = fit(at, counts, totals, features, own).packed()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([kind[0]]), pa.array([kind[1]]), pa.array([same[alike]], pa.binary()),
                 pa.array([int(counts.sum())], pa.int64())], ["set", "model_family", "config", "model", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records sorted by task in; their order makes a rerun add up the same bits."""
        now, counts, totals = None, None, None
        for b in batches:
            for t, g, *packed in zip(*[b.column(c).to_pylist() for c in ("task", "g")], *[b.column(c) for c in ("at", "counts", "totals")]):
                if t != now:
                    if now is not None:
                        yield from fitted(now, counts, totals)
                    now, counts, totals = t, np.zeros((GROUPS, SIDE ** features)), np.zeros((GROUPS, SIDE ** features))
                at, n, s = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.uint16, np.uint32, np.float64)))
                counts[g, at] += n
                totals[g, at] += s
        if now is not None:
            yield from fitted(now, counts, totals)

    columns = ["task", "fold", "part", "g", "at", "counts", "totals"]
    dealt = stored.join(F.broadcast(named), "fold").select(*columns).repartitionById(max(1, len(work)), F.col("task"))
    return dealt.sortWithinPartitions("task", "fold", "g", "part").mapInArrow(run, "set int, model_family string, config string, model binary, n long")
