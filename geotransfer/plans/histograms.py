"""Trees on binned features: boosting with an L2 leaf penalty, and forests, from one grower.

A feature's value is its number of quantile edges below it, one byte. A row's bins travel as one
packed value, stored once and shared by every fit. A tree grows level by level: gradients and
hessians are summed per (open node, feature, bin), a node splits where
``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)`` is largest (ties to the first feature, then the lowest
edge) with enough hessian on both sides, and a leaf holds ``-G/(H+l)``. The loss is the squared
error, so a row's hessian is its weight.

``grow`` works on the rows of one fit inside a task. ``fit_everywhere`` builds the same trees from
a table of any size: a level of all fits is one grouped aggregate over their open nodes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from geotransfer.operators.guards import safe_predictors
from geotransfer.plans.moments import matrix
from geotransfer.schemas import SEED
from geotransfer.session import materialize

BINS = 256
BLOCK = 1 << 22  # histogram cells held at once
STORED_ROUNDS = 20  # rounds between stored margins of ``fit_everywhere``
GRID = 1 << 20  # combinations of bins up to which a model is tabulated


@dataclass(frozen=True)
class Learner:
    """One configuration. ``columns`` are drawn per tree, ``node_columns`` per node; ``forest`` averages its trees."""

    rounds: int
    rate: float = 1.0
    depth: int = 30
    least: float = 5.0  # hessian on both sides of a split
    penalty: float = 0.0
    columns: float = 1.0
    node_columns: float = 1.0
    rows: float = 1.0
    forest: bool = False


def learners(rounds: int = 700, trees: int = 350) -> dict[tuple[str, str], Learner]:
    """The four candidates of the protocol; ``sqrt`` is told by a share of 0."""
    boosted = dict(rounds=rounds, rate=0.05, penalty=1.0, columns=0.8, rows=0.8)
    return {("random_forest", "rf_sqrt"): Learner(trees, node_columns=0.0, forest=True),
            ("random_forest", "rf_half"): Learner(trees, node_columns=0.5, forest=True),
            ("boosted_trees", "gbt_depth6"): Learner(depth=6, least=5.0, **boosted),
            ("boosted_trees", "gbt_depth8"): Learner(depth=8, least=10.0, **boosted)}


FEW_SHOT = Learner(300, rate=0.03, depth=3, least=1.0, penalty=1.0, columns=0.8, rows=0.8)


# ---------------------------------------------------------------- bins

def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner quantile edges of every feature, repeats dropped: one aggregate of mergeable sketches."""
    cols = safe_predictors(features)
    probs = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 100 * bins).alias(c) for c in cols]).first()
    return [np.unique(np.array(row[c] if row[c] is not None else [], np.float64)) for c in cols]


def binned(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], y: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``y`` and ``bins`` (a byte per feature: how many edges are below the value), stored once."""
    cols, keep = list(features), list(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codes_of(matrix(b, cols), edges)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("y"), _rows_binary(codes)], [*keep, "y", "bins"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("y", T.DoubleType()), T.StructField("bins", T.BinaryType())])
    own = df.select(*keep, F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in cols if c not in keep])
    return materialize(own.mapInArrow(task, schema))


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)


def _rows_binary(codes: np.ndarray) -> pa.Array:
    codes = np.ascontiguousarray(codes)
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])


def codes_in(column: pa.Array) -> np.ndarray:
    """The packed bins of a batch, rows by features."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


# ---------------------------------------------------------------- trees

@dataclass
class Trees:
    """Node arrays of all trees of a model. A leaf is its own child on both sides."""

    base: float
    scale: float
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    deepest: int = 0
    grid: np.ndarray | None = None  # margins of every combination of bins, in place of nodes
    rounds: int = 0  # trees behind such a grid
    _grid: np.ndarray | None = None
    _asked: int = 0

    def leaf(self, value: float) -> int:
        at = len(self.value)
        for column, v in ((self.feature, 0), (self.bin, 255), (self.left, at), (self.right, at), (self.value, value)):
            column.append(v)
        return at

    def margins(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """Sum over the trees from ``start`` on, without base and scale."""
        roots = np.array(self.roots[start:], np.int64)
        out = np.zeros(len(codes))
        if not len(roots):
            return out
        feature, cut, left, right = (np.array(a, np.int64) for a in (self.feature, self.bin, self.left, self.right))
        value = np.array(self.value)
        step = max(1, (1 << 20) // len(roots))
        for a in range(0, len(codes), step):
            part = codes[a:a + step]
            node = np.broadcast_to(roots, (len(part), len(roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.deepest):
                node = np.where(part[rows, feature[node]] > cut[node], right[node], left[node])
            out[a:a + step] = value[node].sum(1)
        return out

    def tabulated(self, features: int) -> np.ndarray:
        """Margins of every combination of bins: each leaf is a box of them."""
        out = np.zeros((256,) * features)
        feature, cut, left, right, value = (np.asarray(a).tolist() for a in (self.feature, self.bin, self.left, self.right, self.value))
        for root in np.asarray(self.roots).tolist():
            todo = [(root, (slice(0, 256),) * features)]
            while todo:
                node, box = todo.pop()
                if left[node] == node:
                    out[box] += value[node]
                    continue
                j, at, edge = feature[node], box[feature[node]], cut[node] + 1
                todo.append((left[node], box[:j] + (slice(at.start, min(at.stop, edge)),) + box[j + 1:]))
                todo.append((right[node], box[:j] + (slice(max(at.start, edge), at.stop),) + box[j + 1:]))
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """A model of few features that is asked for many rows is tabulated once; any other walks its trees for every row."""
        if self.grid is not None:
            return self.base + self.scale * self.grid[tuple(codes.T)]
        self._asked += len(codes)
        if self._grid is None and 256 ** codes.shape[1] <= GRID and self._asked * len(self.roots) > 4 * len(self.value):
            self._grid = self.tabulated(codes.shape[1])
        found = self.margins(codes) if self._grid is None else self._grid[tuple(codes.T)]
        return self.base + self.scale * found

    def packed(self) -> bytes:
        blob = io.BytesIO()
        if self.grid is not None:
            np.savez_compressed(blob, head=np.array([self.base, self.scale, self.rounds]), grid=self.grid)
            return blob.getvalue()
        np.savez_compressed(blob, head=np.array([self.base, self.scale, self.deepest]), roots=np.array(self.roots, np.int64),
                            feature=np.array(self.feature, np.int16), bin=np.array(self.bin, np.uint8),
                            left=np.array(self.left, np.int32), right=np.array(self.right, np.int32), value=np.array(self.value))
        return blob.getvalue()

    @staticmethod
    def unpacked(blob: bytes) -> Trees:
        a = np.load(io.BytesIO(blob))
        base, scale, deepest = a["head"].tolist()
        if "grid" in a:
            return Trees(base, scale, grid=a["grid"], rounds=int(deepest))
        return Trees(base, scale, *[a[c] for c in ("roots", "feature", "bin", "left", "right", "value")], int(deepest))


def share_of(count: int, share: float) -> int:
    """Columns drawn: at least one; a share of 0 is the square root of their number."""
    return max(1, math.isqrt(count) if share == 0 else int(share * count))


def _best_splits(g: np.ndarray, h: np.ndarray, learner: Learner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: gain, column and bin of the best split of (node, column, bin) sums."""
    total_g, total_h = g[:, :1].sum(2), h[:, :1].sum(2)
    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gr, hr = total_g[:, :, None] - gl, total_h[:, :, None] - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl ** 2 / (hl + learner.penalty) + gr ** 2 / (hr + learner.penalty) - (total_g ** 2 / (total_h + learner.penalty))[:, :, None]
    gain = np.where((hl >= learner.least) & (hr >= learner.least), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def grow(trees: Trees, codes: np.ndarray, g: np.ndarray, h: np.ndarray, learner: Learner, columns: np.ndarray,
         rng: np.random.Generator) -> np.ndarray:
    """Add one tree; returns the leaf value of every row (also of rows without weight)."""
    bins = int(codes.max(initial=0)) + 2
    root = trees.leaf(_leaf_value(g.sum(), h.sum(), learner))
    trees.roots.append(root)
    at = np.zeros(len(codes), np.int64)  # nodes of this tree, counted from its root
    open_, depth = np.array([0]), 0
    width = share_of(len(columns), learner.node_columns) if learner.node_columns != 1.0 else len(columns)
    weighted = np.flatnonzero(h > 0)
    while len(open_) and depth < learner.depth:
        place = np.full(len(trees.value) - root, -1)
        place[open_] = np.arange(len(open_))
        rows = weighted[place[at[weighted]] >= 0]
        local = place[at[rows]]
        step = max(1, BLOCK // (width * bins))
        grown = []
        for a in range(0, len(open_), step):
            b = min(a + step, len(open_))
            use = rows if b - a == len(open_) else rows[(local >= a) & (local < b)]
            mine = np.broadcast_to(columns, (b - a, len(columns)))
            if learner.node_columns != 1.0:
                mine = columns[np.sort(rng.random((b - a, len(columns))).argsort(1)[:, :width], 1)]
            local_use = place[at[use]] - a
            cell = (local_use[:, None] * width + np.arange(width)) * bins + codes[use[:, None], mine[local_use]]
            shape, size = (b - a, width, bins), (b - a) * width * bins
            gs, hs = (np.bincount(cell.ravel(), np.repeat(v[use], width), size).reshape(shape) for v in (g, h))
            for k, (gain, column, cut) in enumerate(zip(*_best_splits(gs, hs, learner))):
                if gain > 1e-12:
                    gl, hl = gs[k, column, :cut + 1].sum(), hs[k, column, :cut + 1].sum()
                    gt, ht = gs[k, 0].sum(), hs[k, 0].sum()
                    node = root + int(open_[a + k])
                    trees.feature[node], trees.bin[node] = int(mine[k, column]), int(cut)
                    trees.left[node] = trees.leaf(_leaf_value(gl, hl, learner))
                    trees.right[node] = trees.leaf(_leaf_value(gt - gl, ht - hl, learner))
                    grown.append(node - root)
        if not grown:
            break
        depth += 1
        split = np.zeros(len(trees.value) - root, bool)
        split[grown] = True
        feature, cut, left, right = (np.array(c[root:]) for c in (trees.feature, trees.bin, trees.left, trees.right))
        left, right = left - root, right - root
        moved = np.flatnonzero(split[at])
        node = at[moved]
        at[moved] = np.where(codes[moved, feature[node]] > cut[node], right[node], left[node])
        open_ = np.concatenate([left[grown], right[grown]])
    trees.deepest = max(trees.deepest, depth)
    return np.array(trees.value[root:])[at]


def _leaf_value(g: float, h: float, learner: Learner) -> float:
    return float(-g / (h + learner.penalty)) if h + learner.penalty > 0 else 0.0


def fit(codes: np.ndarray, y: np.ndarray, learner: Learner, seed: int = SEED) -> Trees:
    """A model on the rows of one fit. Boosting starts at the mean; a forest draws rows with repeats."""
    rng = np.random.default_rng(seed)
    n, f = codes.shape
    base = float(y.mean()) if n else 0.0
    trees = Trees(base, 1.0 / learner.rounds if learner.forest else learner.rate)
    margin = np.zeros(n)
    every = np.arange(f)
    for _ in range(learner.rounds if n else 0):
        columns = np.sort(rng.choice(f, share_of(f, learner.columns), replace=False)) if learner.columns < 1 else every
        if learner.forest:
            h = np.bincount(rng.integers(0, n, n), minlength=n).astype(np.float64)
            grow(trees, codes, (base - y) * h, h, learner, columns, rng)
            continue
        h = (rng.random(n) < learner.rows).astype(np.float64) if learner.rows < 1 else np.ones(n)
        margin += grow(trees, codes, (base + learner.rate * margin - y) * h, h, learner, columns, rng)
    return trees


# ---------------------------------------------------------------- a table of any size

def fit_everywhere(rows: DataFrame, held: Sequence[int | None], learner: Learner, features: int, fold: str = "fold",
                   id_col: str = "id", seed: int = SEED) -> list[Trees]:
    """A boosted model per entry of ``held`` (the fold it must not see, or None), on all other rows of ``binned``.

    Every level is one scan and one grouped aggregate for all fits and open nodes; Spark picks each
    node's split, and the driver holds the trees alone. Margins are stored every ``STORED_ROUNDS``
    rounds, so a scan scores only the trees since. Rows of a round are drawn by a hash of seed,
    round and id. The trees equal those of ``fit`` where no rows or columns are drawn.
    """
    if learner.forest:
        raise ValueError("forests are fitted on the rows of one task")
    fits = list(held)
    own = rows.select(F.col(id_col).alias("id"), F.col(fold).alias("fold"), "y", "bins")
    sums = own.groupBy("fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    models = []
    for k in fits:
        part = [(r["s"], r["n"]) for r in sums if k is None or r["fold"] != k]
        n = sum(p[1] for p in part)
        models.append(Trees(sum(p[0] for p in part) / n if n else 0.0, learner.rate))
    rng = np.random.default_rng(seed)
    stored, since = own.withColumn("margins", F.array(*[F.lit(0.0)] * len(fits))), [0] * len(fits)
    for r in range(learner.rounds):
        if r and r % STORED_ROUNDS == 0:
            stored, since = materialize(_with_margins(stored, models, since)), [len(m.roots) for m in models]
        columns = (np.sort(rng.choice(features, share_of(features, learner.columns), replace=False))
                   if learner.columns < 1 else np.arange(features))
        drawn = stored
        if learner.rows < 1:
            drawn = stored.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "id"), F.lit(1 << 30)) < int(learner.rows * (1 << 30)))
        roots = [m.leaf(0.0) for m in models]
        open_ = [[root] for root in roots]
        for level in range(learner.depth + 1):
            found = {(x["fit"], x["node"]): x for x in _level(drawn, fits, models, since, roots, open_, level, learner, columns)}
            following: list[list[int]] = [[] for _ in fits]
            for i, m in enumerate(models):
                for node in open_[i]:
                    x = found.get((i, node))
                    if x is None:
                        continue
                    m.value[node] = _leaf_value(x["g"], x["h"], learner)
                    if level < learner.depth and x["best"] and x["best"]["gain"] > 1e-12:
                        m.feature[node], m.bin[node] = -x["best"]["feature"], -x["best"]["bin"]
                        m.left[node], m.right[node] = m.leaf(0.0), m.leaf(0.0)
                        following[i] += [m.left[node], m.right[node]]
            if not any(following):
                break
            open_ = following
            for m in models:
                m.deepest = max(m.deepest, level + 1)
        for m, root in zip(models, roots):
            m.roots.append(root)
    return models


def _batch_rows(b: pa.RecordBatch, models: list[Trees], since: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a batch, and its margins (rows by fits) with the trees grown since they were stored."""
    codes = codes_in(b.column("bins"))
    margins = b.column("margins").flatten().to_numpy().reshape(len(codes), -1).copy()
    for i, m in enumerate(models):
        margins[:, i] += m.margins(codes, since[i])
    return codes, margins


def _with_margins(rows: DataFrame, models: list[Trees], since: list[int]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = _batch_rows(b, models, since)[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(margins) + 1) * margins.shape[1], pa.int32()), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], b.schema.names)

    return rows.mapInArrow(task, rows.schema)


def _level(rows: DataFrame, held: list, models: list[Trees], since: list[int], roots: list[int], open_: list[list[int]], level: int,
           learner: Learner, columns: np.ndarray) -> list:
    """Sums and the best split of every open node of every fit: ``fit``, ``node``, ``g``, ``h`` and ``best``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(nodes), len(columns), BINS)) for nodes in open_]
        for b in batches:
            codes, margins = _batch_rows(b, models, since)
            y, folds = b.column("y").to_numpy(), np.array(b.column("fold").to_pylist(), object)
            for i, m in enumerate(models):
                use = np.flatnonzero(folds != held[i]) if held[i] is not None else np.arange(len(codes))
                node = np.full(len(use), roots[i])
                feature, cut, left, right = (np.array(a) for a in (m.feature, m.bin, m.left, m.right))
                for _ in range(level):
                    node = np.where(codes[use, feature[node]] > cut[node], right[node], left[node])
                place = np.full(len(m.value), -1)
                place[open_[i]] = np.arange(len(open_[i]))
                at = place[node]
                use, at = use[at >= 0], at[at >= 0]
                g = m.base + m.scale * margins[use, i] - y[use]
                cell = ((at[:, None] * len(columns) + np.arange(len(columns))) * BINS + codes[use][:, columns]).ravel()
                for k, weight in enumerate((np.repeat(g, len(columns)), None)):
                    sums[i][k] += np.bincount(cell, weight, sums[i][k].size).reshape(sums[i][k].shape)
        for i, (g, h) in enumerate(sums):
            at = np.nonzero(h)
            for a in range(0, len(at[0]), 50_000):
                n, c, x = (v[a:a + 50_000] for v in at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), i, np.int32)), pa.array(np.array(open_[i], np.int32)[n]),
                     pa.array(columns[c].astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(g[n, c, x]), pa.array(h[n, c, x])],
                    ["fit", "node", "feature", "bin", "g", "h"])

    cells = rows.mapInArrow(task, "fit int, node int, feature int, bin int, g double, h double").groupBy(
        "fit", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    every = Window.partitionBy("fit", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gl, hl, gt, ht, p = F.col("gl"), F.col("hl"), F.col("gt"), F.col("ht"), learner.penalty
    gain = gl * gl / (hl + p) + (gt - gl) * (gt - gl) / (ht - hl + p) - gt * gt / (ht + p)
    ok = (hl >= learner.least) & (ht - hl >= learner.least) & (hl < ht)
    sides = cells.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(every),
                               "ht": F.sum("h").over(every)})
    best = F.max(F.when(ok, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"))))
    return sides.groupBy("fit", "node").agg(F.first("gt").alias("g"), F.first("ht").alias("h"), best.alias("best")).collect()


# ---------------------------------------------------------------- many fits, one task each

def _width(df: DataFrame) -> int:
    """Tasks that groups are dealt to. Fits are dear and their rows few: left alone, Spark would put them all in one task."""
    return max(32, 4 * df.sparkSession.sparkContext.defaultParallelism)


def fit_cells(rows: DataFrame, cell: Sequence[str], learner_of, seed_of=None) -> DataFrame:
    """A packed model per group of ``cell``: ``cell``, ``model``, ``n``. Every group has to fit one task.

    ``rows`` hold ``id``, ``y`` and ``bins``; a group is put in order of its ids, so reruns agree.
    ``learner_of(*cell values)`` names the learner, ``seed_of`` its seed.
    """
    cell = list(cell)
    schema = T.StructType([*[rows.schema[c] for c in cell], T.StructField("model", T.BinaryType()), T.StructField("n", T.LongType())])

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        values = [k.as_py() for k in key]
        model = fit(codes_in(t.column("bins")), t.column("y").to_numpy(), learner_of(*values), seed_of(*values) if seed_of else SEED)
        yield pa.RecordBatch.from_arrays([*[pa.array([v], k.type) for v, k in zip(values, key)], pa.array([model.packed()], pa.binary()),
                                          pa.array([len(t)], pa.int64())], schema=pa.schema(
            [*[(c, k.type) for c, k in zip(cell, key)], ("model", pa.binary()), ("n", pa.int64())]))

    return rows.select(*cell, "id", "y", "bins").repartition(_width(rows), *cell).groupBy(*cell).applyInArrow(task, schema)


def score_cells(rows: DataFrame, models: DataFrame, cell: Sequence[str], on: Sequence[str] | None = None,
                block_rows: int = 200_000) -> DataFrame:
    """``on``, ``cell``, ``id``, ``y`` and ``prediction``: rows meet every model of their ``on`` columns (without them, of their cell).

    Rows with equal bins share a prediction. The distinct bins are scored, in groups of about
    ``block_rows`` to each of which its model is sent; rows then join the predictions of their
    bins, one list with a value per model. So the trees' work ends where the bins repeat, and
    rows are not copied per model before they are scored.
    """
    cell, on = list(cell), list(on or cell)
    named = models.select(*dict.fromkeys([*on, *cell]), "model")
    points = materialize(rows.select(*on, "bins").distinct())
    most = points.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block_rows))
    extra = [c for c in cell if c not in on]
    keys = [*on, *extra, "block"]
    left = points.join(F.broadcast(named.drop("model")), on).select(
        *on, *extra, "bins", F.pmod(F.xxhash64("bins"), F.lit(blocks)).cast("int").alias("block"))
    # Own names: models may be derived from the same rows.
    right = named.select(*[F.col(c).alias(f"m_{c}") for c in keys[:-1]], "model",
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("m_block"))
    schema = T.StructType([*[left.schema[c] for c in [*keys[:-1], "bins"]], T.StructField("prediction", T.DoubleType())])

    def task(key: tuple[pa.Scalar, ...], part: pa.Table, model: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        if not len(part) or not len(model):
            return part.slice(0, 0).select([*keys[:-1], "bins"]).append_column("prediction", pa.array([], pa.float64()))
        p = Trees.unpacked(model.column("model")[0].as_py()).predict(codes_in(part.column("bins")))
        return part.select([*keys[:-1], "bins"]).append_column("prediction", pa.array(p))

    other = [f"m_{c}" for c in keys]
    left, right = left.repartition(_width(left), *keys), right.repartition(_width(left), *other)
    scored = left.groupBy(*keys).cogroup(right.groupBy(*other)).applyInArrow(task, schema)
    lists = scored.groupBy(*on, "bins").agg(F.collect_list(F.struct(*extra, "prediction")).alias("_each"))
    return rows.select(*on, "id", "y", "bins").join(lists, [*on, "bins"]).select(*on, "id", "y", F.inline("_each")).select(
        *dict.fromkeys([*on, *cell]), "id", "y", "prediction")
