"""Exact nearest neighbour between two vector tables.

Source vectors are grouped by their nearest pivot; pivots are source rows and
their number grows with the square root of the table up to a limit. Groups that
lie side by side form a bag of about ``block_rows`` rows. A first pass searches
the bag of each target's own group, which gives a true distance it can reach. By
the triangle inequality a group whose members lie between two radii of its pivot
is skipped by the second pass when even its closest possible member is farther
than that; a target is sent once to each bag that holds a group it needs, so
where nothing can be skipped it is sent to source rows / ``block_rows`` bags and
not to every group. The work of a pass is cut into blocks of bounded size on
both sides, by hash inside a bag, so one popular group is spread over many
tasks. A block pair emits one row per target (its minimum), never the pairs;
inside it sources are sorted along their widest axis and only those within
reach on that axis are measured.

Vectors of at most ``NARROW`` numbers are dealt to boxes of about ``block_rows`` rows instead: a bag is a
box, and the distance to its sides tells whether it is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from geotransfer.functions.text import hash_key
from geotransfer.session import materialize

_SLACK = 1e-9
PIVOT_RANGE = (32, 1024)
NARROW, BOX_SAMPLE = 3, 8192  # numbers in a vector up to which sources are dealt to boxes, and rows that set the boxes
BLOCK_BYTES, BLOCK_RANGE = 8 << 20, (4096, 65536)  # vectors of a block, and its rows
SLICE = 1024  # rows measured against all pivots at once


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ (-2.0 * b.T)
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(a, b), 0.0))


def _closest(a: np.ndarray, b: np.ndarray, reach: np.ndarray, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index (-1: none within ``reach``) and distance of the nearest row of ``b`` for each row of ``a``; ties to the smaller index.

    Rows are taken in the order of the axis on which ``b`` is widest. For a slice of targets, some
    neighbours on the axis bound the distance; the matrix product over all rows within that bound on
    the axis finds the few that can be nearest within rounding, and those are measured directly.
    """
    best, dist = np.full(len(a), -1, dtype=np.int64), np.full(len(a), np.inf)
    slack = 1e-7 * (1.0 + np.sqrt(max((a * a).sum(1).max(), (b * b).sum(1).max())))
    axis = int((b.max(0) - b.min(0)).argmax())
    order = b[:, axis].argsort(kind="stable")
    b, half = b[order], math.isqrt(len(b))
    x, turn = b[:, axis], a[:, axis].argsort(kind="stable")
    for i in range(0, len(a), rows):
        mine = turn[i:i + rows]
        part = a[mine]
        at = part[:, axis]
        low, high = max(0, np.searchsorted(x, at[0]) - half), np.searchsorted(x, at[-1]) + half
        bound = np.minimum(reach[mine], _distances(part, b[low:high]).min(1) if low < len(b) else np.inf) + slack
        low, high = np.searchsorted(x, (at - bound).min()), np.searchsorted(x, (at + bound).max(), "right")
        if low == high:
            continue
        rough = _squares(part, b[low:high])
        r, c = np.nonzero(rough <= np.square(np.sqrt(np.maximum(rough.min(1), 0.0)) + slack)[:, None])
        c += low
        exact = np.sqrt(((part[r] - b[c]) ** 2).sum(1))
        c = order[c]
        pick = np.lexsort((c, exact, r))
        _, first = np.unique(r[pick], return_index=True)
        best[mine], dist[mine] = c[pick][first], exact[pick][first]
    return best, dist


def _bags(centres: np.ndarray, counts: np.ndarray, block_rows: int) -> np.ndarray:
    """A bag per group: runs of groups along the widest direction of their pivots, about ``block_rows`` rows each."""
    z = centres - centres.mean(0)
    order = (z @ np.linalg.svd(z, full_matrices=False)[2][0]).argsort(kind="stable")
    bags, bag, held = np.zeros(len(counts), np.int32), 0, 0
    for k in order.tolist():
        if held and held + counts[k] > block_rows:
            bag, held = bag + 1, 0
        bags[k], held = bag, held + int(counts[k])
    return bags


class _Cuts:
    """Boxes that hold about equal shares of a sample: halved along the widest axis until there are ``leaves``."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.axis, self.at, self.below, self.above, self.depth = [], [], [], [], 0
        self._halve(sample, leaves, 0)
        self.axis, self.at, self.below, self.above = (np.array(a) for a in (self.axis, self.at, self.below, self.above))

    def _halve(self, part: np.ndarray, leaves: int, depth: int) -> int:
        """Number of the new box; a leaf is its own child."""
        k, self.depth = len(self.axis), max(self.depth, depth)
        for column, v in ((self.axis, 0), (self.at, 0.0), (self.below, k), (self.above, k)):
            column.append(v)
        if leaves < 2 or len(part) < 2:
            return k
        axis = int((part.max(0) - part.min(0)).argmax())
        x = np.sort(part[:, axis])
        at = x[max(1, len(x) * (leaves // 2) // leaves)]
        lower = part[:, axis] < at
        if lower.any():  # else half of the sample or more is equal to the least
            self.axis[k], self.at[k] = axis, at
            self.below[k] = self._halve(part[lower], leaves // 2, depth + 1)
            self.above[k] = self._halve(part[~lower], leaves - leaves // 2, depth + 1)
        return k

    def place(self, v: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(v), np.int64), np.arange(len(v))
        for _ in range(self.depth):
            node = np.where(v[rows, self.axis[node]] < self.at[node], self.below[node], self.above[node])
        return node


def _on_line(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """``tid``, ``sid``, ``distance`` for vectors of one number: equal values are merged, values are dealt to ranges, and a range
    looks up its targets among its own sources and the nearest source of the ranges on either side."""
    spark, id_type = src.sparkSession, src.schema["sid"].dataType.simpleString()
    x = (F.col("v")[0].cast("double") + F.lit(0.0)).alias("x")
    asked = tgt.select("tid", x)
    values = src.select("sid", x).groupBy("x").agg(F.min("sid").alias("sid"), F.lit(False).alias("asked")).unionByName(
        asked.select("x").distinct().select("x", F.lit(None).cast(id_type).alias("sid"), F.lit(True).alias("asked")))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = materialize(values.repartitionByRange(width, "x").withColumn("part", F.spark_partition_id()))
    # Two rows per range.
    ends = ranged.where("NOT asked").groupBy("part").agg(F.min(F.struct("x", "sid")).alias("low"), F.max(F.struct("x", "sid")).alias("high")).collect()
    lows, highs = ({r["part"]: (r[k]["x"], r[k]["sid"]) for r in ends} for k in ("low", "high"))

    def task(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        k = key[0].as_py()
        before = [highs[max(p for p in highs if p < k)]] if any(p < k for p in highs) else []
        after = [lows[min(p for p in lows if p > k)]] if any(p > k for p in lows) else []
        part = part.sort_by("x").combine_chunks()
        own, at = part.filter(pc.invert(part.column("asked"))), part.filter(part.column("asked")).column("x").to_numpy()
        near = np.concatenate([[v for v, _ in before], own.column("x").to_numpy(), [v for v, _ in after]])
        ids = pa.concat_arrays([pa.array([i for _, i in before], part.schema.field("sid").type), *own.column("sid").chunks,
                                pa.array([i for _, i in after], part.schema.field("sid").type)])
        right = np.clip(np.searchsorted(near, at), 0, len(near) - 1)
        left = np.maximum(right - 1, 0)
        dl, dr = np.abs(at - near[left]), np.abs(at - near[right])
        smaller = pc.less(ids.take(pa.array(left)), ids.take(pa.array(right))).to_numpy(zero_copy_only=False).astype(bool)
        best = np.where((dl < dr) | ((dl == dr) & smaller), left, right)
        return pa.table({"x": pa.array(at), "sid": ids.take(pa.array(best)), "distance": pa.array(np.minimum(dl, dr))})

    found = ranged.groupBy("part").applyInArrow(task, f"x double, sid {id_type}, distance double")
    return asked.join(materialize(found), "x").select("tid", "sid", "distance")


def nearest_source(source: DataFrame, target: DataFrame, source_id: str, target_id: str,
                   vector: str, pivots: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(target_id, source_id, distance): Euclidean nearest source; ties to the smaller id.

    Vectors of one number are searched on the line (``_on_line``). Without ``pivots`` narrow vectors are dealt to boxes; for wider ones their number is the square root of the source rows, within ``PIVOT_RANGE``;
    without ``block_rows`` a block's vectors take ``BLOCK_BYTES``, within ``BLOCK_RANGE`` rows.
    """
    src = source.select(F.col(source_id).alias("sid"), F.col(vector).alias("v"))
    tgt = target.select(F.col(target_id).alias("tid"), F.col(vector).alias("v"))
    id_type = src.schema["sid"].dataType.simpleString()
    t_type = tgt.schema["tid"].dataType.simpleString()
    v_type = src.schema["v"].dataType.simpleString()

    probe = src.select("v").head()
    if probe is None:
        raise ValueError("source table is empty")
    if len(probe.v) == 1:
        return _on_line(src, tgt).select(F.col("tid").alias(target_id), F.col("sid").alias("nearest_id"), "distance")
    rows, width = src.count(), len(probe.v)
    if block_rows is None:
        block_rows = min(max(BLOCK_BYTES // (8 * width), BLOCK_RANGE[0]), BLOCK_RANGE[1])
    boxed = pivots is None and width <= NARROW
    if pivots is None:
        pivots = BOX_SAMPLE if boxed else min(max(math.isqrt(rows), PIVOT_RANGE[0]), PIVOT_RANGE[1])
    chosen = src.orderBy(hash_key("pivot", "sid"), "sid").limit(pivots).select("v").collect()
    centres = np.asarray([r.v for r in chosen], dtype=np.float64)
    cuts = _Cuts(centres, -(-rows // block_rows)) if boxed else None

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), SLICE):
                batch = whole.slice(a, SLICE)
                v = _matrix(batch.column("v"))
                if cuts is not None:
                    cell, radius = cuts.place(v), np.zeros(len(v))
                else:
                    d = _distances(v, centres)
                    cell = d.argmin(1)
                    radius = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], ["sid", "v", "cell", "radius"])

    cells = materialize(src.mapInArrow(to_cell, f"sid {id_type}, v {v_type}, cell int, radius double"))
    sides = [F.array(*[f(F.col("v")[j].cast("double")) for j in range(width)]) if boxed else f("radius") for f in (F.min, F.max)]
    # At most one row per pivot or box.
    stats = {r.cell: r for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), sides[0].alias("low"), sides[1].alias("high")).collect()}
    used = np.array(sorted(stats), dtype=np.int32)
    n, low, high = (np.array([stats[c][k] for c in used.tolist()]) for k in ("n", "low", "high"))
    if boxed:
        bag_of = np.arange(len(used), dtype=np.int32)
        held = starts = None
    else:
        bag_of = _bags(centres[used], n, block_rows)
        by_bag = bag_of.argsort(kind="stable")  # groups in the order of their bags
        used, n, low, high, bag_of = (x[by_bag] for x in (used, n, low, high, bag_of))
        held, starts = centres[used], np.flatnonzero(np.diff(bag_of, prepend=-1))

    def own_of(v: np.ndarray) -> np.ndarray:
        if cuts is not None:
            return bag_of[np.minimum(np.searchsorted(used, cuts.place(v)), len(used) - 1)]
        return bag_of[_distances(v, held).argmin(1)]

    def needed(v: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Bags (columns) that can hold a source within reach, but for the own one."""
        if cuts is not None:
            gap = np.zeros((len(v), len(used)))
            for j in range(width):
                x = v[:, j, None]
                gap += np.square(np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0.0))
            need = gap <= np.square(reach)[:, None]
            need[np.arange(len(v)), own_of(v)] = False
            return need
        d = _distances(v, held)
        need = np.logical_or.reduceat(np.maximum(d - high, low - d) <= reach[:, None], starts, axis=1)
        need[np.arange(len(d)), bag_of[d.argmin(1)]] = False
        return need

    def own_bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), SLICE):
                batch = whole.slice(a, SLICE)
                bag = own_of(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("v"), pa.array(np.full(len(batch), np.inf)), pa.array(bag)],
                                                 ["tid", "v", "reach", "bag"])

    def other_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), SLICE):
                batch = whole.slice(a, SLICE)
                reach = batch.column("distance").to_numpy() * (1 + _SLACK) + _SLACK
                row, bag = np.nonzero(needed(_matrix(batch.column("v")), reach))
                sent = batch.select(["tid", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(reach[row]), pa.array(bag.astype(np.int32))], ["tid", "v", "reach", "bag"])

    def block_minimum(s: pa.Table, t: pa.Table) -> pa.Table:
        tid, sid = t.column("tid"), s.column("sid")
        if not len(s) or not len(t):
            return pa.table({"tid": tid.slice(0, 0), "sid": sid.slice(0, 0), "distance": pa.array([], pa.float64())})
        s = s.take(pc.sort_indices(sid))
        b, first = np.unique(_matrix(s.column("v")), axis=0, return_index=True)  # copies: smallest id
        order = first.argsort()
        best, dist = _closest(_matrix(t.column("v")), b[order], t.column("reach").to_numpy())
        hit = np.flatnonzero(best >= 0)
        return pa.table({"tid": tid.take(pa.array(hit)), "sid": s.column("sid").take(pa.array(first[order][best[hit]])),
                         "distance": pa.array(dist[hit])})

    visit, found = f"tid {t_type}, v {v_type}, reach double, bag int", f"tid {t_type}, sid {id_type}, distance double"
    size = np.bincount(bag_of, n).astype(int)
    sizes = src.sparkSession.createDataFrame([(int(c), int(b), int(-(-size[b] // block_rows))) for c, b in zip(used, bag_of)],
                                             "cell int, bag int, s_n int")
    keys = ["bag", "sb", "tb"]

    def searched(visits: DataFrame) -> DataFrame:
        """Minimum per target and block pair. Only bags that some target visits are read; the tables of sizes hold at most one row per pivot."""
        need = visits.groupBy("bag").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("t_n"))
        plan = sizes.join(need, "bag")
        left = cells.join(F.broadcast(plan), "cell").select("sid", "v", "bag", F.pmod(F.xxhash64("sid"), "s_n").cast("int").alias("sb"),
                                                            F.explode(F.sequence(F.lit(0), F.col("t_n") - 1)).alias("tb"))
        right = visits.join(F.broadcast(plan.drop("cell").distinct()), "bag").select(
            "tid", "v", "reach", "bag", F.explode(F.sequence(F.lit(0), F.col("s_n") - 1)).alias("sb"),
            F.pmod(F.xxhash64("tid"), "t_n").cast("int").alias("tb"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_minimum, found)

    def least(pairs: DataFrame) -> DataFrame:
        best = F.min(F.struct("distance", "sid")).alias("b")
        return pairs.groupBy("tid").agg(best).select("tid", F.col("b.sid").alias("sid"), F.col("b.distance").alias("distance"))

    near = materialize(least(searched(materialize(tgt.mapInArrow(own_bag, visit)))))
    bounded = tgt.join(near.select("tid", "distance"), "tid")
    far = searched(materialize(bounded.mapInArrow(other_bags, visit)))
    return least(near.unionByName(far)).select(F.col("tid").alias(target_id), F.col("sid").alias("nearest_id"), "distance")
