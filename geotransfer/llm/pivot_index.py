"""Exact top-k inner products through pivots and distance annuli.

Component x becomes floor(256 x). Padding every vector with sqrt(M^2 - |v|^2), M the largest
norm, makes a larger inner product with a query the same as a smaller distance to it. Rows are
keyed by their nearest pivot and the distance to it; each pivot's rows are cut into annuli
(rings) by quantiles of that distance. A query first scans the ring that may lie closest, which
gives its k-th best distance so far. By the triangle inequality a ring with distances [a, b]
to a pivot at distance d from the query holds nothing closer than max(a - d, d - b), so the
second round scans only rings whose bound does not pass the k-th best distance. Inside a ring
rows are sorted by distance and the same bound cuts the scanned stretch.

Pivots come from a bounded sample. Rings above ``block`` rows are dealt into blocks, and so are
the queries of a ring: a task meets at most about ``block`` rows and ``block`` queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from geotransfer.llm.common import mapped
from geotransfer.session import materialize

SCALE = 256.0
SAMPLE = 2_048  # vectors that pivots are chosen from
SLACK = 1e-6  # relative, for distances kept as doubles


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``tag`` and ``v``; vectors that are null or hold a null or non-finite component go, null ids too."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double")))
    return (df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), finite.alias("ok"))
            .where("id IS NOT NULL AND ok").select("id", F.xxhash64("v").alias("tag"), "v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest-first choice and a few rounds of averaging, on the sample only."""
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    pivots = sample[picked]
    for _ in range(4):
        owner = _distances(sample, pivots).argmin(1)
        pivots = np.array([sample[owner == k].mean(0) if (owner == k).any() else p for k, p in enumerate(pivots)])
    return pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter vectors are padded with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py():column.offsets[-1].as_py()].astype(np.float64)
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _key_task(pivots: np.ndarray, width: int, norm2: float):
    def task(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            extra = np.sqrt(np.maximum(norm2 - (x ** 2).sum(1), 0))
            d = _distances(np.column_stack([x, extra]), pivots)
            pivot = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])],
                [*batch.schema.names, "pivot", "dist"])
    return task


class Rings:
    """Bounds of all rings; at most pivots x rings rows."""

    def __init__(self, rows, pivots: np.ndarray, block: int):
        self.pivot = np.array([r["pivot"] for r in rows], np.int32)
        self.ring = np.array([r["ring"] for r in rows], np.int32)
        self.low = np.array([r["low"] for r in rows])
        self.high = np.array([r["high"] for r in rows])
        self.blocks = np.array([-(-r["n"] // block) for r in rows], np.int32)
        self.pivots = pivots

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each query to the ring's pivot, and the least distance to a row of the ring."""
        d = _distances(np.column_stack([queries, np.zeros(len(queries))]), self.pivots)[:, self.pivot]
        return d, np.maximum(np.maximum(self.low - d, d - self.high), 0)


def _route_task(rings: Rings, width: int, norm2: float, first: bool):
    """Rings a query has to scan: the closest one, or all others within its k-th best distance."""
    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"), width)
            d, bound = rings.bounds(q)
            home = np.lexsort((np.abs(d - (rings.low + rings.high) / 2), bound), axis=1)[:, 0]
            at_home = np.arange(len(rings.ring))[None, :] == home[:, None]
            reach = np.full(len(q), np.inf)
            if first:
                want = at_home
            else:
                score = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.sqrt(np.maximum((q ** 2).sum(1) + norm2 - 2 * score, 0))
                reach = np.where(np.isnan(score), np.inf, reach * (1 + SLACK) + SLACK)
                want = ~at_home & (bound <= reach[:, None])
            row, ring = np.nonzero(want)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("tag").take(at), batch.column("v").take(at),
                 pa.array(rings.pivot[ring]), pa.array(rings.ring[ring]), pa.array(d[row, ring]), pa.array(reach[row]),
                 pa.array(rings.blocks[ring])], ["id", "tag", "v", "pivot", "ring", "qdist", "reach", "blocks"])
    return task


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    if top >= 2 ** 63:
        raise ValueError("inner products do not fit 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def _scan_task(k: int, width: int, names: list[str]):
    def scan(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in zip(names, [queries.schema.field("id").type, pa.int64(),
                                                                      queries.schema.field("id").type, pa.int64()])})
        if not queries.num_rows or not rows.num_rows:
            return empty
        rows = rows.sort_by("dist").combine_chunks()
        queries = queries.sort_by("qdist").combine_chunks()
        x, q = _matrix(rows.column("v").chunk(0), width), _matrix(queries.column("v").chunk(0), width)
        dist, qd, reach = (t.column(c).to_numpy() for t, c in ((rows, "dist"), (queries, "qdist"), (queries, "reach")))
        x_id, q_id = rows.column("id").to_numpy(), queries.column("id").to_numpy()
        out_q, out_x, out_s = [], [], []
        for a in range(0, len(q), 256):
            b = min(a + 256, len(q))
            lo = np.searchsorted(dist, (qd[a:b] - reach[a:b]).min() - SLACK)
            hi = np.searchsorted(dist, (qd[a:b] + reach[a:b]).max() + SLACK, "right")
            if lo >= hi:
                continue
            s, ids = _scores(q[a:b], x[lo:hi]), x_id[lo:hi]
            for r in range(b - a):
                can = np.flatnonzero(ids != q_id[a + r])
                if len(can) > k:
                    least = np.partition(s[r, can], len(can) - k)[len(can) - k]
                    can = can[s[r, can] >= least]
                best = can[np.lexsort((ids[can], -s[r, can]))][:k]
                out_q += [a + r] * len(best)
                out_x.append(ids[best])
                out_s.append(s[r, best])
        if not out_q:
            return empty
        at = pa.array(out_q)
        id_type = queries.schema.field("id").type
        return pa.table({names[0]: queries.column("id").take(at), names[1]: queries.column("tag").take(at),
                         names[2]: pa.array(np.concatenate(out_x), id_type), names[3]: pa.array(np.concatenate(out_s))})
    return scan


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          pivots: int = 24, rings: int = 8, block: int = 8_192) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest inner products of each query with other ids.

    ``is_query`` is an expression over ``id``. Ties go to the smaller id. All rows with the
    query's own id are left out, so a repeated id never meets itself; repeated rows are
    candidates each, and equal query rows (id and vector) are one query. Vectors that are null
    or hold null or non-finite components, and null ids, take no part. Shorter vectors count as
    padded with zeros. Without rows or queries the result is empty.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, id_col, vector_col))
    id_type = vectors.schema["id"].dataType.simpleString()
    shape = vectors.agg(F.max(F.size("v")).alias("width"),
                        F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("norm2")).first()
    if shape["width"] is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score bigint")
    width, norm2 = max(shape["width"], 1), float(shape["norm2"])
    some = vectors.orderBy(F.xxhash64("id"), "tag").limit(SAMPLE).toArrow()
    base = _matrix(some.column("v").combine_chunks() if some.column("v").num_chunks > 1 else some.column("v").chunk(0), width)
    base = np.column_stack([base, np.sqrt(np.maximum(norm2 - (base ** 2).sum(1), 0))])
    centres = choose_pivots(base, pivots)
    keyed_rows = mapped(vectors, _key_task(centres, width, norm2),
                        f"id {id_type}, tag bigint, v array<bigint>, pivot int, dist double")
    stored = materialize(keyed_rows)
    cuts = {r["pivot"]: r["cuts"] for r in stored.groupBy("pivot").agg(
        F.percentile_approx("dist", [j / rings for j in range(1, rings)], 1000).alias("cuts")).collect()}
    table = F.create_map(*[x for p, c in cuts.items() for x in (F.lit(p), F.array(*[F.lit(float(y)) for y in c]))])
    ringed = stored.withColumn("ring", F.size(F.filter(table[F.col("pivot")], lambda c: c < F.col("dist"))).cast("int"))
    bounds = Rings(ringed.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"),
                                                       F.count("*").alias("n")).collect(), centres, block)
    sizes = spark.createDataFrame(list(zip(bounds.pivot.tolist(), bounds.ring.tolist(), bounds.blocks.tolist())),
                                  "pivot int, ring int, blocks int")
    blocked = ringed.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "tag"), F.col("blocks")).cast("int"))
    queries = materialize(vectors.where(is_query).dropDuplicates(["id", "tag"]))
    route = f"id {id_type}, tag bigint, v array<bigint>, pivot int, ring int, qdist double, reach double, blocks int"
    names = ["query_id", "query_tag", "vec_id", "score"]

    def scanned(routed: DataFrame) -> DataFrame:
        routed = materialize(routed)
        need = routed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("lanes"))
        to = (routed.join(F.broadcast(need), ["pivot", "ring"])
              .withColumn("lane", F.pmod(F.xxhash64("id", "tag"), F.col("lanes")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("pivot", "ring", "block", "lane", "id", "tag", "v", "qdist", "reach"))
        rows = (blocked.join(F.broadcast(need), ["pivot", "ring"])
                .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
                .select("pivot", "ring", "block", "lane", "id", "v", "dist"))
        keys = ["pivot", "ring", "block", "lane"]
        return to.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
            _scan_task(k, width, names), f"query_id {id_type}, query_tag bigint, vec_id {id_type}, score bigint")

    order = Window.partitionBy("query_id", "query_tag").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = materialize(best(scanned(mapped(queries, _route_task(bounds, width, norm2, True), route))))
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_tag").alias("tag"),
                                                F.col("score").cast("double").alias("kth"))
    rest = queries.join(kth, ["id", "tag"], "left").select("id", "tag", "v", "kth")
    far = scanned(mapped(rest, _route_task(bounds, width, norm2, False), route))
    return best(near.drop("rank").unionByName(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                                                           "score")
