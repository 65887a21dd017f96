"""Repeatable sampling by hash order, spatial folds and label draws.

All random order comes from sha256(seed|id), so a draw does not depend on
partitioning, task order or retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from geotransfer.functions.text import hash_key, row_text
from geotransfer.operators.guards import refuse_rows, require_rows
from geotransfer.operators.joins import lookup_join, null_safe_join
from geotransfer.operators.ordering import SMALL_PLAN_BYTES, number_rows, top_per_group
from geotransfer.schemas import FEW_SHOT_BUDGETS, FEW_SHOT_SEEDS, FOLD, SEED
from geotransfer.session import materialize, plan_bytes


def uniform_from_hash(c: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of a sha256 text."""
    return F.conv(F.substring(c, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _reach(k: int, n: Column) -> Column:
    """A bound on the uniform below which the first ``k`` of ``n`` rows lie.

    The expected number of rows below it is k plus twelve standard deviations
    and sixty, so the chance of missing one is below 1e-30; callers still check.
    """
    return F.when(n <= 4 * k, F.lit(1.0)).otherwise((k + 12 * math.sqrt(k) + 60) / n)


def _enough(df: DataFrame, keys: Sequence[str], k: int, n: str) -> DataFrame:
    """Fail when the pre-filter left a group with fewer rows than it must return."""
    left = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_left", left)
    return require_rows(checked, F.col("_left") >= F.least(F.col(n), F.lit(k)),
                        "hash pre-filter was too narrow; use prefilter=False").drop("_left")


def capped_sample(df: DataFrame, strata: Sequence[str], id_col: str, cap: int, seed: int = SEED,
                  rank: str | None = None, prefilter: bool | None = None) -> DataFrame:
    """min(N, cap) rows of each stratum; small strata are kept whole.

    On large inputs the stratum sizes are counted first and rows whose hash is
    too large to be drawn never reach the shuffle, so a stratum with a third of
    all rows sends little more than ``cap`` rows to its task.
    """
    strata, order = list(strata), hash_key(seed, id_col)
    if prefilter is None:
        prefilter = plan_bytes(df) > SMALL_PLAN_BYTES
    if not prefilter:
        return top_per_group(df, strata, [order, F.col(id_col)], cap, rank)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    near = (lookup_join(df.withColumn("_h", order), sizes, strata)
            .where(uniform_from_hash(F.col("_h")) < _reach(cap, F.col("_n"))))
    near = _enough(near, strata, cap, "_n")
    return top_per_group(near, strata, [F.col("_h"), F.col(id_col)], cap, rank).drop("_h", "_n")


def strata_audit(raw: DataFrame, sample: DataFrame, strata: Sequence[str], cap: int) -> DataFrame:
    """Raw and sampled counts per stratum, the share kept and whether it is min(raw, cap)."""
    strata = list(strata)
    both = (raw.select(*strata, F.lit(1).alias("_r"), F.lit(0).alias("_s"))
            .unionByName(sample.select(*strata, F.lit(0).alias("_r"), F.lit(1).alias("_s"))))
    j = both.groupBy(*strata).agg(F.sum("_r").alias("raw_n"), F.sum("_s").alias("sampled_n"))
    return j.withColumns({
        "sampling_fraction": F.try_divide(F.col("sampled_n"), F.col("raw_n")),
        "as_expected": F.col("sampled_n") == F.least(F.col("raw_n"), F.lit(cap))})


def row_cap(df: DataFrame, n: int, id_col: str, seed: int = SEED,
            prefilter: bool | None = None) -> DataFrame:
    """The ``n`` rows that come first in hash order (a bounded top-n, no full sort)."""
    hashed = df.withColumn("_h", hash_key(seed, id_col))
    if prefilter is None:
        prefilter = plan_bytes(df) > SMALL_PLAN_BYTES
    if prefilter:
        total = df.count()
        near = hashed.where(uniform_from_hash(F.col("_h")) < _reach(n, F.lit(total)))
        if near.count() < min(n, total):
            near = hashed
        hashed = near
    return hashed.orderBy("_h", id_col).limit(n).drop("_h")


def hash_share(df: DataFrame, id_col: str, by: Sequence[str], share: float,
               seed: int = SEED) -> DataFrame:
    """Mark a stratified hold-out: the first ``share`` of each class in hash order."""
    ordered = df.withColumn("_h", hash_key(seed, id_col))
    numbered = number_rows(ordered, ["_h", id_col], by, "_no", total="_n")
    return (numbered.withColumn("held_out", F.col("_no") <= F.floor(F.col("_n") * F.lit(share)))
            .drop("_h", "_no", "_n"))


def stratified_folds(df: DataFrame, id_col: str, by: Sequence[str], k: int = 5,
                     seed: int = SEED) -> DataFrame:
    """Shuffled k folds inside each class."""
    numbered = number_rows(df.withColumn("_h", hash_key(seed, id_col)), ["_h", id_col], by, "_no")
    return (numbered.withColumn(FOLD, F.pmod(F.col("_no") - 1, F.lit(k)).cast("int"))
            .drop("_h", "_no"))


def _assign(totals: list[int]):
    """Lightest-fold assignment over one ordered chunk of blocks."""
    k = len(totals)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = list(totals), []
        pdf = pdf.sort_values("_no")
        for n in pdf["n"]:
            fold = min(range(k), key=lambda f: (load[f], f))
            load[fold] += int(n)
            out.append(fold)
        return pdf.assign(**{FOLD: out})

    return run


def greedy_folds(blocks: DataFrame, block: str, n: str, k: int = 5, tie: Column | None = None,
                 chunk_rows: int = 500_000) -> DataFrame:
    """Whole blocks, largest first, each to the lightest fold so far.

    ``blocks`` has one row per block. The rule is sequential, so the ordered
    block list is taken in chunks of bounded size and only the k fold totals
    pass from one chunk to the next.
    """
    tie = hash_key(SEED, block) if tie is None else tie
    listed = blocks.select(F.col(block), F.col(n).cast("long").alias("n"),
                           (-F.col(n)).cast("long").alias("_neg"), tie.alias("_tie"))
    numbered = number_rows(listed, ["_neg", "_tie"], name="_no")
    numbered = numbered.withColumn("_chunk", F.floor((F.col("_no") - 1) / F.lit(chunk_rows)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    schema += f", `{FOLD}` int"
    numbered = materialize(numbered)  # read by every chunk instead of the raw table
    count = numbered.count()
    totals, done = [0] * k, None
    for c in range(max(1, -(-count // chunk_rows))):
        part = (numbered.where(F.col("_chunk") == c).groupBy("_chunk")
                .applyInPandas(_assign(totals), schema))
        done = part if done is None else done.unionByName(part)
        if count > chunk_rows:
            got = {r[0]: r[1] for r in part.groupBy(FOLD).agg(F.sum("n")).collect()}
            totals = [totals[f] + int(got.get(f, 0)) for f in range(k)]
    return done.select(block, F.col("n").alias("sample_n"), FOLD)


def block_folds(df: DataFrame, block: str, k: int = 5, tie: Column | None = None) -> DataFrame:
    """Fold of every block from its row count."""
    blocks = df.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    return greedy_folds(blocks, block, "n", k, tie)


def with_folds(df: DataFrame, folds: DataFrame, block: str) -> DataFrame:
    """Add the fold by block; a block with very many rows stays where its rows are."""
    return lookup_join(df, folds.select(block, FOLD), [block])


def split_blocks(df: DataFrame, block: str, fold: str = FOLD) -> DataFrame:
    """Blocks that sit in more than one fold."""
    pairs = df.select(block, fold).distinct()
    return pairs.groupBy(block).agg(F.count(F.lit(1)).alias("folds")).where("folds > 1")


def outside_fold(df: DataFrame, k: int, fold: str = FOLD) -> DataFrame:
    return df.where(F.col(fold) != k)


def label_draws(df: DataFrame, id_col: str, fold: str = FOLD, folds: Sequence[int] = range(5),
                budgets: Sequence[int] = tuple(FEW_SHOT_BUDGETS),
                seeds: Sequence[int] = tuple(FEW_SHOT_SEEDS), short_pools: str = "stop") -> DataFrame:
    """Nested draws: for each (fold, seed) a prefix of one hash order of the other folds.

    The pool sizes (one row per fold) bound the hash of every row that can be
    drawn, so only about the largest budget's rows per cell leave the map side;
    smaller budgets are prefixes. A budget larger than its pool stops the job, or is left
    out with ``short_pools="omit"``; ``draw_integrity`` reports such cells as absent.
    """
    if short_pools not in ("stop", "omit"):
        raise ValueError("short_pools is 'stop' or 'omit'")
    folds, budgets, seeds = list(folds), sorted(budgets), list(seeds)
    per = df.groupBy(F.col(fold).cast("int").alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = per.agg(F.struct(F.map_from_entries(F.collect_list(F.struct("_own", "_n"))).alias("m"),
                             F.sum("_n").alias("t")).alias("s")).scalar()
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s"))
                                for f in folds for s in seeds]))
    pool = (df.select(F.col(id_col), F.col(fold).cast("int").alias("_own"), sizes.alias("_z"))
            .withColumn("_c", cells).where(F.col("_own") != F.col("_c.f"))
            .select(F.col("_c.f").alias("fold"), F.col("_c.s").alias("seed"), id_col,
                    (F.col("_z.t") - F.coalesce(F.try_element_at("_z.m", F.col("_c.f")), F.lit(0)))
                    .alias("pool_n")))
    if short_pools == "stop":
        pool = require_rows(pool, F.col("pool_n") >= budgets[-1], "a label pool is smaller than the largest budget")
    hashed = pool.withColumn(
        "_h", F.sha2(F.concat_ws("|", F.col("seed"), F.col("fold"), F.col(id_col)), 256))
    near = hashed.where(uniform_from_hash(F.col("_h")) < _reach(budgets[-1], F.col("pool_n")))
    near = _enough(near, ["fold", "seed"], budgets[-1], "pool_n")
    ranked = top_per_group(near, ["fold", "seed"], [F.col("_h"), F.col(id_col)], budgets[-1], "rank")
    budget = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    return (ranked.select("fold", "seed", id_col, "rank", "pool_n", budget)
            .where((F.col("rank") <= F.col("budget")) & (F.col("budget") <= F.col("pool_n")))
            .drop("pool_n"))


def draw_integrity(draws: DataFrame, df: DataFrame, id_col: str, fold: str = FOLD,
                   cells: DataFrame | None = None) -> DataFrame:
    """Per cell: rows drawn, whether that is the budget, rows from the held-out fold.

    ``cells`` (fold, budget, seed) lists the cells that have to exist; an absent one has n = 0.
    """
    own = df.select(id_col, F.col(fold).alias("_own"))
    found = (lookup_join(own, draws, [id_col]).groupBy("fold", "budget", "seed")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col("_own") == F.col("fold")).alias("held_out_n")))
    if cells is not None:
        found = null_safe_join(cells.select("fold", "budget", "seed"), found, ["fold", "budget", "seed"], "left").na.fill(
            0, ["n", "held_out_n"])
    return found.withColumn("exact", F.col("n") == F.col("budget"))


def draw_cells(spark, folds: Sequence[int] = range(5), budgets: Sequence[int] = tuple(FEW_SHOT_BUDGETS),
               seeds: Sequence[int] = tuple(FEW_SHOT_SEEDS)) -> DataFrame:
    return spark.createDataFrame([(f, b, s) for f in folds for b in budgets for s in seeds],
                                 "fold int, budget int, seed int")


def require_draws(draws: DataFrame, df: DataFrame, id_col: str, fold: str = FOLD) -> None:
    bad = draw_integrity(draws, df, id_col, fold).where(~F.col("exact") | (F.col("held_out_n") > 0))
    refuse_rows(bad, "label draw broke its contract")


def random_points(spark, n: int, box: tuple[float, float, float, float], seed: int) -> DataFrame:
    """Seeded points in a bounding box; the polygon test narrows them to an area."""
    x0, y0, x1, y1 = box
    ids = spark.range(n)
    u = uniform_from_hash(hash_key(f"{seed}|x", "id"))
    v = uniform_from_hash(hash_key(f"{seed}|y", "id"))
    return ids.select(F.col("id").alias("point_id"), (F.lit(x0) + u * F.lit(x1 - x0)).alias("lon"),
                      (F.lit(y0) + v * F.lit(y1 - y0)).alias("lat"))


def keep_latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Upsert rule: the newest row of each key (partial max before the shuffle).

    Rows of equal version are ordered by a hash of their content, so the result is settled.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(F.col(version), F.sha2(row_text(rest), 256))).alias("_r")
    return df.groupBy(*keys).agg(top).select(*keys, "_r.*")


def chunk_numbers(df: DataFrame, year: str, order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size chunks inside each year, in key order."""
    numbered = number_rows(df, order, [year], "_no")
    return (numbered.withColumn("chunk", F.floor((F.col("_no") - 1) / F.lit(size)).cast("int"))
            .drop("_no"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 3) -> DataFrame:
    return top_per_group(df, by, [F.col(c) for c in order], n)

