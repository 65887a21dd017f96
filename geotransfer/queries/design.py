"""Samples, folds and label draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.functions.text import hash_key
from geotransfer.operators import sampling, stats
from geotransfer.queries.registry import query, rounded, stored_once, view, with_views
from geotransfer.schemas import FEW_SHOT_BUDGETS
from geotransfer.session import materialize

CAP = 30

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY block, year
    ORDER BY sha256(concat('42|', shot_number)), shot_number) AS k FROM foot)"""


def sample(spark, sf, cap=CAP):
    return sampling.capped_sample(view(spark, sf, "foot"), ["block", "year"], "shot_number", cap)


@query("capped_sample", "J2 J1 E1 F3", with_views("foot", more=_RANKED) + f"""
    SELECT shot_number, block, year FROM ranked WHERE k <= {CAP}""")
def capped_sample(spark, sf):
    return sample(spark, sf).select("shot_number", "block", "year")


@query("nested_subsample", "J3 E1", with_views("foot", more=_RANKED) + """
    SELECT shot_number, block, year, k <= 10 AS in_development FROM ranked WHERE k <= 30""")
def nested_subsample(spark, sf):
    s = sampling.capped_sample(view(spark, sf, "foot"), ["block", "year"], "shot_number", CAP, rank="k")
    return s.select("shot_number", "block", "year", (F.col("k") <= 10).alias("in_development"))


@query("strata_audit", "D12 J2", with_views("foot") + f"""
    SELECT block, year, count(*) AS raw_n, least(count(*), {CAP}) AS sampled_n,
           round(least(count(*), {CAP}) / count(*), 12) AS sampling_fraction, true AS as_expected
    FROM foot GROUP BY ALL""")
def strata_audit(spark, sf):
    a = sampling.strata_audit(view(spark, sf, "foot"), sample(spark, sf), ["block", "year"], CAP)
    return a.withColumn("sampling_fraction", F.round("sampling_fraction", 12))


def _side(name, src):
    return f"""{name} AS (SELECT year, count(agbd) AS n, avg(agbd) AS mean, stddev_pop(agbd) AS sd,
        quantile_cont(agbd, 0.25) AS p25, quantile_cont(agbd, 0.5) AS p50, quantile_cont(agbd, 0.75) AS p75
        FROM {src} GROUP BY year)"""


@query("sample_distortion", "D13 D6", with_views("foot", more=_RANKED + f", smp AS (SELECT * FROM ranked WHERE k <= 10), "
       + _side("s", "smp") + ", " + _side("r", "foot") + """,
    m AS (SELECT year, r.n AS raw_n, s.n AS sampled_n, (s.mean - r.mean) / r.sd AS smd,
          abs(s.p50 - r.p50) / (r.p75 - r.p25) AS sh FROM r JOIN s USING (year))""") + """
    SELECT year, raw_n, sampled_n, round(smd, 6) AS smd, round(sh, 6) AS median_shift_over_raw_iqr,
           CASE WHEN abs(smd) > 0.1 THEN 'FAIL' WHEN sh > 0.1 THEN 'PASS WITH DISTRIBUTION WARNING' ELSE 'PASS' END
           AS audit_status FROM m""")
def sample_distortion(spark, sf):
    d = stats.distortion(sample(spark, sf, 10), view(spark, sf, "foot"), "agbd", ["year"])
    return d.select("year", "raw_n", "sampled_n", rounded("smd"), rounded("median_shift_over_raw_iqr"),
                    "audit_status")


@query("row_cap", "F5", with_views("foot") + """
    SELECT shot_number FROM foot ORDER BY sha256(concat('42|', shot_number)), shot_number LIMIT 1000""")
def row_cap(spark, sf):
    return sampling.row_cap(view(spark, sf, "foot"), 1000, "shot_number").select("shot_number")


def _greedy(order):
    return f"""
    sized AS (SELECT block, count(*) AS n FROM foot GROUP BY block),
    listed AS (SELECT *, row_number() OVER (ORDER BY n DESC, {order}) AS i FROM sized),
    walk(i, block, n, spatial_fold, load) AS (
        SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), -1, [0::BIGINT, 0, 0, 0, 0]
        UNION ALL
        SELECT i, block, n, pick - 1, [CASE WHEN pick = 1 THEN load[1] + n ELSE load[1] END,
               CASE WHEN pick = 2 THEN load[2] + n ELSE load[2] END, CASE WHEN pick = 3 THEN load[3] + n ELSE load[3] END,
               CASE WHEN pick = 4 THEN load[4] + n ELSE load[4] END, CASE WHEN pick = 5 THEN load[5] + n ELSE load[5] END]
        FROM (SELECT l.i, l.block, l.n, w.load, CAST(list_position(w.load, list_min(w.load)) AS INT) AS pick
              FROM walk w JOIN listed l ON l.i = w.i + 1))"""


def _with_recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_SHA = "sha256(concat('42|', block))"


@query("greedy_folds", "J5 F2", _with_recursive(with_views("foot", more=_greedy(_SHA)))
       + "SELECT block, n AS sample_n, spatial_fold FROM walk WHERE i > 0")
def greedy_folds(spark, sf):
    return sampling.block_folds(view(spark, sf, "foot"), "block")


@query("group_kfold", "J4", _with_recursive(with_views("foot", more=_greedy("CAST(substr(block, 2) AS INT) DESC")))
       + "SELECT block, n AS sample_n, spatial_fold FROM walk WHERE i > 0")
def group_kfold(spark, sf):
    tie = F.lpad((F.lit(999_999) - F.substring("block", 2, 9).cast("int")).cast("string"), 9, "0")
    return sampling.block_folds(view(spark, sf, "foot"), "block", tie=tie)


@query("fold_totals", "J4 J9 D15", _with_recursive(with_views("foot", more=_greedy(_SHA))) + """
    SELECT w.spatial_fold, count(*) AS n, count(DISTINCT f.block) AS blocks, CAST(0 AS BIGINT) AS split_blocks
    FROM foot f JOIN walk w ON f.block = w.block GROUP BY 1""")
def fold_totals(spark, sf):
    foot = view(spark, sf, "foot").select("shot_number", "block")
    folded = sampling.with_folds(foot, sampling.block_folds(foot, "block"), "block")
    split = sampling.split_blocks(folded, "block").agg(F.count(F.lit(1))).scalar()
    return (folded.groupBy("spatial_fold").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_distinct("block").alias("blocks"))
            .withColumn("split_blocks", split))


@query("split_block_check", "D15", with_views("foot") + """
    SELECT block, count(DISTINCT o_custkey % 7) AS folds FROM foot GROUP BY block HAVING count(DISTINCT o_custkey % 7) > 1""")
def split_block_check(spark, sf):
    foot = view(spark, sf, "foot").withColumn("spatial_fold", F.col("o_custkey") % 7)
    return sampling.split_blocks(foot, "block")


_BUDGETS = ", ".join(f"({b})" for b in FEW_SHOT_BUDGETS)
DRAWS = f"""
    cells AS (SELECT f.fold, s.seed FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f, (SELECT unnest([42, 43, 44]) AS seed) s),
    pool AS (SELECT c.fold, c.seed, shot_number, row_number() OVER (PARTITION BY c.fold, c.seed
             ORDER BY sha256(concat_ws('|', c.seed, c.fold, shot_number)), shot_number) AS rank,
             count(*) OVER (PARTITION BY c.fold, c.seed) AS size
             FROM foot JOIN cells c ON foot.fold <> c.fold),
    draws AS (SELECT fold, seed, budget, shot_number, rank FROM pool, (VALUES {_BUDGETS}) b(budget)
              WHERE rank <= budget AND budget <= size)"""


def _drawn(spark, sf, budgets=tuple(FEW_SHOT_BUDGETS)):
    pool = view(spark, sf, "foot").select("shot_number", "fold")
    # The small test tables have fewer rows than the largest budgets; draw_integrity lists the absent cells.
    return sampling.label_draws(pool, "shot_number", "fold", budgets=budgets, short_pools="omit")


def draws_of(spark, sf):
    """The frozen draws: stored once, so that every study of a session reads the same artefact."""
    return stored_once(spark, ("draws", sf), lambda: materialize(_drawn(spark, sf)))


@query("label_draws", "J6", with_views("foot", more=DRAWS) + """
    SELECT CAST(fold AS INT) AS fold, CAST(seed AS INT) AS seed, CAST(budget AS INT) AS budget, shot_number FROM draws""")
def label_draws(spark, sf):
    return _drawn(spark, sf).select("fold", "seed", "budget", "shot_number")


@query("draw_integrity", "J7", with_views("foot", more=DRAWS) + """
    SELECT CAST(c.fold AS INT) AS fold, CAST(c.seed AS INT) AS seed, CAST(b.budget AS INT) AS budget, count(d.shot_number) AS n,
           count(*) FILTER (WHERE f.fold = c.fold) AS held_out_n, count(d.shot_number) = b.budget AS exact
    FROM cells c CROSS JOIN (VALUES """ + _BUDGETS + """) b(budget)
    LEFT JOIN draws d ON d.fold = c.fold AND d.seed = c.seed AND d.budget = b.budget
    LEFT JOIN foot f ON f.shot_number = d.shot_number GROUP BY c.fold, c.seed, b.budget""")
def draw_integrity(spark, sf):
    """Every cell of the design, absent ones with no rows."""
    return sampling.draw_integrity(draws_of(spark, sf), view(spark, sf, "foot"), "shot_number", "fold",
                                   sampling.draw_cells(spark))


@query("holdout_split", "J10", with_views("foot") + """
    SELECT domain AS "domain", shot_number, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('42|', shot_number)), shot_number)
             <= floor(count(*) OVER (PARTITION BY domain) * 0.25) AS held_out FROM foot""")
def holdout_split(spark, sf):
    foot = view(spark, sf, "foot").select("domain", "shot_number")
    return sampling.hash_share(foot, "shot_number", ["domain"], 0.25)


@query("stratified_folds", "J11", with_views("foot") + """
    SELECT domain AS "domain", shot_number, CAST((row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('42|', shot_number)),
             shot_number) - 1) % 5 AS INT) AS spatial_fold FROM foot""")
def stratified_folds(spark, sf):
    foot = view(spark, sf, "foot").select("domain", "shot_number")
    return sampling.stratified_folds(foot, "shot_number", ["domain"])


@query("outside_fold", "J9", with_views("foot") + "SELECT fold, count(*) AS n FROM foot WHERE fold <> 2 GROUP BY fold")
def outside_fold(spark, sf):
    return (sampling.outside_fold(view(spark, sf, "foot"), 2, "fold").groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n")))


@query("hash_order", "J1", with_views("foot") + """
    SELECT shot_number, round(('0x' || substr(sha256(concat('7|', shot_number)), 1, 13))::BIGINT / 4503599627370496e0, 9) AS u
    FROM foot""")
def hash_order(spark, sf):
    u = sampling.uniform_from_hash(hash_key(7, "shot_number"))
    return view(spark, sf, "foot").select("shot_number", rounded(u, 9, "u"))
