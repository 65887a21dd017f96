"""Separability, projection and distance diagnostics between two domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geotransfer.operators.nearest import nearest_source
from geotransfer.operators.ordering import average_ranks
from geotransfer.operators.quantiles import quantiles
from geotransfer.operators.sampling import row_cap, stratified_folds
from geotransfer.operators.stats import auroc, spearman
from geotransfer.plans import logistic
from geotransfer.plans.moments import grouped_moments
from geotransfer.schemas import FOLD
from geotransfer.session import materialize


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "A") -> DataFrame:
    """An array column as numbered scalar columns (the wide form of an embedding)."""
    return df.select("*", *[F.col(vector)[i].cast("double").alias(f"{prefix}{i:02d}")
                            for i in range(size)]).drop(vector)


def balanced(df: DataFrame, domain: str, source: str, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows of each side in hash order."""
    a = row_cap(df.where(F.col(domain) == source), n, id_col)
    return a.unionByName(row_cap(df.where(F.col(domain) != source), n, id_col))


def folded(df: DataFrame, domain: str, source: str, id_col: str, folds: int = 5) -> DataFrame:
    """``df`` with a ``label`` (1: not the source) and folds inside each side, stored. They do not depend on the features."""
    marked = df.withColumn("label", (F.col(domain) != source).cast("double"))
    return materialize(stratified_folds(marked, id_col, ["label"], folds))


def domain_scores(df: DataFrame, features: Sequence[str], domain: str, source: str, id_col: str,
                  folds: int = 5, c: float = 1.0, fit_rows: int | None = None) -> DataFrame:
    """Cross-validated probability of being a target row (standardised logistic model).

    All folds are fitted together by Newton steps (``logistic``). ``fit_rows`` bounds the rows of
    each side that they are fitted on; every row is scored. A table that is ``folded`` keeps its folds.
    """
    data = df if {"label", FOLD} <= set(df.columns) else folded(df, domain, source, id_col, folds)
    train = data if fit_rows is None else materialize(balanced(data, domain, source, id_col, fit_rows))
    scored = logistic.held_out(data, logistic.fit_folds(train, features, "label", FOLD, c))
    return scored.select(id_col, domain, "label", "score")


def separability(scores: DataFrame) -> DataFrame:
    return auroc(scores, "score", F.col("label") == 1.0)


def source_pca(df: DataFrame, features: Sequence[str], domain: str, source: str, id_col: str,
               k: int) -> tuple[DataFrame, list[float]]:
    """Scores on components fitted on standardised source rows, and their shares of variance.

    The components follow from the source's packed moments (one scan); a direction's sign is free.
    """
    cols = list(features)
    m = grouped_moments(df.where(F.col(domain) == source), cols, domain)[source]
    vectors, shares = m.components(k)
    weights = vectors / m.sd()[:, None]
    z = F.array(*[F.col(c).cast("double") - F.lit(float(a)) for c, a in zip(cols, m.mean)])
    pc = F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights.T]), lambda w: F.aggregate(
        F.zip_with(w, F.col("_z"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    out = df.select(id_col, domain, z.alias("_z")).select(id_col, domain, pc.alias("pc"))
    return out, [float(v) for v in shares]


def ranked_errors(df: DataFrame, domain: str, source: str, id_col: str, y: str, p: str) -> DataFrame:
    """``id_col``, ``error`` and its average rank (``error_rank``, null without an error) of every target row, stored. They do not
    depend on the features."""
    error = df.where(F.col(domain) != source).select(id_col, F.abs(F.col(y) - F.col(p)).cast("double").alias("error"))
    known = F.col("error").isNotNull() & ~F.isnan("error")
    rest = error.where(~known).withColumn("error_rank", F.lit(None).cast("double"))
    return materialize(average_ranks(error.where(known), [], "error", "error_rank").unionByName(rest))


def shift_row(df: DataFrame, features: Sequence[str], domain: str, source: str, id_col: str, y: str, p: str,
              components: int = 12, fit_rows: int | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One feature set's row of the domain-shift table: AUROC, PCA distance, variance kept, and the rank
    correlation of distance with the target's absolute error, its p value and the MAE.

    Several sets share their ``folded`` table and their ``errors`` (``ranked_errors``)."""
    score = separability(domain_scores(df, features, domain, source, id_col, fit_rows=fit_rows))
    near, kept = projected_distance(df, features, domain, source, id_col, components)
    both = materialize(near.join(ranked_errors(df, domain, source, id_col, y, p) if errors is None else errors, id_col))
    rho = spearman(both, "distance", "error", y_rank="error_rank")
    middle = quantiles(both, [], "distance", {"distance_median": 0.5}).scalar()
    known = both.agg(F.avg("distance").alias("distance_mean"), middle.alias("distance_median"), F.avg("error").alias("target_mae"))
    for part in (rho, known):
        one = part.select(F.struct(*part.columns).alias("s")).scalar()
        score = score.withColumns({c: one[c] for c in part.columns})
    return score.withColumn("variance_fraction", F.lit(kept))


def projected_distance(df: DataFrame, features: Sequence[str], domain: str, source: str,
                       id_col: str, components: int = 12) -> tuple[DataFrame, float]:
    """Nearest source distance of every target row in the source PCA space."""
    k = min(components, len(features))
    scores, variance = source_pca(df, features, domain, source, id_col, k)
    near = nearest_source(scores.where(F.col(domain) == source),
                          scores.where(F.col(domain) != source), id_col, id_col, "pc")
    return near, sum(variance)
