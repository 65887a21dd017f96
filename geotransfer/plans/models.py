"""Learners on Spark MLlib: candidate registry, assembling, linear models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotransfer.operators.guards import safe_predictors
from geotransfer.plans.moments import Moments, grouped_moments, total
from geotransfer.schemas import RESPONSE, SEED
from geotransfer.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Profile:
    """Size of the learners. The defaults are the full protocol."""

    forest_trees: int = 350
    boost_rounds: int = 700
    forest_depth: int = 30
    max_bins: int = 256
    depth_limit: int = 30


FULL = Profile()

CANDIDATES = [("random_forest", "rf_sqrt"), ("random_forest", "rf_half"),
              ("boosted_trees", "gbt_depth6"), ("boosted_trees", "gbt_depth8")]


def _forest(share: str, p: Profile, seed: int):
    return RandomForestRegressor(labelCol=RESPONSE, numTrees=p.forest_trees, minInstancesPerNode=5,
                                 featureSubsetStrategy=share, maxBins=p.max_bins,
                                 maxDepth=min(p.forest_depth, p.depth_limit), seed=seed)


def _boost(depth: int, leaf: int, p: Profile, seed: int):
    return GBTRegressor(labelCol=RESPONSE, maxIter=p.boost_rounds, stepSize=0.05,
                        maxDepth=min(depth, p.depth_limit), minInstancesPerNode=leaf,
                        subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=p.max_bins,
                        checkpointInterval=20, seed=seed)


BUILDERS = {
    ("random_forest", "rf_sqrt"): lambda p, s: _forest("sqrt", p, s),
    ("random_forest", "rf_half"): lambda p, s: _forest("0.5", p, s),
    ("boosted_trees", "gbt_depth6"): lambda p, s: _boost(6, 5, p, s),
    ("boosted_trees", "gbt_depth8"): lambda p, s: _boost(8, 10, p, s),
}


def build(family: str, config: str, profile: Profile = FULL, seed: int = SEED):
    ensure_checkpoint_dir(SparkSession.active())  # hundreds of boosting rounds would else grow one lineage
    return BUILDERS[(family, config)](profile, seed)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Guarded feature vector; a missing value is an error, not a silent zero."""
    cols = safe_predictors(features)
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights):
            out = out + F.lit(w) * F.col(c)
        return out


def linear_fit(features: Sequence[str], moments: Moments, alpha: float) -> LinearFit:
    """Ridge on standardised features from moments whose last column is the response."""
    weights, intercept = moments.ridge(alpha)
    return LinearFit(tuple(features), tuple(map(float, weights)), intercept)


def fit_ridge(df: DataFrame, features: Sequence[str], y: str = RESPONSE, alpha: float = 10.0) -> LinearFit:
    """Ridge on standardised features by the normal equations (one distributed pass).

    The penalty is alpha times the squared weights against the summed squared error.
    """
    cols = safe_predictors(features)
    whole = total(grouped_moments(df.withColumn("_all", F.lit(0)), [*cols, y], "_all"))
    return linear_fit(cols, whole, alpha)
