"""Checks that stop a job, written so that the check rides in the same plan.

``require_rows`` turns a predicate into a filter that raises on the first bad
row. ``refuse_rows`` runs a small job and stops when any offending row exists.
``unique_keys`` sorts by the key once; a following sort-merge join on the same
key reuses that exchange and order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from geotransfer.schemas import FORBIDDEN_PREDICTORS, PROTECTED_STAGES, REPRESENTATIONS, RESPONSE


class GuardError(RuntimeError):
    """A table or schema broke a contract."""


def require_rows(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass rows through; the job fails on a row where ``ok`` is not true."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def refuse_rows(bad: DataFrame, message: str) -> None:
    """Stop when ``bad`` has any row. The message shows the first one."""
    first = bad.limit(1).collect()
    if first:
        raise GuardError(f"{message}: {first[0].asDict()}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with their count (partial counts before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Pass rows through; fail on the second row of any key."""
    w = Window.partitionBy(*keys).orderBy(*keys)
    seen = df.withColumn("_seen", F.row_number().over(w))
    return require_rows(seen, F.col("_seen") == 1, f"duplicate key in {name}").drop("_seen")


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise GuardError(f"{name} lacks columns {lacking}")
    return df


_FORBIDDEN = frozenset(n.casefold() for n in FORBIDDEN_PREDICTORS)


def predictor_faults(features: Iterable[str], schema: T.StructType | None = None) -> list[tuple[str, str]]:
    """(name, what is wrong with it) of the requested predictors, in order. Names are compared folded.

    With a ``schema`` a predictor also has to name exactly one numeric column of it, whatever the case.
    """
    names = [str(f) for f in features]
    keys = [n.strip().casefold() for n in names]
    types: dict[str, list[T.DataType]] = {}
    for f in schema or ():
        types.setdefault(f.name.strip().casefold(), []).append(f.dataType)
    faults = []
    for name, key in zip(names, keys):
        found = types.get(key, [])
        if key in _FORBIDDEN:
            faults.append((name, "carries a label, an id, a place or a quality mark"))
        elif keys.count(key) > 1:
            faults.append((name, "asked for more than once"))
        elif schema is not None and not (len(found) == 1 and isinstance(found[0], T.NumericType)):
            faults.append((name, "is not one numeric column"))
    return faults


def safe_predictors(features: Iterable[str], schema: T.StructType | None = None) -> list[str]:
    """The requested predictors in order; stops on the first that ``predictor_faults`` finds. No Spark job."""
    names = [str(f) for f in features]
    for name, problem in predictor_faults(names, schema):
        raise GuardError(f"predictor refused: {name} {problem}")
    return names


def feature_schema(name: str, features: Iterable[str]) -> list[str]:
    """The exact ordered list of a named feature set, or an error."""
    features = list(features)
    if features != REPRESENTATIONS[name]:
        raise GuardError(f"feature list of {name} differs from its frozen schema")
    return safe_predictors(features)


def select_representation(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Guarded projection: carried columns first, then the features in fixed order."""
    features = feature_schema(name, REPRESENTATIONS[name])
    require_columns(df, [*keep, *features], name)
    return df.select(*keep, *features)


def protected_inputs(stage_inputs: DataFrame, open_stages: DataFrame | None = None) -> DataFrame:
    """Rows of a (stage, table, has_label) register whose stage may not see labels.

    ``open_stages`` (stage) lists stages that may; without it every stage outside the protected set is open.
    """
    labelled = stage_inputs.where("has_label")
    if open_stages is not None:
        return labelled.join(open_stages.select("stage"), "stage", "left_anti").select(*stage_inputs.columns)
    return labelled.where(F.col("stage").isin(sorted(PROTECTED_STAGES)))


def stage_inputs(stage: str, **tables: DataFrame) -> DataFrame:
    """Register of the tables that enter a stage; a table is labelled if a forbidden response column is in it and filled."""
    rows = None
    for name, df in tables.items():
        held = [c for c in df.columns if c.strip().casefold() in _RESPONSES]
        filled = F.max(F.greatest(*[F.col(c).isNotNull() for c in held], F.lit(False))) if held else F.lit(False)
        row = df.agg(F.lit(stage).alias("stage"), F.lit(name).alias("table"), F.coalesce(filled, F.lit(False)).alias("has_label"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


_RESPONSES = frozenset({RESPONSE, f"{RESPONSE}_se"})


def protect_stage(stage: str, **tables: DataFrame) -> None:
    """Stop if a table with labels enters a protected stage."""
    if tables:
        refuse_rows(protected_inputs(stage_inputs(stage, **tables)), "labels reach a stage that has to stay blind")
