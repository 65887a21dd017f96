"""Query registry and the derived views shared by Spark and the SQL check.

The test tables hold no footprints, so the views derive them from the whole of
``orders``, ``lineitem``, ``events`` and so on by plain arithmetic. One text
defines each view for both engines.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotransfer.session import checkpoint_root


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, oracle: str | None = None):
    def register(fn):
        REGISTRY[name] = Query(name, tuple(operators.split()), fn, oracle)
        return fn
    return register


VIEWS = {
    # Clean footprints of two domains with a formula prediction.
    "foot": """
        SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority,
               CAST(100000000000000000 + o_orderkey AS STRING) AS shot_number,
               CAST(year(o_orderdate) AS INT) AS year,
               CASE WHEN year(o_orderdate) < 1999 THEN 'source' ELSE 'target' END AS domain,
               concat('b', CAST(o_custkey % 50 AS STRING)) AS block,
               CAST(o_custkey % 5 AS INT) AS fold,
               -88e0 + (o_custkey % 1000) / 125e0 AS lon,
               30e0 + (o_orderkey % 997) / 166e0 AS lat,
               118e0 + (o_custkey % 1000) / 1100e0 AS tlon,
               29e0 + (o_orderkey % 997) / 1100e0 AS tlat,
               o_totalprice / 1000e0 AS agbd,
               60e0 + 7e-1 * (o_totalprice / 1000e0) + ((o_orderkey * 7919) % 1000) / 25e0 - 20e0
                   AS prediction,
               ((o_orderkey * 31) % 1013) / 1013e0 AS f1,
               ((o_custkey * 17) % 509) / 509e0 + o_totalprice / 900000e0 AS f2
        FROM {orders}""",
    # Raw footprints with quality flags and missing values.
    "raw": """
        SELECT CAST(100000000000000000 + o_orderkey AS STRING) AS shot_number, o_orderkey,
               CAST(year(o_orderdate) AS INT) AS year,
               concat('g', CAST(o_custkey % 20 AS STRING)) AS granule,
               -88e0 + (o_custkey % 1000) / 125e0 AS lon,
               30e0 + (o_orderkey % 997) / 166e0 AS lat,
               CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS algorithm_run_flag,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS l4_quality_flag,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END
                   AS degrade_flag,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_totalprice / 1000e0 - 20e0 END AS agbd,
               (o_custkey % 20 - 1) / 10e0 AS agbd_se
        FROM {orders}""",
    # Radar pixels sampled at footprints.
    "radar": """
        SELECT CAST(100000000000000000 + o_orderkey AS STRING) AS shot_number,
               CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_orderpriority AS priority,
               CAST((o_orderkey * 37) % 9000 - 100 AS DOUBLE) AS HH,
               CAST((o_orderkey * 53) % 5000 - 50 AS DOUBLE) AS HV,
               CAST(CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 50 WHEN 3 THEN 42
                    WHEN 4 THEN 100 ELSE 255 END AS INT) AS palsar_qa,
               1546300800000 + (o_orderkey % 700) * 86400000 - CASE WHEN o_orderkey % 17 = 0
                    THEN 1700000000000 ELSE 0 END AS palsar_epoch
        FROM {orders}""",
    # Optical observations (integer reflectance with class and bit mask).
    "optical": """
        SELECT l_orderkey, CAST(l_partkey % 400 AS BIGINT) AS px, CAST(l_suppkey % 10 AS BIGINT) AS py,
               CAST(year(l_shipdate) AS INT) AS year,
               CAST(l_linenumber + l_partkey % 7 AS INT) AS SCL,
               CAST((l_orderkey % 6) * 512 AS INT) AS QA60,
               CAST(l_partkey % 1500 + 100 AS DOUBLE) AS B2, CAST(l_orderkey % 1700 + 120 AS DOUBLE) AS B3,
               CAST(l_orderkey % 1900 + 90 AS DOUBLE) AS B4, CAST(l_suppkey % 90 + 700 AS DOUBLE) AS B5,
               l_quantity * 60e0 + 300e0 AS B6, l_quantity * 70e0 + 310e0 AS B7,
               CAST(l_partkey % 4000 + 800 AS DOUBLE) AS B8, l_quantity * 80e0 + 500e0 AS B8A,
               CAST(l_orderkey % 3000 + 400 AS DOUBLE) AS B11, CAST(l_suppkey * 13 % 2000 + 200 AS DOUBLE) AS B12
        FROM {lineitem}""",
    # Timed observations with class codes.
    "obs": """
        SELECT event_id, ts, user_id, event_type, value, props,
               CASE WHEN event_id % 3 = 0 THEN 'target' ELSE 'source' END AS domain,
               CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 255 WHEN 'error' THEN 50
                    WHEN 'purchase' THEN 100 ELSE 42 END AS INT) AS qa
        FROM {events}""",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf, t) for t in used})


def with_views(*names: str, more: str = "") -> str:
    """WITH clause holding the named views, then any further CTEs."""
    parts = []
    for n in names:
        text = VIEWS[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({text})")
    if more:
        parts.append(more)
    return "WITH " + ", ".join(parts) + " "


def rounded(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or (c if isinstance(c, str) else "value"))


def select_rounded(df: DataFrame, keep: Sequence[str], values: Sequence[str],
                   digits: int = 6) -> DataFrame:
    return df.select(*keep, *[rounded(v, digits) for v in values])


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the checkpoint folder for queries that write and read back."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")


_STORED: dict[tuple, DataFrame | dict[str, DataFrame]] = {}


def stored_once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame | dict[str, DataFrame]]):
    """Stored tables that several queries read, made once per session; made again if their files are gone."""
    key = spark.sparkContext.applicationId, *key
    held = _STORED.get(key)
    if held is not None:
        try:
            for df in held.values() if isinstance(held, dict) else [held]:
                df.limit(1).collect()
            return held
        except Exception as gone:
            print(f"{key}: stored tables are gone, made again ({type(gone).__name__})")
    _STORED[key] = build()
    return _STORED[key]


def row_text_sql(*columns: str) -> str:
    """DuckDB text of ``functions.text.row_text``."""
    cells = [f"CASE WHEN CAST({c} AS VARCHAR) IS NULL THEN 'N;' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR), ';') END"
             for c in columns]
    return f"concat({', '.join(cells)})"


def hash_sum_sql(digest: str, part: int = 0) -> str:
    """Exact sum of the ``part``-th 60 bits of sha256 texts, as text."""
    return (f"CAST(coalesce(sum(CAST(('0x' || substr({digest}, {15 * part + 1}, 15))::BIGINT AS DECIMAL(38,0))), 0) AS VARCHAR)")
