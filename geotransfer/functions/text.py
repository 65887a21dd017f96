"""Hash keys, token normalisation and count maps held in text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geotransfer.functions.numeric import _col


def hash_key(seed, *parts) -> Column:
    """sha256 of ``seed|part|...``: the repeatable random order used by all sampling."""
    first = _col(seed) if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("|", first, *[_col(p).cast("string") for p in parts]), 256)


def anonymise(c) -> Column:
    return F.sha2(_col(c).cast("string"), 256)


def token(c) -> Column:
    return F.lower(F.trim(_col(c)))


def count_map(c) -> Column:
    """Parse a count map written as JSON, as a quoted literal or as ``{k=v, ...}``."""
    text = F.trim(_col(c))
    body = F.regexp_replace(F.regexp_replace(text, r"^\{\s*", ""), r"\s*\}$", "")
    pairs = F.split(F.regexp_replace(body, r"[\"']", ""), r"\s*,\s*")
    entries = F.transform(
        F.filter(pairs, lambda p: p != ""),
        lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*?)\s*[=:]\s*(-?\d+)$", 1)).alias("key"),
                           F.regexp_extract(p, r"^(.*?)\s*[=:]\s*(-?\d+)$", 2)
                           .cast("long").alias("value")))
    return F.map_from_entries(entries)


def row_text(columns) -> Column:
    """One text per row that tells values, NULLs and their places apart: ``N;`` or ``<bytes>:<value>;`` per column."""
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        # NULL makes the whole cell NULL; a value is turned to text once, not again in each branch.
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")), F.lit("N;")))
    return F.concat(F.lit(""), *cells)
