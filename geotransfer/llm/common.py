"""Helpers of this subpackage: column hand-over to Arrow tasks and bounded slices of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

SLICE_BYTES = 2 << 20  # texts handled at once inside a task


def tag_of(text: Column) -> Column:
    """128 bits that tell texts apart; null, which equals no text, has none."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def keyed(df: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """``id``, ``tag``, ``text`` and, if asked for, every other column in the struct ``rest``.

    ``tag`` is the text's md5 (see ``tag_of``). Rows that share an id are told apart by it, so a
    repeated row is judged like its twin. Other columns sit in a struct and cannot clash.
    """
    text = F.col(f"`{text_col}`")
    cols = [F.col(f"`{id_col}`").alias("id"), tag_of(text).alias("tag"), text.alias("text")]
    if rest:
        others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
        cols.append((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"))
    return df.select(*cols)


def restored(df: DataFrame, like: DataFrame, id_col: str, text_col: str, more: dict[str, Column] | None = None
             ) -> DataFrame:
    """Columns of ``like`` out of ``id``, ``text`` and ``rest``; ``more`` replaces some."""
    more = more or {}
    own = {id_col: F.col("id"), text_col: F.col("text")}
    return df.select(*[(more.get(c) if c in more else own[c] if c in own else F.col("rest").getField(c)).alias(c)
                       for c in like.columns])


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
           schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose worker gives freed memory back when a task ends, for workers are kept between tasks."""
    def task(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(task, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as bytes."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text or binary column whose values stay near ``limit`` bytes together."""
    low, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        held += n
        if held >= limit:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(column):
        yield low, len(column)


class Memo(dict):
    """Values of a pure function, kept for as many keys as ``most`` and then started anew."""

    def __init__(self, fn: Callable, most: int = 300_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    cond = None
    for k in keys:
        eq = left[k].eqNullSafe(right[k])
        cond = eq if cond is None else cond & eq
    return cond
