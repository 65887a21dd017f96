"""Token ids in Parquet: list columns, dictionary or delta encoding, small row groups, page indexes.

Files hold documents in id order. Each row has its id, the file's range number, the tokens of
the range before it, its token count and the list of ids. Dictionary pages bit-pack common
ids; where a dictionary would grow too large, the writer falls back to delta encoding (format
version 2). Rows, pages and row groups are bounded, so a read by id touches few pages, and
metadata reads skip the token column.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from geotransfer.llm.common import keyed, mapped
from geotransfer.llm.word_tokens import encoder

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}
BATCH_TOKENS = 1 << 20


def _encode_task(path: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = encoder(path), 0
        part = TaskContext.get().partitionId()
        closing = np.array([end_id], "<u4").tobytes()

        def out(ids, held):
            raw = np.frombuffer(b"".join(held), "<i4")
            n = np.fromiter(map(len, held), np.int64, len(held)) // 4
            offsets = np.concatenate([[0], np.cumsum(n)])
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(n), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(raw))],
                ["id", "range", "range_start", "n_tokens", "tokens"]), int(offsets[-1])

        for batch in batches:
            low, held, size = 0, [], 0
            for k, text in enumerate(batch.column("text")):
                held.append(words.encode(text.as_py() or "") + closing)
                size += len(held[-1])
                if size >= 4 * BATCH_TOKENS or k + 1 == batch.num_rows:
                    rows, n = out(batch.column("id").slice(low, k + 1 - low), held)
                    before += n
                    yield rows
                    low, held, size = k + 1, [], 0

    return task


def write_tokens(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, row_group_bytes: int = 16 << 20, dictionary: bool = True) -> None:
    """Encode every text, append ``end_id``, and write the rows in id order (then text checksum).

    Null and empty texts hold the end id alone. Null ids come first. Repeated rows are written
    each. An empty table writes an empty table. Extra columns are not written.
    """
    docs = keyed(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "id", "tag").sortWithinPartitions("id", "tag")
    rows = mapped(ordered, _encode_task(path, end_id),
                  f"id {id_type}, range int, range_start bigint, n_tokens bigint, tokens array<int>")
    options = WRITER | {"parquet.block.size": str(row_group_bytes), "parquet.enable.dictionary": str(dictionary).lower()}
    rows.write.options(**options).parquet(folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``start`` (tokens of all rows before) and ``n_tokens``, without reading token pages."""
    rows = spark.read.parquet(folder).select("id", "range", "range_start", "n_tokens")
    return _with_start(spark, folder, rows)


def read_tokens(spark: SparkSession, folder: str, ids: Sequence | None = None) -> DataFrame:
    """``id``, ``start``, ``n_tokens`` and ``tokens``; with ``ids`` only those rows, found by page index."""
    rows = spark.read.parquet(folder)
    return _with_start(spark, folder, rows if ids is None else rows.where(F.col("id").isin(list(ids))))


def _with_start(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    # One number per written range comes to the driver.
    sums = dict(spark.read.parquet(folder).groupBy("range").agg(F.sum("n_tokens")).collect())
    total, base = 0, []
    for part in sorted(sums):
        base.append((part, total))
        total += sums[part]
    table = spark.createDataFrame(base, T.StructType([T.StructField("range", T.IntegerType()),
                                                      T.StructField("base", T.LongType())]))
    return rows.join(F.broadcast(table), "range").withColumn("start", F.col("base") + F.col("range_start")).drop(
        "base", "range", "range_start")


def _crc_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        at, raw = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        crc = [zlib.crc32(raw[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"),
                                          pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """``id``, ``start``, ``n_tokens`` and ``ids_crc32`` of rows of ``read_tokens``."""
    id_type = rows.schema["id"].dataType.simpleString()
    return mapped(rows.select("id", "start", "n_tokens", "tokens"), _crc_task,
                  f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def folder_for(spark: SparkSession, label: str) -> str:
    from uuid import uuid4

    from geotransfer.session import checkpoint_root
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid4().hex}")
