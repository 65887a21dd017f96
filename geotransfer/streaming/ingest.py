"""Incremental file ingest: Structured Streaming with one keyed state, and a checkpoint as ledger of finished files.

A streaming aggregate holds, per key, how many copies have come, when the first did, and the row
that was taken. A micro-batch changes only the keys it brings, and these are all that it sees:
a key whose first copy came in this batch is new and its row is accepted, any other is a repeat.
The state lies in RocksDB under the checkpoint, so no batch reads what earlier ones have written.
Each batch writes to its own ``batch_id`` folder in overwrite mode, and its time is part of the
checkpoint, so a batch that is replayed after a crash replaces itself and nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from geotransfer.operators.govern import fingerprint, schema_hash
from geotransfer.operators.guards import refuse_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Counting the rows of a state looks up every key once more when it is written; the ledger has that number.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def keyed_state(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ``_copies`` so far, the times of the first and the last, and the row taken (``_r``).

    Of the copies in the first batch the least by a hash of all columns is taken. Copies are
    reduced on the map side, so a key that fills a third of a batch does not gather in one task.
    """
    rest = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    timed = rows.withColumns({"_at": F.current_timestamp(), "_order": F.xxhash64(*[F.col(c) for c in rows.columns])})
    return timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.min("_at").alias("_first"), F.max("_at").alias("_last"),
                                    F.min_by(rest, F.struct("_at", "_order")).alias("_r"))


def split_update(update: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of the keys a batch has changed. Rejected keys carry their copies so far (``total``)."""
    new = F.col("_first") == F.col("_last")
    accepted = update.where(new).select(*keys, "_r.*").select(*columns)
    rejected = update.where(~new | (F.col("_copies") > 1)).select(
        *keys, F.col("_copies").alias("total"), F.when(new, F.lit("repeated in batch")).otherwise(F.lit("already ingested")).alias("reason"))
    return accepted, rejected


def _held(spark: SparkSession, ledger: str, batches: Sequence[int]) -> dict[int, int]:
    """Keys in the state after each of the last ``batches``: every row accepted so far holds one."""
    if not batches or not _exists(spark, ledger):
        return dict.fromkeys(batches, 0)
    earlier = F.greatest(F.col("batch_id"), F.lit(min(batches) - 1))
    counts = spark.read.parquet(ledger).groupBy(earlier.alias("batch_id")).agg(F.sum("rows").alias("n")).collect()
    return {b: sum(c.n for c in counts if c.batch_id <= b) for b in batches}


def ingest(spark: SparkSession, source: str, schema: T.StructType, out: str, keys: Sequence[str],
           partition: str, file_format: str = "parquet", files_per_batch: int | None = None,
           options: dict[str, str] | None = None) -> list[dict]:
    """Take in every file not yet seen and stop. Safe to run again at any time.

    Writes ``table`` (accepted rows), ``rejects`` and ``ledger`` under ``out``; read them with
    ``read_ingested``. A ledger written for another schema stops the job. Returns the batches of
    this run: ``batch_id``, ``input_rows`` read, ``state_rows`` held.
    """
    table, rejects, ledger, keys = f"{out}/table", f"{out}/rejects", f"{out}/ledger", list(keys)
    reader = spark.readStream.schema(schema).format(file_format)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    columns_hash = schema_hash(schema)

    if _exists(spark, ledger):
        other = spark.read.parquet(ledger).where(F.col("schema_hash") != columns_hash)
        refuse_rows(other.select("schema_hash"), "ledger was written for another schema")

    def write_batch(update: DataFrame, batch_id: int) -> None:
        spot = f"batch_id={batch_id}"
        # The changed keys are stored once: the three tables are made from them without another pass over the state.
        update.write.mode("overwrite").parquet(f"{out}/changes/{spot}")
        accepted, rejected = split_update(spark.read.schema(update.schema).parquet(f"{out}/changes/{spot}"), keys, schema.names)
        accepted.write.mode("overwrite").partitionBy(partition).parquet(f"{table}/{spot}")
        rejected.write.mode("overwrite").parquet(f"{rejects}/{spot}")
        entry = fingerprint(accepted).withColumn("schema_hash", F.lit(columns_hash))
        entry.write.mode("overwrite").parquet(f"{ledger}/{spot}")

    own = {name: spark.conf.get(name, None) for name in (PROVIDER, COUNTED)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(COUNTED, "false")
    try:
        query = (keyed_state(reader.load(source), keys).writeStream.outputMode("update").foreachBatch(write_batch)
                 .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in own.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    progress = query.recentProgress
    held = _held(spark, ledger, [p["batchId"] for p in progress])
    return [{"batch_id": p["batchId"], "input_rows": p["numInputRows"], "state_rows": held[p["batchId"]]} for p in progress]


def read_ingested(spark: SparkSession, out: str, part: str = "table") -> DataFrame:
    """The accepted rows, the ``ledger``, or the ``rejects`` with the ``copies`` that each batch turned away."""
    rows = spark.read.parquet(f"{out}/{part}")
    if part != "rejects":
        return rows
    keys = [c for c in rows.columns if c not in ("total", "reason", "batch_id")]
    before = F.lag("total").over(Window.partitionBy(*keys).orderBy("batch_id"))
    return rows.withColumn("copies", F.col("total") - F.coalesce(before, F.lit(1))).drop("total")
