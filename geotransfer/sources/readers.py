"""Scans: delimited text, many files, pruned Parquet, JSON, GeoJSON, tiled tables."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Sequence

from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geotransfer.operators.guards import GuardError


def read_delimited(spark: SparkSession, path, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Headed CSV with declared names and types (18-digit ids stay text), read by the names in the header.

    A header that lacks a declared column stops the read; so does an undeclared column when ``strict``
    (else it is skipped), and a file whose header differs from that of the first file.
    """
    header = spark.read.option("header", True).csv(path).columns
    lacking = sorted(set(schema.names) - set(header))
    more = sorted(set(header) - set(schema.names))
    if lacking or len(set(header)) != len(header) or (strict and more):
        raise GuardError(f"CSV header {header}: lacking {lacking}, undeclared {more}")
    ordered = T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(ordered).option("header", True).option("enforceSchema", False).csv(path).select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by file suffix."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        return read_delimited(spark, path, schema)
    return spark.read.parquet(path)


def read_chunks(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Every CSV chunk of a folder as one scan, with the file each row came from."""
    return read_delimited(spark, folder, schema).select("*", F.col("_metadata.file_path").alias("chunk_file"))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON document per file, or one per line."""
    return spark.read.option("multiLine", not lines).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, ring) rows from a FeatureCollection, a Feature or a bare Polygon."""
    doc = read_manifest(spark, path)
    cols = set(doc.columns)
    if "features" in cols:
        geo = doc.select(F.posexplode("features").alias("i", "f")).select("i", F.col("f.geometry").alias("g"))
    elif "geometry" in cols:
        geo = doc.select(F.lit(0).alias("i"), F.col("geometry").alias("g"))
    elif "coordinates" in cols:
        geo = doc.select(F.lit(0).alias("i"), F.struct("type", "coordinates").alias("g"))
    else:
        raise GuardError("not a GeoJSON polygon document")
    rings = geo.select(F.concat(F.lit("p"), F.col("i").cast("string")).alias("poly_id"),
                       F.col("g.coordinates").alias("c"))
    depth = rings.schema["c"].dataType.simpleString().count("array<")
    if depth == 4:  # MultiPolygon
        rings = rings.select("poly_id", F.explode("c").alias("c"))
    return rings.select("poly_id", F.explode("c").alias("ring"))


def read_tiles(spark: SparkSession, path: str, year: int, months: Sequence[int],
               tiles: Sequence[str]) -> DataFrame:
    """Only the year/month/tile folders that hold the area (partition pruning)."""
    return (spark.read.parquet(path)
            .where((F.col("year") == year) & F.col("month").isin(*months)
                   & F.col("tile").isin(*tiles)))


def read_granules(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many granule files as one scan (no chain of unions in the plan)."""
    return spark.read.parquet(*paths)


RANGE_BYTES = 64 << 20
_PIECE = 1 << 20


class _Range(InputPartition):
    def __init__(self, row: tuple):
        self.row = row


class _RangeReader(DataSourceReader):
    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges

    def partitions(self) -> list[_Range]:
        return [_Range(r) for r in self.ranges] or [_Range(())]

    def read(self, partition: _Range):
        if not partition.row:
            return
        uri, table, name, place, offset, length = partition.row
        store, path = pa_fs.FileSystem.from_uri(uri)
        digest, left = hashlib.sha256(), length
        with store.open_input_file(path) as f:
            f.seek(offset)
            while left:
                piece = f.read(min(_PIECE, left))
                if not piece:
                    raise OSError(f"{uri} became shorter while it was read")
                digest.update(piece)
                left -= len(piece)
        yield table, name, place, offset, length, digest.hexdigest()


class ByteRangeSource(DataSource):
    """Checksums of byte ranges of files: a task reads one range in small pieces, and no row holds content."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "table string, name string, place int, offset bigint, length bigint, sha256 string"

    def reader(self, schema) -> _RangeReader:
        return _RangeReader([tuple(r) for r in json.loads(self.options["ranges"])])


def byte_ranges(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``table`` (entry of the folder), ``name`` (path inside it), ``place``, ``offset``, ``length`` and ``sha256`` of every
    range of every file below ``path`` whose table's name fits ``pattern``. Lengths come from the listing; hidden files are left out. An empty file has no range
    but one of length 0."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, ranges = str(fs.makeQualified(root)).rstrip("/") + "/", fs.listFiles(root, True), []
    while found.hasNext():
        status = found.next()
        uri, size = str(status.getPath()), status.getLen()
        inside = uri[len(base):] if uri.startswith(base) else uri.rsplit("/", 1)[-1]
        if any(part.startswith(("_", ".")) for part in inside.split("/")):
            continue
        table, _, rest = inside.partition("/")
        if not fnmatch.fnmatchcase(table, pattern):
            continue
        local = uri if not uri.startswith("file:") else "file:///" + uri[len("file:"):].lstrip("/")
        for place, offset in enumerate(range(0, max(size, 1), range_bytes)):
            ranges.append((local, table, rest or table, place, offset, min(range_bytes, size - offset)))
    spark.dataSource.register(ByteRangeSource)
    return spark.read.format("byte_ranges").option("ranges", json.dumps(ranges)).load()


def table_checksums(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``name``, ``files``, ``length`` and ``sha256`` of every table below ``path``: a file, or a folder of part files.

    A file's root is the sha256 of its ranges' digests in order, a table's that of ``file:root;`` of its files by name. Both
    lists hold a digest per range and per file. An empty file's root is that of no range.
    """
    ranges = byte_ranges(spark, path, pattern, range_bytes)
    digest = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("length") > 0, F.struct("place", "sha256")))),
                                      lambda r: r["sha256"]), "")
    files = ranges.groupBy("table", "name").agg(F.sha2(digest, 256).alias("root"), F.sum("length").alias("length"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("name", "root"))), lambda f: F.concat(f["name"], F.lit(":"), f["root"], F.lit(";")))
    return files.groupBy(F.col("table").alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"),
                                                           F.sha2(F.array_join(each, ""), 256).alias("sha256"))
