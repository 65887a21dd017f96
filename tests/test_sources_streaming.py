import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from geotransfer.operators.guards import GuardError
from geotransfer.operators.govern import fingerprint_text, inventory, inventory_status
from geotransfer.sources import chunks, readers, writers
from geotransfer.streaming import ingest as stream

ROWS = T.StructType([T.StructField("shot_number", T.StringType()), T.StructField("year", T.IntegerType()),
                     T.StructField("x", T.DoubleType())])


def test_long_ids_survive_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("shot_number,year,x\n000000000123456789,2020,1.5\n999999999999999999,2021,\n")
    rows = readers.read_delimited(spark, str(tmp_path / "a.csv"), ROWS).orderBy("year").collect()
    assert rows[0].shot_number == "000000000123456789" and rows[1].x is None


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("year,shot_number,more,x\n2020,000000000123456789,q,1.5\n")
    row = readers.read_delimited(spark, str(tmp_path / "a.csv"), ROWS).first()
    assert (row.shot_number, row.year, row.x) == ("000000000123456789", 2020, 1.5)
    with pytest.raises(GuardError):
        readers.read_delimited(spark, str(tmp_path / "a.csv"), ROWS, strict=True)
    (tmp_path / "b.csv").write_text("shot_number,year\n1,2020\n")
    with pytest.raises(GuardError):
        readers.read_delimited(spark, str(tmp_path / "b.csv"), ROWS)
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("shot_number,year,x\n1,2020,1\n")
    (folder / "2.csv").write_text("year,shot_number,x\n2020,2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_chunks(spark, str(folder), ROWS).collect()


def test_chunk_audit_sees_missing_values_and_any_wrong_year(spark):
    want = spark.createDataFrame([("a", "1", 2020), ("a", "2", 2020)], "chunk string, k string, year int")
    rows = [("a", "1", 2020, 1.0, None), ("a", "1", 2021, 1.0, 2.0), ("a", "2", None, 1.0, 2.0)]
    for r in (rows, rows[::-1]):
        got = spark.createDataFrame(r, "chunk string, k string, year int, u double, need double")
        a = chunks.chunk_audit(got, want, "k", "chunk", "year", ["u"], ["need"]).first()
        assert (a.wrong_year, a.missing_value_rows, a.status) == (2, 1, "FAIL")
    with pytest.raises(GuardError):
        chunks.chunk_audit(got.drop("need"), want, "k", "chunk", "year", ["u"], ["need"])


def test_chunks_carry_their_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"c{i}.csv").write_text(f"shot_number,year,x\n{i},2020,1\n")
    df = readers.read_chunks(spark, str(tmp_path), ROWS)
    assert {r.chunk_file.rsplit("/", 1)[1] for r in df.collect()} == {"c0.csv", "c1.csv", "c2.csv"}


@pytest.mark.parametrize("kind", ["collection", "feature", "polygon", "multi"])
def test_geojson_forms(spark, tmp_path, kind):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    poly = {"type": "Polygon", "coordinates": [ring]}
    if kind == "multi":
        poly = {"type": "MultiPolygon", "coordinates": [[ring]]}
    feature = {"type": "Feature", "properties": {}, "geometry": poly}
    doc = {"polygon": poly, "feature": feature, "multi": feature,
           "collection": {"type": "FeatureCollection", "features": [feature]}}[kind]
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = readers.read_geojson(spark, str(tmp_path / "a.json")).collect()
    assert [r.ring for r in rows] == [ring]


def test_checksums_and_inventory(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = readers.table_checksums(spark, str(tmp_path))
    assert got.first().sha256 == hashlib.sha256(f"a.bin:{plain_root(tmp_path / 'a.bin', 10)};".encode()).hexdigest()
    want = spark.createDataFrame([("a.bin",), ("b.bin",)], "name string")
    s = inventory_status(inventory(want, got)).first()
    assert (s.expected_n, s.missing_n, s.state) == (2, 1, "in progress")


def test_chunk_audit_statuses(spark):
    want = spark.createDataFrame([(c, f"{c}{i}", 2020) for c in "abcdef" for i in range(3)], "chunk string, k string, year int")
    rows = [(c, f"{c}{i}", 2020, 1.0, 1.0) for c in "abcdef" for i in range(3)]
    rows = [r for r in rows if r[1] != "b0"]                       # b: a masked row
    rows += [("c", "c0", 2020, 1.0, 1.0)]                          # c: repeat
    rows += [("d", "zz", 2020, 1.0, 1.0)]                          # d: foreign
    rows = [r if r[1] != "e0" else ("e", "e0", 2020, float("nan"), 1.0) for r in rows]
    rows = [r if r[1] != "f0" else ("f", "f0", 2021, 0.0, 0.0) for r in rows]
    got = spark.createDataFrame(rows, "chunk string, k string, year int, u double, v double")
    a = {r.chunk: r for r in chunks.chunk_audit(got, want, "k", "chunk", "year", ["u", "v"]).collect()}
    assert {c: r.status for c, r in a.items()} == {"a": "PASS", "b": "SUBSET", "c": "FAIL", "d": "FAIL", "e": "FAIL", "f": "FAIL"}
    assert (a["c"].repeated_keys, a["d"].foreign_keys, a["e"].non_finite_rows) == (1, 1, 1)
    assert (a["f"].wrong_year, a["f"].all_zero_rows) == (1, 1)


def test_candidate_conflict(spark):
    want = spark.createDataFrame([("a", "1"), ("a", "2")], "chunk string, k string")
    rows = spark.createDataFrame([("a", "f1", "1"), ("a", "f1", "2"), ("a", "f2", "1"), ("a", "f2", "2")],
                                 "chunk string, file string, k string")
    choice = chunks.choose_candidates(rows, want, "k", "chunk", "file")
    with pytest.raises(GuardError):
        chunks.require_one_exact(choice, "chunk")
    only = chunks.choose_candidates(rows.where("NOT (file = 'f2' AND k = '2')"), want, "k", "chunk", "file").first()
    assert (only.accepted_file, only.exact_n) == ("f1", 1)


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 4).cast("int").alias("year"))
    writers.write_partitioned(df, str(tmp_path / "t"), ["year"], ["k"])
    got = spark.read.parquet(str(tmp_path / "t")).where("year = 2")
    assert got.count() == 25 and "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()


def test_manifest_upsert_and_public_extract(spark):
    old = spark.createDataFrame([("s", 1, "x"), ("t", 1, "y")], "domain string, v int, h string")
    new = spark.createDataFrame([("s", 2, "z")], "domain string, v int, h string")
    assert {(r.domain, r.h) for r in writers.upsert_manifest(old, new, ["domain"], "v").collect()} == {("s", "z"), ("t", "y")}
    pub = writers.public_extract(spark.createDataFrame([("1", "b7", 2.0)], "shot_number string, block string, x double"),
                                 ["shot_number"], ["block"])
    assert pub.columns == ["x", "block_hash"] and pub.first().block_hash == hashlib.sha256(b"b7").hexdigest()


def _deliver(spark, path, lo, hi):
    spark.range(lo, hi).select(F.col("id").cast("string").alias("shot_number"), (F.lit(2020) + F.col("id") % 2).cast("int").alias("year"),
                               (F.col("id") * 0.5).alias("x")).coalesce(1).write.mode("append").parquet(path)


def test_ingest_restarts_without_doubling(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _deliver(spark, src, 0, 100)
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    stream.ingest(spark, **args)
    _deliver(spark, src, 80, 150)
    stream.ingest(spark, **args)
    first = fingerprint_text(stream.read_ingested(spark, out).drop("batch_id"))
    stream.ingest(spark, **args)
    got = stream.read_ingested(spark, out)
    assert got.count() == 150 and fingerprint_text(got.drop("batch_id")) == first
    rej = stream.read_ingested(spark, out, "rejects").collect()
    assert len(rej) == 20 and {r.reason for r in rej} == {"already ingested"}
    assert stream.read_ingested(spark, out, "ledger").agg(F.sum("rows")).first()[0] == 150


def test_ingest_replays_a_crashed_batch(spark, tmp_path, monkeypatch):
    """The job dies after the table is written but before the ledger; a rerun gives the same table."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _deliver(spark, src, 0, 60)
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    real = stream.fingerprint

    def broken(df, *a):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(stream, "fingerprint", broken)
    with pytest.raises(Exception):
        stream.ingest(spark, **args)
    monkeypatch.setattr(stream, "fingerprint", real)
    stream.ingest(spark, **args)
    assert stream.read_ingested(spark, out).count() == 60
    assert stream.read_ingested(spark, out, "ledger").count() == 1


def test_repeats_inside_and_between_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    for rows in ([("1", 2020, 1.0)] * 5 + [("2", 2020, 2.0), (None, 2020, 3.0)], [("1", 2020, 9.0)] * 2 + [("2", 2020, 2.0)],
                 [("1", 2020, 1.0), (None, 2020, 3.0), ("3", 2021, None)]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
        stream.ingest(spark, **args)
    got = stream.read_ingested(spark, out)
    assert sorted((r.shot_number or "", r.x) for r in got.collect() if r.x) == [("", 3.0), ("1", 1.0), ("2", 2.0)] and got.count() == 4
    rejects = sorted((r.batch_id, r.shot_number or "", r.copies, r.reason) for r in stream.read_ingested(spark, out, "rejects").collect())
    assert rejects == [(0, "1", 4, "repeated in batch"), (1, "1", 2, "already ingested"), (1, "2", 1, "already ingested"),
                       (2, "", 1, "already ingested"), (2, "1", 1, "already ingested")]


def test_a_batch_reads_its_own_files_only(spark, tmp_path):
    """Rows read and keys written by a batch do not grow with the table; the state is where the keys are."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    seen = []
    for k in range(4):
        _deliver(spark, src, 50 * k, 50 * k + 60)
        seen += [(p["input_rows"], p["state_rows"]) for p in stream.ingest(spark, **args) if p["input_rows"]]
    assert seen == [(60, 60), (60, 110), (60, 160), (60, 210)]
    assert [r.rows for r in stream.read_ingested(spark, out, "ledger").orderBy("batch_id").collect()] == [60, 50, 50, 50]


@pytest.mark.parametrize("own", [None, "true"])
def test_state_rows_come_from_the_ledger_and_not_from_a_lookup_per_key(spark, tmp_path, monkeypatch, own):
    """The state does not count its rows while a batch runs; the session's own setting is back afterwards."""
    src, out, seen, real = str(tmp_path / "in"), str(tmp_path / "out"), [], stream.fingerprint
    setting = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    monkeypatch.setattr(stream, "fingerprint", lambda df: (seen.append(spark.conf.get(setting, None)), real(df))[1])
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    before = spark.conf.get(setting, None)
    if own:
        spark.conf.set(setting, own)
    try:
        held = []
        for first, last in ((0, 30), (10, 20), (25, 45)):
            _deliver(spark, src, first, last)
            held += [(p["batch_id"], p["state_rows"]) for p in stream.ingest(spark, **args) if p["input_rows"]]
        assert [p["state_rows"] for p in stream.ingest(spark, **args)] in ([], [45])
        assert spark.conf.get(setting, None) == (own or before)
    finally:
        spark.conf.unset(setting)
    assert seen == ["false"] * 3 and held == [(0, 30), (1, 30), (2, 45)]


def test_batches_of_one_run_have_their_own_state_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    args = dict(source=src, schema=ROWS, out=out, keys=["shot_number", "year"], partition="year")
    (tmp_path / "in").mkdir()
    assert [p["state_rows"] for p in stream.ingest(spark, **args)] in ([], [0])
    for first in (0, 10, 15):
        spark.range(first, first + 10).select(F.col("id").cast("string").alias("shot_number"), F.lit(2020).alias("year"),
                                              F.lit(1.0).alias("x")).coalesce(1).write.mode("append").parquet(src)
    runs = [p for p in stream.ingest(spark, files_per_batch=1, **args) if p["input_rows"]]
    assert [p["input_rows"] for p in runs] == [10, 10, 10] and [p["state_rows"] for p in runs][-1] == 25
    accepted = {r.batch_id: r.rows for r in stream.read_ingested(spark, out, "ledger").collect()}
    assert [p["state_rows"] for p in runs] == [sum(n for b, n in accepted.items() if b <= p["batch_id"]) for p in runs]


def test_another_schema_is_refused(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _deliver(spark, src, 0, 10)
    args = dict(source=src, out=out, keys=["shot_number", "year"], partition="year")
    stream.ingest(spark, schema=ROWS, **args)
    with pytest.raises(GuardError, match="another schema"):
        stream.ingest(spark, schema=T.StructType(ROWS.fields[:2]), **args)


def plain_root(path, size):
    digests = []
    with open(path, "rb") as f:
        while part := f.read(size):
            digests.append(hashlib.sha256(part).hexdigest())
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def test_checksums_of_ranges_fold_to_a_root_per_file_and_table(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    files = {"t.parquet/part-0": b"a" * 2_500, "t.parquet/part-1": b"", "one.parquet": bytes(range(256)) * 40, "note.txt": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    ranges = readers.byte_ranges(spark, str(tmp_path), range_bytes=1_000)
    assert max(r.length for r in ranges.collect()) <= 1_000 and "sha256" in ranges.columns
    got = {r.name: r for r in readers.table_checksums(spark, str(tmp_path), range_bytes=1_000).collect()}
    assert set(got) == {"t.parquet", "one.parquet", "note.txt"}
    root = {n: plain_root(tmp_path / n, 1_000) for n in files}
    assert got["t.parquet"].files == 2 and got["t.parquet"].length == 2_500
    folded = "".join(f"{n}:{root['t.parquet/' + n]};" for n in ("part-0", "part-1"))
    assert got["t.parquet"].sha256 == hashlib.sha256(folded.encode()).hexdigest()
    assert got["one.parquet"].sha256 == hashlib.sha256(f"one.parquet:{root['one.parquet']};".encode()).hexdigest()
    (tmp_path / "one.parquet").write_bytes(bytes(range(256)) * 39 + bytes(256))
    assert readers.table_checksums(spark, str(tmp_path), range_bytes=1_000).where("name = 'one.parquet'").first().sha256 != got["one.parquet"].sha256


def test_checksums_of_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)
    got = readers.table_checksums(spark, str(tmp_path)).first()
    one = hashlib.sha256(bytes(readers.RANGE_BYTES)).hexdigest()
    root = hashlib.sha256((one * ((3 << 30) // readers.RANGE_BYTES)).encode()).hexdigest()
    assert got.length == 3 << 30 and got.sha256 == hashlib.sha256(f"big.bin:{root};".encode()).hexdigest()


def test_quality_filter_reaches_the_scan(spark, tmp_path):
    from geotransfer.operators.qa import quality_filter
    row = spark.createDataFrame([("1", 1, 1, 0, 5.0, 0.1)], "shot_number string, algorithm_run_flag int, l4_quality_flag int, "
                                "degrade_flag int, agbd double, agbd_se double").withColumn("unused", F.lit("x"))
    row.write.parquet(str(tmp_path / "raw"))
    out = quality_filter(spark.read.parquet(str(tmp_path / "raw"))).select("shot_number")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(algorithm_run_flag,1)" in plan and "unused" not in plan and out.count() == 1
