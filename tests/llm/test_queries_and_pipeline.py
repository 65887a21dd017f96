"""Registered queries against DuckDB, and the pipeline against the stages' brute-force versions."""

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from geotransfer.llm import quality_rules
from geotransfer.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_near_copies import smallest
from tests.llm.test_tokens import check_pieces
from tools.check_queries import connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_simhash_query(spark):
    rows = documents(spark)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, SF).collect()}
    prints = [(i, brute.simhash(t)) for i, t in rows]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute.components(prints))}


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in QUERIES["op2_quality_rules"](spark, SF).collect():
        text = dict(documents(spark))[r.doc_id] if not right else texts[r.doc_id]
        texts = dict(documents(spark)) if not right else texts
        want = brute.statistics(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        if r.doc_id in labels:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(right) > 0.9


def test_packing_query_and_padding(spark):
    rows = documents(spark)
    from geotransfer.llm import packing
    pieces = [p.asDict() for p in packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), corpus_pipeline.TOKENIZER).collect()]
    padding, total = check_pieces(rows, pieces, 4096)
    assert padding <= 0.02 * total
    assert QUERIES["op5_packing"](spark, SF).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_pipeline(spark):
    """Every stage's decisions, replayed by the brute-force versions from the rules that were learned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.id for r in quality_rules.judged(docs, rules).where("kept").collect()}
    rows = [(i, t) for i, t in documents(spark) if i in kept]
    assert 0 < len(rows) < docs.count()
    rows = [(i, text) for (i, _), (text, _) in zip(rows, brute.line_dedup(rows, 10))]
    rows = [r for r, c in zip(rows, smallest(rows)) if r[0] == c]
    rows = [(i, " ".join(w)) for i, (w, _) in brute.substring_dedup(rows).items()]
    plain = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    got = {}
    for p in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    have = {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in got.items()}
    assert have == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
