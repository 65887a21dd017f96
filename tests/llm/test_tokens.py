import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from geotransfer.llm import byte_bpe, packing, token_files
from geotransfer.llm.word_tokens import WordEncoder
from tests.llm.test_dedup import corpus, frame

WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", "don't stop", "A  B\n\nC", "²½Ⅷ x1y2", "Σας ΟΔΟΣ", "été É", "<|endoftext|> a<|startoftext|>", "　full wide\x85x\x1cy",
       "日本語 テスト", "a" * 3000, "!!! ??? ...", "İstanbul ß ﬁ", "\x00 null", "_x_ `y` {z}", "'s 're x's", "tab\tand\r\nlines ", "😀 emoji 👨‍👩‍👧"]


@pytest.fixture(scope="module")
def words():
    return WordEncoder(WORD), Tokenizer.from_file(WORD)


def same(words, text):
    got = np.frombuffer(words[0].encode(text), "<u4").tolist()
    assert got == words[1].encode(text, add_special_tokens=False).ids, repr(text)


def test_word_ids_are_the_librarys(words):
    for t in ODD + [t or "" for _, t in corpus(11)]:
        same(words, t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_of_any_text(words, text):
    same(words, text)


@pytest.fixture(scope="module")
def coder():
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.BytePairEncoder(list(byte_bpe.read_ranks(RANKS)), P.PATTERN), plain


def test_byte_ids_are_the_librarys(coder):
    for t in ODD + [t or "" for _, t in corpus(12)]:
        assert np.frombuffer(coder[0].encode(t), "<u4").tolist() == coder[1].encode_ordinary(t), repr(t)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n\t\x85'sL1é", max_size=60)))
def test_byte_ids_of_any_text(coder, text):
    assert np.frombuffer(coder[0].encode(text), "<u4").tolist() == coder[1].encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=20), st.integers(0, 80), st.integers(0, 80))
def test_prefix_table_appends_and_edits(coder, piece, more, a, b):
    ranks = coder[0].ranks
    t = byte_bpe.PrefixTable(ranks, piece)
    assert t.ids() == coder[1]._core_bpe.encode_single_piece(piece) if piece else t.ids() == []
    t.append(more)
    assert t.last == byte_bpe.PrefixTable(ranks, piece + more).last
    a, b = sorted((min(a, len(t.piece)), min(b, len(t.piece))))
    want = t.piece[:a] + more + t.piece[b:]
    t.replace(a, b, more)
    assert t.piece == want and t.last == byte_bpe.PrefixTable(ranks, want).last


def test_edit_in_a_long_piece_is_local(coder):
    r = random.Random(13)
    piece = "".join(r.choice("abcdefgh") for _ in range(5000)).encode()
    t = byte_bpe.PrefixTable(coder[0].ranks, piece)
    t.replace(2000, 2003, b"xyz")
    assert t.last == byte_bpe.PrefixTable(coder[0].ranks, piece[:2000] + b"xyz" + piece[2003:]).last


def test_encode_decode_frames(spark, coder):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "twice"), (3, "twice")]
    coded = byte_bpe.encode(frame(spark, rows), RANKS, P.PATTERN)
    ids = {(r.id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in coded.collect()}
    assert ids == {(i, tuple(coder[1].encode_ordinary(t or ""))) for i, t in rows}
    back = sorted((r.id is not None, r.id or 0, bytes(r.decoded)) for r in byte_bpe.decode(coded, RANKS).collect())
    assert back == sorted((i is not None, i or 0, (t or "").encode()) for i, t in rows)
    assert byte_bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


def check_pieces(rows, pieces, size, end_id=2):
    """Every id lies in one piece, sequences hold at most ``size`` ids without gaps."""
    plain = Tokenizer.from_file(WORD)
    docs = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [end_id]) for _, t in rows)
    got, of = [], {}
    for p in sorted(pieces, key=lambda p: (p["id"] is not None, p["id"] or 0, p["sequence_id"], p["offset"])):
        ids = struct.unpack(f"<{p['length']}I", bytes(p["ids"]))
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and p["length"] > 0
        if p["start"] == 0:
            got.append(())
        assert p["start"] == len(got[-1])
        got[-1] += ids
        of.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(got) == docs
    padding = 0
    for spans in of.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        n = sum(n for _, n in spans)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding, sum(len(g) for g in got)


@pytest.mark.parametrize("stretch", [1 << 20, 900])
def test_packing_loses_and_repeats_nothing(spark, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows = corpus(14, 120) + [(900, "One two. Three four! " * 900), (None, "q"), (5000, "tail")]
    rows = list({r[0]: r for r in rows}.values())
    pieces = packing.pack(frame(spark, rows).coalesce(1), WORD, size=256).collect()
    padding, total = check_pieces(rows, [p.asDict() for p in pieces], 256)
    assert padding < 0.1 * total


def test_dynamic_program_is_optimal():
    r = random.Random(15)
    for _ in range(60):
        ends = np.cumsum([r.randint(1, 6) for _ in range(r.randint(1, 12))])
        pen = np.array([r.choice([0.0, 2.0, 5.0]) for _ in ends])
        size = r.randint(6, 15)
        chosen = packing.cut_windows(ends, pen, size)
        best = {0: 0.0}
        for j, e in enumerate(ends.tolist()):
            best[e] = min(best[s] + size - (e - s) + pen[j] for s in best if e - s <= size)
        t = [0, *ends[chosen].tolist()]
        assert sum(size - (b - a) for a, b in zip(t, t[1:])) + pen[chosen].sum() == pytest.approx(best[int(ends[-1])])


def test_packing_empty_table_and_repeats(spark):
    assert packing.pack(frame(spark, []), WORD).count() == 0
    rows = [(1, "same text."), (1, "same text.")]
    assert packing.pack(frame(spark, rows), WORD).count() == 2


@pytest.mark.parametrize("dictionary", [True, False])
def test_token_files_round_trip(spark, tmp_path, dictionary):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (40, "x y"), (-3, "first")]
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, rows), folder, WORD, dictionary=dictionary)
    plain, at = Tokenizer.from_file(WORD), 0
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.id, r.start, r.n_tokens, list(r.tokens)) == (i, at, len(ids), ids)
        at += len(ids)
    sums = {r.id: r.ids_crc32 for r in token_files.checksums(token_files.read_tokens(spark, folder)).collect()}
    assert sums[40] == zlib.crc32(np.array(plain.encode("x y", add_special_tokens=False).ids + [1], "<u4").tobytes())
    only = token_files.read_tokens(spark, folder, [40]).collect()
    assert [r.id for r in only] == [40] and only[0].start == next(r.start for r in got if r.id == 40)
    assert {(r.id, r.start) for r in token_files.read_metadata(spark, folder).collect()} == {(r.id, r.start) for r in got}
    column = {}
    for f in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                column.setdefault(x.path_in_schema, set()).update(x.encodings)
                assert x.has_column_index and x.has_offset_index
    tokens = column["tokens.list.element"]
    assert ("RLE_DICTIONARY" in tokens) if dictionary else ("DELTA_BINARY_PACKED" in tokens and "RLE_DICTIONARY" not in tokens)


def test_metadata_read_skips_tokens(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write_tokens(frame(spark, [(1, "a"), (2, "b")]), folder, WORD)
    plan = token_files.read_metadata(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "n_tokens:bigint" in plan


def test_token_files_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    token_files.write_tokens(frame(spark, []), folder, WORD)
    assert token_files.read_tokens(spark, folder).count() == 0
