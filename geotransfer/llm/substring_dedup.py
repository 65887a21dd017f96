"""Removal of word windows that start earlier elsewhere in the corpus.

1. Each task counts its windows in a count-min sketch with two rows (one per half of a
   128-bit window hash). Counters saturate at two, so a task sends the sorted slots it has
   met once and twice, and a merge adds them slice by slice. A slot of two or more is
   *estimated repeated*; a count is never too low, so no repeated window is lost.
2. A second pass sends on only windows estimated repeated. Every task keeps the first
   occurrence per hash, so a window that a third of all documents share is sent once per
   chunk, and packs its windows by bucket of hashes. A bucket holds a bounded number of
   windows; grouping it by hash gives the exact first occurrences.
3. First occurrences go back to their documents, packed again by part of the documents, so that
   a row per bucket and part crosses the shuffle and not one per bucket and document. A window that is estimated repeated and is
   not a first occurrence starts earlier elsewhere: its words go.

The sketch has about two slots a window up to ``max_slots`` (2^29: 64 MB a row), and only
that bit mask is broadcast. Past the bound more windows reach the exact pass; the result
stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from geotransfer.llm.common import SLICE_BYTES, keyed, mapped, null_safe, restored, runs, slices, utf8

SLICE_BITS = 20
CHUNK_WINDOWS = 750_000  # windows of a task in one sketch
CHUNK_CANDIDATES = 500_000
BUCKET_WINDOWS = 2_000_000  # windows whose hashes meet in one group of the exact pass, at most about
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every ``width`` consecutive entries of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, size, power = None, 0, h, 1, base
    while True:
        if width & size:
            out = block[:n] if out is None else out * power + block[done:done + n]
            done += size
        if done == width:
            return out
        block = block[:-size] * power + block[size:]
        size, power = size * 2, power * power


class Windows:
    """128-bit hashes of all windows of some texts, in the order of rows and positions."""

    def __init__(self, texts: list[bytes | None], width: int):
        words = [t.split() if t else [] for t in texts]
        self.words = words
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = b"".join([b"".join(map(xxhash.xxh3_128_digest, w)) for w in words])
        pairs = np.frombuffer(flat, np.uint64).reshape(-1, 2)
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        inside = np.maximum(self.counts - width + 1, 0)
        self.row = np.repeat(np.arange(len(words)), inside)
        self.first = np.concatenate([[0], np.cumsum(inside)])
        self.pos = np.arange(self.first[-1]) - self.first[:-1][self.row]
        at = starts[:-1][self.row] + self.pos
        with np.errstate(over="ignore"):
            self.lo, self.hi = (rolling(np.ascontiguousarray(pairs[:, k]), width, BASE[k])[at]
                                if len(at) else np.zeros(0, np.uint64) for k in (0, 1))


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return PACK.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _values(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(UNPACK.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _deltas(rising: np.ndarray) -> bytes:
    return _planes(np.diff(rising, prepend=rising.dtype.type(0)))


def _rising(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(_values(blob, kind), dtype=kind)


def _sketch_task(width: int, slots: int):
    def sketch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out = {"row": [], "slice": [], "once": [], "twice": []}
        for k in (0, 1):
            s = np.sort((np.concatenate([h[k] for h in held]) & np.uint64(slots - 1)).astype(np.uint32))
            new = runs(s)
            met = s[new]
            again = np.diff(np.append(np.flatnonzero(new), len(s))) > 1
            part = met >> np.uint32(SLICE_BITS)
            cuts = np.append(np.flatnonzero(runs(part)), len(met))
            for a, b in zip(cuts[:-1], cuts[1:]):
                local = met[a:b] & np.uint32((1 << SLICE_BITS) - 1)
                out["row"].append(k)
                out["slice"].append(int(part[a]))
                out["once"].append(_deltas(local))
                twice = local[again[a:b]]
                out["twice"].append(_deltas(twice) if len(twice) else None)
        return pa.RecordBatch.from_pydict(out, pa.schema([("row", pa.int32()), ("slice", pa.int32()),
                                                          ("once", pa.binary()), ("twice", pa.binary())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                w = Windows(utf8(batch.column("text").slice(a, b - a)), width)
                if len(w.lo):
                    held.append((w.lo, w.hi))
                    n += len(w.lo)
                if n >= CHUNK_WINDOWS:
                    yield sketch(held)
                    held, n = [], 0
        if n:
            yield sketch(held)

    return task


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sorted counters of a slice; rows come sorted by row and slice."""
    key, once, twice = None, None, None

    def done():
        bits = np.packbits(twice, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict(
            {"row": [key[0]], "slice": [key[1]], "bits": [PACK.compress(bits)]},
            pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("bits", pa.binary())]))

    for batch in batches:
        for r in batch.to_pylist():
            if (r["row"], r["slice"]) != key:
                if key and twice.any():
                    yield done()
                key = (r["row"], r["slice"])
                once, twice = np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
            s = _rising(r["once"], np.uint32)
            twice[s[once[s]]] = True
            once[s] = True
            if r["twice"] is not None:
                twice[_rising(r["twice"], np.uint32)] = True
    if key and twice.any():
        yield done()


Packed = list[tuple[int, int, bytes]]  # (row, slice, compressed bits)


def unpacked(parts: Packed, slots: int) -> np.ndarray:
    """Bit mask (row, bytes) of slots met at least twice."""
    mask = np.zeros((2, slots // 8), np.uint8)
    step = (1 << SLICE_BITS) // 8
    for row, part, bits in parts:
        mask[row, part * step:(part + 1) * step] = np.frombuffer(UNPACK.decompress(bits), np.uint8)
    return mask


def repeated_mask(docs: DataFrame, width: int, chars: int, max_slots: int) -> tuple[Packed, int]:
    """Compressed slices of the mask, and the slots of a row."""
    slots = 1 << SLICE_BITS
    while slots < max_slots and slots < chars // 3:  # about 6 bytes a word: two slots a window
        slots *= 2
    parts = mapped(docs.select("text"), _sketch_task(width, slots), "row int, slice int, once binary, twice binary")
    merged = mapped(parts.repartition("row", "slice").sortWithinPartitions("row", "slice"), _merge_task,
                    "row int, slice int, bits binary")
    return [(r["row"], r["slice"], bytes(r["bits"])) for r in merged.collect()], slots  # bounded by max_slots


def _estimated(mask: np.ndarray, slots: int, w: Windows) -> np.ndarray:
    """Indexes of windows whose counters are two or more in both rows."""
    keep = np.arange(len(w.lo))
    for k, h in ((0, w.lo), (1, w.hi)):
        s = (h[keep] & np.uint64(slots - 1)).astype(np.int64)
        keep = keep[(mask[k][s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1]
    return keep


def _codes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.dictionary_encode(values).indices, -1).to_numpy(zero_copy_only=False)


def _firsts(lo, hi, doc, pos, ids: pa.Array, tag: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of hash, id, tag and position, and which of them open a hash."""
    order = pc.sort_indices(pa.table({"id": ids, "tag": tag}), sort_keys=[("id", "ascending"), ("tag", "ascending")],
                            null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    # Rows equal in id and tag are one document.
    rank[order] = np.cumsum(runs(_codes(ids)[order], _codes(tag)[order]))
    o = np.lexsort((pos, rank[doc], hi, lo))
    return o, runs(lo[o], hi[o])


def _candidate_task(width: int, mask, slots: int, buckets: int):
    """Packed first occurrences of a chunk's candidates, one row per bucket of hashes."""
    def packed(held) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        tag = pa.concat_arrays([h[1] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])
        doc = np.concatenate([h[2] + b for h, b in zip(held, base)])
        pos, lo, hi = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
        hi = (hi >> np.uint64(32)).astype(np.uint32)  # 96 bits of hash are kept
        o, new = _firsts(lo, hi, doc, pos, ids, tag)
        o = o[new]
        bucket = ((lo[o] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        o, bucket = (x[np.argsort(bucket, kind="stable")] for x in (o, bucket))
        cuts = np.append(np.flatnonzero(runs(bucket)), len(o))
        out = {c: [] for c in ("bucket", "lo", "hi", "doc", "pos", "ids", "tags")}
        for a, b in zip(cuts[:-1], cuts[1:]):
            p = o[a:b]
            docs, at = np.unique(doc[p], return_inverse=True)
            out["bucket"].append(int(bucket[a]))
            out["lo"].append(_deltas(lo[p]))
            out["hi"].append(hi[p].tobytes())
            out["doc"].append(_planes(at.astype(np.uint32)))
            out["pos"].append(_planes(pos[p].astype(np.uint32)))
            out["ids"].append(ids.take(pa.array(docs)).to_pylist())
            out["tags"].append(tag.take(pa.array(docs)).to_pylist())
        return pa.RecordBatch.from_pydict(out, pa.schema([
            ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("lo", "hi", "doc", "pos")],
            ("ids", pa.list_(ids.type)), ("tags", pa.list_(pa.binary()))]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        bits = unpacked(mask.value, slots)  # of this task alone: an idle worker keeps the packed form only
        for batch in batches:
            for a, b in slices(batch.column("text")):
                w = Windows(utf8(batch.column("text").slice(a, b - a)), width)
                c = _estimated(bits, slots, w)
                if len(c):
                    held.append((batch.column("id").slice(a, b - a), batch.column("tag").slice(a, b - a),
                                 w.row[c], w.pos[c], w.lo[c], w.hi[c]))
                    n += len(c)
                if n >= CHUNK_CANDIDATES:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return task


def _exact_task(parts: int):
    """Packed rows come sorted by bucket. The exact first occurrence of every hash, packed by part of the documents."""
    def settle(held: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        lo = np.concatenate([_rising(r["lo"], np.uint64) for r in held])
        hi = np.concatenate([np.frombuffer(r["hi"], np.uint32) for r in held])
        pos = np.concatenate([_values(r["pos"], np.uint32) for r in held]).astype(np.int32)
        base = np.cumsum([0] + [len(r["tags"]) for r in held])
        doc = np.concatenate([_values(r["doc"], np.uint32).astype(np.int64) + b for r, b in zip(held, base)])
        ids = pa.concat_arrays([pa.array(r["ids"], id_type) for r in held])
        tag = pa.concat_arrays([pa.array(r["tags"], pa.binary()) for r in held])
        o, new = _firsts(lo, hi, doc, pos, ids, tag)
        o = o[new]
        # The last four bytes of a text's tag deal its document to a part; an empty tag has no windows.
        last = pc.binary_slice(tag, -4).to_pylist()
        part = (np.frombuffer(b"".join(last), "<u4") % np.uint32(parts)).astype(np.int32)[doc[o]]
        o, part = (x[np.lexsort((pos[o], doc[o], part))] for x in (o, part))
        cuts = np.append(np.flatnonzero(runs(part)), len(o))
        out = {c: [] for c in ("part", "doc", "pos", "ids", "tags")}
        for a, b in zip(cuts[:-1], cuts[1:]):
            docs, at = np.unique(doc[o[a:b]], return_inverse=True)
            out["part"].append(int(part[a]))
            out["doc"].append(_planes(at.astype(np.uint32)))
            out["pos"].append(_planes(pos[o[a:b]]))
            out["ids"].append(ids.take(pa.array(docs)).to_pylist())
            out["tags"].append(tag.take(pa.array(docs)).to_pylist())
        return pa.RecordBatch.from_pydict(out, pa.schema([
            ("part", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary()),
            ("ids", pa.list_(id_type)), ("tags", pa.list_(pa.binary()))]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, id_type = [], None
        for batch in batches:
            id_type = batch.column("ids").type.value_type
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield settle(held, id_type)
                    held = []
                held.append(r)
        if held:
            yield settle(held, id_type)

    return task


def _documents_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed first occurrences come sorted by part. One row per document with all its positions."""
    def settle(held: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        ids = pa.concat_arrays([pa.array(r["ids"], id_type) for r in held])
        tag = pa.concat_arrays([pa.array(r["tags"], pa.binary()) for r in held])
        _, first, same = np.unique(_codes(ids).astype(np.int64) * (len(tag) + 1) + _codes(tag), return_index=True, return_inverse=True)
        base = np.cumsum([0] + [len(r["tags"]) for r in held])
        doc = same[np.concatenate([_values(r["doc"], np.uint32).astype(np.int64) + b for r, b in zip(held, base)])]
        pos = np.concatenate([_values(r["pos"], np.int32) for r in held])
        starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(first)))])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pos[np.argsort(doc, kind="stable")]))
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([ids.take(at), tag.take(at), lists], ["id", "tag", "firsts"])

    held, id_type = [], None
    for batch in batches:
        id_type = batch.column("ids").type.value_type
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield settle(held, id_type)
                held = []
            held.append(r)
    if held:
        yield settle(held, id_type)


def _removal_task(width: int, mask, slots: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(mask.value, slots)
        for batch in batches:
            for a, b in slices(batch.column("packed"), SLICE_BYTES // 4):
                part = batch.slice(a, b - a)
                kept, n_words, n_removed = [], [], []
                w = Windows(list(map(_text, part.column("packed").to_pylist())), width)
                c = _estimated(bits, slots, w)
                known = np.concatenate([w.first[k] + p.values.to_numpy() for k, p in enumerate(part.column("firsts"))
                                        if p.is_valid] or [np.zeros(0, np.int64)])
                gone = np.setdiff1d(c, known, assume_unique=True)
                starts = np.concatenate([[0], np.cumsum(w.counts)])
                edge = np.zeros(starts[-1] + 1, np.int64)
                at = starts[:-1][w.row[gone]] + w.pos[gone]
                edge[at] += 1
                edge[at + width] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                for k, words in enumerate(w.words):
                    s = stays[starts[k]:starts[k + 1]]
                    left = int(s.sum())
                    n_words.append(len(words))
                    n_removed.append(len(words) - left)
                    kept.append(b" ".join(words if left == len(words) else [x for x, y in zip(words, s.tolist()) if y]))
                out = [part.column("id"), pa.array(kept, pa.binary()).cast(pa.string()), part.column("rest"),
                       pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["id", "text", "rest", "n_words", "n_removed"])

    return task


def _text(packed: bytes | None) -> bytes | None:
    return None if packed is None else UNPACK.decompress(packed)


def _compress_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([None if t is None else press(t) for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), batch.column("rest"), texts],
                                         ["id", "tag", "rest", "packed"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20,
                   max_slots: int = 1 << 29) -> DataFrame:
    """``id``, ``text`` (kept words joined by one space), ``rest``, ``n_words``, ``n_removed``.

    Words are runs of bytes other than space and 0x09-0x0D. Null and empty texts have no
    words and come back as empty text. A null id is smaller than any other. Rows that share
    an id are ordered by the checksum of their text; rows equal in both are judged alike, so
    twins keep the same words. Ties at equal id, tag and position keep both. An empty table
    gives an empty table. Other columns are returned in ``rest`` whatever their names.
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col, rest=True)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mask, slots = repeated_mask(docs, width, chars, max_slots)
    held = spark.sparkContext.broadcast(mask)
    id_type = docs.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, chars // (6 * BUCKET_WINDOWS))
    found = mapped(docs.select("id", "tag", "text"), _candidate_task(width, held, slots, buckets),
                   f"bucket int, lo binary, hi binary, doc binary, pos binary, ids array<{id_type}>, tags array<binary>")
    first = mapped(found.repartition(buckets, "bucket").sortWithinPartitions("bucket"), _exact_task(buckets),
                   f"part int, doc binary, pos binary, ids array<{id_type}>, tags array<binary>")
    firsts = mapped(first.repartition(buckets, "part").sortWithinPartitions("part"), _documents_task,
                    f"id {id_type}, tag binary, firsts array<int>")
    shape = T.StructType([docs.schema["id"], docs.schema["tag"], docs.schema["rest"], T.StructField("packed", T.BinaryType())])
    sent = mapped(docs, _compress_task, shape)  # texts cross the shuffle compressed
    joined = sent.join(firsts, null_safe(sent, firsts, ("id", "tag")), "left").select(
        sent["id"], sent["packed"], sent["rest"], firsts["firsts"])
    schema = T.StructType([docs.schema["id"], T.StructField("text", T.StringType()), docs.schema["rest"],
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return mapped(joined, _removal_task(width, held, slots), schema)


def stage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with repeated windows removed; ``n_chars`` follows the text."""
    out = remove_repeats(df, id_col, text_col)
    return restored(out, df, id_col, text_col, {"n_chars": F.length("text").cast("bigint")})
