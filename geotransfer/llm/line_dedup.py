"""Line dedup by range partitions of line hashes; the result is a keep bitmap per document.

Every line sends (hash, document, position). The exchange is a range partition on hash,
document *and* position, so one line that a third of all rows hold is spread over many
tasks. A task streams its sorted rows and holds a run of equal hashes only until it has met
``min_docs`` documents. Runs at the edge of a partition may go on in the next one: their
rows are marked, and one count over the marked rows settles them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from geotransfer.llm.common import keyed, mapped, null_safe, restored, runs, slices, utf8
from geotransfer.session import materialize

HASH = ["hi", "lo"]


def _line_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line with a key: hash, document, position, first line of its key in the document."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            row, pos, first, digests = [], [], [], []
            for k, t in enumerate(utf8(batch.column("text").slice(a, b - a))):
                seen = set()
                for i, line in enumerate((t or b"").split(b"\n")):
                    key = line.strip().lower()
                    if key:
                        d = xxhash.xxh3_128_digest(key)
                        row.append(k)
                        pos.append(i)
                        first.append(d not in seen)
                        digests.append(d)
                        seen.add(d)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("id").slice(a, b - a).take(at),
                 batch.column("tag").slice(a, b - a).take(at), pa.array(pos, pa.int32()), pa.array(first, pa.bool_())],
                ["hi", "lo", "id", "tag", "pos", "first"])


DROP, PENDING, KNOWN = 0, 1, 2


def _stream_task(min_docs: int, keep_first: bool):
    """Decide runs of equal hashes in sorted rows.

    Kinds of output row: DROP, a line that goes; PENDING, a line of an edge run with too few
    documents here; KNOWN, the first line of an edge run that has enough documents. A run is
    at the edge if it opens or closes the partition. Other runs are settled here. Between
    batches a task holds the open run's rows, or only its first row once it has enough documents.
    """
    names = ["hi", "lo", "id", "tag", "pos", "first"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, carry, enough = None, None, False

        def rows(t: pa.Table, pick: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            if pick.any():
                part = t.filter(pa.array(pick))
                mark = pa.array(np.full(part.num_rows, kind, np.int32))
                yield from part.append_column("kind", mark).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(names)
            if carry is not None:
                t = pa.concat_tables([carry, t]).combine_chunks()
            hi, lo = t.column("hi").to_numpy(), t.column("lo").to_numpy()
            opening = opening or (hi[0], lo[0])
            new = runs(hi, lo)
            cuts = np.append(np.flatnonzero(new), len(hi))
            docs = np.add.reduceat(t.column("first").to_numpy().astype(np.int64), cuts[:-1])
            sure = docs >= min_docs
            sure[0] |= enough
            size = np.diff(cuts)
            of_sure = np.repeat(sure, size)
            edge = np.zeros(len(hi), bool)
            edge[:size[0]] = (hi[0], lo[0]) == opening
            closed = np.ones(len(hi), bool)
            closed[cuts[-2]:] = False
            drop = of_sure & ~new
            if not keep_first:
                drop |= of_sure & new & closed & ~edge
            yield from rows(t, drop, DROP)
            yield from rows(t, of_sure & new & closed & edge, KNOWN)
            yield from rows(t, ~of_sure & closed & edge, PENDING)
            enough = bool(sure[-1])
            carry = t.slice(cuts[-2], 1 if enough else None)
        if carry is not None:
            yield from rows(carry, np.ones(carry.num_rows, bool), KNOWN if enough else PENDING)

    return task


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(id, tag, pos) of every line that goes."""
    id_type = docs.schema["id"].dataType.simpleString()
    row = f"hi bigint, lo bigint, id {id_type}, tag binary, pos int, first boolean"
    lines = materialize(mapped(docs.select("id", "tag", "text"), _line_task, row))
    order = ["hi", "lo", "id", "tag", "pos"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    streamed = materialize(mapped(ranged, _stream_task(min_docs, keep_first), row + ", kind int"))
    edge = streamed.where(F.col("kind") != DROP)
    many = (edge.groupBy(*HASH)
            .agg(F.sum(F.col("first").cast("int")).alias("docs"), F.max("kind").alias("most"),
                 F.min(F.struct("id", "tag", "pos")).alias("earliest"))
            .where((F.col("docs") >= min_docs) | (F.col("most") == KNOWN)))
    late = edge.join(F.broadcast(many), HASH)  # two hashes a partition at most
    if keep_first:
        late = late.where(~F.struct("id", "tag", "pos").eqNullSafe(F.col("earliest")))
    return streamed.where(F.col("kind") == DROP).select("id", "tag", "pos").unionByName(late.select("id", "tag", "pos"))


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bitmaps, counts = [], []
        for gone in batch.column("gone"):
            p = gone.values.to_numpy()
            keep = np.ones(-(-(int(p.max()) + 1) // 8) * 8, bool)  # whole bytes: the padding keeps
            keep[p] = False
            counts.append(int((~keep).sum()))
            bitmaps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(counts, pa.int64()),
                                          pa.array(bitmaps, pa.binary())], ["id", "tag", "n_dropped", "keep_bitmap"])


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                 keep_first: bool = False) -> DataFrame:
    """``id``, ``tag``, ``n_dropped`` and ``keep_bitmap`` of every document that loses a line.

    A line's key is the line without white space at its ends, A-Z lower-cased; lines with an
    empty key always stay. A key held by ``min_docs`` documents or more loses all its lines,
    or with ``keep_first`` all but the first by id, tag and position. The bitmap is
    zlib-compressed, least bit first, one bit a line up to the last dropped line; lines past
    it stay. Rows that share id and text count as documents of their own and share a bitmap.
    Null or empty texts have no keys; a null id sorts first; an empty table gives none.
    """
    docs = keyed(df, id_col, text_col)
    gone = dropped_lines(docs, min_docs, keep_first).groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))
    id_type = docs.schema["id"].dataType.simpleString()
    return mapped(gone, _pack_task, f"id {id_type}, tag binary, n_dropped bigint, keep_bitmap binary")


def _apply_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for t, m in zip(utf8(batch.column("text")), batch.column("keep_bitmap").to_pylist()):
            lines = (t or b"").split(b"\n")
            n_lines.append(len(lines))
            if m is None:
                texts.append(t or b"")
                n_dropped.append(0)
                continue
            keep = np.ones(len(lines), bool)
            bits = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), bitorder="little")[:len(lines)]
            keep[:len(bits)] = bits
            texts.append(b"\n".join(x for x, y in zip(lines, keep.tolist()) if y))
            n_dropped.append(int((~keep).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("rest"),
             pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            ["id", "text", "rest", "n_lines", "n_dropped"])


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, kept ``text`` (null: empty), ``rest``, ``n_lines``, ``n_dropped``."""
    docs = keyed(df, id_col, text_col, rest=True)
    joined = docs.join(bitmaps, null_safe(docs, bitmaps, ("id", "tag")), "left").select(
        docs["id"], docs["text"], docs["rest"], bitmaps["keep_bitmap"])
    schema = T.StructType([docs.schema["id"], T.StructField("text", T.StringType()), docs.schema["rest"],
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return mapped(joined, _apply_task, schema)


def stage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """The input's rows and columns without frequent lines; ``n_chars`` follows the text."""
    out = apply_bitmaps(df, keep_bitmaps(df, id_col, text_col, min_docs), id_col, text_col)
    return restored(out, df, id_col, text_col, {"n_chars": F.length("text").cast("bigint")})
