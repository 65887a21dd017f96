"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents keep the order of their ids. Cuts are allowed after documents (free), after
sentences (small penalty) and, where neither lies close, inside a sentence (larger penalty).
With f(j) the least cost of cutting the stream at boundary j and t(j) its tokens so far,

    f(j) = penalty(j) + size - t(j) + min { f(i) + t(i) : t(j) - t(i) <= size },

whose minimum a monotone queue yields in constant time per boundary. A task runs this over
bounded stretches of its range of documents and carries the last windows of a stretch into
the next one. The rest at the very end of a range is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geotransfer.llm.common import keyed, mapped
from geotransfer.llm.word_tokens import encoder

STRETCH = 1 << 20  # tokens per run of the dynamic program
SENTENCE, INSIDE = 4.0, 48.0  # penalties, in tokens of padding


def cut_windows(ends: np.ndarray, penalty: np.ndarray, size: int, tail: Callable[[int], float] | None = None) -> list[int]:
    """Indexes of the chosen boundaries. ``ends`` ascends by at most ``size``; the last one is always chosen.

    ``tail`` gives the cost of a last window by its length in place of its padding.
    """
    t, c = [0, *ends.tolist()], [0.0, *penalty.tolist()]
    cost, back = [0.0] * len(t), [0] * len(t)
    queue: deque[int] = deque()  # indexes with rising f + t
    for j in range(1, len(t)):
        v = cost[j - 1] + t[j - 1]
        while queue and cost[queue[-1]] + t[queue[-1]] > v:
            queue.pop()
        queue.append(j - 1)
        low = t[j] - size
        while t[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        cost[j] = c[j] + size - t[j] + cost[i] + t[i]
        back[j] = i
    if tail and len(t) > 1:
        end = t[-1]
        begin = next(i for i, x in enumerate(t) if end - x <= size)
        back[-1] = min(range(begin, len(t) - 1), key=lambda i: (cost[i] + tail(end - t[i]), -i))
    chosen, j = [], len(t) - 1
    while j:
        chosen.append(j - 1)
        j = back[j]
    return chosen[::-1]


def _boundaries(at: np.ndarray, penalty: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries with their least penalties, with inner cuts added wherever a gap passes an eighth of a window."""
    inside = (at > 0) & (at <= total)
    at, penalty = np.append(at[inside], total), np.append(penalty[inside], 0.0 if total not in at[inside][-1:] else SENTENCE)
    order = np.lexsort((penalty, at))
    at, penalty = at[order], penalty[order]
    first = np.append(True, at[1:] != at[:-1])
    ends, penalty = at[first], penalty[first]
    step = max(size // 8, 1)
    gaps = np.diff(ends, prepend=0)
    inner = [np.arange(e - g + step, e, step) for e, g in zip(ends[gaps > step], gaps[gaps > step])]
    if inner:
        more = np.concatenate(inner)
        ends, penalty = np.append(ends, more), np.append(penalty, np.full(len(more), INSIDE))
        order = np.argsort(ends)
        ends, penalty = ends[order], penalty[order]
    return ends, penalty


def _tail(length: int, size: int) -> tuple[float, list[int]]:
    """Cost and windows of a last stretch of at most ``size``: powers of two if that is cheaper than its padding."""
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    padding = 0 if len(powers) == 1 else size - length
    cuts = (len(powers) - 1) * INSIDE
    return (cuts, powers) if cuts < padding else (padding, [length])


_FREE = np.zeros(1)


class Stream:
    """Pieces of documents that wait for their windows."""

    def __init__(self, size: int):
        self.size, self.n = size, 0
        self.docs: list[tuple] = []  # (key, start in document, ids, tokens of the document)
        self.at: list[np.ndarray] = []  # boundaries and their penalties
        self.penalty: list[np.ndarray] = []

    def add(self, key, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append((key, 0, ids, len(ids)))
        self.at += [sentences + self.n, np.array([self.n + len(ids)])]
        self.penalty += [np.full(len(sentences), SENTENCE), _FREE]
        self.n += len(ids)

    def take(self, last: bool) -> Iterator[list[tuple]]:
        """Windows as lists of (key, start, ids, tokens of the document). The last two stay unless ``last``."""
        if not self.n:
            return
        at, fee = np.concatenate(self.at), np.concatenate(self.penalty)
        ends, penalty = _boundaries(at, fee, self.n, self.size)
        # Inside the stream the last window costs nothing: it goes on with the next stretch.
        end = (lambda n: _tail(n, self.size)[0]) if last else (lambda n: 0.0)
        cuts = ends[cut_windows(ends, penalty, self.size, end)].tolist()
        if not last:
            cuts = cuts[:-2]
        elif cuts:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts = [*cuts[:-1], *(begin + np.cumsum(_tail(cuts[-1] - begin, self.size)[1])).tolist()]
        k, used, done = 0, 0, 0
        for cut in cuts:
            window = []
            while done < cut:
                key, start, ids, total = self.docs[k]
                n = min(len(ids) - used, cut - done)
                window.append((key, start + used, ids[used:used + n], total))
                used, done = used + n, done + n
                if used == len(ids):
                    k, used = k + 1, 0
            yield window
        rest = self.docs[k:]
        if rest and used:
            key, start, ids, total = rest[0]
            rest[0] = (key, start + used, ids[used:], total)
        self.docs, self.n = rest, self.n - done
        self.at, self.penalty = [at[at > done] - done], [fee[at > done]]


ENDS = np.zeros(0x110000, bool)  # last characters of chunks that close a sentence
ENDS[[ord(c) for c in ".!?…\n"]] = True


def ended_chunks(text: str) -> np.ndarray:
    """Places of the chunks (see ``WordEncoder.encode_chunks``) that close a sentence."""
    codes = np.frombuffer((text.replace("\n", " \n ") + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.flatnonzero(codes == 32)
    return np.flatnonzero(ENDS[codes[blank - 1]])  # an empty chunk follows a blank, the first one the closing blank


def _pack_task(path: str, size: int, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stream, serial = encoder(path), Stream(size), 0
        base = TaskContext.get().partitionId() << 40
        closing = np.array([end_id], "<u4").tobytes()
        id_type = None

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            out = []
            for window in stream.take(last):
                offset = 0
                for key, start, ids, total in window:
                    raw = ids.tobytes()
                    out.append((key, start, len(ids), zlib.crc32(raw), total, base + serial, offset, raw))
                    offset += len(ids)
                serial += 1
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            id_type = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                _, ids = words.encode_chunks(text)
                cuts = [0, *(ended_chunks(text) + 1).tolist()]
                sentences = [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                upto = np.cumsum(np.fromiter(map(len, sentences), np.int64, len(sentences))) >> 2
                sentences += [*ids[cuts[-1]:], closing]
                stream.add(key, np.frombuffer(b"".join(sentences), "<u4"), upto)
                if stream.n >= STRETCH:
                    yield from rows(False)
        yield from rows(True)

    return task


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096,
         end_id: int = 2) -> DataFrame:
    """One row per piece of a document: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (little-endian 32-bit).

    Documents are dealt in ranges of (id, text checksum); each range is a stream of its own, so
    only its last window may be short. Null and empty texts hold the end id alone. Null ids come
    first; repeated rows are documents of their own, side by side. An empty table gives no piece.
    Extra columns of the input are not read.
    """
    docs = keyed(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "id", "tag").sortWithinPartitions("id", "tag")
    return mapped(ordered, _pack_task(path, size, end_id),
                  f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                  "sequence_id bigint, offset bigint, ids binary")


def stage(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``pack`` with the input's name of the id; nulls and empty tables as there."""
    return pack(df, path, id_col, text_col).withColumnRenamed("id", id_col)
