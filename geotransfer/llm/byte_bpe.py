"""Byte-level BPE by dynamic programming over prefixes.

For a fixed list of ranks every byte prefix has exactly one valid last token: the token that
ends the encoding of that prefix. Storing it per prefix gives the whole encoding by walking
back. A token may follow another if encoding their joined bytes returns the two unchanged, so
the last token at a position is the one whose predecessor (the last token of the prefix before
it) may stand next to it. Appending bytes extends the table; an edit recomputes the table from
the edit until it agrees with the old one for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from geotransfer.llm.common import Memo, keyed, mapped

# Cuts before white space that follows other text; no match of the pattern crosses such a place.
CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
KEPT = 700_000  # chunks, and pieces, that a worker remembers


class Ranks:
    """Token ranks with the tests that the dynamic program needs."""

    def __init__(self, lines: list[bytes]):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.follows = Memo(lambda pair: self.merge(self.bytes[pair[0]] + self.bytes[pair[1]]) == list(pair), 500_000)

    def merge(self, piece: bytes) -> list[int]:
        """Ids by repeated merges of the lowest-ranked neighbours; for a pair of tokens only."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 40:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[p] for p in parts]


class PrefixTable:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece = ranks, b""
        self.last: list[int] = []  # last[k]: last token of the prefix of k + 1 bytes
        self.append(piece)

    def append(self, more: bytes) -> None:
        begin = len(self.piece)
        self.piece += more
        self._extend(begin, len(self.piece))

    def _extend(self, begin: int, end: int) -> None:
        piece, last, rank, follows = self.piece, self.last, self.ranks.rank.get, self.ranks.follows
        longest = self.ranks.longest
        for j in range(begin + 1, end + 1):
            for i in range(j - longest if j > longest else 0, j):
                t = rank(piece[i:j])
                if t is not None and (not i or follows[last[i - 1], t]):
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks lack a single byte")

    def ids(self) -> list[int]:
        out, j = [], len(self.piece)
        while j:
            t = self.last[j - 1]
            out.append(t)
            j -= len(self.ranks.bytes[t])
        return out[::-1]

    def replace(self, begin: int, end: int, by: bytes) -> None:
        """Bytes ``begin:end`` become ``by``; the table is recomputed only until it agrees again."""
        tail, old = self.piece[end:], self.last[end:]
        self.piece, self.last = self.piece[:begin] + by, self.last[:begin]
        self._extend(begin, len(self.piece))
        agree = 0
        for k in range(len(tail)):
            n = len(self.piece)
            self.piece += tail[k:k + 1]
            self._extend(n, n + 1)
            agree = agree + 1 if self.last[-1] == old[k] and len(self.ranks.bytes[old[k]]) <= k + 1 else 0
            if agree >= self.ranks.longest:  # every later entry depends on these only
                self.piece += tail[k + 1:]
                self.last += old[k + 1:]
                return


class BytePairEncoder:
    def __init__(self, lines: list[bytes], pattern: str):
        self.ranks = Ranks(lines)
        self.pattern = regex.compile(pattern)
        self.pieces = Memo(self._piece, KEPT)
        self.chunks = Memo(self._chunk, KEPT)

    def _piece(self, piece: str) -> bytes:
        return np.array(PrefixTable(self.ranks, piece.encode()).ids(), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; each match of the pattern is encoded on its own."""
        if OTHER_SPACE.search(text):
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(text)))


@lru_cache(maxsize=2)
def _encoder(lines: tuple[bytes, ...], pattern: str) -> BytePairEncoder:
    return BytePairEncoder(list(lines), pattern)


def read_ranks(path: str) -> tuple[bytes, ...]:
    with open(path, "rb") as f:
        return tuple(f.read().splitlines())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens`` and ``ids`` (little-endian 32-bit) of every row.

    Null and empty texts have no ids. Ids of rows play no part: null ids and repeated rows are
    encoded row by row. An empty table gives an empty table. Extra columns are not read.
    ``path`` is read in the tasks (part of an installed package).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(read_ranks(path), pattern)
        for batch in batches:
            ids = [e.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["id", "n_tokens", "ids"])

    docs = keyed(df, id_col, text_col).select("id", "text")
    return mapped(docs, task, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space) and ``decoded`` bytes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_ranks(path))}
        size = max(rank.values()) + 1
        text, decimal = [b""] * size, [str(k).encode() for k in range(size)]
        for t, r in rank.items():
            text[r] = t
        for batch in batches:
            sums, out = [], []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), "<u4").tolist()
                out.append(b"".join(map(text.__getitem__, ids)))
                sums.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array(sums, pa.string()),
                                              pa.array(out, pa.binary())], ["id", "n_tokens", "ids_sha256", "decoded"])

    id_type = encoded.schema["id"].dataType.simpleString()
    return mapped(encoded, task, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded binary")
