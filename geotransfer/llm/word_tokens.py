"""Token ids of whole texts by a ``tokenizers`` file, with bounded memory of words already encoded.

Text is cut at spaces and line feeds, which the tokenizer's pattern drops and never crosses.
A chunk that a worker has not met lately goes to the library; a chunk of plain Latin letters and
ASCII punctuation is encoded piece by piece through the library's model, because words in
different case or next to different punctuation then share their pieces.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from geotransfer.llm.common import Memo

# Letters that lower-case one to one and that no normal form changes, then ASCII punctuation without the
# apostrophe (which may start a contraction) and "<" (which may start a special token).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")
KEPT = 800_000  # chunks, and pieces, that a worker remembers


def _byte_letters() -> dict[int, str]:
    """The usual printable letter of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Little-endian 32-bit ids of texts; equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = PLAIN.fullmatch if all("<" in s for s in special) else lambda chunk: None
        self.letters = _byte_letters()
        self.pieces = Memo(self._piece, KEPT)
        self.chunks = Memo(self._chunk, KEPT)

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        plain = self.plain(chunk)
        if plain:
            word, marks = plain.groups()
            ids = self.pieces[word.lower()] if word else b""
            return ids + self.pieces[marks] if marks else ids
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_chunks(self, text: str) -> tuple[list[str], list[bytes]]:
        """Chunks of the text (line feeds are chunks of their own) and the ids of each."""
        chunks = text.replace("\n", " \n ").split(" ")
        return chunks, list(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_chunks(text)[1])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
