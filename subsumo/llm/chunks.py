"""Encoding of whole texts through a bounded cache of chunks.

A byte-level or word-level BPE encodes a text as the concatenation of its pieces' ids. Cutting a text before every
single blank or newline that a non-space character follows never cuts through a piece (the pre-tokenizer's pattern ends a
piece there in any case), so that the ids of a chunk do not depend on its neighbours and can be looked up. Texts for
which this does not hold (a blank or newline followed by white space, NUL, special tokens) are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import islice

UNSAFE = re.compile(r"[ \n]\s|\x00")
#: Chunks above this length are not kept.
LONGEST_KEPT = 48
#: About what a kept chunk takes besides its characters and ids.
OVERHEAD = 140


def older_half(kept: dict) -> dict:
    """Frequent entries come early, so that the newer half goes when a cache is full."""
    return dict(islice(kept.items(), len(kept) // 2))


class ChunkCache:
    """`encode_chunks` maps a list of texts to their ids as little-endian 32-bit integers; about `limit` bytes of short chunks are kept."""

    def __init__(self, encode_chunks: Callable[[list[str]], Iterable[bytes]], specials: tuple[str, ...] = (), limit: int = 64 << 20):
        self.encode_chunks, self.specials, self.limit = encode_chunks, specials, limit
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def cut(self, text: str) -> list[str]:
        if UNSAFE.search(text) or any(s in text for s in self.specials):
            return [text]
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")

    def keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) > LONGEST_KEPT:
            return
        if self.size > self.limit:
            self.kept = older_half(self.kept)
            self.size //= 2
        self.kept[chunk] = ids
        self.size += OVERHEAD + len(chunk) + len(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            chunks = self.cut(text) if text else []
            found = list(map(self.kept.get, chunks))
            try:
                out.append(b"".join(found))
            except TypeError:  # some are not kept
                missing = list({c for c, ids in zip(chunks, found, strict=True) if ids is None})
                fresh = dict(zip(missing, self.encode_chunks(missing), strict=True))
                for chunk, ids in fresh.items():
                    self.keep(chunk, ids)
                out.append(b"".join([fresh[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]))
        return out
