"""Ids of whole texts from the tokenizers library, through the cache of chunks."""

from __future__ import annotations

import json
import os

from .bpe import byte_symbols, pack
from .chunks import ChunkCache
from .common import held


#: What may follow a word in a chunk that goes to the model without the library's pre-tokenizer.
MARKS = ".,;:!?"
#: Letters below this one are letters to every version of Unicode.
LAST_LETTER = "\u0250"


class LibraryEncoder(ChunkCache):
    """`path`: a tokenizers file whose pre-tokenizer is byte-level, or one that drops white space between words.

    A chunk of letters, with a blank before and MARKS behind, has one piece of letters and one of marks in either kind of file;
    its pieces go straight to the library's model, which takes half the time. All other chunks go through the whole library.
    """

    def __init__(self, path: str, limit: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_blanks = spec["pre_tokenizer"]["type"] == "Sequence" and any(p.get("behavior") == "Removed" for p in spec["pre_tokenizer"]["pretokenizers"])
        self.symbols = dict(enumerate(byte_symbols()))
        self.blank = self.symbols[32]
        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        super().__init__(self.packed, tuple(t["content"] for t in spec["added_tokens"]), limit)

    def piece(self, text: str) -> list[int]:
        """The ids of a piece, by the model alone."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(text)]

    def marks_ids(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self.piece(marks)
        return self.marks[marks]

    def packed(self, chunks: list[str]) -> list[bytes]:
        """A chunk of one word by the model, any other by the whole library."""
        found: list[bytes | None] = []
        others = []
        for chunk in chunks:
            word = chunk.rstrip(MARKS)
            if self.drops_blanks:
                letters = word
                fits = word.isalpha() and (word.isascii() or word.islower() and max(word) < LAST_LETTER)
            else:
                letters = word[1:]
                fits = letters.isalpha() and word[0] == " " and (word.isascii() or max(letters) < LAST_LETTER)
            if not fits:
                others.append(chunk)
                found.append(None)
                continue
            if self.drops_blanks:
                letters = letters.lower()
            else:
                letters = self.blank + letters if word.isascii() else word
            ids = [t.id for t in self.model.tokenize(letters)] if word.isascii() else self.piece(letters)
            found.append(pack(ids + self.marks_ids(chunk[len(word) :]) if len(word) < len(chunk) else ids))
        if not others:
            return found
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [pack(next(rest).ids) if ids is None else ids for ids in found]

    def cut(self, text: str) -> list[str]:
        if not self.drops_blanks:
            return super().cut(text)
        if any(s in text for s in self.specials):
            return [text]
        return text.replace("\n", " ").split(" ")


def encoder(path: str) -> LibraryEncoder:
    """The one of this Python worker."""
    return held(path, lambda: LibraryEncoder(path))
