"""Counts over whole texts, for the quality classifier and the quality rules. A null text has no words."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa

from .common import held, slices

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_commas", "n_bangs", "n_wide", "longest")

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
CONTINUED, ASCII = bytes(range(128, 192)), bytes(range(128))


def repeated_words(words: list[bytes], distinct: int | None = None) -> int:
    """How many words stand in a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(dict.fromkeys(words), count()))
    ids, v = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    pair = ids[:-1] * v + ids[1:]
    if v > 1 << 20:  # so that the windows' numbers fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * v + ids[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(window, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def counts(text: str | None) -> list[int]:
    """The FIELDS of a text."""
    if not text:
        return [0] * len(FIELDS)
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return [
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, DIGITS)),
        text.count("."),
        text.count(","),
        text.count("!") + text.count("?"),
        len(text) - (len(data) - len(data.translate(None, ASCII))),
        len(max(words, key=len)) if words else 0,
    ]


def measured(texts: pa.Array) -> np.ndarray:
    """A row of counts for each text."""
    held("statistics", bool)  # what another operator keeps in this worker goes
    return np.array([counts(t) for part in slices(texts) for t in part], np.int64).reshape(len(texts), len(FIELDS))


FEATURES = ("log words", "word length", "symbols", "repeated lines", "repeated words", "words in a line", "distinct", "upper", "digits", "stops", "commas", "bangs", "wide", "longest")


def ratios(c: np.ndarray) -> np.ndarray:
    """The FEATURES of rows of counts."""
    c = c.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.column_stack([
        np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, np.log1p(c[:, 0] / lines), c[:, 6] / words,
        c[:, 7] / chars, c[:, 8] / chars, c[:, 9] / words, c[:, 10] / words, c[:, 11] / words, c[:, 12] / chars, np.log1p(c[:, 13]),
    ])
