"""Statistics of whole texts, for many texts at a time.

``document_statistics`` counts for each row (null: all 0):

n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``),
n_lines (``\\n``-split lines with a word), n_dup_lines (of these, equal to an
earlier line), n_repeat_words (words in 5-word windows that the text has twice
or more), n_distinct_words, n_upper and n_letters (A-Z; A-Z and a-z),
n_digits, n_marks (``!?``), n_pipes, n_stops (``.,;:``), n_high (code points
beyond ASCII), n_plain_words (words that hold an A-Z, a-z or non-ASCII byte),
n_edge_words (words whose last byte is not a letter).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, sequence_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper",
          "n_letters", "n_digits", "n_marks", "n_pipes", "n_stops", "n_high", "n_plain_words", "n_edge_words")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_SYMBOL, _DIGIT, _MARK, _PIPE, _STOP = (_class(c) for c in (b"#*$%&|<>", b"0123456789", b"!?", b"|", b".,;:"))
_LEAD = ~_class(bytes(range(0x80, 0xC0)))  # bytes that begin a code point
_HIGH = _class(bytes(range(0xC0, 0x100)))


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lines, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, data in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if data and b"\n" in data:
            full = [x for x in data.split(b"\n") if x and not x.isspace()]  # bytes.isspace: exactly the six separators
            lines[i], repeats[i] = len(full), len(full) - len(set(full))
        elif data and not data.isspace():
            lines[i] = 1
    return lines, repeats


def _in_repeats(w: Words, hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Which words lie in a window of ``n`` words that its text has more than once."""
    covered = np.zeros(len(w.start) + 1, np.int64)
    grams = sequence_hashes(hashes, n)
    begin = np.flatnonzero(w.room(n)[:len(grams)])
    if len(begin):
        order = np.lexsort((grams[begin], w.doc[begin]))
        at = begin[order]
        same = (grams[at][1:] == grams[at][:-1]) & (w.doc[at][1:] == w.doc[at][:-1])
        often = np.zeros(len(at), bool)
        often[1:] |= same
        often[:-1] |= same
        np.add.at(covered, at[often], 1)
        np.add.at(covered, at[often] + n, -1)
    return np.cumsum(covered[:-1]) > 0


def document_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    w = Words(texts)
    hashes = w.hashes()
    rows = w.rows

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    def words_where(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc[flags], minlength=rows).astype(np.int64)

    letter = _LETTER[w.data]
    wordy = np.concatenate([[0], np.cumsum(letter | (w.data >= 0x80), dtype=np.int64)])
    order = np.lexsort((hashes, w.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    lines, repeats = _lines(texts)
    return {
        "n_words": w.counts.astype(np.int64), "word_chars": per_row(w.solid & _LEAD[w.data]), "n_symbols": per_row(_SYMBOL[w.data]),
        "n_lines": lines, "n_dup_lines": repeats, "n_repeat_words": words_where(_in_repeats(w, hashes)),
        "n_distinct_words": words_where(order[fresh]), "n_upper": per_row(_UPPER[w.data]), "n_letters": per_row(letter),
        "n_digits": per_row(_DIGIT[w.data]), "n_marks": per_row(_MARK[w.data]), "n_pipes": per_row(_PIPE[w.data]),
        "n_stops": per_row(_STOP[w.data]), "n_high": per_row(_HIGH[w.data]),
        "n_plain_words": words_where(wordy[w.end] > wordy[w.start]),
        "n_edge_words": words_where(~letter[w.end - 1] & (w.data[w.end - 1] < 0x80)) if len(w.end) else np.zeros(rows, np.int64),
    }
