"""Batch word arithmetic against plain Python."""
import random
import re

import numpy as np
import pyarrow as pa

from pathweave.llm import words as W
from pathweave.llm.minhash import shingle_sets, signatures
from pathweave.llm.statistics import document_statistics

TEXTS = [None, "", " \t\n", "one", "a b  c\x0bd\x0ce\rf\n", "Ünïcode wörds stay one word", "x" * 5000, "end ", " start",
         "a a a a a a a a a", "same line\nsame line\n\nother\nsame line", "#!|* $%&<> A1"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _split(text):
    return WORD.findall(text or "")


def test_words_are_the_contracts():
    w = W.Words(pa.array(TEXTS))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in TEXTS for x in _split(t)]
    assert list(w.counts) == [len(_split(t)) for t in TEXTS]
    assert list(w.doc) == [i for i, t in enumerate(TEXTS) for _ in _split(t)]


def test_hashes_depend_on_the_word_only():
    w = W.Words(pa.array(TEXTS + TEXTS[::-1]))
    seen = {}
    for h, a, b in zip(w.hashes(), w.start, w.end):
        assert seen.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_chunks():
    whole = pa.array(["skip me", *TEXTS, "not me"])
    part = whole.slice(1, len(TEXTS))
    assert np.array_equal(W.Words(part).hashes(), W.Words(pa.array(TEXTS)).hashes())
    rows = [t for _, c in W.text_chunks(part, 100) for t in c.to_pylist()]
    assert rows == TEXTS
    assert [lo for lo, _ in W.text_chunks(pa.array([], pa.string()))] == []


def test_sequence_hashes_and_sliding_min():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 400).astype(np.uint64)
    for n in (1, 2, 5, 50):
        h = W.sequence_hashes(x, n)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(tuple(x[i:i + n]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
        assert list(W.sliding_min(x, n)) == [min(x[i:i + n]) for i in range(len(x) - n + 1)]
    assert len(W.sequence_hashes(x[:3], 5)) == 0


def test_shingle_sets():
    random.seed(1)
    texts = [" ".join(random.choices("abAB", k=random.randint(0, 30))) for _ in range(50)] + TEXTS
    values, bounds = shingle_sets(pa.array(texts), 5)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = {}
    for i, t in enumerate(texts):
        w = _split((t or "").translate(lower))
        want = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        got = values[bounds[i]:bounds[i + 1]]
        assert len(got) == len(want)
        assert names.setdefault(frozenset(want), tuple(got)) == tuple(got)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (3, 20, 500):  # far fewer and far more members than bins
        errors = []
        for _ in range(20):
            union = W.mix(rng.integers(0, 1 << 62, size * 4).astype(np.uint64))
            a, b = np.sort(union[:size * 3]), np.sort(union[size:])
            sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 300)
            errors.append((sig[0] == sig[1]).mean() - 0.5)
        assert abs(np.mean(errors)) < 0.1


def test_document_statistics():
    got = document_statistics(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        words, t = _split(t), t or ""
        assert got["n_words"][i] == len(words)
        assert got["word_chars"][i] == sum(map(len, words))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t)
        assert got["n_distinct_words"][i] == len(set(words))
        lines = [x for x in t.split("\n") if _split(x)]
        assert got["n_lines"][i] == len(lines)
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        grams = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert got["n_repeat_words"][i] == len(covered)
