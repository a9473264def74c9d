"""Packing by lexical retrieval: related documents share a training window.

Documents are dealt into shards of about ``shard_bytes`` of text; the number of
shards grows with the corpus, so a task's memory does not.  A shard's task
tokenises its texts, builds a BM25 inverted index over them (terms: token ids)
and fills windows: a seed document opens a window, the index returns its nearest
unused documents, and these follow in order of score until the window is full.
The document that crosses the end is cut there, and its rest seeds the next
window, so only a shard's last window can be short.

Tokenising is cached by word: the tokenizer splits at white space and treats each
word by itself (a test holds this against whole texts), so a word's ids are looked up
as bytes and a document's ids are a join of bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, small_batches

END_ID = 2
CACHED_WORDS = 400_000  # words a worker remembers between tasks

# Letters of ASCII and Latin-1 (in UTF-8), then ASCII marks: the splitter's two pieces of most words.
_PIECES = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([.,;:!?|*#$%&]*)")


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, .. in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_characters()


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece that the normaliser leaves as it is."""
        got = self.pieces.get(piece)
        if got is None:
            got = np.array([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))], "<u4").tobytes()
            if len(self.pieces) < CACHED_WORDS:
                self.pieces[piece] = got
        return got

    def word(self, word: bytes) -> bytes:
        simple = _PIECES.fullmatch(word)
        if simple:
            letters, marks = simple.groups()
            return (self._piece(letters.decode().lower().encode()) if letters else b"") + (self._piece(marks) if marks else b"")
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        known, parts = self.known, []
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(known) < CACHED_WORDS:
                    known[w] = ids
            parts.append(ids)
        return b"".join(parts)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Bm25:
    """Inverted index over one shard: for each term its documents and their BM25 weights."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(terms)
        sizes = np.array([c.sum() for c in counts], float)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(float) if n else np.zeros(0)
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        self.names, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(first, len(term))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = sizes[self.doc] / max(sizes.mean(), 1) if n else sizes
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
        self.n = n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for a query of distinct terms."""
        at = np.searchsorted(self.names, terms)
        first, size = self.first[at], self.first[at + 1] - self.first[at]
        total = int(size.sum())
        places = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        return np.bincount(self.doc[places], self.weight[places], self.n)


def fill_windows(lengths: np.ndarray, index: Bm25, terms: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of each piece; every window but the last is full."""
    unused = np.ones(len(lengths), bool)
    number = room = 0
    room = window

    def place(doc: int):
        """Lay a whole document down, window after window; yields its pieces."""
        nonlocal number, room
        start = 0
        while start < lengths[doc]:
            n = min(room, int(lengths[doc]) - start)
            yield doc, start, n, number, window - room
            start, room = start + n, room - n
            if not room:
                number, room = number + 1, window

    seed = 0
    carried = -1  # the document whose rest opened the current window
    while True:
        if carried >= 0:
            query = carried
        else:
            while seed < len(lengths) and not unused[seed]:
                seed += 1
            if seed == len(lengths):
                return
            query = seed
            unused[query] = False
            before = number
            yield from place(query)
            if number > before and room == window:  # it ended with its window: a new seed
                continue
        scores = np.where(unused, index.scores(terms[query]), -1.0)
        near = np.argsort(-scores, kind="stable")[:int(unused.sum())]
        carried = -1
        opened = number
        for doc in near:
            unused[doc] = False
            yield from place(int(doc))
            if number > opened:
                carried = int(doc) if room < window else -1
                break
        else:
            return  # nothing is left


def pack_shard(shard: int, ids: list, texts: list[bytes], path: str, window: int) -> pa.Table:
    encode = tokenizer(path)
    end = np.array([END_ID], "<u4").tobytes()
    tokens = [encode(t) + end for t in texts]
    distinct = [np.unique(np.frombuffer(t, "<u4"), return_counts=True) for t in tokens]
    terms, counts = [d[0].astype(np.int64) for d in distinct], [d[1] for d in distinct]
    lengths = np.array([len(t) // 4 for t in tokens], np.int64)
    rows = [(ids[d], start, n, zlib.crc32(tokens[d][4 * start:4 * (start + n)]), int(lengths[d]), (shard << 24) + number, offset)
            for d, start, n, number, offset in fill_windows(lengths, Bm25(terms, counts), terms, window)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096,
         shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    A document is its text's ids and then END_ID.  Sequences are ``window`` long,
    but for the last of each shard.  Defined cases: a null or empty text is the one
    id END_ID; a null id is packed like any other; repeated rows are each packed; an
    empty table gives an empty result; other columns are ignored.  Ties of score
    go to the document that comes first by (id, text).
    """
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    # A hash of the text's id spreads any group of copies; repeats of one id still differ by text.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(shards)).cast("long"))

    def run(key, table):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        packed = pack_shard(key[0].as_py(), table.column("doc_id").to_pylist(),
                            [t.encode() for t in table.column("text").to_pylist()], tokenizer_path, window)
        give_back()
        return packed

    return small_batches(dealt).groupBy("shard").applyInArrow(run, (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
