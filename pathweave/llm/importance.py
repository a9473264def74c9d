"""Importance resampling towards a target: an Aho-Corasick dictionary emits hash payloads.

A text's words are maximal runs of bytes outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F``
(A-Z lower-cased first); its features are its words and its pairs of neighbouring
words, joined by one blank.  A feature's bucket is its CRC-32 modulo ``buckets``.

1. Every byte that belongs to no word becomes a blank, so a distinct word bounded by
   blanks is one dictionary entry, and a scan of the text by the automaton emits
   exactly one match a word.  An entry's payload is its CRC and its length.
2. CRCs compose: crc(a + b) is crc(a) moved on by len(b) zero bytes, xor crc(b).  A
   pair's bucket comes from two neighbouring payloads; no pair is spelled out.
3. Each task fills its dictionary as it goes: a word that the automaton doesn't hold
   leaves a gap in the matches, gets its payload from its bytes, and is an entry from
   the next rebuild on.  The dictionary is bounded; words beyond it are always
   hashed from their bytes.
4. One pass counts buckets (at most ``buckets`` rows leave a task), the gains of all
   buckets go into a second pass that scores texts.  Ranks come from one range
   partitioning of the small score rows, shifted by the counts of the partitions.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import documents, small_batches
from .words import text_chunks

DICTIONARY_WORDS = 1 << 17  # entries of a task's automaton
DICTIONARY_BYTES = 64       # longer words are hashed from their bytes each time
CRC_POLYNOMIAL = 0xEDB88320

_BYTE_CLASS = np.full(256, 0x20, np.uint8)
_BYTE_CLASS[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTE_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTE_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTE_CLASS[0x80:] = np.arange(0x80, 0x100)


def _zero_operators(count: int) -> np.ndarray:
    """Table k moves a CRC on by 2^k zero bytes, one lookup for each of its four bytes: shape (count, 4, 256)."""
    def squared(rows):  # a matrix is 32 numbers: the images of the single bits
        return [image(rows, r) for r in rows]

    def image(rows, x):
        y = 0
        for bit in range(32):
            if x >> bit & 1:
                y ^= rows[bit]
        return y

    one_bit = [CRC_POLYNOMIAL] + [1 << (b - 1) for b in range(1, 32)]
    matrix = squared(squared(squared(one_bit)))  # eight zero bits
    tables = np.zeros((count, 4, 256), np.uint32)
    for k in range(count):
        for part in range(4):
            for bit in range(8):
                tables[k, part, 1 << bit:2 << bit] = tables[k, part, :1 << bit] ^ np.uint32(matrix[8 * part + bit])
        matrix = squared(matrix)
    return tables


_OPERATORS = _zero_operators(32)


def crc_after(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) moved on by so many zero bytes."""
    crc = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        x, table = crc[at], _OPERATORS[k]
        crc[at] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    return crc


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of a + b, given the CRCs of a and b and the length of b."""
    return crc_after(left, length) ^ right


class Dictionary:
    """Blank-bounded distinct words of what a task has read so far, with payloads."""

    def __init__(self, limit: int = DICTIONARY_WORDS):
        self.limit, self.words = limit, {}
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.automaton, self.built = None, 0

    def _rebuild(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, number in self.words.items():
            self.automaton.add_word(f" {word} ", number)
        self.automaton.make_automaton()
        self.built = len(self.words)
        self.crc = np.fromiter((zlib.crc32(w.encode("latin-1")) for w in self.words), np.uint32, self.built)
        self.length = np.fromiter(map(len, self.words), np.int64, self.built)

    def payloads(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length) of each word of ``data``, whose words are [start, end); ``data`` begins and ends with a blank."""
        text = data.tobytes().decode("latin-1")  # one character a byte
        crc, length = np.zeros(len(start), np.uint32), end - start
        known = np.zeros(len(start), bool)
        if self.built:
            found = np.fromiter((x for match in self.automaton.iter(text) for x in match), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, found[:, 0])  # a match ends on the blank after its word
            crc[at], known[at] = self.crc[found[:, 1]], True
        for w in np.flatnonzero(~known).tolist():
            word = text[start[w]:end[w]]
            crc[w] = zlib.crc32(word.encode("latin-1"))
            if len(word) <= DICTIONARY_BYTES and len(self.words) < self.limit:
                self.words.setdefault(word, len(self.words))
        if len(self.words) > 1.25 * self.built + 256 or (len(self.words) == self.limit > self.built):
            self._rebuild()
        return crc, length


def feature_buckets(texts: pa.Array, dictionary: Dictionary, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, row of each feature, bucket of each feature) of some texts (null: no words)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    # Each row is followed by a blank, the first one also preceded by one: words of two rows never touch.
    bounds = offsets - offsets[0]
    place = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))
    data = np.full(len(raw) + n + 1, 0x20, np.uint8)
    data[place] = _BYTE_CLASS[raw]
    solid = data != 0x20
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    end = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    row = np.searchsorted(bounds[1:] + np.arange(2, n + 2), start, side="right")
    crc, length = dictionary.payloads(data, start, end)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    blank = np.full(1, zlib.crc32(b" "), np.uint32)
    left = composed(crc[pair], np.repeat(blank, len(pair)), np.ones(len(pair), np.int64))
    pairs = composed(left, crc[pair + 1], length[pair + 1])
    rows = np.concatenate([row, row[pair]])
    return np.bincount(row, minlength=n), rows, (np.concatenate([crc, pairs]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts: counted inside the tasks, at most ``buckets`` numbers reach the driver."""
    def count(batches):
        dictionary, total = Dictionary(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                total += np.bincount(feature_buckets(texts, dictionary, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    texts = small_batches(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")))
    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket, one added to each count."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * g) for a Gumbel variate g that depends on the id alone (null: on an empty id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def _scores(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, seed: int) -> DataFrame:
    def weigh(batches):
        dictionary = Dictionary()
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, texts in text_chunks(batch.column("text")):
                words, row, bucket = feature_buckets(texts, dictionary, len(gain))
                features = np.bincount(row, minlength=len(texts))
                total = np.bincount(row, weights=gain[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers below 2^53: exact
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(texts)), pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    rows = small_batches(documents(docs, f"`{id_col}`", f"`{text_col}`"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
                        percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of ``docs``.

    ``weight`` is the floored mean gain of the text's features, ``score`` adds the
    noise of the id.  Of the N rows with at least ``min_words`` words, the
    floor(``percent`` * N / 100) highest scores are drawn and ranked from 1, ties to
    the smaller id; the others' rank is null.  This draws without replacement, in
    proportion to exp(weight / 1000).  Defined cases: a null or empty text has no
    features, weight 0, and is never drawn; a null id is scored like any other and
    comes last among equal scores; rows that repeat an id are rows like any other
    (equal ones rank in an arbitrary order); an empty target has no features; an empty
    table gives an empty result; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    scored = cut_lineage(_scores(docs, id_col, text_col, gain, seed).withColumn("place", F.monotonically_increasing_id()), "scores")  # no texts
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    ranged = cut_lineage(able.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    offset = F.expr(f"array({', '.join(f'{n}L' for n in before)})[part]")
    rank = (offset + F.row_number().over(Window.partitionBy("part").orderBy(*order))).cast("long")
    ranked = ranged.withColumn("rank", F.when(rank <= drawn, rank)).drop("part")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; rows that repeat an id go by the id's best rank.  See ``importance_resample``; null ids are never drawn."""
    ranked = importance_resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return row.join(ranked.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("row.*")
