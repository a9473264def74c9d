"""Histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of the labelled rows (``sample_rows``); its
statistics are binned by quantiles, and trees of a fixed depth grow level by
level from histograms of gradients.  The trees are kept as flat arrays in heap
order (children of i: 2i + 1, 2i + 2), so a batch of documents walks a tree with one
vectorised step for each level.  Scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, fold
from .statistics import document_statistics
from .words import text_chunks


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; only the text decides them."""
    c = {k: v.astype(np.float64) for k, v in document_statistics(texts).items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    chars, letters = np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.stack([
        c["n_words"], c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / letters, c["n_marks"] / words,
        c["n_digits"] / chars, c["n_pipes"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct_words"] / words, c["n_lines"] / words, c["n_letters"] / chars, c["n_stops"] / words, c["n_high"] / chars,
        c["n_plain_words"] / words, c["n_edge_words"] / words], axis=1)


@dataclass
class Trees:
    """All trees in flat arrays: inner nodes [tree, node], leaves [tree, leaf]."""
    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2 ** self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
              ridge: float = 1.0, least_weight: float = 1.0) -> Trees:
    """Logistic boosting.  No rows: every score is 0.5; one class only: its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves, width = 2 ** depth - 1, 2 ** depth, x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Trees(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)  # an unsplit node sends all rows left
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            slot = ((node - first)[:, None] * width + np.arange(width)) * bins + binned
            sums = [np.bincount(slot.ravel(), np.repeat(v, width), count * width * bins).reshape(count, width, bins) for v in (gradient, hessian)]
            left_g, left_h = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            all_g, all_h = (s.sum(axis=2, keepdims=True) for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - all_g ** 2 / (all_h + ridge)
            gain[(left_h < least_weight) | (right_h < least_weight)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, gradient, leaves) / (np.bincount(leaf_of, hessian, leaves) + ridge)
        margin += leaf[leaf_of]
        trees.append((feature, threshold, leaf))
    return Trees(depth, base, *(np.array(a) for a in zip(*trees)))


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample_rows`` labelled documents, picked by a hash of the id.

    Both frames are already named: docs (doc_id, text), labels (doc_id, label).
    """
    picked = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))

    def body(batch: pa.RecordBatch):
        for lo, texts in text_chunks(batch.column("text")):
            x = features(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, len(x)), flat], names=["label", "x"])

    rows = arrow_map(docs.join(F.broadcast(picked), "doc_id").select("label", "text"), body, "label int, x array<double>").collect()
    width = features(pa.array([""])).shape[1]
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), width)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # rows arrive in any order; sums of floats shouldn't depend on it
    return x[order], np.array([r["label"] for r in rows], float)[order]


def _learned(docs: DataFrame, labels: DataFrame, id_col, text_col, label_id_col, label_col, folds, held_out, sample_rows) -> Trees:
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return fit_trees(*training_sample(documents(docs, id_col, text_col), known.where(fold("doc_id", folds) != held_out), sample_rows))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
                   label_col: str = "quality", folds: int = 3, held_out: int = 1, sample_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more; learned as in ``quality_scores``."""
    trees = _learned(docs, labels, id_col, text_col, label_id_col, label_col, folds, held_out, sample_rows)
    place = docs.columns.index(text_col)

    def body(batch: pa.RecordBatch):
        good = [trees.scores(features(texts.cast(pa.string()))) >= 0.5 for _, texts in text_chunks(batch.column(place))]
        if good:
            yield batch.filter(pa.array(np.concatenate(good)))

    return arrow_map(docs, body, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
                   label_col: str = "quality", folds: int = 3, held_out: int = 1, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learned from labelled rows whose crc32(id as text) mod ``folds`` isn't
    ``held_out``.  Defined cases: a null text scores as an empty one; a null id is
    scored, its ``held_out`` is false; of repeated labels the lowest counts; without
    usable labels every score is 0.5; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    trees = _learned(docs, labels, id_col, text_col, label_id_col, label_col, folds, held_out, sample_rows)

    def body(batch: pa.RecordBatch):
        for lo, texts in text_chunks(batch.column("text")):
            scores = trees.scores(features(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "held_out")]
                + [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, body, "doc_id long, held_out boolean, score double, predicted int")
