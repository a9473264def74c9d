"""Language identification by multilingual mixture inference.

A text is a bag of byte trigrams (letters and non-ASCII bytes, A-Z lower-cased,
everything else one space; one trigram around each letter), hashed into
``BUCKETS``.  Training counts the trigrams of all training documents by language.
A document's trigrams are then seen as drawn from a mixture of languages:
expectation-maximisation estimates the proportions.  The set of languages
starts as the best single one and grows by the language with the largest
remaining proportion, as long as the log-likelihood gains more than the penalty;
the prediction is the largest proportion within the selected set.
All documents of a chunk run through EM together, as sparse arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, fold
from .words import Words, mix, text_chunks

BUCKETS = 1 << 16
UNKNOWN = "und"

_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[0x80:] = np.arange(0x80, 0x100)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_U = np.uint64


@dataclass
class Trigrams:
    """Distinct (row, bucket) pairs of some texts, by row, with their counts."""
    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    rows: int


def trigrams(texts: pa.Array) -> Trigrams:
    w = Words(texts)
    data = _FOLDED[w.data]
    at = np.flatnonzero(data != 32)
    row = np.searchsorted(w.bounds, at, side="right") - 1
    before, after = np.full(len(data) + 1, 32, np.uint8), np.full(len(data) + 1, 32, np.uint8)
    before[1:] = data
    after[:-2] = data[1:]
    before[w.bounds[:-1]] = 32  # a text doesn't see its neighbours
    ends = w.bounds[1:]
    after[ends[ends > 0] - 1] = 32
    code = (before[at].astype(np.uint64) << _U(16)) | (data[at].astype(np.uint64) << _U(8)) | after[at].astype(np.uint64)
    bucket = mix(code * _U(0x9E3779B97F4A7C15)) % _U(BUCKETS)
    key, count = np.unique((row.astype(np.uint64) << _U(16)) | bucket, return_counts=True)
    return Trigrams((key >> _U(16)).astype(np.int64), (key & _U(BUCKETS - 1)).astype(np.int64), count, w.rows)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # [bucket, language]

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        table = np.stack([counts[k] for k in languages], axis=1) + 0.5 if languages else np.ones((BUCKETS, 0))
        return Model(languages, np.log(table / table.sum(axis=0)))


def _em(p: np.ndarray, t: Trigrams, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each row's mixture over its allowed languages."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    total = np.maximum(np.bincount(t.row, t.count, t.rows), 1)
    for step in range(rounds + 1):
        part = p * share[t.row]
        whole = part.sum(1)
        if step == rounds:
            return share, np.bincount(t.row, t.count * np.log(whole), t.rows)
        part *= (t.count / whole)[:, None]
        share = np.stack([np.bincount(t.row, part[:, k], t.rows) for k in range(p.shape[1])], axis=1) / total[:, None]
        share = np.where(allowed, np.maximum(share, 1e-9), 0)  # an allowed language keeps a trace, so a likelihood is never 0


def _some(t: Trigrams, rows: np.ndarray) -> tuple[Trigrams, np.ndarray]:
    """The entries of some rows (a mask), renumbered, and which entries they are."""
    entries = rows[t.row]
    number = np.cumsum(rows) - 1
    return Trigrams(number[t.row[entries]], t.bucket[entries], t.count[entries], int(rows.sum())), entries


def mixtures(model: Model, t: Trigrams, rounds: int = 15, penalty: float = 1.5) -> np.ndarray:
    """[row, language] proportions over each row's selected languages; others 0, rows without trigrams all 0.

    A further language must gain more than ``penalty`` * log(trigrams): half of that
    log for its proportion, times 3 as each letter is seen in three trigrams.
    """
    k = len(model.languages)
    shares = np.zeros((t.rows, k))
    if not k or not len(t.row):
        return shares
    logs = model.log_p[t.bucket]
    single = np.stack([np.bincount(t.row, t.count * logs[:, j], t.rows) for j in range(k)], axis=1)
    total = np.bincount(t.row, t.count, t.rows)
    likely = single.max(1)
    chosen = np.zeros((t.rows, k), bool)
    chosen[np.arange(t.rows), single.argmax(1)] = total > 0
    shares[chosen] = 1.0
    p = np.exp(logs - logs.max(1, keepdims=True))
    best = np.bincount(t.row, t.count * logs.max(1), t.rows)  # what the scaling of p took out
    everything, _ = _em(p, t, np.ones((t.rows, k), bool), rounds)
    growing = total > 0
    for _ in range(k - 1):
        if not growing.any():
            break
        part, entries = _some(t, growing)
        grown = chosen[growing]
        rest = np.where(grown, -1.0, everything[growing])
        grown[np.arange(len(grown)), rest.argmax(1)] = True
        share, gained = _em(p[entries], part, grown, rounds)
        gained = gained + best[growing]
        better = gained - likely[growing] > penalty * np.log(np.maximum(total[growing], 2))
        rows = np.flatnonzero(growing)[better]
        chosen[rows], shares[rows], likely[rows] = grown[better], share[better], gained[better]
        growing = np.zeros(t.rows, bool)
        growing[rows] = True
    return shares


def has_letter(texts: pa.Array) -> np.ndarray:
    """Does each text hold a letter of any script (null: no)?"""
    out = np.zeros(len(texts), bool)
    for i, text in enumerate(texts.to_pylist()):
        out[i] = text is not None and any(map(str.isalpha, text))
    return out


def language_counts(rows: DataFrame, languages: int) -> dict[str, np.ndarray]:
    """Trigram counts of each value of ``lang`` in rows (lang, text), summed on the executors.

    The driver gets at most ``languages`` * BUCKETS sums; a table with more
    languages than that is an error, not a sample.
    """
    def body(batch: pa.RecordBatch):
        named = batch.column("lang").dictionary_encode()
        names, code = named.dictionary, named.indices.to_numpy(zero_copy_only=False)
        sums = np.zeros(len(names) * BUCKETS, np.int64)
        for lo, texts in text_chunks(batch.column("text")):
            t = trigrams(texts)
            sums += np.bincount(code[lo + t.row] * BUCKETS + t.bucket, t.count, len(sums)).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(at // BUCKETS)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    sums = arrow_map(rows, body, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))  # at most BUCKETS each
    found = by_language.limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages; raise the limit if that many models fit the executors")
    counts = {}
    for r in found:
        counts[r["lang"]] = np.zeros(BUCKETS)
        counts[r["lang"]][[c["bucket"] for c in r["c"]]] = [c["n"] for c in r["c"]]
    return counts


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4,
                      held_out: int = 2, languages: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the selected set) for each row of ``docs``.

    Learned from rows with a language whose crc32(id as text) mod ``folds`` isn't
    ``held_out``.  Defined cases: a text that is null or has no letter is ``und``
    with score 0, and so is every text if nothing was learned; a null id is predicted,
    its ``held_out`` is false and it teaches nothing; repeated rows are rows like any
    other; ties go to the first language by name; other columns are ignored.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
    learn = named.where((fold("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = Model.of(language_counts(learn.select("lang", "text"), languages))

    def body(batch: pa.RecordBatch):
        for lo, texts in text_chunks(batch.column("text")):
            shares = mixtures(model, trigrams(texts))
            known = has_letter(texts) & (shares.sum(1) > 0)
            first = shares.argmax(1) if len(model.languages) else np.zeros(len(texts), int)
            pred = [model.languages[f] if ok else UNKNOWN for f, ok in zip(first, known)]
            score = [min(float(shares[i, f]), 1.0) if ok else 0.0 for i, (f, ok) in enumerate(zip(first, known))]
            sets = [[model.languages[j] for j in np.flatnonzero(s > 1e-6)] if ok else [] for s, ok in zip(shares, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, len(texts)), batch.column("held_out").slice(lo, len(texts)), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = documents(docs, id_col, text_col)
    rows = rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, body, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
