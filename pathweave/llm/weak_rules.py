"""Quality by weak supervision instead of all-must-pass rules.

Each rule votes good (2), bad (1) or abstains (0) on a document's statistics.  A
document's votes are a pattern, a number in base 3; the corpus is reduced to a
count for each pattern (at most 3^rules, whatever the corpus).  On these counts,
expectation-maximisation estimates the share of good documents and each rule's
accuracy, for good and for bad documents, when it votes; a rule that says nothing
gets no weight, and no label is needed.  A document is kept if its pattern's
posterior probability of being good is at least 1/2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import arrow_map, documents
from .statistics import COUNTS, document_statistics
from .words import text_chunks

#: (name, vote bad if, vote good if): SQL over the statistics of a document with words.
RULES = (
    ("length", "n_words < 15", "n_words >= 100"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("capitals", "10 * n_upper > 4 * n_letters", "10 * n_upper <= n_letters"),
    ("marks", "10 * n_marks > n_words", "100 * n_marks <= n_words"),
    ("plain_words", "10 * n_plain_words < 8 * n_words", "10 * n_plain_words >= 9 * n_words"),
    ("edge_words", "10 * n_edge_words > 4 * n_words", "10 * n_edge_words <= 2 * n_words"),
    ("letters", "10 * (n_letters + n_high) < 8 * word_chars", "10 * (n_letters + n_high) >= 9 * word_chars"),
    ("variety", "100 * n_distinct_words < 15 * n_words", "100 * n_distinct_words >= 30 * n_words"),
)
ABSTAIN, BAD, GOOD = 0, 1, 2


def _statistics_body(batch: pa.RecordBatch):
    ids = batch.column("doc_id")
    for lo, texts in text_chunks(batch.column("text")):
        counts = document_statistics(texts)
        yield pa.RecordBatch.from_arrays([ids.slice(lo, len(texts)), *(pa.array(counts[c]) for c in COUNTS)], names=["doc_id", *COUNTS])


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of ``document_statistics`` for each row."""
    return arrow_map(documents(docs, id_col, text_col), _statistics_body, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def vote_pattern() -> str:
    """All rules' votes as one number, the first rule's as the lowest digit in base 3."""
    return " + ".join(f"{3 ** k} * CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {ABSTAIN} END"
                      for k, (_, bad, good) in enumerate(RULES))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 200, prior: float = 1.0):
    """EM on pattern counts: (share of good, table[rule, class, vote cast], posterior of good for each pattern).

    Classes are bad (0) and good (1); ``table[r, c, c + 1]`` is rule r's accuracy on
    class c.  It starts from the majority of the votes cast; ``prior`` is a
    pseudo-count for each vote.
    """
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    lead = (votes == GOOD).sum(1) - (votes == BAD).sum(1)
    posterior = np.where(lead > 0, 0.9, 0.1)
    table = np.zeros((rules, 2, 3))
    share = 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        share = (weight[1].sum() + prior) / (counts.sum() + 2 * prior)
        for v in (BAD, GOOD):
            table[:, :, v] = (weight @ (votes == v)).T + prior
        table /= table.sum(2, keepdims=True)
        log = np.log(table, where=table > 0, out=np.zeros_like(table))  # an abstention says nothing
        score = np.log([1 - share, share]) + sum(log[r][:, votes[:, r]].T for r in range(rules))
        after = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
        if np.abs(after - posterior).max() < 1e-9:
            break
        posterior = after
    return share, table, posterior


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, p_good and kept for each row of ``docs``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated
    5-word windows; such a document is not kept, whatever the votes.  Defined
    cases: a null or empty text has all counts 0 and fails the base rule; null and
    repeated ids are rows like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    stats = cut_lineage(statistics_of(docs, id_col, text_col).withColumn("pattern", F.expr(vote_pattern())), "statistics")
    stats = stats.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    seen = stats.where("n_words > 0").groupBy("pattern").count().collect()  # at most 3^rules rows
    patterns = np.array(sorted(r["pattern"] for r in seen), np.int64)
    counts = np.array([r["count"] for r in sorted(seen, key=lambda r: r["pattern"])], float)
    posterior = fit_votes(patterns, counts, len(RULES))[2] if seen else np.zeros(0)
    verdicts = stats.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, posterior)], "pattern int, p_good double")
    return (stats.join(F.broadcast(verdicts), "pattern", "left")  # at most 3^rules rows
            .withColumn("kept", F.expr("NOT base_failed AND coalesce(p_good, 0) >= 0.5"))
            .select("doc_id", *COUNTS, "p_good", "base_failed", "kept"))
