"""Line dedup, importance resampling and whitening: brute force, defined cases, and the paths that only skew takes."""
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.llm import importance, line_dedup, whitening
from pathweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _line(k):
    return f"this is line number {k} and it is long enough to count"


def _docs(spark, rows):
    """Columns beside the two that matter have the operators' own names."""
    names = "doc tx place h1 h2 nth docs last places keep row text_ n_lines rank part"
    return spark.createDataFrame([(d, t, *["x"] * 15) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names.split()))


# --- line dedup ------------------------------------------------------------------------------

def _by_hand(rows, min_chars=40, min_docs=5):
    keys = [[x.strip(BLANKS).translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    holders = collections.defaultdict(set)
    for (d, t), ks in zip(rows, keys):
        for k in ks:
            if d is not None and t is not None and len(k) >= min_chars:
                holders[k].add(d)
    out = []
    for (d, t), ks in zip(rows, keys):
        gone = [d is not None and len(holders[k]) >= min_docs and d < max(holders[k]) for k in ks]
        out.append((d, len(ks), sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)))
    return sorted(out, key=repr)


def _line_rows():
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice([_line(rng.randint(0, 30)), f"  {_line(7).upper()}\t", "short", "", _line(1000 + i)]) for _ in range(rng.randint(1, 12))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, _line(1)), (None, None), (103, _line(3) + "\r\n" + _line(3)), (104, "\n".join([_line(k) for k in range(31)] * 40))]
    rows += [(105, _line(1) + "\n" + _line(2))] * 30  # repeated rows
    rows += [(106, _line(1)), (106, _line(2) + "\nother text under the same id"), (-5, _line(1) + "\nünï cödé ßtraße ünï cödé ßtraße ünï cödé")]
    return rows


@pytest.mark.parametrize("share, sample", [(1 / 2000, 1_000_000), (0.02, 1_000_000), (0.02, 50), (1.0, 1_000_000)])
def test_line_dedup_equals_brute_force(spark, share, sample):
    rows = _line_rows()
    got = line_dedup.line_keep_bitmaps(_docs(spark, rows), with_text=True, hot_share=share, sample_lines=sample).toPandas()
    have = sorted(((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.itertuples()), key=repr)
    assert have == _by_hand(rows)


def test_bitmaps_are_runs_of_kept_and_dropped_lines(spark):
    text = "\n".join([_line(1), "a", "b", _line(2), _line(3), "c"])
    rows = [(1, text)] + [(d, "\n".join(_line(k) for k in (1, 2, 3))) for d in range(2, 7)]
    got = {r.doc_id: r for r in line_dedup.line_keep_bitmaps(_docs(spark, rows)).collect()}
    assert got[1].keep == [0, 1, 3, 5, 6] and got[2].keep == [0, 3, 3] and got[6].keep == [3]
    assert "kept_text" not in got[1].asDict()


def test_line_removal_keeps_columns_and_empty_tables(spark):
    docs = _docs(spark, _line_rows())
    cut = line_dedup.remove_repeated_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and set(cut.toPandas().place) == {"x"}
    assert cut.where("doc_id = 100").first().text is None
    empty = _docs(spark, [])
    assert line_dedup.line_keep_bitmaps(empty).count() == 0 and line_dedup.remove_repeated_lines(empty).count() == 0


def test_a_very_long_text_of_repeated_lines(spark):
    long = "\n".join([_line(k % 7) for k in range(30_000)])
    rows = [(d, long) for d in range(6)]
    got = {r.doc_id: r for r in line_dedup.line_keep_bitmaps(_docs(spark, rows), with_text=True).collect()}
    assert [got[d].n_dropped for d in range(6)] == [30_000] * 5 + [0]
    assert got[0].kept_text == "" and got[5].kept_text == long


def test_range_partitions_are_not_exchanged_again(spark):
    lines = line_dedup.long_lines(_docs(spark, _line_rows()), "doc_id", "text", 40)
    plan = line_dedup._dropped(lines, 5, 1.0, 10 ** 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


# --- importance resampling ---------------------------------------------------------------------

def _features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(x.encode()) % 10_000 for x in words] + [zlib.crc32(f"{a} {b}".encode()) % 10_000 for a, b in zip(words, words[1:])]


def _importance_by_hand(docs, target):
    feats = [(d, *_features(t)) for d, t in docs]
    s = collections.Counter(b for _, _, x in feats for b in x)
    t = collections.Counter(b for text in target for b in _features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, words, x in feats:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        rows.append([d, len(words), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[5] = k + 1
    return rows


def _canon(frame):
    return sorted(([None if pd.isna(v) else int(v) for v in r] for r in frame.itertuples(index=False, name=None)), key=repr)


def test_crc_composition():
    rng = np.random.default_rng(2)
    left, right = [[rng.bytes(int(n)) for n in rng.integers(0, 3000, 300)] for _ in range(2)]
    crc = [np.array([zlib.crc32(x) for x in side], np.uint32) for side in (left, right)]
    got = importance.composed(crc[0], crc[1], np.array([len(x) for x in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


@pytest.mark.parametrize("limit", [0, 3, 1 << 17])
def test_dictionary_of_any_size_gives_the_same_buckets(limit):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "an", "ant", "the", "ünï", "x1", "日本語", "w" * 300, "A-b", "…", "\x00q"]) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    texts += [None, "", "  ", "\n\t!", "one"]
    dictionary = importance.Dictionary(limit)
    for _ in range(3):  # later rounds find the words in the automaton
        words, row, bucket = importance.feature_buckets(pa.array(texts), dictionary, 10_000)
        for i, t in enumerate(texts):
            want = _features(t)
            assert words[i] == len(want[0]) and sorted(bucket[row == i]) == sorted(want[1])
    assert len(dictionary.words) <= limit


@driver_tables
def test_importance_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op12_importance_resampling"](spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _canon(got) == sorted(([r[0], *r[2:]] for r in _importance_by_hand(docs, target)), key=repr)


def test_importance_defined_cases(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma-delta", "ünï", "x9", "the", "of"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 19, 20, 40])))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "!!! ..."), (203, "word " * 30_000), (None, "the of " * 20), (None, None)]
    docs = _docs(spark, rows)
    target = spark.createDataFrame([("alpha beta " * 30, 1), (None, 2), ("", 3)], "text string, part int")
    got = importance.importance_resample(docs, target).toPandas()
    assert _canon(got) == sorted(_importance_by_hand(rows, [r[0] for r in target.collect()]), key=repr)
    repeated = rows + [rows[0]] * 500  # fully equal rows rank in any order, none is lost
    got = importance.importance_resample(_docs(spark, repeated), target).toPandas()
    drawn = sorted(got["rank"].dropna().astype(int))
    able = sum(len(_features(t)[0]) >= 20 for _, t in repeated)
    assert drawn == list(range(1, able * 25 // 100 + 1)) and len(got) == len(repeated)
    assert importance.importance_resample(_docs(spark, []), target).count() == 0
    none = importance.importance_resample(docs, target.limit(0)).toPandas()
    assert _canon(none) == sorted(_importance_by_hand(rows, []), key=repr)
    taken = importance.draw(docs, target)
    assert taken.columns == docs.columns and taken.where("doc_id IS NULL").isEmpty()


# --- whitening ---------------------------------------------------------------------------------

@pytest.mark.parametrize("values", [np.linspace(5, 1, 40), np.repeat([4.0, 1.0, 0.0], [3, 10, 7]), 10.0 ** -np.linspace(0, 12, 30), np.ones(9), [0.0, 0.0],
                                    [2.0], np.concatenate([[1 + 1e-9, 1.0], np.zeros(4)]), [3.0, -1.0, -3.0]])
def test_spectral_components(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.spectral_components(a)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(e - np.sort(values)[::-1]).max() <= 1e-13 * size
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 and np.abs(a @ v - v * e).max() <= 1e-13 * d * size


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0]
    values = np.array([5, 3, 1, 1e-6, 1e-9, -1e-9, -1e-3, -1, -2, -2, -7, 4.0])
    got = whitening.polar_factor(q @ np.diag(values) @ q.T)
    assert np.abs(got - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, x string, n double")


def _white_by_hand(rows, k=16):
    length = collections.Counter(len(v) for _, v in rows).most_common(1)[0][0]
    x = np.floor(np.array([v for _, v in rows if len(v) == length]) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / e.sum()


@driver_tables
def test_whitening_query_equals_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = _white_by_hand(rows)
    assert (got.n == n).all() and (got.deviation.values.reshape(-1, 16) == deviation[:, None]).all()
    assert list(got.component[:16]) == list(range(1, 17)) and (got.identity_error < 1e-10).all()
    have = got.whitened.values.reshape(-1, 16)
    assert np.abs(have * np.sign((have * white).sum(0)) - white).max() < 1e-8
    assert np.allclose(got.explained.values.reshape(-1, 16), explained, rtol=1e-10)


def test_whitening_defined_cases(spark):
    rng = np.random.default_rng(6)
    good = [(i, (rng.standard_normal(5) * [4, 3, 2, 1, 0.5]).tolist()) for i in range(300)]
    good += [(1000, good[0][1])] * 400 + [(None, good[1][1])]  # repeated rows weigh once, a null id is a row
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0]), (2003, [float("nan")] * 5), (2004, [float("inf"), 1.0, 1.0, 1.0, 1.0]),
           (2005, [1.0, 2.0]), (2006, [1e300, 0.0, 0.0, 0.0, 0.0])]
    got = whitening.whiten_embeddings(_vectors(spark, good + bad)).toPandas()
    assert len(got) == len(good) and (got.vec_id.fillna(-1) < 2000).all()
    n, deviation, white, _ = _white_by_hand(good, 5)
    assert (got.n == n).all() and n == 300 and sorted(got.deviation) == sorted(deviation)
    assert all(len(w) == 5 for w in got.whitened) and got.identity_error.max() < 1e-10
    assert np.allclose(np.sort(np.abs(np.stack(got.whitened)), axis=0), np.sort(np.abs(white), axis=0), atol=1e-8)
    assert whitening.whiten_embeddings(_vectors(spark, [])).count() == 0
    assert whitening.whiten_embeddings(_vectors(spark, bad[:5])).count() == 0
    flat = whitening.whiten_embeddings(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in flat] == [(1, 0, [], None)] * 2
    line = whitening.whiten_embeddings(_vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in line)  # rank one


def test_sums_and_deviations_are_exact_beyond_doubles(spark):
    big = 2.0 ** 55
    rows = [(i, [big + 64 * i, -big, 0.5 * i]) for i in range(20)]
    x = [[int(math.floor(c * 64)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    got = {r.vec_id: r.deviation for r in whitening.whiten_embeddings(_vectors(spark, rows)).collect()}
    assert got == {i: sum((20 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    wide = [(i, [2.0 ** 50 * i]) for i in range(4)]
    assert all(r.deviation is None for r in whitening.whiten_embeddings(_vectors(spark, wide)).collect())  # no long holds it
