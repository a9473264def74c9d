"""Each opN query on the smallest tables: DuckDB where SQL can say it, else a brute-force version."""
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from pathweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


def _canon(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_norm, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got, want = _canon(QUERIES[name](spark, SF).toPandas()), _canon(con.sql(ORACLES[name]).df())
    assert got == want


def test_packing_keeps_every_id_once(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op2_lexical_packing"](spark, SF).toPandas()
    assert set(got.doc_id) == set(docs)
    for doc, pieces in got.groupby("doc_id"):
        ids = np.array(whole.encode(docs[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    full = got.groupby("sequence_id").length.sum()
    assert (full < 4096).sum() <= 1 + full.sum() // (1 << 20)  # one short window a shard


def test_suffix_tree_base_is_exact_and_score_is_better(spark, docs):
    got = QUERIES["op4_suffix_tree_scores"](spark, SF).toPandas().set_index("doc_id")
    tokens = {d: WORD.findall((t or "").translate(LOWER)) + [None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held[d])
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_shards_hold_equal_bytes(spark, docs):
    got = QUERIES["op6_histogram_shards"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs)
    for r in got.itertuples():
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    share = got["size"].sum() / 40
    sums = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (abs(sums - share) <= got["size"].max() + 0.002 * share).all()


@pytest.mark.parametrize("name, table, label, pred, least", [
    ("op8_quality_scores", "labels", "quality", "predicted", 0.93), ("op9_language_mixture", "documents", "lang", "lang_pred", 0.95)])
def test_held_out_accuracy(spark, con, name, table, label, pred, least):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == got.doc_id.nunique() == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    folds, part = (3, 1) if name.startswith("op8") else (4, 2)
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % folds == part)).all()
    assert got.score.between(0, 1).all()
    known = got.merge(con.sql(f"SELECT doc_id, {label} AS truth FROM {table}").df(), on="doc_id").dropna(subset="truth")
    held = known[known.held_out]
    assert len(held) > 20 and (held[pred] == held.truth).mean() >= least


def test_weak_rules(spark, con, docs):
    got = QUERIES["op10_weak_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for d, t in docs.items():
        words, r = WORD.findall(t), got.loc[d]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    known = got.join(con.sql("SELECT doc_id, quality FROM labels").df().set_index("doc_id"), how="inner")
    judged = known[~known.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.95
    assert known[known.quality == 0].kept.mean() < 0.2
