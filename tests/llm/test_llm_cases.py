"""Nulls, empty and very long texts, ties, repeats, clashing columns, empty tables; and the paths that only skew takes."""
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.llm import boosting, decontamination, language_mixture, minhash, packing, sharding, substring_dedup, suffix_tree, warc, weak_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tx long, key string, row long, node long, part int, n int, whole string, _bad string, _dropped string, id string"


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") + rng.choice("aeiou") for _ in range(n))


LONG = _prose(99, 30_000)
SHARED = _prose(7, 60)
ROWS = [(1, _prose(1, 120)), (2, _prose(1, 120)), (2, _prose(1, 120)), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (None, _prose(1, 120)),
        (None, None), (7, LONG), (8, LONG), (9, _prose(2, 80) + " " + SHARED), (10, SHARED + "\n" + _prose(3, 80)), (11, "same " * 400),
        (12, "same " * 400), (13, "four short words here"), (14, "Four SHORT words here"), (15, "ünï cödé ßtraße"), (16, "1 2 3 !!")]


def _frame(spark, rows):
    data = [(d, t, "en" if t else None, "s", None, 1, "k", 2, 3, 4, 5, "w", "b", "d", "i") for d, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return _frame(spark, [])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SHARED, 0), (2, None, 0), (3, "", 0), (4, "four short words here", 0), (5, _prose(55, 40), 0), (None, _prose(56, 40), 0)],
                                 "item_id long, text string, n int")


def test_substring_dedup(spark, docs, empty):
    got = substring_dedup.substring_dedup(docs).toPandas()
    assert len(got) == len(ROWS)
    by = {d: g for d, g in got.groupby("doc_id")}
    assert by[1].n_removed.item() == 0 and list(by[2].n_removed) == [120, 120]
    assert by[8].n_removed.item() == 30_000 and by[7].n_removed.item() == 0
    assert by[10].n_removed.item() == 60 and by[12].n_removed.item() == 400
    assert got[got.doc_id.isna()].n_removed.eq(0).all()  # a null id takes no part
    assert by[10].kept_text.item() == _prose(3, 80)
    assert by[3].kept_text.item() is None and by[4].kept_text.item() == ""
    cut = substring_dedup.remove_repeats(docs).toPandas()
    assert list(cut.columns) == docs.columns and len(cut) == len(ROWS) and set(cut.whole) == {"w"}
    assert substring_dedup.substring_dedup(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_hot_buckets_give_the_same(spark):
    rows = [(i, _prose(i, 30) + " " + SHARED + " " + _prose(1000 + i, 30)) for i in range(40)]
    df = _frame(spark, rows)
    cold, hot = (substring_dedup.substring_dedup(df, hot=h).orderBy("doc_id").toPandas() for h in (5_000, 3))
    pd.testing.assert_frame_equal(cold, hot)
    assert list(cold.n_removed) == [0] + [60] * 39


def test_repeated_rows_cost_their_number_and_not_its_square(spark, monkeypatch):
    """Rows that repeat an id and a text get one list each of what is wanted and what goes, not one list for each repeat."""
    text = _prose(70, 100)
    seen = {}
    for n in (20, 200):
        most = []

        def spied(df, body, schema, most=most, plain=substring_dedup.arrow_map):
            lists = [c for c in df.columns if c in ("wanted", "ranges")]
            if lists:
                most.append(df.agg(F.max(F.size(lists[0]))).first()[0])
            return plain(df, body, schema)

        with monkeypatch.context() as patch:
            patch.setattr(substring_dedup, "arrow_map", spied)
            got = substring_dedup.substring_dedup(_frame(spark, [(1, text)] * n + [(2, text)] * n + [(3, None)])).toPandas()
        assert sorted(got.n_removed) == [0] * (n + 1) + [100] * n
        seen[n] = max(most)
    assert seen[20] == seen[200]


def test_bucket_task_splits_at_buckets(monkeypatch):
    rows = [(d, 0, 0, m, False, _prose(m, 60).encode()) for m in range(20) for d in (1, 2)]
    names = ["doc_id", "tx", "start", "minimiser", "hot", "packed"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
    want = sum(b.num_rows for b in substring_dedup._bucket_task(50)(iter([batch])))
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 500)
    for size in (1, 3, 40):
        parts = [batch.slice(lo, size) for lo in range(0, 40, size)]
        assert sum(b.num_rows for b in substring_dedup._bucket_task(50)(iter(parts))) == want == 20


def test_a_bucket_without_repeats_gives_no_ranges():
    names = ["doc_id", "tx", "start", "minimiser", "hot", "packed"]
    for rows in ([(1, 0, 0, 5, False, _prose(1, 60).encode()), (2, 0, 0, 5, False, _prose(2, 60).encode())], [(1, 0, 0, 5, False, b"too short")]):
        batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
        assert [b.num_rows for b in substring_dedup._bucket_task(50)(iter([batch]))] == [0]


def _jaccard_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = (t or "").translate(lower).split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
        if not changed:
            break
    return label


def test_near_duplicates(spark, docs, empty):
    got = minhash.near_duplicates(docs).toPandas()
    assert len(got) == len(ROWS)
    want = _jaccard_components([(d, t) for d, t in ROWS if d is not None])
    assert {int(d): int(c) for d, c in zip(got.doc_id, got.component_id) if d == d} == want
    nulls = got[got.doc_id.isna()]
    assert nulls.component_id.isna().all() and nulls.kept.all()
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_family_near_the_threshold(spark):
    """Variants of one text with similarities around 0.75: stars alone lose links, the blocks find them."""
    rng = random.Random(5)
    base = _prose(21, 70).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    got = minhash.near_duplicates(_frame(spark, rows)).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == _jaccard_components(rows)


def test_block_links_are_a_spanning_forest():
    sets = [np.unique(np.arange(i, i + 20)).astype(np.uint64) for i in [*range(30), *range(100, 110)]]
    table = pa.table({"side": [0] * 40, "node": list(range(40)), "component": [0, 0] + list(range(2, 40)), "members": [s.tobytes() for s in sets]})
    got = minhash._block_links(75)(None, table).to_pylist()
    linked = {(a, b) for a in range(40) for b in range(a + 1, 40) if len(c := np.intersect1d(sets[a], sets[b])) * 100 >= 75 * (40 - len(c))}
    assert {(r["a"], r["b"]) for r in got} <= linked and len(got) == 28 + 9  # components 0..29 (two nodes in one) and 30..39


def test_a_large_family_gives_linear_edges(spark, monkeypatch):
    """5,000 copies of one text with one word changed: similar where the places are near, and so connected over all places."""
    rng = random.Random(8)
    base = _prose(31, 60).split()
    rows = []
    for i in range(5_000):
        words = list(base)
        words[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(words)))
    sizes, cut = [], minhash.cut_lineage

    def counted(df, name="lineage"):
        out = cut(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "cut_lineage", counted)
    got = minhash.near_duplicates(_frame(spark, rows)).toPandas()
    assert (got.component_id == 0).all()
    assert max(n for name, n in sizes if name == "links") <= 20 * len(rows)


@pytest.mark.parametrize("stars", [1, 2, 5])
def test_star_rounds_do_not_change_components(spark, stars, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 6_000)  # a few sets each
    monkeypatch.setattr(minhash, "LARGE_BLOCKS", 2)
    rng = random.Random(9)
    rows = []
    for family in range(4):
        base = _prose(40 + family, 40).split()
        for i in range(60):
            words = list(base)
            for at in rng.sample(range(40), rng.randint(0, 3)):
                words[at] = f"w{rng.randrange(10 ** 9)}"
            rows.append((family * 100 + i, " ".join(words)))
    got = minhash.near_duplicates(_frame(spark, rows), stars=stars).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == _jaccard_components(rows)


def test_dropping_near_duplicates_goes_by_text(spark):
    copy, other, third = _prose(61, 60), _prose(62, 60), _prose(63, 60)
    rows = [(1, copy), (5, copy), (5, other), (5, other), (6, third), (6, third + " tail"), (7, third), (None, copy), (None, copy), (8, None), (9, "")]
    got = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(_frame(spark, rows)).collect()), key=repr)
    third_kept = [(d, t) for d, t in got if d == 6]
    assert len(third_kept) == 1 and third_kept[0][1] in (third, third + " tail")
    rest = [(1, copy), (5, other), (None, copy), (None, copy), (8, None), (9, "")]
    assert got == sorted(rest + third_kept, key=repr)
    one = minhash.drop_near_duplicates(_frame(spark, [(1, copy), (2, copy), (3, other), (None, copy)]))
    assert one.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((r.doc_id or -1, r.text) for r in one.collect()) == sorted([(1, copy), (3, other), (-1, copy)])
    assert minhash.drop_near_duplicates(_frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, benchmark, empty):
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, benchmark).collect()}
    assert set(got) == {(9, 1), (10, 1), (13, 4), (14, 4)}
    assert got[9, 1].window_start == 80 and got[9, 1].similarity == 1.0
    clean = decontamination.decontaminate(docs, benchmark).toPandas()
    assert list(clean.columns) == docs.columns and len(clean) == len(ROWS) - 4
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_only_contaminated_rows_of_an_id_go(spark, benchmark):
    clean, bad = _prose(300, 80), _prose(301, 20) + " " + SHARED
    docs = _frame(spark, [(None, clean), (None, bad), (20, clean), (20, bad), (21, bad), (None, None)])
    got = decontamination.decontaminate(docs, benchmark).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, clean), (20, clean), (None, None)], key=repr)
    assert {r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()} == {None, 20, 21}


def test_decontamination_at_text_ends_and_with_edits(spark):
    words = _prose(77, 50).split()
    item = " ".join(words)
    edited = list(words)
    edited[25] = "changed"
    rows = [(1, " ".join(words[5:]) + " " + _prose(4, 60)), (2, _prose(5, 60) + " " + " ".join(words[:45])), (3, " ".join(edited)),
            (4, _prose(6, 100)), (5, " ".join(words[:25])), (6, (item + " ") * 3)]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(_frame(spark, rows), bench).collect()}
    assert got == {1, 2, 3, 6}


def test_long_items_are_matched_whole(spark):
    """The last five words, or all of the first part, of an item of 20,005 words are not the item."""
    words = _prose(400, 20_005).split()
    docs = _frame(spark, [(1, _prose(401, 50) + " " + " ".join(words[-5:])), (2, " ".join(words[:14_900])), (3, " ".join(words[-4_000:]))])
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).count() == 0


def test_simhash_counts_every_bit_of_long_items(spark):
    rng = random.Random(3)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (16_383, 16_384, 40_001)]
    rows.append(([-1] * 40_001,))
    df = spark.createDataFrame(rows, "g array<long>").select("g", decontamination.simhash("g").alias("f"))
    for r in df.collect():
        ones = [sum(x >> b & 1 for x in r.g) for b in range(64)]
        assert r.f & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * ones[b] > len(r.g))


def test_simhash_counts_every_bit(spark):
    rng = random.Random(2)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40, 41, 9000)]
    df = spark.createDataFrame(rows, "g array<long>").select("g", decontamination.simhash("g").alias("f"))
    for r in df.collect():
        ones = [sum(x >> b & 1 for x in r.g) for b in range(64)]
        assert r.f & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * ones[b] > len(r.g))


def test_blocks_guarantee_the_radius():
    rng = random.Random(1)
    blocks = decontamination._blocks(23)
    assert sum(m.bit_length() for _, m in blocks) == 64
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), 23))
        assert any(x >> lo & mask == 0 for lo, mask in blocks)


def test_packing(spark, docs, empty):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = packing.pack(docs, path, window=64, shard_bytes=1 << 14).toPandas()
    assert got.groupby("sequence_id").length.sum().max() == 64
    assert got[got.doc_id == 4].doc_tokens.tolist() == [1] and (got.doc_id == 2).sum() >= 2
    total = got.length.sum()
    one = packing.pack(docs, path, window=64).toPandas()
    assert one.length.sum() == total and (one.groupby("sequence_id").length.sum() < 64).sum() <= 1
    assert packing.pack(empty, path).count() == 0


def test_word_tokenizer_equals_whole_texts():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    encode = packing.WordTokenizer(path)
    texts = ["It's we'll I'd x's", "ÀÉÎ ß ÿ × ÷ ª º", "é ä ́x", "a b c\x1cd \x85 e", "123 a1b2 --- ...!!", "İstanbul ΣΑΣ ǅ",
             "日本語 テスト 한국어", "<|endoftext|> a<|startoftext|>b", "tab\tnew\nline\r\x0b\x0c", LONG[:5000], "word!!! #tag $%& |x|", "  ﻿ z"]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_windows_prefer_near_documents():
    """Two vocabularies: a window holds one of them as long as it lasts."""
    terms = [np.arange(10) if i % 2 else np.arange(100, 110) for i in range(40)]
    counts = [np.ones(10)] * 40
    pieces = list(packing.fill_windows(np.full(40, 10), packing.Bm25(terms, counts), terms, 100))
    windows = {}
    for doc, _, _, number, _ in pieces:
        windows.setdefault(number, set()).add(doc % 2)
    assert len(pieces) == 40 and all(len(kinds) == 1 for kinds in windows.values())


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_arc_records_are_read_by_their_length(version):
    payload = b"line\n\nhttp://fake 0.0.0.0 20200101000000 text/html 5\nWARC/1.1\r\n\r\n"
    data = warc.arc_version_block(version, b"f.arc") + b"\n"
    data += b"\n".join(warc.arc_record(version, b"f.arc", url, 5, payload) for url in ("http://a/ b c", "x\r\ny%", None)) + b"\n"
    got = list(warc.parse_arc(data))
    assert [r["url"] for r in got] == ["http://a/ b c", "x\r\ny%", None]
    assert all(warc.split_http(r["block"])[1] == payload for r in got)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))


def test_arc_to_warc(spark):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\n</p>"
    rows = [(5, "u5", big), (3, None, big), (9, "u 9\n", big), (1, "a", "tiny"), (2, "b", "tiny"), (4, "c", None), (6, "d", ""), (None, "e", big),
            (7, "f", big), (7, "f", big), (8, "g", "é" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.arc_round_trip(pages).toPandas()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got.itertuples() if r.page_id == r.page_id}
    assert {(p, k, None if t != t else t) for p, k, t in kinds} == {
        (5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None),
        (6, "response", None), (7, "revisit", 3), (8, "response", None)}
    assert len(got) == len(rows) and got[got.page_id.isna()].record_type.tolist() == ["response"]
    assert set(got[got.page_id.isin([3, 5, 7, 9])].payload_bytes) == {len(big)} and got[got.page_id == 8].payload_bytes.item() == 120
    assert warc.arc_round_trip(pages.limit(0)).count() == 0


def test_warc_files_read_back_their_payloads(spark, scratch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} ü</html>" * 9) for i in range(30)], "page_id long, url string, html string")
    warc.write_arc(pages, f"{scratch}/arc")
    warc.convert_arc(spark, f"{scratch}/arc", f"{scratch}/warc")
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_warc(spark, f"{scratch}/warc").collect()}
    assert got == {r.page_id: (r.url, r.html) for r in pages.collect()}


def test_suffix_tree(spark, docs, empty):
    got = suffix_tree.suffix_tree_scores(docs).toPandas()
    assert len(got) == len(ROWS) and (got.n_known <= got.n_tokens).all()
    assert got[got.doc_id.isin([3, 4, 5])].n_tokens.tolist() == [1, 1, 1]
    few = suffix_tree.suffix_tree_scores(docs, head=3).toPandas()  # nearly all words come from the join
    key = ["doc_id", "n_tokens", "n_known", "base_score"]
    left, right = (x[key].sort_values(key).reset_index(drop=True).round(6) for x in (got, few))
    pd.testing.assert_frame_equal(left, right)
    assert suffix_tree.suffix_tree_scores(empty).count() == 0


def test_suffix_tree_is_a_distribution(spark):
    """Probabilities of all next tokens, unknown class included, sum to 1 in every state."""
    texts = spark.createDataFrame([("the cat sat on the mat " * 5 + f"x{i % 7}",) for i in range(60)], "text string")
    tree, counts = suffix_tree.fit_tree(texts, share=1e-3)
    assert len(tree.depth1.context) and len(tree.depth2.context)
    count = {r.key: r.n for r in counts.collect()}
    for history in ([], ["the"], ["the", "cat"], ["cat", "sat"], ["sat", "on"], ["on", "the"]):
        chance = 0.0
        known = suffix_tree.tokens(pa.array([" ".join(history)])).value[1:-1]
        for key in [*count, 12345]:
            value = np.concatenate([[suffix_tree.END], known, [key]]).astype(np.int64)
            opens = np.zeros(len(value) - 1, bool)
            opens[0] = True
            inside, _, _, logs = suffix_tree.score_tokens(tree, suffix_tree.Tokens(value, np.zeros(len(value) - 1, int), np.array([len(value) - 1]), opens))
            chance += np.exp(logs[-1] + (0 if inside[-1] else tree.root(np.array([count.get(key, 0)]))[0]))
        assert abs(chance - 1) < 1e-9, history


def test_suffix_tree_grows_with_what_is_learned(spark):
    """A next word that three words back decide, 12 times each, in 1.6 million other tokens: no share of the corpus, and no depth of two, holds it."""
    words = "transform(sequence(0, 1599), i -> concat('w', pmod(xxhash64(id, i), 40000)))"
    texts = spark.range(1000).select(F.expr("id * 5 + 1000000").alias("doc_id"), F.expr(f"array_join({words}, ' ')").alias("text"))
    taught = ["one of the red", "two of the blue", "see an apple", "bite an orange"]
    held = ["one of the red", "one of the blue", "two of the blue", "two of the red"]
    ids = {part: [i for i in range(400) if (zlib.crc32(str(i).encode()) % 5 == 1) == part] for part in (False, True)}
    rows = list(zip(ids[False], taught * 12)) + list(zip(ids[True], held))
    df = texts.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in suffix_tree.suffix_tree_scores(df).where("doc_id < 1000000").collect()}
    one_red, one_blue, two_blue, two_red = (got[i] for i in ids[True][:4])
    assert one_red > one_blue + 0.5 and two_blue > two_red + 0.5


def test_suffix_tree_scores_do_not_depend_on_the_head(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the cat sat on", "a dog ran to", "the mat was", "a red hat"]) for _ in range(30))) for i in range(60)]
    key = ["doc_id", "n_known", "base_score", "score"]
    many, few = (suffix_tree.suffix_tree_scores(_frame(spark, rows), head=h).select(key).orderBy("doc_id").toPandas().round(6) for h in (1 << 19, 3))
    pd.testing.assert_frame_equal(many, few)
    assert (many.score > many.base_score).all()


def test_shards(spark, docs, empty):
    got = sharding.histogram_shards(docs, 4).toPandas()
    assert len(got) == len(ROWS) and got.shard.between(0, 3).all()
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert got[got.doc_id == 3]["size"].item() == 16 and got[got.doc_id == 3].text_crc32.isna().item()
    assert sharding.histogram_shards(empty, 4).count() == 0
    hot = _frame(spark, [(i, "same text") for i in range(4000)] + [(i, _prose(i, 3)) for i in range(4000, 6000)])
    got = sharding.histogram_shards(hot, 10).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 10 and sums.max() - sums.min() <= 0.004 * sums.mean() + 2 * got["size"].max()
    split = got[got.doc_id < 4000].shard
    assert split.nunique() == split.max() - split.min() + 1  # equal texts lie in neighbouring shards


def test_written_shards_hold_their_rows(spark, scratch):
    rows = [(i, _prose(i, 20)) for i in range(300)]
    sharding.write_shards(_frame(spark, rows), f"{scratch}/out", 5)
    out = spark.read.parquet(f"{scratch}/out")
    assert out.select("shard").distinct().count() == 5
    assert {(r.doc_id, r.text) for r in out.collect()} == set(rows)


def test_boosting(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 0), (12, 0, 0), (12, None, 0), (None, 1, 0), (7, 1, 0), (8, 1, 0), (99, 0, 0)],
                                   "doc_id long, quality int, label int")
    got = boosting.quality_scores(docs, labels, held_out=5).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all() and not got.held_out.any()
    none = boosting.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 1).all()
    kept = boosting.quality_filter(docs, labels, held_out=5).toPandas()
    assert list(kept.columns) == docs.columns and len(kept) == got.predicted.sum()
    assert boosting.quality_scores(empty, labels).count() == 0 and boosting.quality_filter(empty, labels).count() == 0


def test_trees_learn_a_joint_condition():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    trees = boosting.fit_trees(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.98


def test_language_mixture(spark, docs, empty):
    got = language_mixture.predict_languages(docs).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([3, 4, 5, 16])].lang_pred) == {"und"} and set(got[got.doc_id == 6].lang_pred) == {"en"}
    untaught = language_mixture.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(untaught.lang_pred) == {"und"} and (untaught.score == 0).all()
    assert language_mixture.predict_languages(empty).count() == 0


def test_mixed_text_gets_both_languages():
    one, two = _prose(1, 3000), " ".join(w[::-1] + "zz" for w in _prose(2, 3000).split())
    counts = {}
    for name, text in (("a", one), ("b", two)):
        t = language_mixture.trigrams(pa.array([text]))
        counts[name] = np.bincount(t.bucket, t.count, language_mixture.BUCKETS)
    counts["c"] = np.bincount(language_mixture.trigrams(pa.array(["qqq www " * 500])).bucket, minlength=language_mixture.BUCKETS).astype(float)
    model = language_mixture.Model.of(counts)
    mixed = " ".join(one.split()[:150] + two.split()[:50])
    share = language_mixture.mixtures(model, language_mixture.trigrams(pa.array([mixed, one[:400], "", None])))
    assert 0.6 < share[0, 0] < 0.85 and 0.15 < share[0, 1] < 0.4 and share[0, 2] == 0
    assert share[1].tolist() == [1, 0, 0] and share[2:].sum() == 0


def test_weak_rules(spark, docs, empty):
    got = weak_rules.weak_quality(docs).toPandas()
    assert len(got) == len(ROWS)
    assert got[got.doc_id.isin([3, 4, 5, 6])].base_failed.all() and not got[got.doc_id.isin([3, 4, 5, 6])].kept.any()
    assert got[got.doc_id.isin([1, 2, 7])].kept.all() and not got[got.doc_id == 11].kept.any()
    assert weak_rules.weak_quality(empty).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.5]  # the last rule says nothing
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where((rng.random(20_000) < a) == good, 2, 1)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    share, table, _ = weak_rules.fit_votes(patterns, counts.astype(float), 4)
    assert abs(share - 0.8) < 0.03
    for r, a in enumerate(accuracy):
        assert abs(table[r, 1, weak_rules.GOOD] - a) < 0.04 and abs(table[r, 0, weak_rules.BAD] - a) < 0.08


def _plain_tree_scores(train, texts, least=8, discount=0.5):
    """Every context of every length, held in dictionaries: log10 probability of each text."""
    end = None
    count, after, longest = {}, {}, 0
    for text in train:
        for w in [*text, end]:
            count[w] = count.get(w, 0) + 1
    for text in train:
        value = [end, *text, end]
        for i in range(1, len(value)):
            for k in range(1, i + 1):
                seen = after.setdefault(tuple(value[i - k:i]), {})
                seen[value[i]] = seen.get(value[i], 0) + 1
                longest = max(longest, k)
    mass = sum(count.values()) + 0.5 * (len(count) + 1)
    states = {}

    def probability(context, w):
        for k in range(len(context), 0, -1):
            if context[-k:] in states:
                children, backoff = states[context[-k:]]
                return children[w] if w in children else backoff * probability(context[len(context) - k + 1:], w)
        return (count.get(w, 0) + 0.5) / mass

    for context in sorted(after, key=len):
        seen = after[context]
        n = sum(seen.values())
        children = {w: (c - discount) / n for w, c in seen.items() if c >= least}
        if not children:
            continue
        shorter = {w: probability(context[1:], w) for w in children}
        backoff = max(1 - sum(children.values()), 1e-9) / (1 - min(sum(shorter.values()), 1 - 1e-9))
        rest = n - sum(seen[w] for w in children)
        gain = sum(seen[w] * math.log(children[w] / shorter[w]) for w in children) + rest * math.log(backoff)
        if gain > 0.5 * (len(children) + 1) * math.log(max(n, 2)):
            states[context] = children, backoff
    scores = []
    for text in texts:
        value = [end, *text, end]
        scores.append(sum(math.log10(probability(tuple(value[:i]), value[i])) for i in range(1, len(value))))
    return scores, max(map(len, states))


def test_suffix_tree_equals_a_plain_one(spark):
    """Copies, near copies and a passage whose next word 12 words decide: the same scores as from every context of every length."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    copy, near, middle = ([rng.choice(words) for _ in range(n)] for n in (60, 50, 11))
    texts = [[rng.choice(words[:6]) for _ in range(rng.randrange(40))] for _ in range(60)]
    texts += [copy] * 25 + [[w if rng.random() > 0.03 else rng.choice(words) for w in near] for _ in range(60)]
    texts += [[side, *middle, "red" if side == "left" else "blue"] for side in ("left", "right") * 40]
    rng.shuffle(texts)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    want, deepest = _plain_tree_scores(train, texts)
    assert deepest >= 12
    got = suffix_tree.suffix_tree_scores(_frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).orderBy("doc_id").toPandas()
    np.testing.assert_allclose(got.score, want, rtol=1e-9)
