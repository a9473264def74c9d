"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the
least hash among its runs of ``seed`` words.  Consecutive windows mostly share
their minimiser, so they travel together, as one packed string (a super-k-mer),
to the minimiser's bucket: equal windows have equal minimisers and meet there,
and sorting the bucket's windows finds every repeat.

1. Each document is cut into super-k-mers; only (document, start, windows,
   minimiser) is kept.  A bucket that only one document reaches can't hold a
   repeat across documents, so a first aggregation of these small rows (map-side
   combined) names the buckets which two documents reach.
2. Only those buckets' super-k-mers are packed and shuffled.  A task sorts the
   windows of whole buckets and marks each window that an earlier document has.
3. A bucket of more than ``hot`` super-k-mers never lands in one task: its
   windows are spread by their own fingerprint instead, where equal ones are
   pre-aggregated before the shuffle.
4. Marked word ranges go back to their documents, and the words are cut out.

Windows are compared by two independent 64-bit fingerprints (128 bits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.session import cut_lineage

from .common import arrow_map, documents, give_back, text_key
from .words import Words, sequence_hashes, signed, sliding_min, text_chunks

LONGEST_PACK = 256  # windows; a longer run of one minimiser (a repeated word) goes as several super-k-mers
TASK_BYTES = 2 << 20  # packed bytes whose buckets a task sorts at a time


def superkmers(words: Words, window: int, seed: int):
    """(row, start, windows, minimiser) of each super-k-mer of the chunk, as arrays."""
    empty = np.zeros(0, np.int64)
    if len(words.start) < window:
        return empty, empty, empty, empty
    seeds = sequence_hashes(words.hashes(), seed)
    least = sliding_min(seeds, window - seed + 1)
    begin = np.flatnonzero(words.room(window)[:len(least)])
    if not len(begin):
        return empty, empty, empty, empty
    least, doc = least[begin], words.doc[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    in_run = np.arange(len(begin)) - np.repeat(run, np.diff(np.append(run, len(begin))))
    new |= in_run % LONGEST_PACK == 0
    first = np.flatnonzero(new)
    return doc[first], begin[first] - words.first[doc[first]], np.diff(np.append(first, len(begin))), signed(least[first])


def _kmers_body(window: int, seed: int):
    names = ["doc_id", "tx", "start", "n", "minimiser"]

    def body(batch: pa.RecordBatch):
        ids, tx = batch.column("doc_id"), batch.column("tx")
        for lo, texts in text_chunks(batch.column("text")):
            row, start, n, least = superkmers(Words(texts), window, seed)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), tx.take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least)], names=names)
    return body


def _pack_body(window: int):
    """Rows with their list of wanted super-k-mers -> one packed string each."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def body(batch: pa.RecordBatch):
        for lo, texts in text_chunks(batch.column("text")):
            out = []
            ids, tx, wants = (batch.column(c).slice(lo, len(texts)).to_pylist() for c in ("doc_id", "tx", "wanted"))
            for doc, t, data, wanted in zip(ids, tx, texts.cast(pa.binary()).to_pylist(), wants):
                if wanted and data is not None:
                    words = data.split()
                    out += [(doc, t, w["start"], w["minimiser"], w["hot"], b" ".join(words[w["start"]:w["start"] + w["n"] + window - 1]))
                            for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                                 names=["doc_id", "tx", "start", "minimiser", "hot", "packed"])
    return body


def _windows(batch: pa.RecordBatch, window: int):
    """Fingerprints, pack and word place of each window of the batch's packed strings."""
    words = Words(batch.column("packed"))
    hashes = words.hashes()
    one, two = sequence_hashes(hashes, window), sequence_hashes(hashes, window, second=True)
    begin = np.flatnonzero(words.room(window)[:len(one)])
    pack = words.doc[begin]
    place = begin - words.first[pack] + batch.column("start").to_numpy(zero_copy_only=False)[pack]
    return one[begin], two[begin], pack, place


def _repeats(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Sort the windows of whole buckets; ranges [lo, hi) of words in windows that a smaller id has too."""
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    one, two, pack, place = _windows(batch, window)
    order = np.lexsort((doc[pack], two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    earliest = doc[pack[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    marked = np.zeros(len(order), bool)
    marked[order] = doc[pack[order]] > earliest
    pack, place = pack[marked], place[marked]
    fresh = np.ones(len(pack), bool)
    fresh[1:] = (pack[1:] != pack[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first, len(pack))[1:] - 1
    rows = pa.array(pack[first])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows), batch.column("tx").take(rows),
         pa.array(place[first].astype(np.int32)), pa.array((place[last] + window).astype(np.int32))],
        names=["doc_id", "tx", "lo", "hi"])


def _bucket_task(window: int):
    """A partition sorted by minimiser, taken some whole buckets at a time."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < TASK_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("minimiser").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            yield from _by_buckets(table.slice(0, cut), window)
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held) if cut else 0
        if held:
            yield from _by_buckets(pa.Table.from_batches(held), window)
        held.clear()
        give_back()
    return run


def _by_buckets(table: pa.Table, window: int):
    """Whole buckets, about TASK_BYTES of packed strings at a time."""
    if not table.num_rows:
        return
    batch = table.combine_chunks().to_batches()[0]
    keys = batch.column("minimiser").to_numpy()
    opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    before = np.cumsum(np.append(0, pc.binary_length(batch.column("packed")).to_numpy()[:-1]))[opens]
    cuts = opens[np.flatnonzero(np.append(True, np.diff(before // TASK_BYTES) > 0))]
    for lo, hi in zip(cuts, np.append(cuts[1:], len(keys))):
        yield _repeats(batch.slice(lo, hi - lo), window)


def _spread_body(window: int):
    def body(whole: pa.RecordBatch):
        for lo, packed in text_chunks(whole.column("packed")):
            batch = whole.slice(lo, len(packed))
            one, two, pack, place = _windows(batch, window)
            rows = pa.array(pack)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(one)), pa.array(signed(two)), batch.column("doc_id").take(rows), batch.column("tx").take(rows),
                 pa.array(place.astype(np.int32))], names=["f1", "f2", "doc_id", "tx", "place"])
    return body


def _cut(data: bytes, ranges: list | None) -> tuple[bytes, int, int, str]:
    """The text without the words in the ranges (each goes with the white space after it), words, removed words, digest of the kept."""
    words = data.split()
    if not ranges:
        return data, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, [r["lo"] for r in ranges], 1)
    np.add.at(gone, [min(r["hi"], len(words)) for r in ranges], -1)
    gone = np.cumsum(gone[:-1]) > 0
    start = Words(pa.array([data], pa.binary())).start
    follows = np.append(start[1:], len(data))
    keep = np.ones(len(data), bool)
    for lo, hi in zip(start[gone], follows[gone]):
        keep[lo:hi] = False
    kept = [w for w, g in zip(words, gone) if not g]
    text = np.frombuffer(data, np.uint8)[keep].tobytes()
    return text, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _cut_body(batch: pa.RecordBatch):
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    for lo, texts in text_chunks(batch.column("text")):
        ranges = batch.column("ranges").slice(lo, len(texts)).to_pylist()
        rows = [_cut(data or b"", r) for data, r in zip(texts.cast(pa.binary()).to_pylist(), ranges)]
        text, *counts = (pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))
        text = pc.if_else(pc.is_valid(texts), text, pa.scalar(None, pa.binary())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), text, *counts],
                                         names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(rows: DataFrame, window: int = 50, seed: int = 10, hot: int = 5_000) -> DataFrame:
    """(doc_id, tx, lo, hi): word ranges of windows that also begin in a document with a smaller id.

    ``rows``: doc_id, text, tx (fingerprint of the text).  Null ids take no part.
    """
    spark = rows.sparkSession
    kmers = cut_lineage(arrow_map(rows.where("doc_id IS NOT NULL"), _kmers_body(window, seed),
                                  "doc_id long, tx long, start int, n int, minimiser long"), "superkmers")
    buckets = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("packs"))
    shared = cut_lineage(buckets.where("least < most").select("minimiser", (F.col("packs") > hot).alias("hot")), "buckets")
    wanted = (kmers.join(shared, "minimiser").groupBy("doc_id", "tx")
              .agg(F.collect_set(F.struct("start", "n", "minimiser", "hot")).alias("wanted")))  # at most a document's own windows
    packs = arrow_map(rows.join(wanted, ["doc_id", "tx"], "left"), _pack_body(window),
                      "doc_id long, tx long, start int, minimiser long, hot boolean, packed binary")
    any_hot = not shared.where("hot").isEmpty()
    if any_hot:
        packs = cut_lineage(packs, "packs")  # read by both ways below
    ranges = (packs.where("NOT hot").repartition("minimiser").sortWithinPartitions("minimiser")
              .mapInArrow(_bucket_task(window), "doc_id long, tx long, lo int, hi int"))
    if any_hot:
        spread = arrow_map(packs.where("hot"), _spread_body(window), "f1 long, f2 long, doc_id long, tx long, place int")
        spread = cut_lineage(spread, "hot_windows")
        least = spread.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
        marked = spread.join(least, ["f1", "f2"]).where(F.col("doc_id") > F.col("least"))
        ranges = ranges.unionByName(marked.select("doc_id", "tx", F.col("place").alias("lo"), (F.col("place") + window).alias("hi")))
    return ranges


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    seed: int = 10, hot: int = 5_000) -> DataFrame:
    """Remove each word covered by a window that also begins in a document with a smaller id.

    Returns doc_id, kept_text, n_words, n_removed, kept_sha256, a row for each
    row of ``docs``.  Windows are judged on the input.  Defined cases: a null or
    empty text has no words (digest of the empty string; null stays null); a
    null id neither loses words nor takes them from others; rows with the same
    id are one document, so they take no words from each other; a text shorter
    than a window is kept; other columns are ignored.
    """
    # tx must be computed alike on both sides of the two joins, so that Spark reuses the one exchange of the texts.
    rows = documents(docs, id_col, text_col).withColumn("tx", text_key())
    ranges = (repeated_ranges(rows, window, seed, hot).groupBy("doc_id", "tx")
              .agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    return arrow_map(rows.join(ranges, ["doc_id", "tx"], "left"), _cut_body,
                     "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 10,
                   hot: int = 5_000) -> DataFrame:
    """The rows and columns of ``docs``, their texts without the words that ``substring_dedup`` removes."""
    # The whole row travels as one struct, so no column of it can clash with ours.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")).withColumn("tx", text_key())
    ranges = (repeated_ranges(rows.select("doc_id", "text", "tx"), window, seed, hot).groupBy("doc_id", "tx")
              .agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    kind = rows.schema["whole"].dataType

    def body(batch: pa.RecordBatch):
        lo = 0
        for cut in _cut_body(batch):
            n = cut.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("whole").slice(lo, n), cut.column("kept_text")], names=["whole", "kept_text"])
            lo += n

    cut = arrow_map(rows.join(ranges, ["doc_id", "tx"], "left").select("whole", "doc_id", "text", "ranges"), body,
                    T.StructType().add("whole", kind).add("kept_text", "string"))
    return cut.select(*(F.col("kept_text").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns))
