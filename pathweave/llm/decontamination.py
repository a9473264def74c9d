"""Benchmark decontamination by SimHash over item-sized windows (DataFrame functions only).

A window is as many consecutive words of a document as a benchmark item has; a
window that would pass a text's end is cut there.  Both are multisets of
``shingle``-word shingles (A-Z lower-cased); a shingle weighs as often as it
occurs, and similarity is sum(min) / sum(max) of the weights.

1. Gate.  A window can only reach the similarity if at least that share of its
   shingles belong to items of its own size.  Document shingles are joined with
   the items' (shingle, size) pairs, and only windows with enough hits go on.
2. SimHash.  A 64-bit fingerprint of the weighted shingles.  Each shingle hash
   adds its 64 bits to 64 counters, kept as 16-bit lanes of 16 longs, so that
   one addition moves four counters.
3. Multi-index Hamming blocks.  The bits are cut into ``radius + 1`` blocks.  Two
   fingerprints within the radius agree in a block at least, so joining windows
   and items of one size on (size, block, value) finds all of them; a pair is
   taken at its first common block only.
4. Pairs within the radius are verified by exact weighted-shingle similarity.

At weighted similarity 0.75 two fingerprints differ in 11 of 64 bits on average
(standard deviation 3); the default radius of 23 is four deviations away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import documents, text_key

LANES = 0x0001000100010001
LANE_GRAMS = 16_383  # so many shingles a 16-bit lane counts; longer windows are counted bit by bit
BROADCAST_ROWS = 1_000_000  # shingles of the items, times the blocks for the index; beyond it they are shuffled like any table


def _words(text: str) -> str:
    """Words of an SQL string expression, A-Z lower-cased (null: none)."""
    trimmed = rf"regexp_replace(coalesce({text}, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '')"
    lowered = f"translate({trimmed}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"filter(split({lowered}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _shingles(words: str, shingle: int) -> str:
    """Shingle hashes in order; fewer words than ``shingle`` are one shingle."""
    gram = ", ".join(f"{words}[i + {k}]" for k in range(shingle))
    return (f"CASE WHEN size({words}) >= {shingle} THEN transform(sequence(0, size({words}) - {shingle}), i -> xxhash64({gram})) "
            f"WHEN size({words}) > 0 THEN array(xxhash64(concat_ws(' ', {words}))) ELSE cast(array() AS array<bigint>) END")


def simhash(grams: str) -> Column:
    """64-bit SimHash of an array of shingle hashes of any size: bit b is set where over half of them have it."""
    zero = "named_struct(" + ", ".join(f"'c{k}', 0L" for k in range(16)) + ")"
    step = "named_struct(" + ", ".join(f"'c{k}', a.c{k} + (shiftrightunsigned(h, {k}) & {LANES}L)" for k in range(16)) + ")"
    # A count v passes half of the total T where v + (16383 - T div 2) reaches bit 14 of its lane.
    carry = f"(16383L - size({grams}) div 2) * {LANES}L"
    bits = " | ".join(f"shiftleft(shiftrightunsigned((s.c{k} + {carry}) & {LANES << 14}L, 14), {k})" for k in range(16))
    wide = " | ".join(f"if(2 * size(filter({grams}, h -> (shiftrightunsigned(h, {b}) & 1L) = 1L)) > size({grams}), shiftleft(1L, {b}), 0L)" for b in range(64))
    return F.expr(f"CASE WHEN size({grams}) <= {LANE_GRAMS} THEN aggregate({grams}, {zero}, (a, h) -> {step}, s -> {bits}) ELSE {wide} END")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of each of radius + 1 blocks of the 64 bits."""
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]


def _block_values(radius: int) -> Column:
    values = ", ".join(f"(shiftrightunsigned(fingerprint, {lo}) & {mask}L)" for lo, mask in _blocks(radius))
    return F.posexplode_outer(F.expr(f"array({values})")).alias("block", "value")


def _first_common_block(radius: int) -> str:
    cases = " ".join(f"WHEN (shiftrightunsigned(x, {lo}) & {mask}L) = 0 THEN {b}" for b, (lo, mask) in enumerate(_blocks(radius)))
    return f"CASE {cases} END"


def items_of(benchmark: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """item_id, n (words), grams of each item, whole whatever its length; items without words are left out."""
    return (benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.expr(_words(f"cast(`{text_col}` AS string)")).alias("w"))
            .where("size(w) > 0").select("item_id", F.size("w").alias("n"), F.expr(_shingles("w", shingle)).alias("grams")))


def _grams_of(text: str, shingle: int) -> Column:
    """Shingle hashes of a text; the words are bound once, in a lambda, so no rewrite of the plan can split them again per shingle."""
    return F.expr(f"element_at(transform(array({_words(text)}), w -> {_shingles('w', shingle)}), 1)")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", shingle: int = 5, percent: int = 75, radius: int = 23) -> DataFrame:
    """``contaminated``, and ``tx``: the matches of each distinct text of an id."""
    rows = documents(docs, id_col, text_col).withColumn("tx", text_key())
    items = cut_lineage(items_of(benchmark, item_col, item_text_col, shingle).withColumn("fingerprint", simhash("grams")), "items")
    gate = items.select(F.explode("grams").alias("gram"), "n").distinct()
    n_gate = items.select(F.sum(F.size("grams")).alias("n")).first()["n"] or 0
    index = items.select("item_id", "n", F.col("grams").alias("item_grams"), F.col("fingerprint").alias("item_print"), _block_values(radius))

    # Outer explodes: an inner one would be given a filter on its array's size, which builds the array a second time.
    grams = rows.select("doc_id", "tx", _grams_of("text", shingle).alias("grams"))
    hits = grams.select("doc_id", "tx", F.posexplode_outer("grams").alias("place", "gram")).join(_bounded(gate, n_gate), "gram")
    # m shingles in a window of n words, need of which must be hits: need hits within m places, and every window start around them.
    hits = (hits.groupBy("doc_id", "tx", "n").agg(F.array_sort(F.collect_list("place")).alias("p"))  # at most a document's own words
            .withColumn("m", F.expr(f"greatest(n - {shingle - 1}, 1)")).withColumn("need", F.expr(f"(m * {percent} + 99) div 100"))
            .where("size(p) >= need"))
    starts = ("flatten(transform(filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < m), "
              "i -> sequence(p[i + need - 1] - m + 1, p[i])))")
    hits = (hits.select("doc_id", "tx", "n", "m", F.expr(f"array_distinct({starts})").alias("starts")).where("size(starts) > 0"))
    wanted = hits.select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), "n", "m", "starts")
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t")))
    found = found.select("doc_id", "tx", "n", "m", "starts", _grams_of("text", shingle).alias("grams"))
    windows = found.select("doc_id", "tx", "n", F.expr(
        "inline_outer(transform(starts, s -> named_struct('start', greatest(s, 0), 'grams', slice(grams, greatest(s, 0) + 1, m + least(s, 0)))))"))
    probes = (windows.withColumn("fingerprint", simhash("grams"))
              .select("doc_id", "tx", "n", "start", "grams", "fingerprint", _block_values(radius)))
    near = (probes.join(_bounded(index, n_gate * (radius + 1)), ["n", "block", "value"]).withColumn("x", F.expr("fingerprint ^ item_print"))
            .where(f"bit_count(x) <= {radius}").where(f"block = {_first_common_block(radius)}"))
    plain = "size(array_distinct(grams)) = size(grams) AND size(array_distinct(item_grams)) = size(item_grams)"
    counted = ("aggregate(array_distinct(item_grams), 0, (a, g) -> a + least(size(filter(grams, y -> y = g)), size(filter(item_grams, y -> y = g))))")
    near = (near.withColumn("both", F.expr(f"CASE WHEN {plain} THEN size(array_intersect(grams, item_grams)) ELSE {counted} END"))
            .withColumn("either", F.expr("size(grams) + size(item_grams) - both")).where(f"100 * both >= {percent} * either"))
    best = near.groupBy("doc_id", "tx", "item_id").agg(F.max(F.expr("struct(both / either AS similarity, -start AS back)")).alias("best"))
    return best.select("doc_id", "tx", "item_id", "best.similarity", F.expr("cast(-best.back AS bigint)").alias("window_start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", shingle: int = 5, percent: int = 75, radius: int = 23) -> DataFrame:
    """doc_id, item_id, similarity, window_start: each document and item with a window similar enough.

    ``similarity`` is the best window's, ``window_start`` the first word (from 0)
    of the first such window.  Defined cases: a null or empty text or item
    matches nothing; an item of fewer words than ``shingle`` matches only a whole
    document of the same words; a row with a null id is examined like any other
    and reported under null; rows that repeat an id are reported once; other
    columns are ignored.
    """
    found = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, shingle, percent, radius)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.expr("struct(similarity, -window_start AS back)")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", F.expr("-best.back").alias("window_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose own text is contaminated, whatever their id.

    Defined cases are those of ``contaminated``; columns may have any names.
    """
    # The whole row travels as one struct, so no column of it can clash with ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       text_key(F.col(f"`{text_col}`").cast("string")).alias("tx"))
    bad = cut_lineage(_matches(docs, benchmark, id_col, text_col, **options)
                      .select(F.col("doc_id").alias("bad_id"), F.col("tx").alias("bad_tx")).distinct(), "contaminated")
    return rows.join(_bounded(bad, bad.count()), F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("tx") == F.col("bad_tx")), "left_anti").select("row.*")
