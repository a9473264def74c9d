"""Line dedup with keep bitmaps (DataFrame functions only).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  A key of at least ``min_chars`` code points found in at least
``min_docs`` documents is repeated; its lines go, except in the document with the
largest id that holds it.

1. Every long line becomes a small row (hash, document, position), written once.
   Texts stay where they are.
2. Those rows are range-partitioned by hash and sorted by document, largest first,
   and position.  A window streams over each hash: the rows of its first document
   are the first occurrence and stay, the others go once the hash counts enough
   documents.
3. A line that a large share of all rows hold would be one range.  Such hashes (at
   most ``1 / HOT_SHARE`` of them) are found on a sample and take another way:
   documents of each are deduplicated and counted with partial aggregation, and the
   few results are looked up in the map task.  The sample decides the way, not the
   result.
4. The positions that go are gathered for each document and become its keep bitmap,
   as run lengths.  Applying it to a text takes slices of its lines.

Lines are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import text_key

HOT_SHARE = 1 / 2000      # of the sampled lines: a hash with more takes the pre-aggregated way
SAMPLE_LINES = 1_000_000  # about so many lines are sampled to find them
_STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(line: Column) -> Column:
    """A-Z lower-cased; ``lower`` does the same for a line of ASCII, and faster."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, tx, place, h1, h2) of each line whose key has ``min_chars`` code points; ``tx`` tells apart texts under one id."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    lines = rows.select("doc", text_key().alias("tx"), F.posexplode(_lines_of(F.col("text"))).alias("place", "line"))
    long = lines.select("doc", "tx", "place", F.btrim("line", F.lit(_STRIPPED)).alias("k")).where(F.length("k") >= min_chars)
    keys = long.select("doc", "tx", "place", _lower(F.col("k")).alias("k"))
    return keys.select("doc", "tx", "place", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(11), F.col("k")).alias("h2"))


def hot_hashes(lines: DataFrame, share: float, sample: int) -> list[int]:
    """Hashes with more than ``share`` of the sampled lines: fewer than 1 / ``share``, whatever the table."""
    rows = lines.count()
    if not rows:
        return []
    some = lines.select("h1") if rows <= sample else lines.select("h1").sample(fraction=sample / rows, seed=11)
    total = min(rows, sample)
    return [r["h1"] for r in some.groupBy("h1").count().where(F.col("count") > share * total).collect()]


def _dropped(lines: DataFrame, min_docs: int, share: float, sample: int) -> DataFrame:
    """(doc, tx, place) of the lines that go."""
    hot = hot_hashes(lines, share, sample)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    by_hash = Window.partitionBy("h1", "h2")
    streamed = (lines.where(~is_hot).repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "place")
                .withColumn("nth", F.dense_rank().over(by_hash.orderBy(F.desc("doc"))))
                .withColumn("docs", F.max("nth").over(by_hash))
                .where((F.col("nth") > 1) & (F.col("docs") >= min_docs)).select("doc", "tx", "place"))
    if not hot:
        return streamed
    often = lines.where(is_hot)
    kept = (often.select("h1", "h2", "doc").distinct().groupBy("h1", "h2")
            .agg(F.count("*").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs))
    # One row for each hash that shares its first half with a hot one: the hot ones themselves, but for accidents.
    return streamed.unionByName(often.join(F.broadcast(kept), ["h1", "h2"]).where("doc < last").select("doc", "tx", "place"))


def keep_edges(places: str, n: str) -> Column:
    """Run-length coded keep bitmap: the lines at which runs kept and dropped take turns, a kept run (perhaps empty) first.

    ``places`` holds the dropped lines, sorted, without repeats (null: none); the last edge is ``n``, the number of lines.
    """
    first = "filter(p, (x, i) -> i = 0 OR p[i - 1] < x - 1)"
    after = "transform(filter(p, (x, i) -> i = size(p) - 1 OR p[i + 1] > x + 1), x -> x + 1)"
    edges = f"concat(flatten(transform(arrays_zip({first}, {after}), z -> array(z.`0`, z.`1`))), array({n}))"
    return F.expr(f"if({places} IS NULL, array({n}), transform(array({places}), p -> {edges})[0])")


def apply_keep(text: Column, keep: str) -> Column:
    """The kept lines of the text, joined by line ends, given the edges in column ``keep``."""
    bound = F.array(F.struct(F.split(F.coalesce(text, F.lit("")), "\n").alias("l"), F.col(keep).alias("e")))  # bound once: neither is built again for each run

    def kept(z: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(z["e"]) - 1) / 2).cast("int")), lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get(z["e"], 2 * k - 1)).alias("lo"), F.get(z["e"], 2 * k).alias("hi")))
        return F.array_join(F.transform(F.filter(runs, lambda r: r["lo"] < r["hi"]),
                                        lambda r: F.array_join(F.slice(z["l"], r["lo"] + 1, r["hi"] - r["lo"]), "\n")), "\n")
    return F.when(F.size(keep) == 1, F.coalesce(text, F.lit(""))).otherwise(F.transform(bound, kept)[0])


def _with_edges(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, share: float, sample: int) -> DataFrame:
    """A struct ``row`` of all columns of each row, its ``doc``, ``text``, ``n_lines``, ``n_dropped`` and ``keep``."""
    lines = cut_lineage(long_lines(docs, id_col, text_col, min_chars), "lines")
    gone = (_dropped(lines, min_docs, share, sample).groupBy("doc", "tx")
            .agg(F.sort_array(F.collect_set("place")).alias("places")))  # at most a document's own lines
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"),
                       text.alias("text"), text_key(text).alias("tx"), F.size(_lines_of(text)).alias("n_lines"))
    both = rows.join(gone, ["doc", "tx"], "left").select("row", "doc", "text", "n_lines", "places")
    return both.select("row", "doc", "text", "n_lines", F.coalesce(F.size("places"), F.lit(0)).alias("n_dropped"),
                       keep_edges("places", "n_lines").alias("keep"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
                      with_text: bool = False, hot_share: float = HOT_SHARE, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep for each row of ``docs``; with ``with_text`` also the kept text.

    ``keep`` is a run-length coded bitmap of the lines: the line numbers (from 0) at
    which runs of kept and of dropped lines take turns, a kept run first; the last is
    n_lines.  Without ``with_text`` no text leaves the scan.  Defined cases: a null or
    empty text is one empty line, kept; a row with a null id takes no part (its lines
    neither count nor go); rows that repeat an id are one document when lines are
    counted, each keeping its own lines by its own text; a line that a document holds
    twice stays or goes in both places; an empty table gives an empty result;
    other columns are ignored.
    """
    out = _with_edges(docs, id_col, text_col, min_chars, min_docs, hot_share, sample_lines)
    text = [apply_keep(F.col("text"), "keep").alias("kept_text")] if with_text else []
    return out.select(F.col("doc").alias("doc_id"), F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), "keep", *text)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated lines cut from the text; a text that loses none, or is null, stays as it is.

    Defined cases are those of ``line_keep_bitmaps``; columns may have any names.
    """
    out = _with_edges(docs, id_col, text_col, min_chars, min_docs, HOT_SHARE, SAMPLE_LINES)
    cut = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(apply_keep(F.col("text"), "keep"))
    return out.select(*(cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
