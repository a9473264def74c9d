"""Sharding by histogram sort (DataFrame functions only).

Documents are ordered by (hash of the text, hash of the id), which puts equal
texts side by side, and cut into ranges of nearly equal bytes.  The cuts are
found by counting: each round counts, across all partitions, the exact bytes and
rows of the key intervals that still hold a cut, each split into 256, and keeps
the child interval where the wanted byte falls.  It ends when every cut is
within the tolerance or between two neighbouring keys.  Only then are rows moved,
once, to their final place.

The key is two 64-bit numbers read as 16 digits of 8 bits, most significant
first.  A text that a third of all rows share is one value of the first eight
digits; the rounds then go on into the id's digits, so it is spread like any
other range and never has to fit into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import documents

DIGITS = 16  # of 8 bits: eight of the text's hash, eight of the id's
ROW_BYTES = 16  # what a row weighs besides its text


def key_prefix(digits: int) -> Column:
    """The first ``digits`` digits of the key, two hexadecimal characters each (their order is the key's order)."""
    return F.substring(F.col("key"), 1, 2 * digits)


def _key(doc_id: Column, text: Column) -> Column:
    """16 digits as 32 hexadecimal characters.  A null text is a group of its own, a null id hashes to a fixed value."""
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text, text.isNull()), F.xxhash64(doc_id))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return documents(docs, id_col, text_col).select(
        "doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), _key(F.col("doc_id"), F.col("text")).alias("key"))


@dataclass
class _Cut:
    """A cut sought at ``target`` bytes: somewhere in the keys that begin with ``prefix``, before which lie ``below`` bytes."""
    target: float
    prefix: str
    below: int
    at: str | None = None  # the first key (prefix) of the range after the cut, once found


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[str]:
    """``shards`` - 1 key prefixes in order; a row belongs after each prefix that its key is not less than.

    ``tolerance``: accepted error of a cut, as a share of a shard's bytes.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    cuts = [_Cut(total * i / shards, "", 0) for i in range(1, shards)]
    accepted = tolerance * total / shards
    for digit in range(1, DIGITS + 1):
        sought = [c for c in cuts if c.at is None]
        if not sought:
            break
        active = sorted({c.prefix for c in sought})
        counted = (keyed.where(key_prefix(digit - 1).isin(active)).groupBy(key_prefix(digit).alias("p"))
                   .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
        children: dict[str, list] = {p: [] for p in active}
        for row in sorted(counted.collect(), key=lambda r: r["p"]):  # at most 256 intervals for each cut
            children[row["p"][:-2]].append(row)
        for cut in sought:
            below = cut.below
            for i, child in enumerate(children[cut.prefix]):
                after = below + child["bytes"]
                if after < cut.target and i + 1 < len(children[cut.prefix]):
                    below = after
                    continue
                # The cut falls into this child: take its nearer edge if that is good enough or nothing finer exists.
                low, high = cut.target - below, after - cut.target
                if min(low, high) <= accepted or child["rows"] == 1 or digit == DIGITS:
                    cut.at = child["p"] if low <= high else child["p"] + "~"  # "~" sorts after every hexadecimal digit
                else:
                    cut.prefix, cut.below = child["p"], below
                break
            else:
                cut.at = ""  # no rows at all
    return sorted(c.at or "" for c in cuts)


def _range_of(cuts: list[str]) -> Column:
    """Number of cuts that are not greater than the key, by binary search in a literal array."""
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    if not cuts:
        return F.lit(0)
    table = "array(" + ", ".join(f"'{c}'" for c in cuts) + ")"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
                  f"CASE WHEN at + step <= {len(cuts)} AND {table}[at + step - 1] <= key THEN at + step ELSE at END)")


def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                     tolerance: float = 0.001, ranges_per_shard: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``, by the law ``bytes``.

    Shards hold nearly equal bytes (text in UTF-8 plus 16 a row): each cut is
    within ``tolerance`` of a shard, or as near as whole rows allow.  ``slot``
    numbers a shard's rows from 0 in key order, so equal texts are neighbours;
    a group of equal texts is split only where a cut falls into it.  Every shard
    is moved as ``ranges_per_shard`` equal ranges, so a task gets a range and not
    a whole shard.  Defined cases: a null text weighs 16, its crc32 is null; a null
    id is kept; rows with the same id and text get slots in an arbitrary order; an
    empty table gives an empty result; other columns are ignored.
    """
    keyed = cut_lineage(_keyed(docs, id_col, text_col), "keys")  # small: no texts
    cuts = splitters(keyed, shards * ranges_per_shard, tolerance * ranges_per_shard)
    placed = keyed.withColumn("part", _range_of(cuts))
    counts = placed.groupBy("part").agg(F.count("*").alias("rows")).collect()  # one row for each range
    rows = {r["part"]: r["rows"] for r in counts}
    offsets, seen = [], 0
    for r in range(shards * ranges_per_shard):
        if r % ranges_per_shard == 0:
            seen = 0
        offsets.append(seen)
        seen += rows.get(r, 0)
    before = F.expr(f"array({', '.join(f'{n}L' for n in offsets)})[part]")
    in_range = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.expr(f"cast(part div {ranges_per_shard} AS int)").alias("shard"),
        (before + in_range - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = 0.001, ranges_per_shard: int = 8) -> None:
    """Write all columns of ``docs`` as Parquet, one folder ``shard=N`` for each shard, in key order; the rows move once."""
    keyed = cut_lineage(_keyed(docs, id_col, text_col), "keys")
    cuts = splitters(keyed, shards * ranges_per_shard, tolerance * ranges_per_shard)
    key = _key(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    (docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), key.alias("key")).withColumn("part", _range_of(cuts))
     .repartition(shards * ranges_per_shard, "part").sortWithinPartitions("part", "key")
     .select("whole.*", F.expr(f"cast(part div {ranges_per_shard} AS int)").alias("shard"))
     .write.mode("overwrite").partitionBy("shard").parquet(path))
