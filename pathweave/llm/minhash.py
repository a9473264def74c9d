"""Near duplicates by one-permutation MinHash.

1. A text's set is its distinct shingles of ``shingle`` words.  One hash per
   shingle is enough for all ``bands * rows`` bins: its high part picks the bin,
   each bin keeps its least hash, and an empty bin borrows from a bin picked by a
   hash of (bin, attempt), until one that isn't empty (optimal densification).
2. Texts with equal sets are one class, for which the least id stands.
3. ``rows`` bins form a band; classes with an equal band share a bucket.  A bucket
   of k classes gives k - 1 candidate edges, a star around its least id, and not
   k * (k - 1) / 2 pairs.
4. Candidates are confirmed on full sets and joined to components, in turns of one pair a
   member: those that a turn has connected needn't be compared.
5. A star alone could lose a link between two leaves that aren't linked with the
   centre.  Buckets that still hold several components make clusters, over shared
   members.  A large cluster first gets more stars, around other centres: one pair a
   member each, which contract its components further.
6. What is left is compared in blocks on full sets.  A block gives out a spanning
   forest of what it connects, never its similar pairs.  Each pair that shares a
   bucket is thus confirmed, refused, or already connected.

With 6 rows and 50 bands, a pair at similarity 0.75 shares no bucket with
probability (1 - 0.75^6)^50 = 6e-5, at 0.8 with probability 3e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import arrow_map, documents, drop_tables, give_back, text_key
from .words import Words, mix, sequence_hashes, signed, text_chunks

BLOCK_BYTES = 2 << 20  # of sets that a task compares with another such block
MATRIX_GRAMS = 2048   # shingles in a 0/1 matrix at a time
LARGE_BLOCKS = 16     # a cluster of more blocks gets stars before its blocks meet
_U = np.uint64


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and the row bounds.

    A row with words but fewer than ``shingle`` has its whole sequence as one shingle.
    """
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams = sequence_hashes(hashes, shingle)
    begin = np.flatnonzero(words.room(shingle)[:len(grams)])
    rows, values = [words.doc[begin]], [grams[begin]]
    for n in range(1, shingle):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            rows.append(short)
            values.append(sequence_hashes(hashes, n)[words.first[short]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(words.rows + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` hashes for each non-empty set, densified."""
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    row = np.repeat(np.arange(len(filled)), sizes[filled])
    flat = np.full(len(filled) * bins, np.iinfo(np.uint64).max, np.uint64)
    bin_of = ((values >> _U(32)) * _U(bins)) >> _U(32)
    at = row * bins + bin_of.astype(np.int64)
    order = np.lexsort((values, at))
    at, low = at[order], values[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    flat[at[first]] = mix(low[first])
    table = flat.reshape(len(filled), bins)
    empty = np.ones(len(filled) * bins, bool)
    empty[at] = False
    lacking = np.flatnonzero(empty)
    attempt = 0
    while len(lacking):
        attempt += 1
        r, b = np.divmod(lacking, bins)
        pick = mix(b.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(bins)
        source = r * bins + pick.astype(np.int64)
        found = ~empty[source]
        flat[lacking[found]] = flat[source[found]]
        lacking = lacking[~found]
    return table


def _sign_body(shingle: int, bands: int, rows: int):
    def body(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        for lo, texts in text_chunks(batch.column("text")):
            values, bounds = shingle_sets(texts, shingle)
            sizes = np.diff(bounds)
            filled = np.flatnonzero(sizes)
            table = signatures(values, bounds, bands * rows)
            keys = np.zeros((len(filled), bands), np.uint64)
            for r in range(rows):
                keys = mix(keys * _U(0x9E3779B97F4A7C15) + table[:, r::rows][:, :bands])
            keys = mix(keys + np.arange(bands, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
            prints = [hashlib.blake2b(values[bounds[i]:bounds[i + 1]].tobytes(), digest_size=16).digest() for i in filled]
            lists = np.zeros(len(sizes) + 1, np.int64)
            lists[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            where = np.full(len(sizes), -1)
            where[filled] = np.arange(len(filled))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, len(sizes)), pa.array(sizes.astype(np.int64)),
                 pa.array([prints[i] if i >= 0 else None for i in where], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(signed(keys.reshape(-1))))],
                names=["doc_id", "n_shingles", "class", "keys"])
    return body


def _sets_body(shingle: int):
    def body(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        for lo, texts in text_chunks(batch.column("text")):
            values, bounds = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, len(bounds) - 1),
                 pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["node", "members"])
    return body


def _confirm_body(percent: int):
    def body(batch: pa.RecordBatch):
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])
    return body


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = (pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("ys")), "b")
              .join(sets.select(F.col("node").alias("a"), F.col("members").alias("xs")), "a"))
    return arrow_map(joined.select("a", "b", "xs", "ys"), _confirm_body(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node each linked node can reach, by least labels and pointer jumps.

    Only nodes whose label has changed tell it to their neighbours, so an edge isn't
    read again in each round; at first those are the nodes with a lesser neighbour.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    label = cut_lineage(label.withColumn("changed", F.expr("component <> node")), "labels")
    while True:
        told = label.where("changed").select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        near = both.join(told, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        least = label.join(near, "node", "left").select("node", "component", F.least("component", "theirs").alias("lower"))
        jump = label.select(F.col("node").alias("lower"), F.col("component").alias("root"))
        after = least.join(jump, "lower", "left").select("node", F.least("lower", "root").alias("component"), F.col("component").alias("before"))
        after = cut_lineage(after.select("node", "component", F.expr("component <> before").alias("changed")), "labels")
        done = after.where("changed").isEmpty()
        drop_tables(label)
        label = after
        if done:
            drop_tables(both)
            return label.select("node", "component")


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a forest with the connected components of a symmetric 0/1 matrix: fewer than its rows."""
    unseen = np.ones(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if not unseen[root]:
            continue
        unseen[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & unseen)
            unseen[found] = False
            edges += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return edges


def _block_links(percent: int):
    """Links that connect the components among one or two blocks of sets, by products of 0/1 matrices: a spanning forest."""
    def run(key, table):
        side = table.column("side").to_numpy()
        rows = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(rows[1]):
            rows[1] = rows[0]  # a block with itself
        members = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        size = np.array([len(m) for m in members])
        node = table.column("node").to_numpy()
        component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        grams, code = np.unique(np.concatenate(members), return_inverse=True)
        of = np.repeat(np.arange(len(members)), size)
        common = np.bincount(code, minlength=len(grams)) > 1
        number = np.cumsum(common) - 1
        of, code = of[common[code]], number[code[common[code]]]
        both = np.zeros((len(rows[0]), len(rows[1])), np.float32)
        order = np.argsort(code, kind="stable")
        of, code = of[order], code[order]
        for lo in range(0, int(common.sum()), MATRIX_GRAMS):
            part = slice(*np.searchsorted(code, [lo, lo + MATRIX_GRAMS]))
            dense = np.zeros((len(members), MATRIX_GRAMS), np.float32)
            dense[of[part], code[part] - lo] = 1
            both += dense[rows[0]] @ dense[rows[1]].T
        union = size[rows[0]][:, None] + size[rows[1]][None, :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (component[rows[0]][:, None] != component[rows[1]][None, :]))
        x, y = rows[0][x], rows[1][y]
        pair = np.full((component.max() + 1,) * 2, -1)
        pair[component[x], component[y]] = pair[component[y], component[x]] = np.arange(len(x))
        used = np.array([pair[i, j] for i, j in spanning_forest(pair >= 0)], np.int64)
        a, b = node[x[used]], node[y[used]]
        give_back()
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, turns: int = 3) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the candidate pairs (a, b), a < b.

    Near copies share many buckets, of as many centres.  In a turn each member is compared with
    the least centre that isn't in its component yet, one pair a member; what the
    turns don't connect is compared at last.  A pair is confirmed, refused or already connected.
    """
    links = label = None
    left = pairs
    for turn in range(turns + 1):
        asked = left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if turn < turns else left
        asked = cut_lineage(asked, "asked")
        if asked.isEmpty():
            drop_tables(asked)
            break
        found = cut_lineage(confirmed(asked, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        label = components(links)
        if turn < turns:
            of = [label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b")]
            tried = asked.select("b", F.col("a").alias("tried"))
            left = (left.join(tried, "b").where("a > tried").drop("tried").join(of[0], "a", "left").join(of[1], "b", "left")
                    .where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"))
            left = cut_lineage(left, "pairs_left")
    if links is None:
        links = cut_lineage(confirmed(pairs, sets, percent), "links")
        label = components(links)
    return links, label


def _weight() -> Column:
    """Bytes that a set takes in a block, about."""
    return 8 * F.col("n") + 2048


def _clusters(rest: DataFrame) -> DataFrame:
    """(node, n, component, cluster) of the members (key, node, n, component) of unsettled buckets: buckets that share members make a cluster."""
    edges = (rest.join(rest.groupBy("key").agg(F.min("node").alias("a")), "key").where("node > a")
             .select("a", F.col("node").alias("b")).distinct())
    clusters = components(edges).withColumnRenamed("component", "cluster")
    return cut_lineage(rest.select("node", "n", "component").distinct().join(clusters, "node"), "clusters")


def _more_stars(nodes: DataFrame, turn: int, percent: int) -> DataFrame | None:
    """Pairs of each large cluster's next centre with the members of other components; None if no cluster is large."""
    large = nodes.groupBy("cluster").agg(F.sum(_weight()).alias("bytes")).where(F.col("bytes") > LARGE_BLOCKS * BLOCK_BYTES).select("cluster")
    draw = F.xxhash64("node", F.lit(turn))
    centres = (nodes.join(large, "cluster").groupBy("cluster")
               .agg(*(F.min_by(c, draw).alias(f"c_{c}") for c in ("node", "n", "component"))))
    if centres.isEmpty():
        return None
    pairs = nodes.join(centres, "cluster").where("component <> c_component").where(f"100 * least(c_n, n) >= {percent} * greatest(c_n, n)")
    return pairs.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b"))


def _remaining_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect the components among the nodes of each cluster.

    The nodes, in order of their set's size, are cut into blocks of bounded bytes; every
    two blocks meet in one task, which hands out fewer links than it has members.
    Blocks whose sizes can't be similar don't meet, nor do two blocks of the cluster's
    largest component, so a great group of near copies only meets those that aren't in
    it yet.
    """
    largest = (nodes.groupBy("cluster", "component").agg(F.count("*").alias("c"))
               .groupBy("cluster").agg(F.max_by("component", "c").alias("largest")))
    before = F.sum(_weight()).over(Window.partitionBy("cluster", "major").orderBy("n", "node"))
    nodes = (nodes.join(largest, "cluster").withColumn("major", F.expr("component = largest"))
             .withColumn("block", F.floor(before / BLOCK_BYTES)).select("node", "n", "component", "cluster", "major", "block"))
    nodes = cut_lineage(nodes, "clusters")
    blocks = (nodes.groupBy("cluster", "major", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
              .withColumn("name", F.expr("2 * block + cast(major AS int)")))
    other = blocks.select("cluster", *(F.col(c).alias(f"{c}2") for c in ("major", "low", "high", "name")))
    meetings = (blocks.join(other, "cluster").where("name <= name2 AND NOT (major AND major2)")
                .where(f"100 * least(high, high2) >= {percent} * greatest(low, low2)").select("cluster", "name", "name2"))
    sides = meetings.select("cluster", "name", "name2", F.explode(F.expr(
        "CASE WHEN name = name2 THEN array(struct(0 AS side, name AS own)) "
        "ELSE array(struct(0 AS side, name AS own), struct(1 AS side, name2 AS own)) END")).alias("s"))
    rows = (nodes.withColumn("own", F.expr("2 * block + cast(major AS int)"))
            .join(sides.select("cluster", "name", "name2", "s.*"), ["cluster", "own"]).join(sets, "node"))
    return (rows.select("cluster", "name", "name2", "side", "node", "component", "members")
            .groupBy("cluster", "name", "name2").applyInArrow(_block_links(percent), "a long, b long").where("a < b").distinct())


def _unsettled(members: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``members`` whose bucket still holds more than one component, with their component."""
    labelled = (members.select("key", "node", "n").join(label, "node", "left")
                .select("key", "node", "n", F.coalesce("component", "node").alias("component")))
    several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return cut_lineage(labelled.join(several, "key"), "unsettled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 75, bands: int = 50, rows: int = 6, stars: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Links are pairs with 100 * intersection >= ``percent`` * union of their
    shingle sets (A-Z lower-cased).  ``stars`` bounds the rounds of stars in large
    clusters; the result doesn't depend on it.  Defined cases: texts that are null, empty or
    without words have no shingles and no links; a null id is never linked, its
    component is null and it is kept; rows that repeat an id are one node, so they
    share a component; other columns are ignored.
    """
    source = documents(docs, id_col, text_col)
    signed_docs = cut_lineage(arrow_map(source, _sign_body(shingle, bands, rows),
                                        "doc_id long, n_shingles long, class binary, keys array<long>"), "signatures")
    linkable = signed_docs.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("class").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys"),
                                            F.first("n_shingles").alias("n"))
    members = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    members = cut_lineage(members.join(buckets.select("key", "centre"), "key").select("key", "node", "n", "centre"), "buckets")

    fits = F.expr(f"100 * least(an, n) >= {percent} * greatest(an, n)")  # sizes alone can refuse a pair
    centre = members.where("node = centre").select("key", F.col("node").alias("a"), F.col("n").alias("an")).distinct()
    pairs = (members.where("node > centre").join(centre, "key").where(fits)
             .select("a", F.col("node").alias("b")).distinct())
    in_buckets = members.select(F.col("node").alias("doc_id")).distinct()
    sets = arrow_map(source.join(in_buckets, "doc_id", "left_semi"), _sets_body(shingle), "node long, members binary")
    if not linkable.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.distinct()  # rows that repeat an id: each of its texts once
    sets = cut_lineage(sets, "sets")
    pairs = cut_lineage(pairs, "pairs")
    links, label = _star_links(pairs, sets, percent)

    # What stars leave: a link between two members neither of which is linked with their bucket's centre.
    rest = _unsettled(members.where("node > centre"), label)
    nodes = _clusters(rest)
    for turn in range(1, stars):
        more = _more_stars(nodes, turn, percent)
        if more is None:
            break
        links = cut_lineage(links.unionByName(confirmed(more, sets, percent)), "links")
        label = components(links)
        nodes = cut_lineage(nodes.drop("component").join(label, "node", "left")
                            .withColumn("component", F.coalesce("component", "node")), "clusters")
    more = cut_lineage(_remaining_links(nodes, sets, percent), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    drop_tables(members, pairs, sets, links, rest, nodes, more)

    owner = linkable.select("doc_id", "class").join(classes.select("class", "node"), "class")
    owner = (owner.join(label, "node", "left").groupBy("doc_id")
             .agg(F.min(F.coalesce("component", "node")).alias("component_id")))
    return (signed_docs.select("doc_id", "n_shingles").join(owner, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near duplicates the row with the least id stays.

    Rows are judged by their own text, whatever their id: where an id has several
    texts, each is a document of its own (ties between them go to the lesser
    fingerprint of the text), and of rows with the same id and text one stays.  A
    null id or a text without words is never a duplicate.  Columns may have any names.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                      F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("tx", text_key())
    several = cut_lineage(row.where("id IS NOT NULL").groupBy("id").agg(F.min("tx").alias("x"), F.max("tx").alias("y"), F.count("*").alias("n"))
                          .where("n > 1").select("id", F.expr("x < y").alias("texts")), "repeated_ids")
    if several.isEmpty():
        found = near_duplicates(row, "id", "text", **options).where("NOT kept").select(F.col("doc_id").alias("id"))
        return row.join(found, "id", "left_anti").select("row.*")
    # A number of its own for each text of an id: the id itself where there is only one.
    row = row.join(several, "id", "left").withColumn("node", F.when(F.coalesce("texts", F.lit(False)), F.xxhash64("id", "tx")).otherwise(F.col("id")))
    found = near_duplicates(row, "node", "text", **options).select(F.col("doc_id").alias("node"), "component_id").where("node IS NOT NULL").distinct()
    first = (row.where("node IS NOT NULL").select("node", "id", "tx").distinct().join(found, "node")
             .groupBy("component_id").agg(F.min(F.struct("id", "tx")).alias("first")))
    stays = first.select(F.col("first.id").alias("id"), F.col("first.tx").alias("tx"))
    kept = row.join(stays, ["id", "tx"], "left_semi")
    once = kept.where("texts IS NULL").unionByName(kept.where("texts IS NOT NULL").dropDuplicates(["id", "tx"]))
    return once.unionByName(row.where("id IS NULL").select(once.columns)).select("row.*")
