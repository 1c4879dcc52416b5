"""MinHash near-dedup by DartMinHash.

A document's elements are its shingles of five words, weighted by how often
they occur. Darts are thrown at the regions (element, weight, rank): the
darts of a unit of weight come as a Poisson process in rank, all of them
functions of hashes, so two documents see the same darts where their regions
agree. A document keeps the darts below its weight and below a rank at which
about ``K (ln K + 3)`` of them are expected (the rank is doubled for those that
leave a coordinate empty), each dart belongs to one of ``K`` coordinates, and
the earliest per coordinate is the signature: coordinates agree with a
probability of the weighted Jaccard similarity. ``BANDS`` bands of four
coordinates are joined; a pair of similarity 0.8 is missed once in 40,000.

From bands to classes, without all pairs of a band:

1. exact copies are one node (a 128-bit digest of the text),
2. nodes are dropped whose similarity to any other can't reach the threshold: a shingle cell that no other
   node of any bucket has is in no intersection, which bounds the similarity of a node and of a pair exactly,
3. in two rounds, each node of a bucket is compared with the bucket's one hub (the node that
   shares buckets with most others, then the one of those outside the first one's class; the exact weighted Jaccard similarity of the shingles decides),
   and nodes that agree become a class (connected components),
4. in buckets that still hold several classes, each node is put as its difference from the hub: the cells that one of them has and the other has not.
   Nodes a and b differ in |Da| + |Db| - 2 |Da and Db| cells, which similarity holds down to a share of their sizes, so a pair of which one has
   no link to the hub must have cells of its differences in common, and one of these must be among the rarest half or so of each (a prefix filter on
   differences, not on whole sets: what all of a group have in common never makes a pair). Pairs that have are compared. No link between classes is lost
   and none is capped; pairs within a class need no more comparison.

How it is spread: signatures are one narrow pass; buckets, pairs and labels are shuffled by
hashes and kept in the shared folder; nothing is collected but counts of changes.

Edge cases: null and empty texts have no shingles and are copies of each other only; texts of
one to four words are one shingle; a very long text has as many cells as words and is held whole by the task that has its row; a similarity of exactly the
threshold is a link; rows that agree in id and text are one document; a null id names no class
unless all of a class are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, free, materialize, mix64, named, sizes, slices, text_key, unit, utf8

SHINGLE, SIMILARITY = 5, 0.8
K, BANDS, ROWS = 80, 20, 4
BATCH_BYTES = 1 << 20


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of all texts: the number of the text, and a hash of (shingle, occurrence of it). Sorted by text."""
    w = Words(texts)
    h = w.hashes()
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    s = np.zeros(n, U64)
    place = np.arange(n) - w.first[w.doc]
    left = w.counts[w.doc] - place  # words from here on
    for j in range(SHINGLE):
        there = np.minimum(np.arange(n) + j, n - 1)
        s += np.where(left > j, mix64(h[there] + U64(j * 0x51ED27)), U64(j + 1))
    keep = (left >= SHINGLE) | (place == 0)
    doc, s = w.doc[keep], mix64(s[keep])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return doc, mix64(s + run.astype(U64) * U64(0xD1B54A32D192ED03))


def signatures(doc: np.ndarray, cells: np.ndarray, n_docs: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(n_docs, k) hashes of the earliest darts, and the number of cells of each text; rows without cells are zeros."""
    weight = np.bincount(doc, minlength=n_docs)
    out = np.zeros((n_docs, k), U64)
    reach = k * (np.log(k) + 3) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight)
    while len(todo):
        mine = np.zeros(n_docs, bool)
        mine[todo] = True
        pick = mine[doc]
        c, d = cells[pick], doc[pick]
        rank = np.zeros(len(c))
        found = []
        throw = 0
        while len(c):
            throw += 1
            dart = mix64(c + U64((throw * 0x9FB21C651E98DF25) & (2**64 - 1)))
            rank = rank - np.log(unit(dart))
            near = rank <= reach[d]
            c, d, rank, dart = c[near], d[near], rank[near], dart[near]
            found.append((d, rank, mix64(dart ^ U64(0xA5A5A5A5A5A5A5A5))))
        d, rank, dart = (np.concatenate(x) for x in zip(*found))
        slot = d * k + (dart % U64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        full = np.bincount(slot[first] // k, minlength=n_docs) == k
        out.reshape(-1)[slot[first]] = dart[first]
        todo = todo[~full[todo]]
        reach[todo] *= 2
    return out, weight


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys of bands of ``rows`` coordinates."""
    s = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.repeat(np.arange(bands, dtype=U64)[None, :], len(s), 0)
    for r in range(rows):
        key = mix64(key * U64(31) + s[:, :, r])
    return key.view(np.int64)


def _signed():
    """A function of a text column: struct(n, bands)."""

    @F.pandas_udf("n long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for part in slices(texts, sizes(texts), BATCH_BYTES):
                doc, cells = elements([utf8(t) for t in texts.iloc[part]])
                signature, weight = signatures(doc, cells, part.stop - part.start)
                yield pd.DataFrame({"n": weight, "bands": [b if n else b[:0] for b, n in zip(band_keys(signature), weight)]})

    return run


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k (id), node (text digest), n (cells), bands (array of keys, empty without words) of every row."""
    kept = docs.select(F.col(id_col).alias("k"), text_key(text_col).alias("node"), _signed()(F.col(text_col)).alias("r"))
    return kept.select("k", "node", "r.*")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, cells (sorted array of 64-bit hashes) from node, t."""

    def run(batches):
        for pdf in batches:
            for part in slices(pdf, sizes(pdf["t"]), BATCH_BYTES):
                doc, cells = elements([utf8(t) for t in pdf["t"].iloc[part]])
                small = cells.view(np.int64)
                cut = np.searchsorted(doc, np.arange(1, part.stop - part.start))
                yield pd.DataFrame({"node": pdf["node"].iloc[part], "cells": np.split(small, cut) if part.stop - part.start > 1 else [small]})

    return texts.mapInPandas(run, "node binary, cells array<long>")


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is ``least`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("cells").alias("ca"))
    two = sets.select(F.col("node").alias("b"), F.col("cells").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb")).cast("double")
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(both / (F.size(F.array_distinct("ca")) + F.size(F.array_distinct("cb")) - both) >= least).select("a", "b")


def differing(nodes: DataFrame, sets: DataFrame, least: float, possible) -> DataFrame:
    """Candidate pairs (a, b) of different labels among the nodes of each hub: all that reach ``least`` and have not both a link to the hub. ``nodes`` has
    hub, nh (the hub's cells), node, label, n, shared.

    With c = (1 - least) / (1 + least), w = |D| - c n: a pair reaches ``least`` if |Da and Db| >= (wa + wb) / 2, and a node has a link to the hub if w <= c nh. One of
    the pair has none, so (wa + wb) / 2 > (w + c nh) / 2 =: t for the other one, and one of the |D| - t rarest of its cells (rounded up) is the other's too."""
    c = (1 - least) / (1 + least)
    far = (
        nodes.join(sets.select("node", "cells"), "node")
        .join(sets.select(F.col("node").alias("hub"), F.col("cells").alias("of_hub")), "hub")
        .withColumn("d", F.concat(F.array_except("cells", "of_hub"), F.array_except("of_hub", "cells")))
        .select("hub", "nh", "node", "label", "n", "shared", F.size("d").alias("size"), "d").where("size > 0")
    )
    far = far.withColumn("w", F.col("size") - c * F.col("n")).withColumn("linked", F.col("w") <= c * F.col("nh"))
    far = far.withColumn("prefix", F.col("size") - F.floor((F.col("w") + c * F.col("nh")) / 2 - 1e-9).cast("int"))
    cells = materialize(far.select("hub", "node", "label", "n", "shared", "size", "w", "linked", "prefix", F.explode("d").alias("cell")), "cells")
    seen = cells.groupBy("hub", "cell").agg(F.count("*").alias("seen"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    place = F.row_number().over(Window.partitionBy("hub", "node").orderBy("seen", "cell"))
    cells = materialize(cells.join(seen, ["hub", "cell"]).withColumn("place", place).where("lo <> hi").drop("seen", "lo", "hi"), "cells")
    names = ["node", "label", "n", "shared", "size", "w", "linked", "prefix", "place"]
    side = lambda mark: cells.select("hub", "cell", *[F.col(x).alias(x + mark) for x in names])
    one, two = side("_a").where("not linked_a"), side("_b").where("place_b <= prefix_b")
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1  # cells in common at most, if this is the first
    wanted = (
        (F.col("label_a") != F.col("label_b"))
        & (F.col("linked_b") | ((F.col("place_a") <= F.col("prefix_a")) & (F.col("node_a") < F.col("node_b"))))
        & (left >= (F.col("w_a") + F.col("w_b")) / 2 - 1e-9)
        & possible(F.col("shared_a"), F.col("n_a"), F.col("shared_b"), F.col("n_b"))
    )
    same = (one["hub"] == two["hub"]) & (one["cell"] == two["cell"])
    return one.join(two, same & wanted).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component, for all nodes of the edges (a, b). Least-label rounds with shortcuts."""
    edges = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = materialize(labels.join(near, "node").join(hop, "label", "left").select("node", F.least("label", "near", "hop").alias("label"), (F.least("label", "near", "hop") != F.col("label")).alias("moved")), "labels")
        if not new.where("moved").head(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """``id_col``, node, class_id (the least id of the class) and class_size (rows) for every row."""
    return labelled(docs, id_col, text_col, similarity, rounds).drop("label")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """What ``classes`` returns, with label, which tells classes apart that share a class_id."""
    signed = materialize(sign(docs, id_col, text_col), "signed")
    nodes = materialize(signed.groupBy("node").agg(F.min("k").alias("k"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    busy = in_band.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    members = materialize(in_band.join(busy, "band").select("node", "band"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "k"), "node")
    text = docs.select(F.col(id_col).alias("k"), text_key(text_col).alias("node"), F.col(text_col).alias("t"))
    with_text = text.join(wanted.select(F.col("k").alias("k2"), F.col("node").alias("node2")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("node") == F.col("node2"))).select("node", "t")
    sets = materialize(shingle_sets(with_text).dropDuplicates(["node"]), "sets")
    own = sets.select(F.xxhash64("node").alias("id"), F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1").groupBy("id").agg(F.count("*").alias("own"))
    size = sets.select("node", F.xxhash64("node").alias("id"), F.size(F.array_distinct("cells")).alias("n")).join(own, "id", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
    size = size.where(F.col("shared") >= similarity * F.col("n") - 1e-9)
    crowd = members.groupBy("band").agg(F.count("*").alias("m"))
    members = materialize(members.select("node", "band").join(size, "node").join(crowd, "band"), "members")
    crowd = members.groupBy("node").agg(F.sum("m").alias("m"))
    members = members.drop("m").join(crowd, "node")
    labels = members.select("node", F.col("node").alias("label")).distinct()

    def possible(shared, n, other_shared, other_n):
        """Whether a pair's similarity can reach the threshold, by the cells that other nodes have at all."""
        common = F.least(shared, other_shared)
        return common >= similarity * (n + other_n - common) - 1e-9

    def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after joining the classes that ``links`` connects."""
        of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))
        apart = links.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
        roots = components(apart).select(F.col("node").alias("label"), F.col("label").alias("root"))
        return materialize(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "classes")

    top = F.min(F.struct(-F.col("m"), "node", "label", "n", "shared"))
    for r in range(rounds):
        placed = materialize(members.join(labels, "node"), "placed")
        mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), top.alias("hub")).where("lo <> hi").select("band", "hub")
        if r:
            others = placed.join(mixed, "band").where(F.col("label") != F.col("hub.label")).drop("hub")
            mixed = others.groupBy("band").agg(top.alias("hub"))
        pairs = placed.join(mixed, "band").where(F.col("label") != F.col("hub.label")).where(possible(F.col("shared"), F.col("n"), F.col("hub.shared"), F.col("hub.n")))
        pairs = pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        labels = merge(labels, materialize(verify(pairs, sets, similarity), "links"))

    placed = materialize(members.join(labels, "node"), "placed")
    mixed = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), top.alias("hub")).where("lo <> hi and size > 2")
    beside = placed.join(mixed.select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("nh")), "band").where("node <> hub")
    rest = beside.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    beside = beside.join(rest, "band", "left_semi").select("hub", "nh", "node", "label", "n", "shared").distinct()
    rest = differing(beside, sets, similarity, possible)
    labels = merge(labels, materialize(verify(rest, sets, similarity), "links"))

    of_node = nodes.select("node", "k", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = of_node.groupBy("label").agg(F.min("k").alias("class_id"), F.sum("rows").alias("class_size"))
    of_node = of_node.join(named, "label").select("node", "label", "class_id", "class_size")
    return signed.select(F.col("k").alias(id_col), "node").join(of_node, "node").select(id_col, "node", "label", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns it came with: the one with the least id (rows without an id come last) and, there, the least
    text digest; of rows that agree in both, the one whose columns have the least hash."""
    rows = labelled(docs, id_col, text_col).groupBy(F.col(id_col).alias("k"), "node", "label").agg(F.count("*").alias("n"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("k").isNull().alias("no_id"), "k", "node", "n")).alias("best"))
    k, n, m, one = (free(docs.columns, x) for x in ("best_k", "best_n", "best_rows", "best_row"))
    best = materialize(best.select(F.col("best.k").alias(k), F.col("best.node").alias(n), F.col("best.n").alias(m)), "kept")
    found = docs.join(best, F.col(id_col).eqNullSafe(F.col(k)) & (text_key(text_col) == F.col(n)))
    row = F.struct(*map(named, docs.columns))
    equal = found.where(F.col(m) > 1).groupBy(k, n).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(one))
    return found.where(F.col(m) == 1).select(*map(named, docs.columns)).unionByName(equal.select(f"{one}.*"))


def op9_minhash_near_dedup(spark, sf_dir):
    """doc_id, class_id, class_size for every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")
