"""Merkle dataset manifest: a hash tree over rows, by group and over groups, with a proof and a check for every row.

A leaf is the hash of a row's columns. The leaves of a group ascend by id; every two consecutive nodes become their hash until one, the group's subroot, remains. The
subroots, in the order of the groups, become the root in the same way.

Levels are built eight at a time: 256 consecutive nodes of a group are one block, which a task hashes to its top; the tops are the next nodes. What is
stored are node rows, each linked to its parent eight levels up, with the siblings that a climb meets between them. The check is a recursive query: it starts at every leaf, at first
changed where the row was tampered with, goes from parent to parent, appends the siblings and folds the hash, until there is no parent.

How it is spread: a leaf's place in its group is found by ranges and counts, so that no group has to fit a task; a group's blocks are spread over tasks. Above the leaves there are node rows for each
block of 256 leaves, nodes that blocks share once for each of them (a 256th of the leaves' number, times the steps), so a step of the climb joins 256 leaves with one node row, never all leaves with the root. Every step's
rows are shuffled: about 1.5 KB for a leaf in all.

Edge cases: null columns are part of the hash; ids need not be unique or there: null ids come first, rows that share an id ascend by their leaf, equal rows have equal leaves and places beside each
other; the null group comes first; a group of one row has its leaf as its subroot, one group's subroot is the root; a lone leaf's proof is the hash of nothing; an id that is null is never
tampered with; n_chars of any size counts on beyond a long; very long texts are hashed whole; an empty table gives an empty result. Further columns don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, numbered

HOP, BLOCK = 8, 256
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
HOPS = "array<struct<side:string,hash:binary>>"


def hashed(values: list[Column]) -> Column:
    """32 bytes: SHA-256 of the columns' values, each ``-`` if null, else its count of bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", counter_col: str = "n_chars", every: int = 7) -> DataFrame:
    """id, grp, leaf and changed: the leaf after tampering, which adds one to the counter where ``every`` divides the id's crc32."""
    hit = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    more = F.col(counter_col).cast("decimal(38,0)") + 1
    whole = hashed([F.col(c) for c in columns])
    other = hashed([more if c == counter_col else F.col(c) for c in columns])
    return docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), whole.alias("leaf"), F.when(hit, other).otherwise(whole).alias("changed"))


def _node(left: bytes, right: bytes = b"") -> bytes:
    return hashlib.sha256((left.hex() + right.hex()).encode()).digest()


def climb_block(hashes: list[bytes], levels: int) -> tuple[list[list[dict]], bytes]:
    """The siblings that each node of a block meets in so many levels, lowest first, and the block's top."""
    hops: list[list[dict]] = [[] for _ in hashes]
    for level in range(levels):
        for i, met in enumerate(hops):
            at = i >> level
            beside = at ^ 1
            met.append({"side": "left" if at & 1 else "right" if beside < len(hashes) else "none", "hash": hashes[beside] if beside < len(hashes) else None})
        hashes = [_node(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
    return hops, hashes[0]


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """``nodes`` (grp, at, group_rows, hash, ...) with ``hops`` to the parent and, in the first row of each block, its ``top``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        levels = min(HOP, (table.column("group_rows")[0].as_py() - 1).bit_length())
        hops, top = climb_block(table.column("hash").to_pylist(), levels)
        kind = pa.list_(pa.struct([("side", pa.string()), ("hash", pa.binary())]))
        return table.append_column("hops", pa.array(hops, kind)).append_column("top", pa.array([top] + [None] * (len(hops) - 1), pa.binary())).drop_columns("block")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return materialize(nodes.withColumn("block", F.shiftright("at", HOP)).groupBy("grp", "block").applyInArrow(run, f"{kinds}, hops {HOPS}, top binary"), label)


def tree(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The node rows of every eighth level, from ``nodes`` (grp, at, group_rows, hash, ...) up; the last ones' blocks are all whole groups."""
    steps = [blocks(nodes, label)]
    most = steps[0].agg(F.max("group_rows")).first()[0] or 0
    while most > BLOCK:
        top = steps[-1].where("top is not null").select("grp", F.shiftright("at", HOP).alias("at"), F.floor((F.col("group_rows") + BLOCK - 1) / BLOCK).alias("group_rows"), F.col("top").alias("hash"))
        steps.append(blocks(top, label))
        most = -(-most // BLOCK)
    return steps


#: H of what stands in hops after a hash, and the siblings as bytes.
FOLD = "unhex(aggregate({hops}, lower(hex({start})), (a, h) -> sha2(CASE h.side WHEN 'left' THEN concat(lower(hex(h.hash)), a) WHEN 'right' THEN concat(a, lower(hex(h.hash))) ELSE a END, 256)))"
SIBLINGS = "aggregate({hops}, CAST('' AS BINARY), (a, h) -> CASE WHEN h.hash IS NULL THEN a ELSE concat(a, h.hash) END)"

CLIMB = f"""
WITH RECURSIVE climb MAX RECURSION LEVEL 100 AS (
  SELECT id, grp, block, leaf, {FOLD.format(hops="hops", start="changed")} AS folded, {SIBLINGS.format(hops="hops")} AS proof, CAST(1 AS INT) AS parent,
    CAST(NULL AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root
  FROM {{leaves}}
  UNION ALL
  SELECT c.id, c.grp, c.block, c.leaf, {FOLD.format(hops="n.hops", start="c.folded")}, concat(c.proof, {SIBLINGS.format(hops="n.hops")}), n.parent, n.subroot, n.root
  FROM climb c JOIN {{nodes}} n ON c.grp <=> n.grp AND c.block = n.block AND c.parent = n.node
)
SELECT id, leaf, subroot, root, unhex(sha2(lower(hex(proof)), 256)) AS proof, folded FROM climb WHERE parent IS NULL
"""


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", counter_col: str = "n_chars", every: int = 7) -> tuple[DataFrame, DataFrame]:
    """The leaves (id, grp, block, leaf, changed, hops; the parent is node 1) and the node rows above them: grp, block, node, parent (null at the root), hops, subroot, root."""
    rows = materialize(leaves(docs, columns, id_col, group_col, counter_col, every).withColumn("u", F.monotonically_increasing_id()), "merkle-leaves")  # u deals equal rows to several ranges
    placed = numbered(rows, ["grp"], ["id", "leaf", "u"], "merkle-placed")
    below = tree(placed.drop("u").withColumn("hash", F.col("leaf")), "merkle-nodes")
    discard(rows, placed)
    subroots = below[-1].where("top is not null").select(F.col("grp").alias("name"), F.col("top").alias("hash"), F.lit(0).alias("grp"))
    tops = numbered(subroots, ["grp"], ["name"], "merkle-groups")
    above = tree(tops, "merkle-tops")
    root = above[-1].where("top is not null").select("grp", F.col("top").alias("root"))  # a row
    groups = above[0].join(root, "grp").select("name", "at", F.col("hash").alias("subroot"), "root", "hops")

    none = F.lit(None).cast("binary")
    block = below[0].where("top is not null").select(F.col("grp").alias("g"), F.shiftright("at", HOP).alias("block"))
    steps = []  # hops of a node above a block, by step
    for i, step in enumerate(below[1:]):
        over = step.select("grp", "at", "hops")
        steps.append(block.join(over, block["g"].eqNullSafe(over["grp"]) & (F.shiftright("block", HOP * i) == over["at"])).select("g", "block", "hops", none.alias("subroot"), none.alias("root")))
    for i, step in enumerate(above):
        over = groups if i == 0 else groups.drop("hops").join(step.select(F.col("at").alias("over"), "hops"), F.shiftright("at", HOP * i) == F.col("over"))
        under = block if i or not steps else steps.pop().select("g", "block", F.col("hops").alias("before"))  # the last step in a group goes on to the groups' tree
        met = under.join(over, under["g"].eqNullSafe(over["name"]))
        hops = F.concat("before", "hops") if "before" in under.columns else F.col("hops")
        steps.append(met.select("g", "block", hops.alias("hops"), "subroot", "root"))
    nodes = None
    for i, step in enumerate(steps, 1):
        rows_of = step.select(F.col("g").alias("grp"), "block", F.lit(i).alias("node"), F.lit(i + 1 if i < len(steps) else None).cast("int").alias("parent"), "hops", "subroot", "root")
        nodes = nodes.unionByName(rows_of) if nodes is not None else rows_of
    nodes = materialize(nodes, "merkle-links")
    discard(*below[1:], *above, tops)
    return below[0].select("id", "grp", F.shiftright("at", HOP).alias("block"), "leaf", "changed", "hops"), nodes


def climb(leaf_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof and folded (32 bytes each) of every leaf. The recursive query runs here, as its limit of a million rows is lifted meanwhile."""
    spark, limit = leaf_rows.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return materialize(spark.sql(CLIMB, leaves=leaf_rows, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(limit, before)


def op11_merkle_manifest(spark, sf_dir):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every document."""
    found = climb(*manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    text = lambda c: F.lower(F.hex(c))
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return found.select(F.col("id").alias("doc_id"), *[text(c).alias(n) for c, n in names.items()], (F.col("folded") == F.col("root")).alias("verified"))


#: Level by level, with the groups' tree as one more group.
OP11_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM documents),
f AS (SELECT r, doc_id, lang, [coalesce(strlen(v) || ':' || v, '-') for v in [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS a,
  [coalesce(strlen(v) || ':' || v, '-') for v in [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text]] AS b FROM d),
k(r, x, o, crc) AS (SELECT r, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM d WHERE doc_id IS NOT NULL UNION ALL SELECT r, x, o + 1, xor(crc >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT r, x, o, c AS crc, c AS b FROM (SELECT r, x, o, CASE WHEN o % 8 = 0 THEN xor(crc, CAST(ascii(substr(x, o // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS c FROM k WHERE o < 8 * length(x)))),
crc AS MATERIALIZED (SELECT d.r, CASE WHEN k.crc IS NULL OR xor(k.crc, 4294967295) % 7 <> 0 THEN 1 ELSE 0 END AS crc FROM d LEFT JOIN k ON d.r = k.r AND k.o = 8 * length(k.x)),
h AS MATERIALIZED (SELECT r, doc_id, lang, sha256(array_to_string(a, '')) AS leaf, sha256(array_to_string(b, '')) AS other FROM f),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
v(lang, level, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM l UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY lang, level, i // 2, n),
low AS MATERIALIZED (SELECT * FROM v),
g AS MATERIALIZED (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
w(level, i, n, h) AS (SELECT 0, i, n, subroot FROM g UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM w WHERE n > 1 GROUP BY level, i // 2, n),
high AS MATERIALIZED (SELECT * FROM w),
top AS (SELECT h AS root, level AS height FROM high WHERE n = 1),
sib AS MATERIALIZED (SELECT l.r, level, low.i & 1 = 0 AS before, low.h FROM l JOIN low ON l.lang IS NOT DISTINCT FROM low.lang AND low.i = xor(l.i >> level, 1)
  UNION ALL SELECT l.r, g.height + high.level, high.i & 1 = 0, high.h FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN high ON high.i = xor(g.i >> high.level, 1)),
proof AS (SELECT r, sha256(string_agg(h, '' ORDER BY level)) AS p FROM sib GROUP BY r),
s AS MATERIALIZED (SELECT l.r, CASE WHEN crc = 0 THEN other ELSE leaf END AS x, g.height + top.height AS height FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN crc USING (r), top),
c(r, level, x, height) AS (SELECT r, 0, x, height FROM s UNION ALL SELECT c.r, c.level + 1, sha256(CASE WHEN sib.before THEN sib.h || c.x ELSE c.x || coalesce(sib.h, '') END), height FROM c LEFT JOIN sib ON c.r = sib.r AND c.level = sib.level WHERE c.level < height)
SELECT l.doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, c.x AS folded_root, c.x = root AS verified
FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN c ON l.r = c.r AND c.level = c.height LEFT JOIN proof ON l.r = proof.r, top
"""
