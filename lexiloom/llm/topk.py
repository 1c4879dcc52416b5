"""Exact top-k search by MaxScore.

Vectors are turned into integers, floor(64 x). A query's terms are its
dimensions; the posting list of a dimension in a block of candidates is its
column. What a set of terms can add to a score has two bounds: the sum of the largest products that the
columns' extremes allow, and the product of the lengths (Cauchy and Schwarz). A query's terms are sorted by size;
the essential ones are as few as leave the others together below its k-th score so far, so a candidate that has nothing in the
essential postings can't get in. Essential postings are traversed for a block of candidates and many queries
at once, the other terms are probed in steps, only for candidates that stay
competitive. Candidates lie in the order of their lengths, so the first block gives good k-th scores and whole blocks fall away later.
Shards' top k are merged by a ranking window, which ranks within shards before it shuffles.

How it is spread: candidates are dealt to shards and queries to blocks by a hash
(numbers of both follow from counts, so a task sees bounded ones); each pair of
shard and query block is one group. The work, queries times candidates, is that of the contract.

Edge cases: vectors that are null or hold null or non-finite components, and
null ids, take no part; of rows that share an id the least vector counts; a row whose id is the query's own is no candidate;
shorter vectors count as padded with zeros; equal scores rank by smaller id; an empty table gives an empty result. Products are summed in doubles where
that is exact, and in whole numbers without a limit where components are too large for that; components and scores end at the limits of a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, QUERIES, BLOCK = 8192, 4096, 1024
STEP, SPARSE = 8, 0.02


def maxscore(queries: np.ndarray, own: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) ids and scores of the k best rows of ``shard`` for each query, best first, ties by id; id -1 where there are fewer."""
    length = np.sqrt((shard * shard).sum(1))
    order = np.lexsort((ids, -length))
    shard, ids, length = shard[order], ids[order], length[order]
    n_q, n_terms = queries.shape
    by_size = np.argsort(-np.abs(queries), 1, kind="stable")
    place = np.argsort(by_size, 1, kind="stable")  # of each term in its query's order
    tail = lambda x: np.hstack([np.cumsum(x[:, ::-1], 1)[:, ::-1], np.zeros((n_q, 1))])  # noqa: E731  of the terms from each place on
    tail_length = np.sqrt(tail(np.take_along_axis(queries, by_size, 1) ** 2))
    best, best_id = np.full((n_q, k), -np.inf), np.full((n_q, k), -1, np.int64)
    slack = 1e-6  # what rounding may add to the lengths' products, times the products
    for lo in range(0, len(shard), block):
        rows, row_ids, row_length = shard[lo : lo + block], ids[lo : lo + block], length[lo : lo + block]
        extremes = np.maximum(queries * rows.max(0), queries * rows.min(0))
        by_column = tail(np.take_along_axis(extremes, by_size, 1))
        bound = np.minimum(by_column, tail_length * row_length[0] * (1 + slack))
        least = best[:, -1]
        live = np.flatnonzero(bound[:, 0] >= least)
        if not len(live):
            continue
        essential = np.minimum((bound[live] >= least[live, None]).sum(1), n_terms)
        q_live, place_live, at = queries[live], place[live], essential
        score = rows @ np.where(place_live < at[:, None], q_live, 0).T
        while True:
            rest = np.minimum(by_column[live, at][None, :], row_length[:, None] * (tail_length[live, at] * (1 + slack))[None, :])
            stay = score + rest >= least[live][None, :]
            if at.min() == n_terms or np.count_nonzero(stay) < SPARSE * stay.size:
                break
            more = np.minimum(at + STEP, n_terms)  # many are competitive: probe the next terms of all at once
            score += rows @ np.where((place_live >= at[:, None]) & (place_live < more[:, None]), q_live, 0).T
            at = more
        row, col = np.nonzero(stay)
        score, at = score[row, col], at[col]
        while True:
            q = live[col]
            open_ = at < n_terms
            if not open_.any():
                break
            for j in range(STEP):
                term = by_size[q, np.minimum(at + j, n_terms - 1)]
                score = score + np.where(at + j < n_terms, rows[row, term] * queries[q, term], 0)
            at = np.minimum(at + STEP, n_terms)
            stay = score + np.minimum(by_column[q, at], row_length[row] * tail_length[q, at] * (1 + slack)) >= least[q]
            row, col, score, at = row[stay], col[stay], score[stay], at[stay]
        q = live[col]
        there = row_ids[row] != own[q]
        q, found, score = q[there], row_ids[row[there]], score[there]
        touched = np.unique(q)
        all_q = np.concatenate([np.repeat(touched, k), q])
        all_id = np.concatenate([best_id[touched].ravel(), found])
        all_score = np.concatenate([best[touched].ravel(), score])
        order = np.lexsort((all_id, -all_score, all_q))
        first = np.searchsorted(all_q[order], touched)
        pick = order[first[:, None] + np.arange(k)]
        best[touched], best_id[touched] = all_score[pick], all_id[pick]
    return best_id, best


def by_products(query: np.ndarray, own: int, shard: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one query by whole numbers of any size, for components too large for exact sums of doubles."""
    scores = shard.astype(object) @ query.astype(object)
    order = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[order], np.array([min(max(scores[i], -(2**63)), 2**63 - 1) for i in order], np.int64)


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * 64))
    bad = F.exists(F.col(vector_col).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    n = rows.agg(F.count("*").alias("n"), F.sum((F.pmod("id", F.lit(every)) == 0).cast("long")).alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-(n["q"] or 0) // query_rows))
    deal = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    both = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = rows.select("id", "x", deal(shards).alias("s"), both("b", blocks))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "x", both("s", shards), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"))

    def match(cs, qs):
        names = ["query_id", "vec_id", "score"]
        if not len(cs) or not len(qs):
            return pd.DataFrame({x: [] for x in names}, dtype="int64")
        wide = max(1, *map(len, cs["x"]), *map(len, qs["x"]))
        table = lambda col: np.stack([np.pad(np.asarray(v, np.int64), (0, wide - len(v))) for v in col])
        shard, query, ids, own = table(cs["x"]), table(qs["x"]), cs["id"].to_numpy(np.int64), qs["id"].to_numpy(np.int64)
        largest = max(int(np.abs(x.astype(float)).max()) for x in (shard, query))
        if wide * largest * largest < 2**53:
            found, score = maxscore(query.astype(float), own, shard.astype(float), ids, k)
            there = np.isfinite(score)
            return pd.DataFrame({"query_id": np.repeat(own, k)[there.ravel()], "vec_id": found[there], "score": score[there].astype(np.int64)})
        each = [by_products(q, i, shard, ids, k) for q, i in zip(query, own)]
        return pd.DataFrame({"query_id": np.repeat(own, [len(f) for f, _ in each]), "vec_id": np.concatenate([f for f, _ in each]), "score": np.concatenate([x for _, x in each])})

    found = candidates.groupBy("s", "b").cogroup(queries.groupBy("s", "b")).applyInPandas(match, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark, sf_dir):
    """query_id, rank, vec_id, score for the vectors whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by brute force.
OP7_SQL = """
WITH v AS (SELECT vec_id, min([floor(CAST(x AS DOUBLE) * 64) for x in embedding]) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
           GROUP BY vec_id),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
