"""Mixing sources to target weights by hash-threshold histograms.

Sources get weights in the order of their names (by code point, null last) and share a budget of words: each gets its weight's share, but at most
``most`` times its own size; what is above goes to the others by weight, until none is above.

A source whose target is q whole copies and a rest takes each document q times and, of the rest, those whose hash lies under a threshold once more. Thresholds are nested:
a larger budget takes a superset. They are found without sorting: words are summed by source and the hash's first 12 bits, running sums over these 4096
buckets give the bucket in which the rest ends, and only rows of that bucket are summed again by the next 12 bits, five times in all. Rows whose 60 bits are the
threshold's own share what remains by their sizes (one row, but for rows that are equal), so a source's words differ from its target by less than the number of these rows.

DataFrame functions only. How it is spread: one pass over the texts writes id, source, hash and size; sums by source and bucket are
combined before they are shuffled; rows meet their source's thresholds by a broadcast of the at most 1000 sources with over a thousandth of all rows, others by a shuffle. Numbers
of sources, of which there may be many, are found by ranges, and shares above the limit in rounds of sums; only sums reach the driver.

Edge cases: a null text has no words; a document without words is taken with none; a null id or source is a value like others; equal rows take equal numbers of words; a source
without words has the target 0; sizes and sums are longs; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free, joined, materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 5


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """k, source, h (60 bits of a hash of id and text) and size (words) of every row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), t).cast("binary"))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return docs.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), h.alias("h"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``."""
    at = numbered(sources.withColumn("named", F.col("source").isNull()), [], ["named", "source"], "mix-sources").drop("named", "group_rows")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("at", F.lit(len(weights))) + 1).cast("int")).cast("double")
    at = at.withColumn("weight", weight).drop("at")
    budget = share * (at.agg(F.sum("source_size")).first()[0] or 0)
    each, above = 0.0, -1
    limit = F.lit(float(most)) * F.col("source_size")
    while True:  # each round leaves more sources at their limits, or is the last
        full = limit <= F.col("weight") * each
        sums = at.agg(F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if sums["n"] == above or not sums["weight"]:
            break
        above, each = sums["n"], (budget - (sums["fixed"] or 0)) / sums["weight"]
    return at.withColumn("target", F.least(limit, F.col("weight") * each)).drop("weight")


def crossing(rows: DataFrame, bucket) -> DataFrame:
    """source, bucket, rest: of each source the bucket in which the running sum of sizes passes ``rest`` (a column of ``rows``), and what is left to take from it."""
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # 4096 buckets at most
    return sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select("source", "bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))


def part(h: str, level: int):
    """The hash's bits of a level."""
    return F.shiftright(h, BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col``, size, source_size, target, copies (of the whole text), words (of the copy beyond these) and taken for every row."""
    rows = materialize(sized(docs, id_col, source_col, text_col), "mix-sizes")
    buckets = materialize(rows.groupBy("source", part("h", 0).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-buckets")
    sources = targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("source_rows")), weights, share, most)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    sources = sources.withColumn("copies", whole).withColumn("rest", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    ends = crossing(joined(buckets.drop("rows"), "source", sources.select("source", "rest", F.col("source_rows")), "source_rows"), F.col("bucket")).withColumnRenamed("source", "of_source").withColumnRenamed("rest", "left")
    sources = materialize(sources.join(ends, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source"), "mix-ends")

    found = materialize(joined(rows, "source", sources, "source_rows"), "mix-met")
    discard(rows, buckets)
    at = part("h", 0)
    sure = found.where(F.col("bucket").isNull() | (at != F.col("bucket"))).withColumn("words", F.when(F.col("bucket").isNull() | (at > F.col("bucket")), 0).otherwise(F.col("size")))
    open_ = materialize(found.where(at == F.col("bucket")).drop("bucket", "rest").withColumnRenamed("left", "rest"), "mix-open")
    done = [sure]
    for level in range(1, LEVELS):
        ends = crossing(open_, part("h", level)).select(F.col("source").alias("of_source"), "bucket", F.col("rest").alias("left"))
        met = materialize(open_.join(ends, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source"), "mix-open")
        at = part("h", level)
        done.append(met.where(at != F.col("bucket")).withColumn("words", F.when(at > F.col("bucket"), 0).otherwise(F.col("size"))))
        open_ = met.where(at == F.col("bucket")).drop("bucket", "rest").withColumnRenamed("left", "rest")
    tied = open_.groupBy(F.col("source").alias("of_source")).agg(F.sum("size").alias("tied"))
    last = open_.join(tied, F.col("source").eqNullSafe(F.col("of_source")))
    exact = F.floor(F.col("rest").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") / F.col("tied")).cast("long")
    done.append(last.withColumn("words", F.when(F.col("tied") == 0, 0).otherwise(exact)))
    columns = [F.col("k").alias(id_col), "size", "source_size", "target", "copies", F.col("words").cast("long").alias("words")]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("words"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs`` (whose ids are unique and not null), each as often as ``mixed`` takes it, the last time with as many of its words as are left. ``mixed`` is
    shuffled to the documents by id."""
    k, n, w, text = (free(docs.columns, x) for x in ("mix_k", "mix_copies", "mix_words", "mix_text"))
    take = mixed.select(F.col(id_col).alias(k), F.col("copies").alias(n), F.when(F.col("words") == F.col("size"), F.lit(-1)).otherwise(F.col("words")).alias(w))
    both = docs.join(take, F.col(id_col) == F.col(k))
    some = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col(w).cast("int")), " ")
    last = F.when(F.col(w) == -1, F.array(F.col(text_col))).when(F.col(w) > 0, F.array(some)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col(text_col), F.col(n).cast("int")), last)
    out = both.withColumn(text, F.explode(texts))
    return out.select(*[F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op13_source_mixing(spark, sf_dir):
    """doc_id, size, source_size, target, taken for every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same with sorted running sums. Limits are met in the order of size by weight.
OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 15) AS BIGINT) AS h,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w FROM s0),
s2 AS (SELECT *, coalesce(sum(2.0 * source_size) OVER r, 0) AS fixed, sum(w) OVER (ORDER BY source_size / w DESC, source DESC NULLS FIRST) AS weights, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS i
       FROM s1 WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT (1.5 * total - fixed) / weights AS each FROM s2 WHERE 2.0 * source_size > w * ((1.5 * total - fixed) / weights) ORDER BY i LIMIT 1),
s4 AS (SELECT source, source_size, least(2.0 * source_size, w * coalesce((SELECT each FROM s3), 0)) AS target FROM s1),
s5 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS copies FROM s4),
s6 AS (SELECT *, CAST(floor(target - copies * source_size) AS BIGINT) AS rest FROM s5),
h AS (SELECT source, h, sum(size) AS tied FROM d GROUP BY source, h),
u AS (SELECT source, h, tied, sum(tied) OVER (PARTITION BY source ORDER BY h) - tied AS before FROM h)
SELECT d.doc_id, d.size, s6.source_size, s6.target, CAST(s6.copies * d.size + CASE WHEN before + tied <= rest THEN d.size WHEN before >= rest THEN 0 ELSE floor((rest - before) * d.size / tied) END AS BIGINT) AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
"""
