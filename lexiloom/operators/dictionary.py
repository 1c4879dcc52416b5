"""Dictionary relations: tables of (word, code, phones) with a priority between kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_priority(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Each key's entry in the first kind that has it: one join on the tagged union. ``entries``: word, prio, kind. Entries that no key asks for go before anything is grouped."""
    best = entries.join(keys.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.min(F.struct("prio", "kind")).alias("x"))
    return keys.join(best, "word", "left").select("word", F.col("x.kind").alias("kind"))


def merge_new(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``extra`` whose keys it lacks."""
    return base.unionByName(extra.join(base.select(*keys), keys, "left_anti"))


def duplicates(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def display_names(prons: DataFrame) -> DataFrame:
    """word, code, name: the k-th code of a word is word, word(2), ...; only words with several codes, or with another code than the word."""
    w = Window.partitionBy("word").orderBy("code")
    p = prons.withColumn("k", F.row_number().over(w)).withColumn("several", F.count("*").over(Window.partitionBy("word")) > 1)
    name = F.when(F.col("k") == 1, F.col("word")).otherwise(F.concat("word", F.lit("("), "k", F.lit(")")))
    return p.where(F.col("several") | (F.col("code") != F.col("word"))).select("word", "code", name.alias("name"))
