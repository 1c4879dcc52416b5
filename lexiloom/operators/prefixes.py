"""Prefix statistics of words and of the forms of declined words.

What words share is found by grouping alone: a prefix tree is the words' prefixes with their counts, and the longest common prefix of a group is that of its least and its
greatest string, so no group is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consonants of Ukrainian, and what belongs to the letter before it.
CONSONANTS = "бвгґджзйклмнпрстфхцчшщ"
MARKS = "ь'"


def common(a: Column, b: Column) -> Column:
    """The longest prefix that two strings share."""
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.when(F.least(F.length(a), F.length(b)) > 0, F.size(same)).otherwise(0))


def prefix_tree(words: DataFrame, least: int = 1) -> DataFrame:
    """prefix, n (distinct words that begin so), whole (whether it is a word) and branches (different next letters) of the prefixes that ``least`` distinct words (word) share."""
    cut = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))).alias("k"))
    rows = cut.select(F.expr("left(word, k)").alias("prefix"), F.expr("substring(word, k + 1, 1)").alias("next"))
    nodes = rows.groupBy("prefix", "next").agg(F.count("*").alias("n"))  # at most as many rows for a prefix as there are letters
    out = nodes.groupBy("prefix").agg(F.sum("n").alias("n"), F.max(F.col("next") == "").alias("whole"), F.count(F.nullif("next", F.lit(""))).alias("branches"))
    return out.where(F.col("n") >= least)


def forms(declined: DataFrame) -> DataFrame:
    """name, class, form from groups (name, class, form) whose forms may be several ones with commas between, with asterisks before them. Empty ones and ``-`` are no forms."""
    each = declined.select("name", "class", F.explode(F.split(F.coalesce("form", F.lit("")), ",")).alias("form"))
    return each.select("name", "class", F.regexp_replace(F.trim("form"), r"^\*", "").alias("form")).where(~F.col("form").isin("", "-"))


def split_forms(each: DataFrame, suffixes: DataFrame, longest: int = 8) -> DataFrame:
    """``each`` (name, class, form) with stem and suffix: the longest suffix of the form's class (``suffixes``: class, suffix; a null class is for all) that leaves a letter or more
    and begins with no mark; where there is none, the stem is the form. A form's few endings meet the suffixes by equality."""
    some = each.select("class", "form").distinct()
    ends = some.select("class", "form", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")).where(F.length("form") > F.col("k")).withColumn("suffix", F.expr("right(form, k)"))
    ends = ends.where(~F.substring("suffix", 1, 1).isin(*MARKS))
    known = suffixes.select(F.col("class").alias("of"), "suffix").distinct()
    own = ends.join(known.where("of is not null"), (ends["class"] == known["of"]) & (ends["suffix"] == known["suffix"]), "left_semi")
    best = own.unionByName(ends.join(known.where("of is null").select("suffix"), "suffix", "left_semi").select(*ends.columns)).groupBy("class", "form").agg(F.max("k").alias("k"))
    met = each.join(best.select(F.col("class").alias("c"), F.col("form").alias("f"), "k"), F.col("class").eqNullSafe(F.col("c")) & (F.col("form") == F.col("f")), "left")
    k = F.coalesce("k", F.lit(0))
    return met.select("name", "class", "form", F.substring("form", F.lit(1), F.length("form") - k).alias("stem"), F.when(k > 0, F.expr("right(form, k)")).alias("suffix"))


def suffix_usage(split: DataFrame) -> DataFrame:
    """class, suffix, n: forms that each suffix was split from."""
    return split.where("suffix is not null").groupBy("class", "suffix").agg(F.count("*").alias("n"))


def stems(split: DataFrame, consonants: str = CONSONANTS, marks: str = MARKS) -> DataFrame:
    """name, stem, n: the stems of each group after those became one, their longest common prefix, that differ only in what follows their last consonant and its marks (without a consonant: their
    first letter). ``n`` counts the forms."""
    counts = split.groupBy("name", "stem").agg(F.count("*").alias("n"))
    core = F.coalesce(F.nullif(F.regexp_extract("stem", f"^.*[{consonants}{consonants.upper()}][{marks}]*", 0), F.lit("")), F.substring("stem", 1, 1))
    merged = counts.withColumn("core", core).groupBy("name", "core").agg(F.min("stem").alias("lo"), F.max("stem").alias("hi"), F.sum("n").alias("n"))
    return merged.select("name", common(F.col("lo"), F.col("hi")).alias("stem"), "n")


def different_stems(merged: DataFrame, silent: str = "ьч-") -> DataFrame:
    """name, n: stems of each group, without those that end in a letter of ``silent``."""
    return merged.groupBy("name").agg(F.count_if(~F.substring("stem", -1, 1).isin(*silent)).alias("n"))
