"""Vocabulary of a language model, and relations between dictionaries, usage and utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_of(words: DataFrame, usage: DataFrame) -> DataFrame:
    """word, cnt: all words of either side; words that the corpus lacks have 0. ``usage``: word, cnt."""
    return words.select("word").distinct().join(usage, "word", "full").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def covered(words: DataFrame, train_phones: DataFrame) -> DataFrame:
    """The rows whose phones (array) are all among ``train_phones`` (phone); null phones, words that can't be spelled, are not covered."""
    unknown = words.select("word", F.explode("phones").alias("phone")).join(train_phones, "phone", "left_anti").select("word")
    return words.where(F.col("phones").isNotNull()).join(unknown, "word", "left_anti")


def choose(usage: DataFrame, dictionary: DataFrame, denied: DataFrame, train_phones: DataFrame, min_usage: int = 10, most: int = 0) -> DataFrame:
    """word, cnt, known: the dictionary's words, always, and the most used words of the corpus: not denied, neither a word nor a code of the
    dictionary, used ``min_usage`` times or more (-1: any), with phones that training has. ``most`` (0: any number) holds for both together;
    equal usage ranks by word. ``usage``: word, cnt, phones; ``dictionary``: word, code; ``denied``: word."""
    known = dictionary.select("word").distinct()
    taken = known.union(dictionary.select("code")).distinct()
    candidates = usage.where(~F.col("word").isin("<s>", "</s>") & ((F.lit(min_usage) == -1) | (F.col("cnt") >= min_usage)))
    candidates = covered(candidates.join(denied, "word", "left_anti").join(taken, "word", "left_anti"), train_phones)
    if most:
        candidates = candidates.orderBy(F.desc("cnt"), "word").limit(max(0, most - known.count()))
    kept = known.join(usage.select("word", "cnt"), "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.lit(True).alias("known"))
    return kept.unionByName(candidates.select("word", "cnt", F.lit(False).alias("known")))


def with_sentence_marks(vocabulary: DataFrame, usage: DataFrame) -> DataFrame:
    """word, cnt of a vocabulary with <s> and </s>."""
    marks = usage.where(F.col("word").isin("<s>", "</s>")).select("word", "cnt")
    return vocabulary.select("word", "cnt").unionByName(marks)


def model_unigrams(vocabulary: DataFrame) -> DataFrame:
    """word, cnt, logprob: words without usage get 1. The total is one row, joined by broadcast."""
    seen = vocabulary.select("word", F.greatest("cnt", F.lit(1)).alias("cnt"))
    total = seen.agg(F.sum("cnt").alias("total"))
    return seen.crossJoin(F.broadcast(total)).select("word", "cnt", F.round(F.log10(F.col("cnt") / F.col("total")), 6).alias("logprob"))


def within(bigrams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The bigrams (w1, w2, cnt) of which the vocabulary has both words."""
    words = vocabulary.select("word")
    return bigrams.join(words.withColumnRenamed("word", "w1"), "w1", "left_semi").join(words.withColumnRenamed("word", "w2"), "w2", "left_semi")


def expansions(codes: DataFrame, *dictionaries: DataFrame) -> DataFrame:
    """code, kind, word: every entry of any of the dictionaries (code, kind, word) that has the code."""
    every = dictionaries[0]
    for d in dictionaries[1:]:
        every = every.unionByName(d)
    return codes.select("code").distinct().join(every, "code")


def phone_text(words: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phones, valid: the phones of each utterance's words (keys, pos, code), joined by ~; ??? for a code that no entry (code, phones as text) has,
    (...) for one that has several, CRLF for one with a line end or tab."""
    found = entries.groupBy("code").agg(F.count("*").alias("n"), F.first("phones").alias("phones"))
    joined = words.join(found, "code", "left")
    piece = F.when(F.col("code").rlike(r"[\r\n\t]"), "CRLF").when(F.col("n").isNull(), "???").when(F.col("n") > 1, "(...)").otherwise(F.col("phones"))
    parts = joined.select(*keys, "pos", piece.alias("piece"), (~F.col("code").rlike(r"[\r\n\t]") & F.coalesce(F.col("n") == 1, F.lit(False))).alias("ok"))
    out = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("all"), F.min("ok").alias("valid"))
    return out.select(*keys, F.array_join(F.col("all.piece"), "~").alias("phones"), "valid")


def code_usage(codes: DataFrame, words: DataFrame) -> DataFrame:
    """code, n: how often utterances (code, one row a use) use each code, zero included. Uses are summed before they are joined."""
    used = words.groupBy("code").agg(F.count("*").alias("n"))
    return codes.select("code").distinct().join(used, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def stress_assigned(phones: Column) -> Column:
    """Whether a vowel of the phones has a stress mark, or there is no vowel."""
    vowels = F.filter(phones, lambda p: p.rlike("^[AEIOUY]1?$"))
    return (F.size(vowels) == 0) | F.exists(vowels, lambda p: p.endswith("1"))


def mixed_stress(prons: DataFrame) -> DataFrame:
    """word, n, stressed: words with several pronunciations (word, phones) of which some have stress and some not."""
    out = prons.groupBy("word").agg(F.count("*").alias("n"), F.sum(stress_assigned(F.col("phones")).cast("long")).alias("stressed"))
    return out.where("n > 1 and stressed > 0 and stressed < n")


def normal_phones(phones: Column) -> Column:
    """Phones without digits, in capitals."""
    return F.transform(phones, lambda p: F.upper(F.regexp_replace(p, "[0-9]", "")))


def one_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """word, cnt, both: usage (word, cnt) from the one of two sources that has the word; ``both`` tells the words that break this rule."""
    a, b = first.select("word", F.col("cnt").alias("a")), second.select("word", F.col("cnt").alias("b"))
    out = a.join(b, "word", "full")
    return out.select("word", F.coalesce(F.nullif("a", F.lit(0)), "b").alias("cnt"), (F.coalesce("a", F.lit(0)) > 0).alias("x"), (F.coalesce("b", F.lit(0)) > 0).alias("y")).select("word", "cnt", (F.col("x") & F.col("y")).alias("both"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those that have their keys; a null ``value`` deletes."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.where(F.col(value).isNotNull()).select(*base.columns))


def tilde(part: Column, side: Column) -> Column:
    """A word part with a tilde where the word goes on: left parts end in one, right ones begin with one, middle ones have both."""
    return F.when(side == "left", F.concat(part, F.lit("~"))).when(side == "right", F.concat(F.lit("~"), part)).when(side == "middle", F.concat(F.lit("~"), part, F.lit("~"))).otherwise(part)


def consistent(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """line, path, id, ok: lines of the two files (line, path) and (line, id) side by side; ``ok`` if the path contains the id. A line that one of them lacks is not ok."""
    return ids.join(texts, "line", "full").withColumn("ok", F.coalesce(F.contains("path", "id"), F.lit(False)))
