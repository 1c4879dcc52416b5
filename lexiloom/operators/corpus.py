"""Corpus operators: token runs, sentences, n-gram counts, back-off language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def token_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, tok, run_type: narrow, one row a token."""
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.tokens(F.col(text_col))).alias("pos", "tok"))
    return exploded.withColumn("run_type", T.run_type(F.col("tok")))


def class_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, run_type, n, chars: tokens and characters by class, counted in the row; rows that share an id are summed."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    letters, blanks, tokens = T.skeleton(F.col("t"))
    t = t.select("doc_id", F.length("t").cast("long").alias("whole"), letters.alias("letters"), blanks.alias("blanks"), tokens.alias("tokens"))
    size = lambda c: F.length(c).cast("long")
    t = t.select(
        "doc_id", "whole", size("letters").alias("l1"), size("blanks").alias("l2"), size("tokens").alias("l3"), T.n_of(F.col("tokens"), "a").alias("alpha"), T.n_of(F.col("tokens"), " ").alias("space"), T.n_of(F.col("tokens"), "0").alias("digit"),
        T.n_of(F.col("tokens"), T.STOP).alias("stop"),
    )
    t = t.withColumn("punct", F.expr("l3 - alpha - space - digit - stop"))
    every = "stack(5, 'stop', stop, stop, 'punct', punct, punct, 'space', space, l1 - l2 + space, 'digit', digit, l2 - l3 + digit, 'alpha', alpha, whole - l1 + alpha) AS (run_type, n, chars)"
    return t.selectExpr("doc_id", every).where("n > 0").groupBy("doc_id", "run_type").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_id, first_pos, last_pos, n_tokens: the extent of each sentence in its document's tokens. Each further stop of a run that ended a sentence is
    a sentence of its own. A sentence is a row before anything is shuffled; documents are told apart by id and text, so rows
    that share an id don't mix (equal rows are one document), and null ids don't meet in one task."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), T.sentences(F.col(text_col)).alias("s"))
    one = parts.select("doc_id", "t", (F.size("s") - 1).alias("last"), F.posexplode("s").alias("nth", "s")).where("s <> ''")
    stops = F.length(F.regexp_extract("s", f"[{T.STOP}]*$", 0))
    sized = one.select("doc_id", "t", "nth", F.length(T.skeleton(F.col("s"))[2]).cast("long").alias("n"), F.when(F.col("nth") < F.col("last"), stops - 1).otherwise(0).alias("extra")).distinct()
    before = Window.partitionBy("doc_id", "t").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("id", F.coalesce(F.sum(1 + F.col("extra")).over(before), F.lit(0)))
    each = placed.withColumn("j", F.explode(F.sequence(F.lit(0), "extra")))
    n_tokens = F.when(F.col("j") == 0, F.col("n") - F.col("extra")).otherwise(1)
    first = F.when(F.col("j") == 0, F.col("at")).otherwise(F.col("at") + F.col("n") - F.col("extra") + F.col("j") - 1)
    out = each.select("doc_id", (F.col("id") + F.col("j")).alias("sent_id"), first.alias("first_pos"), n_tokens.cast("long").alias("n_tokens"))
    return out.withColumn("last_pos", F.col("first_pos") + F.col("n_tokens") - 1)


def good_sentences(text: Column) -> Column:
    """The words of each sentence without numbers and optional hyphens, for the sentences that have words: an array of arrays."""
    good = F.filter(T.sentences(text), lambda s: ~s.rlike("[0-9¬]"))
    return F.filter(F.transform(good, lambda s: T.words(s)), lambda w: F.size(w) > 0)


def sentence_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_words of the documents that have words in sentences without numbers and optional hyphens. The counts are made in a generator: a filter on them would be put below and find the sentences twice."""
    counts = F.transform(F.array(good_sentences(F.col(text_col))), lambda s: F.struct(F.size(s).cast("long").alias("n_sentences"), F.size(F.flatten(s)).cast("long").alias("n_words")))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.filter(counts, lambda c: c["n_sentences"] > 0)))


def word_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, next: the words of each document's sentences without numbers and optional hyphens, between <s> and </s>; next crosses sentence ends, not documents.
    All of it happens within the row, so counting is the first thing that is shuffled."""
    found = docs.select(good_sentences(F.col(text_col)).alias("found"))
    marked = F.transform("found", lambda w: F.concat(F.array(F.lit("<s>")), w, F.array(F.lit("</s>"))))
    stream = found.select(F.flatten(marked).alias("s"))
    return stream.select(F.explode(F.arrays_zip(F.col("s").alias("word"), F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))).alias("next"))).alias("x")).select("x.word", "x.next")


def pairs(stream: DataFrame) -> DataFrame:
    """word, next, cnt: what both unigrams and bigrams can be summed from, so that the texts are read once."""
    return stream.groupBy("word", "next").agg(F.count("*").alias("cnt"))


def unigrams_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def bigrams_of(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("next").isNotNull()).select(F.col("word").alias("w1"), F.col("next").alias("w2"), "cnt")


def sizes(pairs: DataFrame) -> DataFrame:
    """gram, n, usage: distinct unigrams and bigrams and how often they occur, from one pass over the pairs."""
    words = pairs.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.count("next").alias("n2"), F.sum(F.when(F.col("next").isNotNull(), F.col("cnt"))).alias("cnt2"))
    one = words.agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt"), F.coalesce(F.sum("n2"), F.lit(0)).alias("n2"), F.sum("cnt2").alias("cnt2"))
    return one.selectExpr("stack(2, 1, n, cnt, 2, n2, cnt2) AS (gram, n, usage)")


def unigrams(stream: DataFrame) -> DataFrame:
    return stream.groupBy("word").agg(F.count("*").alias("cnt"))


def bigrams(stream: DataFrame) -> DataFrame:
    return stream.where(F.col("next").isNotNull()).groupBy(F.col("word").alias("w1"), F.col("next").alias("w2")).agg(F.count("*").alias("cnt"))


def lm_unigram(counts: DataFrame) -> DataFrame:
    """word, logprob, backoff; the total is one row, joined by broadcast."""
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", F.round(F.log10(F.col("cnt") / F.col("total")), 6).alias("logprob"), F.lit(round(-0.6989700043360187, 6)).alias("backoff"))


def lm_bigram(counts: DataFrame, cover: float = 0.8) -> DataFrame:
    """w1, w2, cnt, logprob = log10(cover * c(w1, w2) / sum over w of c(w1, w)). The sums are a partial aggregate joined back, so that a very frequent w1 can be split."""
    sums = counts.groupBy("w1").agg(F.sum("cnt").alias("total"))
    return counts.join(sums, "w1").select("w1", "w2", "cnt", F.round(F.log10(cover * F.col("cnt") / F.col("total")), 6).alias("logprob"))


def recovered_usage(counts: DataFrame, hints: DataFrame) -> DataFrame:
    """word, cnt: words of ``hints`` (word, log10_hint) without usage get 1, or their hinted share of the new total."""
    both = hints.join(counts, "word", "full").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"), "log10_hint")
    sums = both.agg(F.sum("cnt").alias("t"), F.sum((F.col("cnt") == 0).cast("long")).alias("rare"), F.sum(F.when(F.col("cnt") == 0, F.pow(F.lit(10.0), "log10_hint"))).alias("hinted"))
    new = F.floor((F.col("t") + F.col("rare")) / (1 - F.coalesce("hinted", F.lit(0.0))))
    got = F.when(F.col("cnt") > 0, F.col("cnt")).when(F.col("log10_hint").isNull(), 1).otherwise(F.greatest(F.lit(1), F.floor(F.pow(F.lit(10.0), "log10_hint") * new)))
    return both.crossJoin(F.broadcast(sums)).select("word", got.cast("long").alias("cnt"))
