"""Matches with wildcards, messages, caches of results, names of segments: what checks and reports of a project are made of."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English letters that no Cyrillic letter looks like; Russian letters that Ukrainian lacks; vowels, consonants and capitals of Ukrainian.
ENGLISH_ONLY = "bdDfFgGhjJklLmnNqQrRsStuUvVwWyYzZ"
RUSSIAN_ONLY = "ёЁъЪыЫэЭ"
UKRAINIAN_VOWELS = "аеєиіїоуюяАЕЄИІЇОУЮЯ"
UKRAINIAN_CONSONANTS = "бвгґджзйклмнпрстфхцчшщБВГҐДЖЗЙКЛМНПРСТФХЦЧШЩ"
UKRAINIAN_CAPITALS = "АБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЮЯ"


def letters(text: Column, those: str) -> Column:
    """How many of the letters ``those`` a text has."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, those, ""))).cast("long")


def match_forms(asked: DataFrame, forms: DataFrame, key: str, features: list[str], name: str = "form") -> DataFrame:
    """``asked`` with ``matches`` (how many forms fit) and the form's name where exactly one does. A form (``key``, ``features``, ``name``) fits if its key is equal and every feature that it states is; a
    feature that it leaves null fits any value, null too.

    Forms are told apart by the set of features that they state; what is asked, each distinct combination once, asks for each of these sets with its own values in it: one equality join, of
    2^features rows at most for a combination. Nulls in ``key`` fit nothing."""
    bit = lambda c, i: F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
    stated = sum((bit(c, i) for i, c in enumerate(features)), F.lit(0))
    held = forms.select(F.col(key).alias("f_key"), stated.alias("f_mask"), *[F.col(c).alias(f"f_{c}") for c in features], F.col(name).alias("f_name"))
    masks = F.array(*[F.lit(sum(b << i for i, b in enumerate(bits))) for bits in product((0, 1), repeat=len(features))])
    want = asked.select(F.col(key).alias("w_key"), *[F.col(c).alias(f"w_{c}") for c in features]).distinct().withColumn("mask", F.explode(masks))
    same = (want["w_key"] == held["f_key"]) & (want["mask"] == held["f_mask"])
    for i, c in enumerate(features):
        same = same & F.when(want["mask"].bitwiseAND(1 << i) != 0, want[f"w_{c}"]).eqNullSafe(held[f"f_{c}"])
    met = want.join(held, same).groupBy("w_key", *[f"w_{c}" for c in features]).agg(F.count("*").alias("matches"), F.min("f_name").alias("w_name"))
    back = asked[key] == met["w_key"]
    for c in features:
        back = back & asked[c].eqNullSafe(met[f"w_{c}"])
    out = asked.join(met, back, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select(*[asked[c] for c in asked.columns], "matches", F.when(F.col("matches") == 1, F.col("w_name")).alias(name))


def suggestions(entries: DataFrame, prefix: str, most: int = 101) -> DataFrame:
    """The first ``most`` words, in order, of a dictionary (word, code) that begin with ``prefix`` or have a code that does, whatever the case."""
    low = prefix.lower()
    return entries.where(F.startswith(F.lower("word"), F.lit(low)) | F.startswith(F.lower("code"), F.lit(low))).select("word").distinct().orderBy("word").limit(most)


def code_messages(codes: DataFrame, known: DataFrame, broken: DataFrame, filler: DataFrame) -> DataFrame:
    """code, message for each distinct code of utterances that is wrong: in the known and in the broken dictionary, in none but with entries that are like it (a code with a number, or the word itself), or in none at
    all. Dictionaries are (word, code). A code with a number is found by the code without it: equality joins only."""
    codes = codes.select("code").where("code is not null").distinct()
    plain = F.regexp_replace("code", r"\(.*$", "")

    def facts(d: DataFrame, mark: str) -> list[tuple[DataFrame, str]]:
        return [
            (d.select("code").distinct().withColumn(f"{mark}_is", F.lit(True)), "code"),
            (d.where(F.contains("code", F.lit("("))).groupBy(plain.alias("code")).agg(F.min("code").alias(f"{mark}_like")), "code"),
            (d.select(F.col("word").alias("code")).distinct().withColumn(f"{mark}_word", F.col("code")), "code"),
        ]

    out = codes
    for d, mark in ((known, "k"), (broken, "b"), (filler, "f")):
        for side, on in facts(d, mark):
            out = out.join(side, on, "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    quoted = F.concat(F.lit("PronId '"), F.col("code"), F.lit("'"))
    other_word, other_like = F.coalesce("b_word", "f_word"), F.coalesce("b_like", "f_like")
    parts = [F.concat(F.lit(" "), F.col("k_like")), F.concat(F.lit("word "), F.col("k_word")), F.concat(F.lit(" "), other_like), F.concat(F.lit("word "), other_word)]
    similar = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    none = ~there("k_is") & ~there("b_is") & ~there("f_is")
    message = (
        F.when(none & (similar == ""), F.concat(quoted, F.lit(" is not in the phonetic dictionary"))).when(none, F.concat(quoted, F.lit(" can't be found. Try "), similar))
        .when(there("k_is") & there("b_is"), F.concat(quoted, F.lit(" has occurence in multiple dictionaries")))
    )
    return out.select("code", message.alias("message")).where("message is not null")


def cached(cache: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cache of decoder results (path, actual, word_dist) with those of ``results`` that it lacks, each distinct pair of path and actual once; and counts: path, old (results that the cache had
    already), new."""
    have = cache.groupBy("path", "actual").agg(F.lit(1).alias("have"), F.min("word_dist").alias("word_dist"))
    got = results.groupBy("path", "actual").agg(F.count("*").alias("n"), F.min("word_dist").alias("word_dist"))
    both = have.select("path", "actual", "have", F.col("word_dist").alias("before")).join(got, ["path", "actual"], "full")
    whole = both.select("path", "actual", F.when(F.col("have") == 1, F.col("before")).otherwise(F.col("word_dist")).alias("word_dist"))
    counts = both.where("n is not null").groupBy("path").agg(F.count("have").alias("old"), F.count_if(F.col("have").isNull()).alias("new"))
    return whole, counts


def new_errors(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Results with errors (word_dist is not 0) whose pair of path and actual the cache lacks."""
    return results.where(F.coalesce("word_dist", F.lit(1)) != 0).join(cache.select("path", "actual").distinct(), ["path", "actual"], "left_anti")


def segment_name(path: Column, start: Column, end: Column) -> Column:
    """base_00273-00032: the file's name without its last ending, and the ids of the markers at both ends."""
    base = F.regexp_replace(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), r"\.[^.]*$", "")
    pad = lambda c: F.when(F.length(c.cast("string")) < 5, F.lpad(c.cast("string"), 5, "0")).otherwise(c.cast("string"))
    return F.concat(base, F.lit("_"), pad(start), F.lit("-"), pad(end))


def segment_paths(path: Column, start: Column, end: Column, source: str, base: str, below: str) -> Column:
    """struct(name, relative, whole): a segment's file name without ending, its path below ``base``, and its whole path, for a sound file below ``source`` whose segments go below ``base``/``below``."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.when(F.startswith(clean, F.lit(source.rstrip("/") + "/")), F.substring(clean, F.lit(len(source.rstrip("/")) + 2), F.length(clean))).otherwise(clean)
    folder = F.regexp_extract(inside, "^(.*/)?[^/]*$", 1)
    name = segment_name(path, start, end)
    relative = F.concat(F.lit(below.strip("/") + "/"), folder, name)
    return F.struct(name.alias("name"), relative.alias("relative"), F.concat(F.lit(base.rstrip("/") + "/"), relative).alias("whole"))


def phases(segments: DataFrame, key: Column, ratio: float = 0.7, swap: bool = False, broken_in_train: bool = True, seed: int = 1932) -> DataFrame:
    """``segments`` (exclude: the phase that a segment is kept out of; broken: whether it has broken words) with ``phase``: train, test or rejected. What is kept out of one phase goes to the other, broken
    ones go to training; what both rules part is rejected; the rest is dealt by a hash of the key, and ``swap`` changes these over."""
    test = F.coalesce(F.lower("exclude") == "train", F.lit(False))
    train = F.coalesce(F.lower("exclude") == "test", F.lit(False)) | (F.coalesce("broken", F.lit(False)) & F.lit(broken_in_train))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10000
    a, b = ("test", "train") if swap else ("train", "test")
    dealt = F.when(h < int(ratio * 10000), a).otherwise(b)
    return segments.withColumn("phase", F.when(test & train, "rejected").when(test, "test").when(train, "train").otherwise(dealt))


def framed(words: DataFrame, entries: DataFrame, keys: list[str], silence: str = "sil", pause: str = "sp") -> DataFrame:
    """keys, phones, unknown: ``sil``, the phones of the words (keys, pos, code) with ``sp`` between words, ``sil``; null, and the unknown codes in order, if ``entries`` (code, phones as an array, one row a code)
    lacks one."""
    met = words.join(entries.select("code", "phones"), "code", "left")
    all_of = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "code", "phones"))).alias("w"))
    unknown = F.transform(F.filter("w", lambda x: x["phones"].isNull()), lambda x: x["code"])
    body = F.flatten(F.transform("w", lambda x, i: F.when(i == 0, x["phones"]).otherwise(F.concat(F.array(F.lit(pause)), x["phones"]))))
    whole = F.concat(F.array(F.lit(silence)), body, F.array(F.lit(silence)))
    return all_of.select(*keys, F.when(F.size(unknown) == 0, whole).alias("phones"), unknown.alias("unknown"))


def features_table(rows: DataFrame, keys: list[str], label: str, vector: str) -> DataFrame:
    """keys, label, f0, f1, ...: a column for each component, as other tools read them. The vectors' length is that of the longest one; shorter ones have nulls behind. A row with a null vector has only nulls."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    return rows.select(*keys, label, *[F.get(F.col(vector), F.lit(i)).alias(f"f{i}") for i in range(max(0, width))])


def first_files(lines: DataFrame, file: str, most: int, skip: str = "BROKEN") -> DataFrame:
    """The rows of the first ``most`` files, by name, whose path lacks ``skip``. The files' names alone are sorted; ``most`` bounds what is broadcast."""
    names = lines.where(~F.contains(file, F.lit(skip))).select(file).distinct().orderBy(file).limit(most)
    return lines.join(F.broadcast(names), file, "left_semi")


def stamp(time: Column) -> Column:
    """yyyyMMddHHmmss."""
    return F.date_format(time, "yyyyMMddHHmmss")


def phase_of(text: Column) -> Column:
    """train or test by a text of any case, null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("train", "test"), t)


def language_name(code: Column) -> Column:
    """The name of a language's code: Ukrainian, Russian, English; the code itself for others, - for none."""
    return F.when(code.isNull() | (code == ""), "-").when(code == "uk", "Ukrainian").when(code == "ru", "Russian").when(code == "en", "English").otherwise(code)


def vocabulary_by_phase(usage: DataFrame, known: DataFrame, broken: DataFrame, removed: DataFrame, min_usage: int) -> DataFrame:
    """phase, word, cnt: the vocabulary of training and of testing. Both have the known dictionary's words and the corpus's words that are used ``min_usage`` times or more and that no dictionary has and nobody
    removed; the broken dictionary's words are in training alone. ``usage``: word, cnt; the others: word."""
    use = usage.select("word", "cnt").where(~F.col("word").isin("<s>", "</s>"))
    listed = known.select("word", F.lit(True).alias("in_test")).unionByName(broken.select("word", F.lit(False).alias("in_test"))).groupBy("word").agg(F.max("in_test").alias("in_test"))
    mine = listed.join(use, "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"), "in_test")
    more = use.where(F.col("cnt") >= min_usage).join(listed, "word", "left_anti").join(removed.select("word").distinct(), "word", "left_anti")
    both = mine.unionByName(more.withColumn("in_test", F.lit(True)))
    phase = F.explode(F.when(F.col("in_test"), F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("train")))).alias("phase")
    return both.select(phase, "word", "cnt")


def lists_by(rows: DataFrame, key: str, item: str) -> DataFrame:
    """key, items: the sorted items of each key. A list is one row, as the format asks for it."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def hours(segments: DataFrame, seconds: str, text: str, only: str | None = None) -> DataFrame:
    """hours: of all segments, or of those only whose text is ``only``."""
    s = F.col(seconds) if only is None else F.when(F.col(text) == only, F.col(seconds))
    return segments.agg(F.coalesce(F.sum(s), F.lit(0.0)).alias("seconds")).select((F.col("seconds") / 3600).alias("hours"))


def project(stress: DataFrame, usage: DataFrame, rules: DataFrame, codes: DataFrame) -> DataFrame:
    """part, subject, message: all that is wrong with a project. ``stress``: word, of whose pronunciations some have stress and some not; ``usage``: code, n (uses); ``rules``: id, message of markers; ``codes``: code,
    message of utterances."""
    line = lambda part, df, subject, message: df.select(F.lit(part).alias("part"), F.col(subject).cast("string").alias("subject"), message.alias("message"))
    return (
        line("dictionary", stress, "word", F.lit("not all pronCodes specify stress")).unionByName(line("dictionary", usage.where("n = 0"), "code", F.lit("pronCode is not used")))
        .unionByName(line("annotation", rules, "id", F.col("message"))).unionByName(line("utterance", codes, "code", F.col("message")))
    )
