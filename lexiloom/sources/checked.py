"""Readers that report what they reject: each gives the good rows and the errors, (file, record, message), of one pass over the files. Good rows always stay; a record can have one error.

``counted`` puts an Observation on a table of rows with messages, so that the number of errors by kind is known after the one action that writes the good rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T

_PATH = "_metadata.file_path"


def parted(rows: DataFrame, message: Column, record: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows without a message, as ``columns``, and the errors of the others. ``rows`` has a column file."""
    marked = rows.withColumn("message", message).withColumn("record", record)
    return marked.where("message is null").select(*columns), marked.where("message is not null").select("file", "record", "message")


def counted(rows: DataFrame, messages: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """``rows`` without those of which a condition of ``messages`` holds, and an observation of how many rows there were, ``rows``, and how often each message is the first that holds, by its key."""
    first = F.coalesce(*[F.when(c, F.lit(m)) for m, c in messages.items()], F.lit(""))
    seen = Observation(name)
    marked = rows.withColumn("first_message", first)
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("first_message") == m).alias(m) for m in messages])
    return marked.where("first_message = ''").drop("first_message"), seen


def lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """file, at, line of text files; ``at`` (the part of the file, the place in it) puts the lines of a file in order. Files are read in parts, so ``at`` is no line number; ``numbered`` makes one."""
    raw = spark.read.option("encoding", charset).option("sep", "\u0001").option("quote", "").schema("line string").csv(path) if charset != "UTF-8" else spark.read.text(path).withColumnRenamed("value", "line")
    return raw.select(F.col(_PATH).alias("file"), F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place")).alias("at"), F.regexp_replace("line", r"\r$", "").alias("line"))


def numbered(rows: DataFrame) -> DataFrame:
    """file, n (from 1), line: lines by their number in the file. A window over each file."""
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("n"), "line")


def pronunciations(spark: SparkSession, path: str, phones: list[str] | None = None, charset: str = "UTF-8", longest: int = 64) -> tuple[DataFrame, DataFrame]:
    """file, nth, word, prons of ``word PH PH`` lines, and the errors. Lines of one word right below each other are one entry with their pronunciations (arrays of phones in capitals) in order; a word that comes again
    later is another entry. Broken lines part nothing. ``phones``: those that are known, any if None. Lines of fewer than three characters, or that begin with a blank, are passed over."""
    raw = lines(spark, path, charset).where((F.length("line") >= 3) & ~F.col("line").rlike(r"^[ \t]"))
    word = F.regexp_extract("line", r"^([^ \t]+)", 1)
    found = F.filter(F.split(F.upper(F.regexp_extract("line", r"^[^ \t]+[ \t](.*)$", 1)), "[ \t]+"), lambda p: p != "")
    raw = raw.withColumn("word", word).withColumn("phones", found)
    known = F.lit(False) if phones is None else F.exists("phones", lambda p: ~p.isin(*phones))
    message = (
        F.when(~F.col("line").rlike("[ \t]"), "no phones").when(F.length("word") > longest, "word is too long").when(F.size("phones") == 0, "no phones").when(known, "unknown phone")
    )
    good, errors = parted(raw, message, F.col("line"), ["file", "at", "word", "phones"])
    order = Window.partitionBy("file").orderBy("at")
    run = F.sum(F.when(F.lag("word").over(order) == F.col("word"), 0).otherwise(1)).over(order)
    runs = good.withColumn("nth", run).groupBy("file", "nth").agg(F.first("word").alias("word"), F.array_sort(F.collect_list(F.struct("at", "phones"))).alias("p"))
    return runs.select("file", "nth", "word", F.col("p.phones").alias("prons")), errors


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of XML with ``broken``, the text of an element that can't be read."""
    read = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", "true")
    return read.schema(f"{schema}, broken string").load(path).withColumn("file", F.col(_PATH))


def stresses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file, word, syllable (from 0) of a stress dictionary, and the errors: elements that can't be read, that lack a part, whose syllable is no number or not one of the word's."""
    w = _xml(spark, path, "word", "_name string, _stressedSyllable string")
    first = F.split("_stressedSyllable", " ")[0]
    number = F.when(first.rlike(r"^[+-]?[0-9]{1,9}$"), first.cast("int")) - 1
    w = w.withColumn("word", F.col("_name")).withColumn("syllable", number)
    vowels = T.vowel_count(F.col("word"))
    message = (
        F.when(F.col("broken").isNotNull(), "can't be read").when(F.coalesce("word", F.lit("")) == "", "the stress definition is incomplete").when(F.col("_stressedSyllable").isNull(), "the stress definition is incomplete")
        .when(F.col("syllable").isNull(), "can't parse stressed syllable").when((F.col("syllable") < 0) | (F.col("syllable") >= vowels), "syllable index is out of range")
    )
    return parted(w, message, F.coalesce("broken", F.concat_ws(" ", "word", "_stressedSyllable"), F.lit("")), ["file", "word", "syllable"])


def declensions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """lemma, class, forms (array of struct(name, case, gender, number)) of a declension dictionary, one row a lemma, and the errors: elements that can't be read, groups without a name, and lemmas with
    several groups that have forms, of different numbers (none of those groups is kept). Of groups without and with forms the latter stays, of equal ones the one with the least forms as text."""
    g = _xml(spark, path, "group", "_name string, _class string, word array<struct<_name:string,_case:string,_gender:string,_number:string>>")
    g = g.withColumn("n", F.coalesce(F.size("word"), F.lit(0)))
    unread = F.when(F.col("broken").isNotNull(), "can't be read").when(F.coalesce("_name", F.lit("")) == "", "a group without a name")
    good, errors = parted(g, unread, F.coalesce("broken", "_class", F.lit("")), ["file", "_name", "_class", "word", "n"])
    some = F.when(F.col("n") > 0, F.col("n"))
    by = good.groupBy("_name").agg(F.min(some).alias("lo"), F.max(some).alias("hi"), F.min_by(F.struct("_class", "word"), F.struct(-F.col("n"), F.to_json("word"), "_class")).alias("g"), F.min("file").alias("file"))
    clash = F.col("lo") < F.col("hi")
    form = lambda w: F.struct(*[w[f"_{c}"].alias(c) for c in ("name", "case", "gender", "number")])
    rows = by.where(~F.coalesce(clash, F.lit(False))).select(F.col("_name").alias("lemma"), F.col("g._class").alias("class"), F.coalesce(F.transform("g.word", form), F.array().cast("array<struct<name:string,case:string,gender:string,number:string>>")).alias("forms"))
    return rows, errors.unionByName(by.where(clash).select("file", F.col("_name").alias("record"), F.lit("duplicate word groups with different word forms").alias("message")))
