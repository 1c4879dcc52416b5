"""Readers of speech toolkits' files: annotation and dictionary XML, word lists, pronunciations, transcriptions, PCM audio, big-endian indexes."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARKER = "_id int, _sampleInd long, _levelOfDetail string, _transcripText string, _lang string, _speakerBriefId string, _exclude string"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").option("recursiveFileLookup", "true").schema(schema).load(path)


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """file, id, sample, level (word if unset), text, lang, speaker, exclude of each marker below ``path``; a bad number fails."""
    m = _xml(spark, path, "syncPoint", _MARKER).withColumn("file", F.input_file_name())
    return m.select("file", F.col("_id").alias("id"), F.col("_sampleInd").alias("sample"), F.coalesce("_levelOfDetail", F.lit("word")).alias("level"), F.col("_transcripText").alias("text"), F.col("_lang").alias("lang"), F.col("_speakerBriefId").alias("speaker"), F.col("_exclude").alias("exclude"))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "speaker", "_briefId string, _name string").select(F.input_file_name().alias("file"), F.col("_briefId").alias("id"), F.col("_name").alias("name"))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "param", "_name string, _value string").select(F.input_file_name().alias("file"), F.col("_name").alias("name"), F.col("_value").alias("value"))


def phonetic_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, code, phones, log10_hint, comment: one pronunciation as an attribute (its code is the word) or several as ``pron``; both, or a hint above 0, fail."""
    w = _xml(spark, path, "word", "_name string, _phones string, _log10ProbHint double, _comment string, pron array<struct<_code:string,_phones:string>>")
    ok = F.when(F.col("_phones").isNotNull() & F.col("pron").isNotNull(), F.raise_error(F.concat(F.lit("phones and pron: "), "_name"))).when(F.col("_log10ProbHint") > 0, F.raise_error(F.concat(F.lit("hint above 0: "), "_name")))
    one = F.array(F.struct(F.col("_name").alias("_code"), F.col("_phones").alias("_phones")))
    out = w.where(ok.cast("string").isNull()).select(F.col("_name").alias("word"), F.explode(F.coalesce("pron", one)).alias("p"), F.col("_log10ProbHint").alias("log10_hint"), F.col("_comment").alias("comment"))
    return out.select("word", F.col("p._code").alias("code"), F.filter(F.split("p._phones", " "), lambda x: x != "").alias("phones"), "log10_hint", "comment")


def stress_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, syllable (from 0): the first number of the list."""
    w = _xml(spark, path, "word", "_name string, _stressedSyllable string")
    return w.select(F.col("_name").alias("word"), (F.split("_stressedSyllable", " ")[0].cast("int") - 1).alias("syllable")).where("syllable >= 0")


def declensions(spark: SparkSession, path: str) -> DataFrame:
    """lemma, class, and a row a form; of a repeated lemma the group with most forms stays."""
    g = _xml(spark, path, "group", "_name string, _class string, word array<struct<_name:string,_case:string,_gender:string,_number:string,_person:string,_tense:string>>")
    g = g.withColumn("n", F.coalesce(F.size("word"), F.lit(0))).withColumn("k", F.row_number().over(Window.partitionBy("_name").orderBy(F.desc("n"), F.to_json("word"))))
    f = g.where("k = 1").select(F.col("_name").alias("lemma"), F.col("_class").alias("class"), F.explode_outer("word").alias("w"))
    return f.select("lemma", "class", *[F.col(f"w._{c}").alias("form" if c == "name" else c) for c in ("name", "case", "gender", "number", "person", "tense")])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words, one a line; ``##`` anywhere drops the line, ``#`` starts a comment."""
    t = spark.read.text(path).where(~F.col("value").contains("##"))
    return t.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("word")).where("word <> ''").distinct()


def pronunciations(spark: SparkSession, path: str, charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(word, phones) of ``word<TAB>PH PH`` lines, and the lines that don't parse. Windows-1251 needs spark.sql.legacy.javaCharsets."""
    raw = spark.read.option("encoding", charset).option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    good = F.col("line").rlike(r"^[^\t]+\t[^\t]*[^\t ][^\t]*$")
    parts = F.split("line", "\t")
    return raw.where(good).select(parts[0].alias("word"), F.filter(F.split(parts[1], " "), lambda x: x != "").alias("phones")), raw.where(~good)


def pronunciation_vocabulary(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """word, phones of ``word<TAB>PH PH`` lines; of several for a word the one that comes first in its file counts (by its place in the text)."""
    whole = spark.read.option("encoding", charset).text(path, wholetext=True)
    lines = whole.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("nth", "line")).where(F.col("line").rlike(r"^[^\t]+\t[^\t]*[^\t ]"))
    parts = F.split("line", "\t")
    best = lines.groupBy(parts[0].alias("word")).agg(F.min_by(parts[1], F.struct("file", "nth")).alias("p"))
    return best.select("word", F.filter(F.split("p", " "), lambda x: x != "").alias("phones"))


def listed_audio(spark: SparkSession, ids: DataFrame, path: str) -> DataFrame:
    """id, path, length of the audio files below ``path`` that a list of ids (id: the path without its ending) names; a missing file has a null path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.lower("path").rlike(r"\.(wav|flac)$"))
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    found = ids.select("id", F.substring_index("id", "/", -1).alias("base")).join(files.withColumn("base", base), "base", "left")
    return found.where(F.col("path").isNull() | F.contains("path", "id")).select("id", "path", "length")


def model_version(spark: SparkSession, path: str) -> DataFrame:
    """name: the last folder of the base folder that a training configuration names: what stands between the first and the last double quote of the first line with ``$CFG_BASE_DIR``. Empty
    without such a line or quotes."""
    text = spark.read.text(path, wholetext=True)
    line = F.regexp_extract("value", r"(?m)^([^\r\n]*\$CFG_BASE_DIR[^\r\n]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(line, '"(.*)"', 1), r"[/\\\\]+$", "")
    return text.select(F.regexp_extract(folder, r"([^/\\\\]*)$", 1).alias("name"))


def result_xml(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, expected, actual, word_dist of decoder results as XML rows ``utter``."""
    rows = _xml(spark, path, "utter", "_relWavPath string, _expected string, _actual string, _wordDist int")
    return rows.select(F.col("_relWavPath").alias("rel_path"), F.col("_expected").alias("expected"), F.col("_actual").alias("actual"), F.col("_wordDist").alias("word_dist"))


def transcription(spark: SparkSession, path: str) -> DataFrame:
    """text, id of ``text (id)`` lines; the last parenthesis counts."""
    pattern = r"^(.*)\(([^()]*)\)\s*$"
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(F.trim(F.regexp_extract("value", pattern, 1)).alias("text"), F.regexp_extract("value", pattern, 2).alias("id"))


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("id"))


def result_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A map a block of ``key=value`` lines; blank lines part blocks."""
    t = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.col("value")).alias("value")).where("value <> ''")
    return t.select(F.expr("str_to_map(value, '\n', '=')").alias("fields"))


def dsl_cards(spark: SparkSession, path: str) -> DataFrame:
    """word, sound: headwords (lines that aren't indented, without ``{[...]}``) of a file with the sound that follows them."""
    whole = spark.read.text(path, wholetext=True)
    cards = whole.select(F.explode(F.split("value", r"\r?\n(?=[^\s#])")).alias("card"))
    head = F.trim(F.regexp_replace(F.regexp_extract("card", r"^([^\r\n]*)", 1), r"\{\[.*?\]\}", ""))
    return cards.select(head.alias("word"), F.regexp_extract("card", r"\[s\]([^\[]+)\[/s\]", 1).alias("sound")).where("word <> '' AND NOT startswith(word, '#')")


def pcm_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels, samples of 16-bit WAV files."""

    def parse(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            with wave.open(io.BytesIO(b)) as w:
                rows.append((w.getframerate(), w.getnchannels(), np.frombuffer(w.readframes(w.getnframes()), "<i2").tolist()))
        return pd.DataFrame(rows, columns=["rate", "channels", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.pandas_udf(parse, "rate int, channels int, samples array<short>")("content").alias("w")).select("path", "w.*")


def star_index(spark: SparkSession, path: str) -> DataFrame:
    """name, offset, size of a big-endian index: a name, a zero byte, two unsigned 32-bit numbers."""

    def run(batches):
        for pdf in batches:
            for b in pdf["content"]:
                rows, at = [], 0
                while (end := b.find(b"\0", at)) >= 0 and end + 9 <= len(b):
                    rows.append((b[at:end].decode("utf-8", "replace"), *struct.unpack_from(">II", b, end + 1)))
                    at = end + 9
                yield pd.DataFrame(rows, columns=["name", "offset", "size"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, offset long, size long")
