"""Writers: language model lines, pronunciation lists, transcription and utterance maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arpa_lines(unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """section, w1, w2, line: sort by the first three (nulls first) for the file."""
    none = F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("decimal(12,6)").cast("string")
    head = lambda df, s, text: df.sparkSession.range(1).select(F.lit(s).alias("section"), none.alias("w1"), none.alias("w2"), F.lit(text).alias("line"))
    size = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.lit(f"{n}").alias("w1"), none.alias("w2"), F.concat(F.lit(f"ngram {n}="), "n").alias("line"))
    ones = unigrams.select(F.lit(2).alias("section"), F.col("word").alias("w1"), none.alias("w2"), F.concat_ws(" ", number("logprob"), "word", number("backoff")).alias("line"))
    twos = bigrams.select(F.lit(3).alias("section"), "w1", "w2", F.concat_ws(" ", number("logprob"), "w1", "w2").alias("line"))
    parts = [head(unigrams, 1, "\\data\\"), size(unigrams, 1), size(bigrams, 2), head(unigrams, 2, "\\1-grams:"), ones, head(unigrams, 3, "\\2-grams:"), twos, head(unigrams, 4, "\\end\\")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_arpa(unigrams: DataFrame, bigrams: DataFrame, path: str) -> None:
    """The model as text files whose names sort in the order of the lines (a range sort, no single task)."""
    arpa_lines(unigrams, bigrams).orderBy("section", F.col("w1").asc_nulls_first(), F.col("w2").asc_nulls_first()).select("line").write.text(path)


def write_pronunciations(prons: DataFrame, path: str) -> None:
    """``name<TAB>phones`` of name, phones (array), by name."""
    prons.select(F.concat_ws("\t", "name", F.array_join("phones", " ")).alias("line")).orderBy("line").write.text(path)


def write_words(words: DataFrame, path: str, column: str = "word") -> None:
    words.select(F.col(column).cast("string").alias("line")).distinct().orderBy("line").write.text(path)


def write_transcription(utterances: DataFrame, path: str, silence: bool = False) -> None:
    """``<s> text </s> (id)`` and the ids, from id, text; ``silence`` keeps the silence tags (training)."""
    text = F.col("text") if silence else F.trim(F.regexp_replace(F.regexp_replace("text", r"<sil>|\[sp\]", " "), " +", " "))
    ordered = utterances.orderBy("id")
    ordered.select(F.concat(F.lit("<s> "), text, F.lit(" </s> ("), "id", F.lit(")")).alias("line")).write.text(f"{path}.transcription")
    ordered.select(F.col("id").cast("string").alias("line")).write.text(f"{path}.fileids")


def write_utterance_maps(utterances: DataFrame, path: str) -> None:
    """utt2spk, wav.scp, text and spk2utt by phase, from id, speaker, wav, text, phase."""
    for name, value in (("utt2spk", "speaker"), ("wav.scp", "wav"), ("text", "text")):
        _by_phase(utterances.select("phase", F.concat_ws(" ", "id", value).alias("line")), f"{path}/{name}")
    by = utterances.groupBy("phase", "speaker").agg(F.concat_ws(" ", "speaker", F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), " ")).alias("line"))
    _by_phase(by.select("phase", "line"), f"{path}/spk2utt")  # the format wants all of a speaker in a line


def _by_phase(lines: DataFrame, path: str) -> None:
    """Text files by phase whose names sort in the order of the lines: partitions are ranges of (phase, line), so a phase is not one task."""
    lines.repartitionByRange("phase", "line").sortWithinPartitions("phase", "line").write.partitionBy("phase").text(path)


def write_pronunciations_xml(prons: DataFrame, path: str) -> None:
    """Words as XML rows ``word`` from word, code, phones (array) and, where they are columns, log10_hint and comment of the word (of several the largest): an attribute ``phones`` where the only code is the
    word, else a child ``pron`` for each code. A hint above 0 is not written."""
    text = F.array_join("phones", " ")
    more = {"log10_hint": "_log10ProbHint", "comment": "_comment"}
    kept = [F.max(F.when(F.col(c) <= 0, F.col(c)) if c == "log10_hint" else F.col(c)).alias(n) for c, n in more.items() if c in prons.columns]
    by = prons.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.col("code").alias("_code"), text.alias("_phones")))).alias("pron"), *kept)
    plain = (F.size("pron") == 1) & (F.element_at("pron", 1)["_code"] == F.col("word"))
    rows = by.select(F.col("word").alias("_name"), F.when(plain, F.element_at("pron", 1)["_phones"]).alias("_phones"), F.when(~plain, F.col("pron")).alias("pron"), *[n for c, n in more.items() if c in prons.columns])
    rows.write.format("xml").option("rootTag", "phoneticDict").option("rowTag", "word").save(path)


def normalization_log(sentences: DataFrame) -> DataFrame:
    """line: ``-- raw`` and ``++ normalized`` of each sentence (raw, words: array) whose words differ from its text."""
    plain = F.array_join("words", " ")
    changed = sentences.where(F.col("raw") != plain)
    return changed.select(F.explode(F.array(F.concat(F.lit("-- "), "raw"), F.concat(F.lit("++ "), plain))).alias("line"))


def corpus_line(words: Column) -> Column:
    """``<s> words </s>`` of a sentence's words."""
    return F.concat(F.lit("<s> "), F.array_join(words, " "), F.lit(" </s>"))


def write_results_xml(results: DataFrame, path: str) -> None:
    """Decoder results (rel_path, expected, actual, word_dist) as XML rows ``utter``."""
    names = {"rel_path": "_relWavPath", "expected": "_expected", "actual": "_actual", "word_dist": "_wordDist"}
    results.select([F.col(c).alias(n) for c, n in names.items()]).write.format("xml").option("rootTag", "results").option("rowTag", "utter").save(path)


def write_annotation(markers: DataFrame, path: str) -> None:
    """Markers as XML rows ``syncPoint`` with attributes; null ones are left out."""
    markers.select([F.col(c).alias(f"_{c}") for c in markers.columns]).write.format("xml").option("rootTag", "audioSpeechAnnotation").option("rowTag", "syncPoint").save(path)
