"""The build of a recognizer's parts by phase: counts that both phases share, and for each phase vocabulary, language model and dictionaries, written as files.

Every step's result is written to the folder that driver and executors share and then noted in a manifest there, a table of (step, digest, path). A build that was stopped, wherever, is started again with
the same call: noted steps with the same settings are read, others are made. What a stopped step left behind is never read, as it isn't noted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import sinks

from . import corpus, reports, vocabulary
from .shared import stored

PHASES = ("train", "test")
MANIFEST = "step string, digest string, path string"


@dataclass
class Steps:
    """Steps of a build in ``folder`` under ``settings`` (what can be put as JSON; other settings make steps anew). ``made`` names those that this run made."""

    spark: SparkSession
    folder: str
    settings: dict = field(default_factory=dict)
    made: list[str] = field(default_factory=list)

    def digest(self, step: str) -> str:
        return hashlib.sha256(json.dumps([step, self.settings], sort_keys=True).encode()).hexdigest()

    def noted(self) -> DataFrame:
        """The manifest; empty before the first step."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def path(self, step: str) -> str | None:
        """Where the result of a step lies, if it is noted."""
        found = self.noted().where((F.col("step") == step) & (F.col("digest") == self.digest(step))).agg(F.min("path")).first()
        return found[0]

    def once(self, step: str, write: Callable[[str], None]) -> str:
        """The path of a step's result, which ``write`` puts there if no run did before."""
        path = self.path(step)
        if path is None:
            path = f"{self.folder}/{step}-{uuid.uuid4().hex}"
            write(path)
            self.spark.createDataFrame([(step, self.digest(step), path)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
            self.made.append(step)
        return path

    def table(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table that a step makes."""
        return self.spark.read.parquet(self.once(step, lambda path: make().write.parquet(path)))


def dictionary(words: DataFrame, entries: DataFrame, spell: Callable[[Column], Column]) -> DataFrame:
    """word, code, phones of a vocabulary: the entries (word, code, phones) of each word that has some, else the word itself as spelled by rule."""
    own = words.select("word").distinct()
    found = entries.join(own, "word", "left_semi").select("word", "code", "phones")
    rest = own.join(entries.select("word").distinct(), "word", "left_anti")
    return found.unionByName(rest.select("word", F.col("word").alias("code"), spell(F.col("word")).alias("phones")))


def models(phase: str, usage: DataFrame, bigrams: DataFrame, known: DataFrame, broken: DataFrame, removed: DataFrame, min_usage: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A phase's vocabulary (word, cnt), unigrams (word, cnt, logprob) and bigrams (w1, w2, cnt, logprob)."""
    words = reports.vocabulary_by_phase(usage, known, broken, removed, min_usage).where(F.col("phase") == phase).select("word", "cnt")
    marked = stored(vocabulary.with_sentence_marks(words, usage))
    return words, vocabulary.model_unigrams(marked), corpus.lm_bigram(stored(vocabulary.within(bigrams, marked)))


def build(
    steps: Steps, docs: DataFrame, known: DataFrame, broken: DataFrame, filler: DataFrame, removed: DataFrame, spell: Callable[[Column], Column], min_usage: int = 10
) -> dict[str, str]:
    """Paths of the files by name: for each phase ``<phase>.vocab``, ``<phase>.arpa``, ``<phase>.dict`` and ``filler.dict``. Dictionaries are word, code, phones (array); ``removed``: word.

    The texts are read once: what is counted is a table that both phases read. The test dictionary must not have a code of the broken dictionary; a build that would give one fails there, after the steps before
    were noted."""
    spelled = lambda d: d.select(F.col("code").alias("name"), "phones")
    pairs = steps.table("pairs", lambda: corpus.pairs(corpus.word_stream(docs)))
    usage = steps.table("usage", lambda: corpus.unigrams_of(pairs))
    files = {"filler.dict": steps.once("filler.dict", lambda path: sinks.write_pronunciations(spelled(filler), path))}
    bigrams = corpus.bigrams_of(pairs)
    for phase in PHASES:
        words = known.select("word").distinct(), broken.select("word").distinct()
        voc, ones, twos = models(phase, usage, bigrams, *words, removed, min_usage)
        voc = steps.table(f"{phase}-words", lambda v=voc: v)
        files[f"{phase}.vocab"] = steps.once(f"{phase}.vocab", lambda path, v=voc: sinks.write_words(v, path))
        ones = steps.table(f"{phase}-unigrams", lambda u=ones: u.select("word", "cnt", "logprob", F.lit(-0.69897).alias("backoff")))
        twos = steps.table(f"{phase}-bigrams", lambda b=twos: b)
        files[f"{phase}.arpa"] = steps.once(f"{phase}.arpa", lambda path, u=ones, b=twos: sinks.write_arpa(u, b, path))
        entries = known.unionByName(broken) if phase == "train" else known
        prons = steps.table(f"{phase}-dictionary", lambda v=voc, e=entries: dictionary(v, e.select("word", "code", "phones"), spell).join(filler.select("code"), "code", "left_anti").select("word", "code", "phones"))
        if phase == "test":
            wrong = prons.join(broken.select("code"), "code", "left_semi").agg(F.count("*"), F.min("code")).first()
            if wrong[0]:
                raise ValueError(f"{wrong[0]} codes of the test dictionary are in the broken dictionary, {wrong[1]} among them")
        files[f"{phase}.dict"] = steps.once(f"{phase}.dict", lambda path, d=prons: sinks.write_pronunciations(spelled(d), path))
    return files
