"""What is dear is done once: texts are read once by a query, letters are told by their first test."""

import time

import pytest
from pyspark.sql import functions as F

import lexiloom.plans.reports  # noqa: F401
import lexiloom.plans.speech  # noqa: F401
import lexiloom.plans.vocabulary  # noqa: F401
from lexiloom.functions import text as T
from lexiloom.operators import alignment, corpus
from lexiloom.plans import catalogue

SF = "/root/testdata/sf0.001"
MANY = "ngram_sizes arpa_lines phase_models phase_vocabulary vocabulary_choice vocabulary_unigrams vocabulary_bigrams stressed_phones speller_diff suffix_split".split()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def of_texts(df):
    """How often a plan reads documents."""
    return plan(df).count("Relation [doc_id")


@pytest.mark.parametrize("name", MANY)
def test_texts_are_read_once(spark, name):
    assert of_texts(catalogue.QUERIES[name](spark, SF)) <= (name == "ngram_sizes")  # the others have stored what they count


def test_sentences_are_found_once(spark):
    assert "Filter" not in plan(catalogue.QUERIES["sentence_filter"](spark, SF))
    docs = spark.createDataFrame([(1, "Ab cd. Ef 5 gh. Ij!"), (2, "5."), (None, None), (3, ""), (3, "x. Yz")], "doc_id long, text string")
    assert sorted(map(tuple, corpus.sentence_counts(docs).collect())) == [(1, 2, 3), (3, 1, 2)]


def test_sizes_of_empty_and_single(spark):
    none = spark.createDataFrame([], "word string, next string, cnt long")
    assert sorted(map(tuple, corpus.sizes(none).collect())) == [(1, 0, None), (2, 0, None)]
    last = spark.createDataFrame([("a", None, 3), ("a", "b", 2), ("b", "a", 4)], none.schema)
    assert sorted(map(tuple, corpus.sizes(last).collect())) == [(1, 2, 9), (2, 2, 6)]


NEGATED = f"[^{T.STOP}{T.PUNCT}{T.SPACE}0-9]"


def test_letters_are_all_other_characters(spark):
    every = spark.createDataFrame([("".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000),)], "t string")
    new, old = every.select(F.regexp_replace("t", T.LETTER, ""), F.regexp_replace("t", NEGATED, "")).first()
    assert new == old and len(new) == 62


def test_letters_are_told_soon(spark):
    long = spark.range(1).select(F.repeat(F.lit("слово words wörter "), 60_000).alias("t")).localCheckpoint()

    def least(found):
        times = []
        for _ in range(5):
            began = time.perf_counter()
            long.select(F.size(found)).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    assert least(T.words(F.col("t"))) < 0.7 * least(F.regexp_extract_all("t", F.lit(NEGATED + "+"), F.lit(0)))


def test_paths_are_found_once(spark):
    u = spark.createDataFrame([([[0.0], [1.0]], ["a", "b"])], "frames array<array<double>>, states array<string>")
    model = spark.createDataFrame([("a", [0.0], [1.0]), ("b", [1.0], [1.0])], "state string, mean array<double>, var array<double>")
    assert plan(alignment.by_state(alignment.align(u, model))).count("ln(") == 1  # of the density, in the emissions of each path


def test_training_reads_utterances_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(i):
        read.add(1)
        return [[float(i)], [float(i + 5)]], ["a", "b"]

    u = spark.createDataFrame(spark.sparkContext.range(12, numSlices=2).map(counted), "frames array<array<double>>, states array<string>")
    model, scores = alignment.train(u, rounds=3, least_gain=-1.0)
    assert sorted((r.state, r.n, r.mean) for r in model.collect()) == [("a", 12, [5.5]), ("b", 12, [10.5])] and len(scores) == 3
    assert read.value == 12


def test_impossible_paths_and_equal_starts(spark):
    lowest = float("-inf")
    df = spark.createDataFrame([([[lowest, lowest]] * 3,), ([[0.0, lowest], [lowest, 0.0], [0.0, 1.0]],)], "e array<array<double>>")
    assert [(r[0].score, r[0].starts) for r in df.select(alignment.viterbi(F.col("e"))).collect()] == [(lowest, [0]), (1.0, [0, 1])]
    rows = spark.createDataFrame([([[1.0], [2.0]], ["a", "b"], [0, 0], -3.0)], "frames array<array<double>>, states array<string>, starts array<int>, score double")
    assert sorted(map(tuple, alignment.by_state(rows).collect())) == [("b", [1.0], -3.0), ("b", [2.0], 0.0)]
