"""Goldens and brute force for number words, pronunciation, signals, readers and writers."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import numerals, phonetics, signal
from lexiloom.operators import speech
from lexiloom.sources import files, sinks


@pytest.mark.parametrize(
    "n, kind, case, gender, want",
    [
        (651, "card", "G", "f", "шестисот п'ятдесяти одної"),
        (652, "card", "N", "m", "шістсот п'ятдесят два"),
        (652, "card", "N", None, None),
        (8000, "ord", "G", "m", "восьмитисячного"),
        (321000, "ord", "N", "m", "трьохсотдвадцятиоднотисячний"),
        (2001, "ord", "D", "m", "дві тисячі першому"),
        (-1, "card", "N", "m", None),
        (10**18, "card", "N", "m", None),
    ],
)
def test_number_words(n, kind, case, gender, want):
    assert numerals.words(n, kind, case, None, gender) == want


def test_zero():
    assert numerals.words(0, "card", "G", "pl") == "нулів"


def test_suffix_split(spark):
    words = spark.createDataFrame([("книгами",), ("он",)], "word string")
    got = phonetics.suffix_split(words, spark.createDataFrame([("ми",), ("ами",)], "suffix string"))
    assert {tuple(r) for r in got.collect()} == {("книгами", "книг", "ами"), ("он", "он", None)}


def test_mfcc_of_a_sine_and_short_input():
    x = np.sin(2 * np.pi * 440 * np.arange(4000) / 16000) * 1000
    f = signal.mfcc_frames(x, 16000.0)
    assert f.shape == (1 + (4000 - 400) // 160, 39) and np.isfinite(f).all()
    assert signal.mfcc_frames(x[:399], 16000.0).shape == (0, 39)
    bank = signal.filter_bank(512, 16000.0)
    assert bank.shape == (24, 256) and bank.max() <= 1 and (bank >= 0).all()


def test_mixtures_tell_labels_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 2), (rng.normal(size=3) + 6 * (i % 2)).tolist()) for i in range(200)] + [(0, None), (None, [1.0, 1.0, 1.0]), (1, [None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    model = speech.gmm_train(df, "label", "v")
    got = df.withColumn("best", speech.gmm_classify(F.col("v"), model, "int")).where("label IS NOT NULL AND v IS NOT NULL AND v[0] IS NOT NULL").where("best <> label").count()
    assert set(model) == {0, 1} and got == 0
    assert speech.gmm_train(df.limit(0), "label", "v") == {}


def test_dictionary_and_annotation_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<d><word name="a" phones="A B"/><word name="b" log10ProbHint="-2"><pron code="b(1)" phones="B1"/><pron code="b(2)" phones="B2 C"/></word></d>')
    got = {tuple(map(str, r)) for r in files.phonetic_dictionary(spark, str(tmp_path / "d.xml")).drop("comment").collect()}
    assert got == {("a", "a", "['A', 'B']", "None"), ("b", "b(1)", "['B1']", "-2.0"), ("b", "b(2)", "['B2', 'C']", "-2.0")}
    markers = spark.createDataFrame([(1, 10, "word", "раз"), (2, 20, "phone", None)], "id int, sampleInd long, levelOfDetail string, transcripText string")
    sinks.write_annotation(markers, str(tmp_path / "m"))
    back = files.annotation(spark, str(tmp_path / "m")).select("id", "sample", "level", "text").collect()
    assert {tuple(r) for r in back} == {(1, 10, "word", "раз"), (2, 20, "phone", None)}


def test_text_files(spark, tmp_path):
    (tmp_path / "w").write_text("one # first\n## no\ntwo\n\none\n")
    assert {r.word for r in files.word_list(spark, str(tmp_path / "w")).collect()} == {"one", "two"}
    (tmp_path / "p").write_text("да\tD A\nбез\n")
    good, bad = files.pronunciations(spark, str(tmp_path / "p"))
    assert [(r.word, r.phones) for r in good.collect()] == [("да", ["D", "A"])] and [r.line for r in bad.collect()] == ["без"]
    sinks.write_transcription(spark.createDataFrame([("u1", "<sil> так (ні) [sp]")], "id string, text string"), str(tmp_path / "t"))
    got = files.transcription(spark, str(tmp_path / "t.transcription")).collect()
    assert [(r.text, r.id) for r in got] == [("<s> так (ні) </s>", "u1")]
    (tmp_path / "r").write_text("path=a\nactual=x\n\npath=b\nactual=y\n")
    assert [r.fields["path"] for r in files.result_blocks(spark, str(tmp_path / "r")).collect()] == ["a", "b"]


def test_binary_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([1, -2, 3], "<i2").tobytes())
    r = files.pcm_wav(spark, str(tmp_path)).collect()[0]
    assert (r.rate, r.channels, r.samples) == (8000, 1, [1, -2, 3])
    (tmp_path / "x.ridx").write_bytes(b"ab\0\0\0\0\1\0\0\1\0")
    assert [tuple(r) for r in files.star_index(spark, str(tmp_path / "x.ridx")).collect()] == [("ab", 1, 256)]


def test_cepstra_have_no_seams(spark):
    r = np.random.default_rng(4)
    values = {1: r.normal(0, 50, 9000), 2: r.normal(0, 50, 4096), 3: r.normal(0, 50, 31), 4: r.normal(0, 50, 4110), 5: r.normal(0, 50, 8200)}
    rows = [(u, i, float(v)) for u, x in values.items() for i, v in enumerate(x)]
    got = speech.cepstra(spark.createDataFrame(rows, "u long, i long, v double"), "u", ["i"], "v", 8000.0, 32, 16).collect()
    for u, x in values.items():
        mine = {f["frame"]: f["features"] for f in got if f["u"] == u}
        want = signal.mfcc_frames(x, 8000.0, 32, 16)
        assert sorted(mine) == list(range(len(want))) and sum(f["u"] == u for f in got) == len(want)
        assert all(np.allclose(mine[i], f) for i, f in enumerate(want))
