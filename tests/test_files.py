"""Readers and writers: round trips and literals."""

from pyspark.sql import functions as F

from lexiloom.sources import files, sinks


def test_pronunciations_as_xml(spark, tmp_path):
    prons = spark.createDataFrame([("слово", "слово", ["S", "L"]), ("в", "в", ["V"]), ("в", "ф", ["F"]), ("так", "так(1)", ["T"])], "word string, code string, phones array<string>")
    sinks.write_pronunciations_xml(prons, str(tmp_path / "d"))
    got = files.phonetic_dictionary(spark, str(tmp_path / "d"))
    assert sorted((r["word"], r["code"], r["phones"]) for r in got.collect()) == sorted((r["word"], r["code"], r["phones"]) for r in prons.collect())


def test_hints_and_comments_as_xml(spark, tmp_path):
    rows = [("слово", "слово", ["S", "L"], -2.5, None), ("в", "в", ["V"], None, "two ways"), ("в", "ф", ["F"], None, "two ways"), ("так", "так", ["T"], 3.0, "a hint above 0")]
    sinks.write_pronunciations_xml(spark.createDataFrame(rows, "word string, code string, phones array<string>, log10_hint double, comment string"), str(tmp_path / "d"))
    got = {(r["word"], r["code"]): (r["log10_hint"], r["comment"]) for r in files.phonetic_dictionary(spark, str(tmp_path / "d")).collect()}
    assert got == {("слово", "слово"): (-2.5, None), ("в", "в"): (None, "two ways"), ("в", "ф"): (None, "two ways"), ("так", "так"): (None, "a hint above 0")}


def test_results_as_xml(spark, tmp_path):
    rows = [("a/b.wav", "так", "та к", 2), ("c.wav", "ні", None, 1)]
    sinks.write_results_xml(spark.createDataFrame(rows, "rel_path string, expected string, actual string, word_dist int"), str(tmp_path / "r"))
    assert sorted(tuple(r) for r in files.result_xml(spark, str(tmp_path / "r")).collect()) == rows


def test_utterance_maps(spark, tmp_path):
    rows = [(f"u{i:03d}", f"s{i % 3}", f"/w/{i}.wav", f"text {i}", "Train" if i % 4 else "Test") for i in range(40)]
    sinks.write_utterance_maps(spark.createDataFrame(rows, "id string, speaker string, wav string, text string, phase string"), str(tmp_path / "m"))
    read = lambda name, phase: [x for p in sorted((tmp_path / "m" / name / f"phase={phase}").glob("part*")) for x in p.read_text().splitlines()]
    for phase in ("Train", "Test"):
        own = [r for r in rows if r[4] == phase]
        assert read("utt2spk", phase) == [f"{r[0]} {r[1]}" for r in own] and read("text", phase) == [f"{r[0]} {r[3]}" for r in own]
        assert read("spk2utt", phase) == [" ".join([s, *(r[0] for r in own if r[1] == s)]) for s in ("s0", "s1", "s2")]


def test_words_and_model_files(spark, tmp_path):
    words = spark.createDataFrame([("b",), ("a",), ("b",)], "word string")
    sinks.write_words(words, str(tmp_path / "w"))
    assert sorted(r["word"] for r in files.word_list(spark, str(tmp_path / "w")).collect()) == ["a", "b"]
    prons = spark.createDataFrame([("b", ["B"]), ("a(2)", ["A", "X"])], "name string, phones array<string>")
    sinks.write_pronunciations(prons, str(tmp_path / "p"))
    good, bad = files.pronunciations(spark, str(tmp_path / "p"))
    assert sorted((r["word"], r["phones"]) for r in good.collect()) == [("a(2)", ["A", "X"]), ("b", ["B"])] and bad.count() == 0
    (tmp_path / "v").write_text("в\tV\nв\tF\nні\tN I\nзайве\n", "utf-8")
    assert sorted((r["word"], r["phones"]) for r in files.pronunciation_vocabulary(spark, str(tmp_path / "v")).collect()) == [("в", ["V"]), ("ні", ["N", "I"])]
    for text, name in [
        ('# x\n$CFG_BASE_DIR = "C:/TrainSphinx/persian.v39";\n$CFG_BASE_DIR = "other";\n', "persian.v39"), ('  $CFG_BASE_DIR="C:\\a/model/";\n', "model"), ("$CFG_BASE_DIR = 'x';\n", ""), ("$CFG_X = 1;\n", ""),
        ('$CFG_BASE_DIR = "model";', "model"),
    ]:
        (tmp_path / "cfg").write_text(text)
        assert files.model_version(spark, str(tmp_path / "cfg")).first()["name"] == name


def test_listed_audio(spark, tmp_path):
    for name in ("x/a.wav", "y/a.wav", "y/b.txt"):
        (tmp_path / "au" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "au" / name).write_bytes(b"abc")
    ids = spark.createDataFrame([("x/a",), ("y/b",)], "id string")
    got = {r["id"]: (r["path"] or "")[-7:] for r in files.listed_audio(spark, ids, str(tmp_path / "au")).collect()}
    assert got == {"x/a": "x/a.wav", "y/b": ""}


def test_dsl_stress_and_declensions(spark, tmp_path):
    (tmp_path / "d.dsl").write_text("#NAME x\nword{[i]} one\n\t[s]a.wav[/s]\nтак\n\ttext\n", "utf-8")
    assert sorted((r["word"], r["sound"]) for r in files.dsl_cards(spark, str(tmp_path / "d.dsl")).collect()) == [("word one", "a.wav"), ("так", "")]
    (tmp_path / "s.xml").write_text('<d><word name="слово" stressedSyllable="2 1"/><word name="так" stressedSyllable="1"/></d>', "utf-8")
    assert sorted((r["word"], r["syllable"]) for r in files.stress_dictionary(spark, str(tmp_path / "s.xml")).collect()) == [("слово", 1), ("так", 0)]
    (tmp_path / "g.xml").write_text('<d><group name="він" class="p"><word name="він" case="n"/><word name="його" case="g"/></group><group name="він" class="p"></group></d>', "utf-8")
    assert sorted(r["form"] for r in files.declensions(spark, str(tmp_path / "g.xml")).where(F.col("form").isNotNull()).collect()) == ["він", "його"]


def test_log_of_changes(spark):
    s = spark.createDataFrame([("a 1 b", ["a", "one", "b"]), ("same", ["same"])], "raw string, words array<string>")
    assert [r["line"] for r in sinks.normalization_log(s).collect()] == ["-- a 1 b", "++ a one b"]
