"""Literals for text functions and small operators; fixed values are typed once more."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import phonetics, signal
from lexiloom.functions import text as T
from lexiloom.operators import corpus, recordings, vocabulary


def one(spark, column, *values):
    """A column over one row that holds the values as a, b, ..."""
    row = spark.range(1).select(*[F.lit(v).alias("abcdef"[i]) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias("abcdef"[i]) for i, v in enumerate(values)])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, latin", [("Григорій", "Hryhorij"), ("Жук", "Zhuk"), ("ґанок", "ganok"), ("їжак", "jizhak"), ("Єва", "Eva"), ("об'єкт", "ob'ekt"), ("сіль", "sil"), ("щука", "shuka"), ("Юлія", "Julija"), ("Хата", "Hata"), ("ц 世", "c _")])
def test_transliteration(spark, word, latin):
    assert one(spark, T.transliterate(F.col("a")), word) == latin.replace("Zhuk", "ZHuk").replace("Julija", "JUlija")


@pytest.mark.parametrize("text, parts", [
    ("Один. Два! Три", ["Один.", " Два!", " Три"]), ("див. далі. Кінець", ["див. далі.", " Кінець"]), ("у 5 км. від", ["у 5 км. від"]), ("А. Б. Франко", ["А. Б. Франко"]), ("Що?! Так... Ні", ["Що?!", " Так...", " Ні"]),
    ("...кінець", ["...", "кінець"]), ("13 р. 25. Далі", ["13 р. 25.", " Далі"]), ("др. обл. проф. рис. св. ", ["др.", " обл.", " проф.", " рис. св. "]), ("ДИВ. там", ["ДИВ. там"]), ("завдив. там", ["завдив.", " там"]), ("", []),
])
def test_sentences(spark, text, parts):
    assert [x for x in one(spark, T.sentences(F.col("a")), text) if x] == parts


def test_abbreviations_are_the_fixed_ones():
    known = "англ г га гр год грец грн д див дж дол е зв км коп крб л лат мал мед мл млн н напр нім оп п пер перен р ред рос розд розм рис рр руб с св см ст т тис укр фр хв ч шт ім ін іст"
    assert set(T.ABBREVIATIONS) == set(known.split()) and len(T.ABBREVIATIONS) == len(set(T.ABBREVIATIONS)) == 51


def test_word_stream_of_shared_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "Ab cd. Ef 5 gh. Ij"), (1, "Ab zz."), (None, "Kl."), (None, None), (2, "")], "doc_id long, text string")
    got = {(r["word"], r["next"]) for r in corpus.word_stream(docs).collect()}
    assert got == {("<s>", "Ab"), ("Ab", "cd"), ("cd", "</s>"), ("</s>", "<s>"), ("<s>", "Ij"), ("Ij", "</s>"), ("</s>", None), ("Ab", "zz"), ("zz", "</s>"), ("<s>", "Kl"), ("Kl", "</s>")}
    spans = sorted((r["doc_id"] or 0, r["sent_id"], r["first_pos"], r["last_pos"]) for r in corpus.sentence_spans(docs).collect())
    assert spans == [(0, 0, 0, 1), (1, 0, 0, 3), (1, 0, 0, 3), (1, 1, 4, 10), (1, 2, 11, 12)]


@pytest.mark.parametrize("token, kind", [("12", "arabic"), ("XIV", "roman"), ("cat", "english"), ("объект", "russian"), ("слово", "ukrainian"), ("под'їзд", "ukrainian"), ("世界", "other")])
def test_word_class(spark, token, kind):
    assert one(spark, T.word_class(F.col("a")), token) == kind


def test_small_text_functions(spark):
    assert one(spark, T.vowel_count(F.col("a")), "Україна") == 4
    assert one(spark, T.trim_blanks(F.col("a")), " \t x y\t") == "x y"
    assert one(spark, T.code_word(F.col("a")), "слова(2)") == "слова" and one(spark, T.code_stress(F.col("a")), "слова(2)") == 2 and one(spark, T.code_stress(F.col("a")), "слова") is None
    assert one(spark, T.mangled(F.col("a")), "слова(2)") == "слова2"
    assert [one(spark, T.roman_value(F.col("a")), x) for x in ("I", "IV", "XIX", "XXI", "XXII", "iv")] == [1, 4, 19, 21, -1, -1]
    assert one(spark, T.unified(F.col("a")), "пере¬рва — об’єкт 1¬2 ¬x") == "перерва - об'єкт 12 ¬x"
    assert one(spark, T.utterance_words(F.col("a")), "#так {w:слова,s:2}  ні") == ["так", "слова(2)", "ні"]


def test_mel_and_back(spark):
    assert abs(one(spark, signal.mel_inverse(signal.mel(F.col("a"))), 440.0) - 440) < 1e-9 and abs(one(spark, signal.mel(F.col("a")), 700.0) - 781.17) < 0.01


def test_recording_helpers(spark):
    accepted = lambda *w: one(spark, recordings.accepted(F.col("a")), list(w))
    assert accepted("a", "b", "c") == ["a", "b"] and accepted("a", "b", "</s>") == ["a"] and accepted("a", "[inh]", "b") == ["a", "[inh]"] and accepted("a") == ["a"] and accepted("a", "b", "<s>", "</s>") == ["a"]
    assert one(spark, recordings.recipe(F.col("a")), "test.wav;3-15;R3 # R5").asDict() == {"file": "test.wav", "from_id": 3, "to_id": 15, "times": 3}
    assert one(spark, recordings.recipe(F.col("a")), "# nothing") is None and one(spark, recordings.recipe(F.col("a")), "f;1-2")["times"] == 1
    assert one(spark, recordings.in_top(F.col("a"), F.lit(1), 2), [3.0, 2.0, 2.0]) and not one(spark, recordings.in_top(F.col("a"), F.lit(2), 2), [3.0, 2.0, 2.0])
    assert [one(spark, phonetics.phone_name(F.col("a")), x) for x in (0, 5, 6, -1)] == ["a", "u", "?", "?"]


def test_states_and_parts(spark):
    names = ["a1", "a2", "?", "?", "7x", "e1", "e2", "a1"]
    got = recordings.merged_states(spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "k int, name string, at int"), "k", ["at"]).orderBy("run").collect()
    assert [(r["phone"], r["first"], r["last"]) for r in got] == [("a", 0, 1), ("?", 2, 2), ("?", 3, 3), ("7x", 4, 4), ("e", 5, 6), ("a", 7, 7)]
    parts = spark.createDataFrame([(1, i, p) for i, p in enumerate(["ab~", "~cd", "x", "~y", "q~", "~r~", "~s"])], "k int, pos int, part string")
    assert [r["word"] for r in recordings.merged_parts(parts, ["k"]).orderBy("run").collect()] == ["abcd", "x", "~y", "qrs"]


def test_phone_text(spark):
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "zz"), (2, 0, "a"), (3, 0, "a\tb")], "u int, pos int, code string")
    entries = spark.createDataFrame([("a", "A1"), ("b", "B"), ("b", "P")], "code string, phones string")
    got = {r["u"]: (r["phones"], r["valid"]) for r in vocabulary.phone_text(words, entries, ["u"]).collect()}
    assert got == {1: ("A1~(...)~???", False), 2: ("A1", True), 3: ("CRLF", False)}


def test_vocabulary_choice(spark):
    usage = spark.createDataFrame([("aa", 30, ["a"]), ("bb", 20, ["b"]), ("cc", 25, ["c"]), ("dd", 40, ["a"]), ("ee", 9, ["a"]), ("ff", 50, None), ("<s>", 99, ["a"])], "word string, cnt long, phones array<string>")
    dictionary = spark.createDataFrame([("known", "dd")], "word string, code string")
    denied = spark.createDataFrame([("cc",)], "word string")
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "phone string")
    choose = lambda **k: sorted(r["word"] for r in vocabulary.choose(usage, dictionary, denied, train, **k).collect())
    assert choose() == ["aa", "bb", "known"] and choose(most=2) == ["aa", "known"] and choose(min_usage=-1) == ["aa", "bb", "ee", "known"]
