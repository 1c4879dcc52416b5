"""Form matches against loops, messages by case, caches, names, phases; prefixes of Ukrainian forms."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import prefixes, reports

rng = random.Random(9)


def test_forms_by_loops(spark):
    some = lambda: rng.choice([None, "x", "y", "z"])
    forms = [(rng.choice("ab"), some(), some(), some(), f"f{i}") for i in range(40)]
    asked = [(rng.choice(["a", "b", "c", None]), some(), some(), some()) for _ in range(200)]
    got = reports.match_forms(spark.createDataFrame(asked, "lemma string, c string, g string, n string").repartition(3), spark.createDataFrame(forms, "lemma string, c string, g string, n string, form string"), "lemma", ["c", "g", "n"])

    def by_hand(q):
        fit = [f for f in forms if f[0] == q[0] and all(v is None or v == w for v, w in zip(f[1:4], q[1:]))]
        return (*q, len(fit), fit[0][4] if len(fit) == 1 else None)

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(by_hand, asked), key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_numeral_forms(spark):
    """Gender counts only where a form states it: дві for the feminine, двох for all."""
    forms = spark.createDataFrame([("два", "N", "m", "два"), ("два", "N", "f", "дві"), ("два", "G", None, "двох"), ("один", "N", None, "a"), ("один", "N", "m", "b")], "lemma string, case string, gender string, form string")
    asked = spark.createDataFrame([("два", "N", "f"), ("два", "G", "f"), ("два", "G", None), ("один", "N", "m"), ("три", "N", "m")], "lemma string, case string, gender string")
    got = {(r["lemma"], r["case"], r["gender"]): (r["matches"], r["form"]) for r in reports.match_forms(asked, forms, "lemma", ["case", "gender"]).collect()}
    assert got == {("два", "N", "f"): (1, "дві"), ("два", "G", "f"): (1, "двох"), ("два", "G", None): (1, "двох"), ("один", "N", "m"): (2, None), ("три", "N", "m"): (0, None)}


def test_messages(spark):
    d = lambda rows: spark.createDataFrame(rows, "word string, code string")
    known = d([("слова", "слова(1)"), ("слова", "слова(2)"), ("він", "він"), ("both", "both")])
    got = {r.code: r.message for r in reports.code_messages(spark.createDataFrame([("слова",), ("він",), ("both",), ("нема",), ("sil",), ("brk",), (None,)], "code string"), known, d([("both", "both"), ("brk", "brk(1)")]), d([("sil", "sil")])).collect()}
    assert got == {
        "слова": "PronId 'слова' can't be found. Try  слова(1)word слова", "both": "PronId 'both' has occurence in multiple dictionaries", "нема": "PronId 'нема' is not in the phonetic dictionary",
        "brk": "PronId 'brk' can't be found. Try  brk(1)word brk",
    }


def test_suggestions(spark):
    d = spark.createDataFrame([("Слово", "слово"), ("інше", "СЛОВечко"), ("так", "так"), ("слон", "слон"), ("слон", "x")], "word string, code string")
    assert [r.word for r in reports.suggestions(d, "слов").collect()] == ["Слово", "інше"]
    assert [r.word for r in reports.suggestions(d, "", 2).collect()] == ["Слово", "слон"]


def test_cache(spark):
    r = lambda rows: spark.createDataFrame(rows, "path string, actual string, word_dist int")
    cache, results = r([("a", "x", 1), ("a", "y", 0), ("b", "x", 2)]), r([("a", "x", 5), ("a", "z", 0), ("a", "z", 0), ("c", "q", 3), ("b", "w", None)])
    whole, counts = reports.cached(cache, results)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted([("a", "x", 1), ("a", "y", 0), ("b", "x", 2), ("a", "z", 0), ("c", "q", 3), ("b", "w", None)], key=repr)
    assert {tuple(c) for c in counts.collect()} == {("a", 1, 1), ("c", 0, 1), ("b", 0, 1)}
    assert {(x.path, x.actual) for x in reports.new_errors(cache, results).collect()} == {("c", "q"), ("b", "w")}


def test_names_and_paths(spark):
    df = spark.createDataFrame([("C:\\PG\\data\\SpeechAudio\\ncru1-slovo\\22229.WAV", 273, 32), ("C:/PG/data/SpeechAudio/top.x.wav", 123456, 7)], "p string, a long, b long")
    got = [tuple(r.s) for r in df.select(reports.segment_paths(F.col("p"), F.col("a"), F.col("b"), "C:/PG/data/SpeechAudio/", "C:/PG/out/wav", "persian_train").alias("s")).collect()]
    assert got[0] == ("22229_00273-00032", "persian_train/ncru1-slovo/22229_00273-00032", "C:/PG/out/wav/persian_train/ncru1-slovo/22229_00273-00032")
    assert got[1][:2] == ("top.x_123456-00007", "persian_train/top.x_123456-00007")


def test_phases(spark):
    df = spark.createDataFrame([(1, "Train", False), (2, "test", False), (3, "train", True), (4, None, True), (5, "test", True)] + [(i, None, None) for i in range(10, 2010)], "id long, exclude string, broken boolean")
    got = {r.id: r.phase for r in reports.phases(df, F.col("id")).collect()}
    assert [got[i] for i in range(1, 6)] == ["test", "train", "rejected", "train", "train"]
    assert 0.66 < sum(got[i] == "train" for i in range(10, 2010)) / 2000 < 0.74
    swapped = {r.id: r.phase for r in reports.phases(df.repartition(7), F.col("id"), swap=True).collect()}
    assert [swapped[i] for i in range(1, 6)] == [got[i] for i in range(1, 6)] and all(swapped[i] != got[i] for i in range(10, 2010))
    free = {r.id: r.phase for r in reports.phases(df, F.col("id"), broken_in_train=False).collect()}
    assert free[3] == "test"


def test_framed_phones(spark):
    words = spark.createDataFrame([(1, 0, "два"), (1, 1, "слова"), (2, 0, "один"), (2, 1, "ні"), (2, 2, "х")], "u long, pos int, code string")
    entries = spark.createDataFrame([("два", ["D", "V", "A"]), ("слова", ["S"]), ("один", ["O"])], "code string, phones array<string>")
    got = {r.u: (r.phones, r.unknown) for r in reports.framed(words, entries, ["u"]).collect()}
    assert got == {1: (["sil", "D", "V", "A", "sp", "S", "sil"], []), 2: (None, ["ні", "х"])}


def test_letters_and_words_as_text(spark):
    df = spark.createDataFrame([("Їжак ЁжSun Ь",), (None,)], "t string")
    count = lambda those: [r[0] for r in df.select(reports.letters(F.col("t"), those)).collect()]
    assert count(reports.UKRAINIAN_VOWELS) == [2, 0] and count(reports.RUSSIAN_ONLY) == [1, 0] and count(reports.ENGLISH_ONLY) == [3, 0]
    assert count(reports.UKRAINIAN_CAPITALS) == [1, 0] and count(reports.UKRAINIAN_CONSONANTS) == [3, 0]
    assert len(reports.UKRAINIAN_CONSONANTS) == 44 and len(reports.UKRAINIAN_VOWELS) == 20 and len(set(reports.UKRAINIAN_CAPITALS)) == 32
    t = spark.createDataFrame([("TRAIN ", "uk"), ("test", ""), ("x", "pl"), (None, None)], "p string, l string")
    assert [tuple(r) for r in t.select(reports.phase_of(F.col("p")), reports.language_name(F.col("l"))).collect()] == [("train", "Ukrainian"), ("test", "-"), (None, "pl"), (None, "-")]


def test_phase_vocabulary(spark):
    w = lambda *x: spark.createDataFrame([(v,) for v in x], "word string")
    usage = spark.createDataFrame([("a", 9), ("b", 1), ("new", 5), ("gone", 5), ("rare", 1), ("<s>", 99)], "word string, cnt long")
    got = {tuple(r) for r in reports.vocabulary_by_phase(usage, w("a"), w("b", "never"), w("gone"), 5).collect()}
    assert got == {("train", "a", 9), ("test", "a", 9), ("train", "b", 1), ("train", "never", 0), ("train", "new", 5), ("test", "new", 5)}


# ---- prefixes


@pytest.mark.parametrize("a, b, want", [("слово", "слава", "сл"), ("а", "б", ""), ("", "б", ""), ("так", "такий", "так"), ("x", "x", "x")])
def test_common_prefix(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(prefixes.common(F.col("a"), F.col("b"))).first()[0] == want


def test_prefix_tree(spark):
    got = {r.prefix: (r.n, r.whole, r.branches) for r in prefixes.prefix_tree(spark.createDataFrame([("кіт",), ("кіт",), ("кіш",), ("кішка",), ("",)], "word string"), 2).collect()}
    assert got == {"к": (3, False, 1), "кі": (3, False, 2), "кіш": (2, True, 1)}


def test_stems_of_forms(spark):
    forms = spark.createDataFrame([("книга", "noun", "книга"), ("книга", "noun", "книги,*книжки"), ("книга", "noun", "книзі"), ("книга", "noun", "-"), ("день", "noun", "день"), ("день", "noun", "дня"), ("йти", "verb", "йду")], "name string, class string, form string")
    each = prefixes.forms(forms)
    assert sorted(r.form for r in each.where("name = 'книга'").collect()) == ["книга", "книги", "книжки", "книзі"]
    suffixes = spark.createDataFrame([("noun", "а"), ("noun", "и"), ("noun", "ки"), ("noun", "ь"), (None, "я"), ("verb", "у"), ("verb", "и")], "class string, suffix string")
    split = prefixes.split_forms(each, suffixes)
    got = {r.form: (r.stem, r.suffix) for r in split.collect()}
    assert got == {"книга": ("книг", "а"), "книги": ("книг", "и"), "книжки": ("книж", "ки"), "книзі": ("книзі", None), "день": ("день", None), "дня": ("дн", "я"), "йду": ("йд", "у")}
    assert {tuple(r) for r in prefixes.suffix_usage(split).collect()} == {("noun", "а", 1), ("noun", "и", 1), ("noun", "ки", 1), ("noun", "я", 1), ("verb", "у", 1)}
    s = spark.createDataFrame([("g", "f", "буркоче", None), ("g", "f", "буркочу", None), ("g", "f", "буркот", None), ("g", "f", "бурі", None), ("g", "f", "бурю", None), ("g", "f", "бур", None), ("h", "f", "ая", None), ("h", "f", "аю", None), ("h", "f", "о", None)], "name string, class string, form string, x string")
    merged = prefixes.stems(s.select("name", F.col("form").alias("stem")))
    assert {tuple(r) for r in merged.collect()} == {("g", "буркоч", 2), ("g", "буркот", 1), ("g", "бур", 3), ("h", "а", 2), ("h", "о", 1)}
    assert {tuple(r) for r in prefixes.different_stems(merged).collect()} == {("g", 2), ("h", 2)}
