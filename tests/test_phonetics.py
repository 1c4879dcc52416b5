"""Pronunciation rules: known words, and random ones against rules that go a letter after the other."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import phonetics as P

ALL = {*P.VOWELS, *P.IOTATED, "ї"}


def by_letters(word: str | None, stressed: int | None = None, palatal: bool = True) -> list[str] | None:
    """The phones of a word, a letter after the other."""
    if word is None:
        return None
    w = word.lower()
    places = [i for i, c in enumerate(w) if c in ALL]
    accent = places[0] if len(places) == 1 else places[stressed] if stressed is not None and 0 <= stressed < len(places) else -1
    out: list[list] = []  # base, soft (None: open), vowel, stressed

    def soften() -> None:
        if out and not out[-1][2]:
            out[-1][1] = True

    i = 0
    while i < len(w):
        c, step = w[i], 1
        before = w[i - 1] if i else ""
        if c in "- ":
            pass
        elif c == "ї":
            out += [["J", None, False, False], ["I", None, True, i == accent]]
        elif cluster := next((k for k in P.CLUSTERS if w.startswith(k, i)), None):
            out += [[p.rstrip("1"), True if p.endswith("1") else None, False, False] for p in P.CLUSTERS[cluster].split()]
            step = len(cluster)
        elif c == "ь":
            if not out or out[-1][2]:
                return None
            soften()
        elif c == "'":
            if out and not out[-1][2]:
                out[-1][1] = False
        elif c in P.IOTATED:
            if not before or before in "- ь'" or before in ALL:
                out.append(["J", None, False, False])
            else:
                soften()
                if len(out) > 1 and out[-2][0] == out[-1][0]:
                    out[-2][1] = True
            out.append([P.IOTATED[c], None, True, i == accent])
        elif c in P.VOWELS:
            if c == "і":
                soften()
            elif c == "е" and out and not out[-1][2]:
                out[-1][1] = False
            out.append([P.VOWELS[c], None, True, i == accent])
        elif c in P.CONSONANTS:
            after = w[i + 1 :].removeprefix("ь")[:1]
            base = P.CONSONANTS[c]
            out.append([P.VOICED_TO_UNVOICED[base] if c in P.DAMPED and after and after in P.UNVOICED else base, None, False, False])
        else:
            return None
        i += step
    for k in range(len(out) - 2, -1, -1):
        here, there = out[k], out[k + 1]
        if there[1] and here[0] in P.SPREADS and there[0] in P.SPREADS:
            here[1] = True
        if here[0] in P.UNVOICED_TO_VOICED and there[0] in P.VOICED_TO_UNVOICED:
            here[0] = P.UNVOICED_TO_VOICED[here[0]]
    mark = lambda base, soft: base + ("1" if base in P.SOFT else "2" if palatal and base != "J" else "") if soft else base
    return [base + "1" * strong if vowel else mark(base, soft) for base, soft, vowel, strong in out]


KNOWN = [("єврей", "J E V R E J"), ("життя", "ZH Y T1 T1 A"), ("боротьба", "B O R O D1 B A"), ("дзвін", "DZ V2 I1 N"), ("щастя", "SH CH A S1 T1 A"), ("-", ""), ("", ""), ("abc", None), ("ь", None), ("аь", None), (None, None), ("п'ять", "P J A1 T1"), ("Їжак", "J I ZH A K")]


def test_known_words(spark):
    df = spark.createDataFrame(KNOWN, "w string, want string")
    for r in df.select("w", "want", F.array_join(P.g2p(F.col("w")), " ").alias("got")).collect():
        assert r.got == r.want, r.w


def test_stress(spark):
    df = spark.createDataFrame([("мама", 1), ("мама", 0), ("мама", 2), ("мама", -1), ("мама", None), ("сон", None), ("моя", 1), ("її", 1)], "w string, s int")
    got = [" ".join(r[0]) for r in df.select(P.g2p(F.col("w"), F.col("s"))).collect()]
    assert got == ["M A M A1", "M A1 M A", "M A M A", "M A M A", "M A M A", "S O1 N", "M O J A1", "J I J I1"]


@pytest.mark.parametrize("palatal", [True, False])
def test_random_words(spark, palatal):
    rng = random.Random(8)
    parts = [*P.VOWELS, *P.IOTATED, *P.CONSONANTS, *P.CLUSTERS, "ї", "щ", "ь", "ь", "'", "-", " ", "сс", "нн", "тт", "зд", "дьс", "жк"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    words += ["".join(rng.choice(list(P.CONSONANTS)) + rng.choice(["", "ь", *"аеиіоуєюяї"]) for _ in range(5)) for _ in range(2000)] + ["слово.", "x", "б" * 40 + "ь"]
    rows = [(w, rng.choice([None, 0, 1, 2])) for w in words]
    got = spark.createDataFrame(rows, "w string, s int").select("w", "s", P.g2p(F.col("w"), F.col("s"), palatal).alias("p")).collect()
    assert sum(r.p is not None for r in got) > 3000
    for r in got:
        assert r.p == by_letters(r.w, r.s, palatal), (r.w, r.s)


def test_stress_of_a_dictionary(spark):
    words = spark.createDataFrame([("мама",), ("слово",), ("сон",)], "word string")
    got = {r.word: " ".join(r.phones) for r in P.stressed_g2p(words, spark.createDataFrame([("мама", 1), ("мама", 0), ("нема", 0)], "word string, syllable int")).collect()}
    assert got == {"мама": "M A1 M A", "слово": "S L O V O", "сон": "S O1 N"}


def test_syllables_and_places(spark):
    df = spark.createDataFrame([("Їжак", 0), ("Їжак", 2), ("Їжак", 1), ("Їжак", 9), ("Їжак", -1), ("", 0)], "w string, p int")
    assert [r[0] for r in df.select(P.syllable_at(F.col("w"), F.col("p"))).collect()] == [0, 1, -1, -1, -1, -1]
    back = df.where("p = 2").select(P.vowel_at(F.col("w"), F.lit(1)), P.vowel_at(F.col("w"), F.lit(2))).first()
    assert tuple(back) == (2, -1)


def test_no_python_worker(spark):
    assert "Python" not in spark.createDataFrame([("так",)], "w string").select(P.g2p(F.col("w")))._jdf.queryExecution().toString()
