"""Ukrainian number words: an integer with case, gender and kind (cardinal, ordinal) as declined words.

Forms follow from stems and endings, so that the tables stay small. Numbers of
0 to 10**18 - 1 have words; others, and forms that need a gender that isn't
given, are null. Spark calls it on distinct (number, form) rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASES = "NGDAILV"
# Forms by case (nominative, genitive, dative, accusative, instrumental, locative, vocative).
ONE = {
    "m": "один одного одному один одним одному один",
    "f": "одна одної одній одну однією одній одна",
    "neut": "одне одного одному одне одним одному одне",
    "pl": "одні одних одним одні одними одних одні",
}
ZERO = {"sing": "нуль нуля нулю нуль нулем нулі нулю", "pl": "нулі нулів нулям нулі нулями нулях нулі"}
LOW = {
    2: "два двох двом два двома двох два",
    3: "три трьох трьом три трьома трьох три",
    4: "чотири чотирьох чотирьом чотири чотирма чотирьох чотири",
    7: "сім семи семи сім сьома семи сім",
    8: "вісім восьми восьми вісім вісьмома восьми вісім",
    6: "шість шести шести шість шістьма шести шість",
    40: "сорок сорока сорока сорок сорока сорока сорок",
    90: "дев'яносто дев'яноста дев'яноста дев'яносто дев'яноста дев'яноста дев'яносто",
    100: "сто ста ста сто ста ста сто",
    200: "двісті двохсот двомстам двісті двомастами двохстах двісті",
    300: "триста трьохсот трьомстам триста трьомастами трьохстах триста",
    400: "чотириста чотирьохсот чотирьомстам чотириста чотирмастами чотирьохстах чотириста",
    500: "п'ятсот п'ятисот п'ятистам п'ятсот п'ятьмастами п'ятистах п'ятсот",
    600: "шістсот шестисот шестистам шістсот шістьмастами шестистах шістсот",
    700: "сімсот семисот семистам сімсот сьомастами семистах сімсот",
    800: "вісімсот восьмисот восьмистам вісімсот вісьмомастами восьмистах вісімсот",
    900: "дев'ятсот дев'ятисот дев'ятистам дев'ятсот дев'ятьмастами дев'ятистах дев'ятсот",
}
# Regular numerals: the stem before -ь (or nothing for the tens of 50 to 80).
STEMS = {5: "п'ят", 9: "дев'ят", 10: "десят", 11: "одинадцят", 12: "дванадцят", 13: "тринадцят", 14: "чотирнадцят", 15: "п'ятнадцят", 16: "шістнадцят", 17: "сімнадцят", 18: "вісімнадцят", 19: "дев'ятнадцят", 20: "двадцят", 30: "тридцят", 50: "п'ятдесят", 60: "шістдесят", 70: "сімдесят", 80: "вісімдесят"}
# Stems of ordinals other than the regular ones.
ORDINAL = {0: "нульов", 1: "перш", 2: "друг", 3: "трет", 4: "четверт", 6: "шост", 7: "сьом", 8: "восьм", 40: "сороков", 90: "дев'яност", 100: "сот"}
HARD = {"m": "ий ого ому ий им ому ий", "f": "а ої ій у ою ій а", "neut": "е ого ому е им ому е", "pl": "і их им і ими их і"}
SOFT = {"m": "ій ього ьому ій ім ьому ій", "f": "я ьої ій ю ьою ій я", "neut": "є ього ьому є ім ьому є", "pl": "і іх ім і іми іх і"}
# Endings of the names of powers of a thousand.
FEMININE = {"sing": "а і і у ею і е", "pl": "і - ам і ами ах і"}
MASCULINE = {"sing": "- а у - ом і е", "pl": "и ів ам и ами ах и"}
POWERS = ["", "тисяч", "мільйон", "мільярд", "трильйон", "квадрильйон"]


def _pick(forms: str, case: str) -> str:
    return forms.split()[CASES.index(case)].replace("-", "")


def cardinal(n: int, case: str, gender: str | None) -> str:
    """One base number; ``gender`` of m, f, neut, pl."""
    if n == 1:
        return _pick(ONE[gender], case)
    if n == 2 and case in "NAV" and gender is None:
        raise KeyError("gender")
    if n == 2 and case in "NAV" and gender == "f":
        return "дві"
    if n in LOW:
        return _pick(LOW[n], case)
    ends = ("" if 50 <= n <= 80 else "ь") + " и и " + ("" if 50 <= n <= 80 else "ь") + " ьма и " + ("" if 50 <= n <= 80 else "ь")
    return STEMS[n] + ends.split(" ")[CASES.index(case)]


def ordinal(n: int, case: str, gender: str) -> str:
    stem = ORDINAL.get(n) or STEMS.get(n) or _pick(LOW[n], "G")
    return stem + _pick((SOFT if n == 3 else HARD)[gender], case)


def base_numbers(group: int) -> list[int]:
    """A group of three digits as base numbers: hundreds, tens, units, with 1 to 19 whole."""
    rest = group % 100
    parts = [group - rest, *([rest] if rest < 20 else [rest - rest % 10, rest % 10])]
    return [p for p in parts if p]


def power_name(power: int, last: int, case: str) -> str:
    ends = FEMININE if power == 1 else MASCULINE
    if last == 1:
        return POWERS[power] + _pick(ends["sing"], case)
    return POWERS[power] + _pick(ends["pl"], "G" if last >= 5 and case in "NAV" else case)


def words(n: int | None, kind: str = "card", case: str = "N", number: str | None = None, gender: str | None = None) -> str | None:
    """The words of ``n``, or None if there are none. ``number`` pl stands for the plural."""
    if n is None or not 0 <= n < 10**18 or case not in CASES:
        return None
    form = "pl" if number == "pl" else gender
    try:
        if n == 0:
            return ordinal(0, case, form) if kind == "ord" else _pick(ZERO["pl" if number == "pl" else "sing"], case)
        groups = [(p, n // 1000**p % 1000) for p in range(5, -1, -1)]
        groups = [(p, base_numbers(g)) for p, g in groups if g]
        out: list[str] = []
        for power, parts in groups:
            final = power == groups[-1][0]
            if kind == "ord" and final and power:  # one word: genitive parts, then the power as an ordinal
                joined = "".join("одно" if p == 1 else cardinal(p, "G", "m") for p in parts)
                out.append(joined + POWERS[power] + "н" + _pick(HARD[form], case))
                continue
            here = "N" if kind == "ord" else case
            shape = ("f" if power == 1 else "m") if power else form
            rest = parts[:-1] if kind == "ord" and final else parts
            out += [cardinal(p, here, shape) for p in rest]
            if kind == "ord" and final:
                out.append(ordinal(parts[-1], case, form))
            elif power:
                out.append(power_name(power, parts[-1], here))
        return " ".join(out)
    except KeyError:
        return None


def number_words(n: Column, kind: str = "card", case: str = "N", gender: str | None = "m") -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if pd.isna(x) else words(int(x), kind, case, None, gender)).astype(object), "string")(n)


def spelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, words, times: the numbers of up to 18 digits in each text. Words are made once for each distinct number."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[0-9]+"), F.lit(0))).alias("d"))
    counted = found.where(F.length("d") <= 18).groupBy("doc_id", F.col("d").cast("long").alias("n")).agg(F.count("*").alias("times"))
    made = counted.select("n").distinct().withColumn("words", number_words(F.col("n")))
    return counted.join(made, "n").select("doc_id", "n", "words", "times")
