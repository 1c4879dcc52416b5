"""Grapheme to phoneme for Ukrainian as column expressions: rules over letters, then softness and voice of neighbouring phones.

Phones are written as a base, then ``1`` for soft or stressed, ``2`` for palatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and their phones; classes of phones; clusters and what they become (a 1 marks a soft phone).
VOWELS = {"а": "A", "е": "E", "и": "Y", "і": "I", "о": "O", "у": "U"}
IOTATED = {"є": "E", "ю": "U", "я": "A"}
CONSONANTS = {"б": "B", "в": "V", "г": "H", "ґ": "G", "д": "D", "ж": "ZH", "з": "Z", "й": "J", "к": "K", "л": "L", "м": "M", "н": "N", "п": "P", "р": "R", "с": "S", "т": "T", "ф": "F", "х": "KH", "ц": "TS", "ч": "CH", "ш": "SH"}
CLUSTERS = {"нтськ": "N S1 K", "стськ": "S1 K", "нтст": "N S T", "здж": "ZH DZH", "стд": "Z D", "стс": "S S", "стц": "S TS", "тьс": "TS1", "дз": "DZ", "дж": "DZH", "зж": "ZH ZH", "сш": "SH SH", "тс": "TS", "тц": "TS TS", "тч": "CH CH", "щ": "SH CH"}
SOFT = set("D DZ Z L N R S T TS".split())
SPREADS = set("D DZ T TS Z S N L".split())
VOICED_TO_UNVOICED = dict(B="P", H="KH", G="K", D="T", DZ="TS", DZH="CH", Z="S", ZH="SH")
UNVOICED_TO_VOICED = {u: v for v, u in VOICED_TO_UNVOICED.items()}
DAMPED, UNVOICED = set("бгджз"), set("пхктцчсшфщ")
FILLERS = ["<sil>", "<s>", "</s>", "[sp]", "_s", "[inh]", "[exh]", "[eee]", "[yyy]", "_ignore"]

ALL_VOWELS = "".join([*VOWELS, *IOTATED, "ї"])

#: Within the rules a phone is one letter: a vowel a small one, a consonant a capital one.
_VOWEL = {"A": "a", "E": "e", "Y": "y", "I": "i", "O": "o", "U": "u"}
_CONSONANT = {c: c for c in "BVHGDZJKLMNPRSTF"} | {"ZH": "W", "KH": "Q", "TS": "C", "CH": "X", "SH": "Y", "DZ": "E", "DZH": "U"}


def _letters_of(phones: str) -> str:
    """The phones of a cluster as letters, soft ones with a tilde."""
    return "".join(_CONSONANT[p.rstrip("1")] + "~" * p.endswith("1") for p in phones.split())


def _any(phones) -> str:
    return "[" + "".join(_CONSONANT[p] for p in phones) + "]"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def spelled(word: Column) -> Column:
    """The letters of a word, small, as phones and what they do to the phone before: ``~`` softens it, ``^`` keeps it hard, ``+`` softens it and an equal one before it. ``!`` after a letter is kept."""
    # a vowel letter with a J in it has it at a word's or part's start, after vowels, soft signs and apostrophes; elsewhere it softens
    w = F.regexp_replace(word, f"(?<![^- ь'!{ALL_VOWELS}])([{''.join(IOTATED)}])", "J$1")
    w = F.regexp_replace(w, f"(?<!J)([{''.join(IOTATED)}])", "+$1")
    # voiced letters before unvoiced ones, soft or not, are unvoiced; a star marks them
    w = F.regexp_replace(w, f"([{''.join(sorted(DAMPED))}])(?=ь?[{''.join(sorted(UNVOICED))}])", "$1*")
    pieces = F.regexp_extract_all(w, F.lit("|".join([*CLUSTERS, f"[{''.join(sorted(DAMPED))}][*]", "."])), F.lit(0))
    of = {k: _letters_of(v) for k, v in CLUSTERS.items()} | {f"{c}*": _CONSONANT[VOICED_TO_UNVOICED[CONSONANTS[c]]] for c in sorted(DAMPED)} | {c: _CONSONANT[p] for c, p in CONSONANTS.items()}
    of |= {c: _VOWEL[p] for c, p in (VOWELS | IOTATED).items()} | {"і": "~i", "е": "^e", "ї": "Ji", "ь": "~", "'": "^", "J": "J", "+": "+", "!": "!"}
    table = _lookup(of)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), F.lit(""))), "")


def settled(letters: Column) -> Column:
    """Consonants with a tilde where they are soft: the last mark after a consonant counts, marks after vowels don't, and an equal consonant before one that a vowel softened is soft too."""
    s = F.regexp_replace(letters, "(?<![A-Z~^+])[~^+]+", "")
    s = F.regexp_replace(s, "[~^+]*([~^+])", "$1")
    return F.translate(F.regexp_replace(s, r"([A-Z])[~^]?(?=\1[+])", "$1~"), "+^", "~")


def assimilated(letters: Column) -> Column:
    """Consonants that soften before soft ones of their class, and unvoiced ones that are voiced before voiced ones, through all of a row of them."""
    soft = _any(sorted(SPREADS))
    s = F.regexp_replace(letters, f"({soft})~?(?=(?:{soft}~?)*{soft}~)", "$1~")
    unvoiced = _any(UNVOICED_TO_VOICED)
    s = F.regexp_replace(s, f"({unvoiced})(?=~?(?:{unvoiced}~?)*{_any(VOICED_TO_UNVOICED)})", "$1*")
    for u, v in UNVOICED_TO_VOICED.items():
        s = F.replace(s, F.lit(_CONSONANT[u] + "*"), F.lit(_CONSONANT[v]))
    return s


def named(letters: Column, palatal: bool = True) -> Column:
    """array<string> of phones by name."""
    names = {c: p for p, c in _CONSONANT.items()} | {c + "~": p + ("1" if p in SOFT else "2" if palatal and p != "J" else "") for p, c in _CONSONANT.items()}
    names |= {c: p for p, c in _VOWEL.items()} | {c + "!": p + "1" for p, c in _VOWEL.items()}
    table = _lookup(names)
    return F.transform(F.regexp_extract_all(letters, F.lit("[A-Z]~?|[a-z]!?"), F.lit(0)), lambda p: F.element_at(table, p))


def g2p(word: Column, stressed: Column | None = None, palatal: bool = True) -> Column:
    """array<string> of phones: letters to phones by the clusters and letters that a word is cut into, then softness and voice of neighbours, all as expressions. ``stressed`` is the syllable (from 0), which a word of
    one syllable doesn't need. Null for a null word, one with an unknown letter, or with a soft sign that follows no consonant."""
    w = F.lower(word)
    known = "".join([*VOWELS, *IOTATED, *CONSONANTS])
    good = w.rlike(f"^[{known}щїь' -]*$") & ~w.rlike(f"(^|[{ALL_VOWELS}])[- ']*ь")
    syllables = F.regexp_count(w, F.lit(f"[{ALL_VOWELS}]"))
    at = F.when(syllables == 1, F.lit(0)).otherwise(F.lit(None) if stressed is None else stressed.cast("int"))
    place = F.when(at.isNull() | (at < 0), -1).otherwise(vowel_at(w, at))
    marked = F.when(place >= 0, F.concat(F.substring(w, F.lit(1), place + 1), F.lit("!"), F.substring(w, place + 2, F.length(w)))).otherwise(w)
    return F.when(good, named(assimilated(settled(spelled(marked))), palatal))


def differing(entries: DataFrame) -> DataFrame:
    """word, phones, rule: the entries (word, phones as text) whose phones are not those that the rules give for the word. Rules run once for each distinct word; words without phones by rule are left out."""
    by_rule = entries.select("word").distinct().withColumn("rule", F.array_join(g2p(F.col("word")), " "))
    wrong = F.coalesce(F.col("phones") != F.col("rule"), F.lit(False))  # a plain comparison would send its null checks, and the rules with them, down to every occurrence of a word
    return entries.join(by_rule, "word").where(wrong).select("word", "phones", "rule")


def strip_modifiers(phone_list: Column) -> Column:
    """Phones without softness and stress."""
    return F.transform(phone_list, lambda p: F.regexp_replace(p, "[0-9]+$", ""))


def vowel_at(word: Column, syllable: Column) -> Column:
    """The place (from 0) of the vowel of a syllable (from 0), -1 if there's none."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.lower(F.substring(word, i, F.lit(1))).rlike("^[аеєиіїоуюя]$"))
    return F.coalesce(F.get(at, syllable.cast("int")) - 1, F.lit(-1))


def syllable_at(word: Column, place: Column) -> Column:
    """The syllable (from 0) whose vowel stands at a place (from 0), -1 if there is no vowel."""
    before = F.regexp_count(F.lower(F.substring(word, F.lit(1), place.cast("int"))), F.lit(f"[{ALL_VOWELS}]"))
    own = F.lower(F.substring(word, place.cast("int") + 1, F.lit(1))).rlike(f"^[{ALL_VOWELS}]$") & (place >= 0)
    return F.when(F.coalesce(own, F.lit(False)), before).otherwise(-1)


def stressed_g2p(words: DataFrame, stresses: DataFrame) -> DataFrame:
    """word, phones of words (word) with the stress that a dictionary (word, syllable from 0; of several the first) gives; words that it lacks have none, if they have more than one syllable."""
    one = stresses.groupBy("word").agg(F.min("syllable").alias("syllable"))
    return words.join(one, "word", "left").select("word", g2p(F.col("word"), F.col("syllable")).alias("phones"))


def suffix_split(words: DataFrame, suffixes: DataFrame, longest: int = 6) -> DataFrame:
    """word, stem, suffix: the longest known suffix that leaves two letters or more and doesn't start with ь or '; suffix null if none fits.
    An equality join of a word's few endings with the suffixes (word parts), no comparison of each with each."""
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")).where(F.length("word") - F.col("k") >= 2)
    ends = ends.select("word", F.expr("right(word, k)").alias("suffix"), "k").where(~F.col("suffix").rlike("^[ь']"))
    best = ends.join(suffixes.select("suffix").distinct(), "suffix").groupBy("word").agg(F.max_by("suffix", "k").alias("suffix"))
    return words.join(best, "word", "left").select("word", F.expr("left(word, length(word) - coalesce(length(suffix), 0))").alias("stem"), "suffix")


#: Vowels by number, from 0.
NUMBERED = "aeyiou"


def phone_number(name):
    """0 to 5 of a vowel's name, -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, NUMBERED)), name).cast("int") - 1, F.lit(-1))


def phone_name(number):
    """A vowel's name, ? for a number that has none."""
    return F.when((number >= 0) & (number < len(NUMBERED)), F.element_at(F.array(*map(F.lit, NUMBERED)), F.greatest(number, F.lit(0)).cast("int") % len(NUMBERED) + 1)).otherwise("?")
