"""Text expressions: tokenizer classes, word classes, transliteration, small parsers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of each token class, as the bodies of regular-expression classes.
STOP = r".?!…"
PUNCT = r"_\"#$%&+/:;<=>@\\^\[\](){},‚§©«»“”„‟–—*•№\x{F009}¬\-'’`"
SPACE = r"\t\r\n \x{00A0}"


def _others(marks: str) -> str:
    """A class of the characters that a body lacks: positive, those of Latin-1 as a set that is asked first. A negated class asks each of its rarer marks about each letter, which takes six times as long."""
    mark = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), marks) + "]")
    found = [c for c in range(0x10000) if mark.match(chr(c))]
    near = "".join(f"\\x{{{c:X}}}" for c in range(256) if c not in found)
    ends = [255, *(c for c in found if c > 255), 0x110000]
    return f"[[{near}]" + "".join(f"\\x{{{a + 1:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(ends, ends[1:]) if b - a > 1) + "]"


#: The class of the characters that are in none of these classes and no digits either.
LETTER = _others(f"{STOP}{PUNCT}{SPACE}0-9")
TOKEN = rf"{LETTER}+|[{SPACE}]+|[0-9]+|[{STOP}]|[{PUNCT}]"
# Letters.
UK_VOWELS = "аеєиіїоуюя"
UK_CONSONANTS = "бвгґджзйклмнпрстфхцчшщ"
RU_LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# Abbreviations after which a stop ends no sentence.
ABBREVIATIONS = """англ г га год гр грец грн д див дж дол е зв км коп крб л лат мал мед мл млн н напр нім оп п пер перен р ред рис розд розм рос рр руб с св см ст
т тис укр фр хв ч шт ім ін іст""".split()
#: A character of no text, put after each sentence.
END = "\uFDD0"


def tokens(text: Column) -> Column:
    """All tokens of a text, in order; together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def run_type(token: Column) -> Column:
    """stop, punct, space, digit or alpha: a token's first character tells."""
    is_in = lambda body: token.rlike(f"^[{body}]")
    first = F.substring(token, 1, 1)  # the most frequent ones are told by a comparison
    plain = F.when(first.between("a", "z") | first.between("A", "Z"), "alpha").when(first == " ", "space").when(first.between("0", "9"), "digit")
    return plain.when(token.rlike(f"^{LETTER}"), "alpha").when(is_in(STOP), "stop").when(is_in(PUNCT), "punct").when(is_in(SPACE), "space").otherwise("alpha")


def skeleton(text: Column) -> tuple[Column, Column, Column]:
    """A text with each run of letters as ``a``; then also each run of blanks as one; then also each run of digits as ``0``, which leaves a character a token."""
    letters = F.regexp_replace(text, f"{LETTER}+", "a")
    blanks = F.regexp_replace(letters, f"[{SPACE}]+", " ")
    return letters, blanks, F.regexp_replace(blanks, "[0-9]+", "0")


def n_of(text: Column, characters: str) -> Column:
    """How many of a text's characters are among some."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def sentences(text: Column, abbreviations: list[str] = ABBREVIATIONS) -> Column:
    """A text cut after each run of stops that ends a sentence, in order: after the text's start or a token of two characters or more that is no
    abbreviation. (Further stops of such a run stay with it.) What follows the last end comes last, often empty."""
    long = f"{LETTER}{{2}}|[0-9]{{2}}|[{SPACE}]{{2}}"
    short = "|".join(a for a in abbreviations if len(a) > 1)
    ends = f"[{STOP}](?<=(?:^|{long})[{STOP}])" + (f"(?<!(?<!{LETTER})(?iu:{short})[{STOP}])" if short else "") + f"[{STOP}]*"  # a stop comes first, so that nothing else is looked at elsewhere
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(END), F.lit("\uFDD1")), ends, "$0" + END)
    return F.split(marked, END)


def words(sentence: Column) -> Column:
    """The tokens of a sentence that are neither stops, signs, blanks nor numbers."""
    return F.regexp_extract_all(sentence, F.lit(f"{LETTER}+"), F.lit(0))


def word_class(token: Column) -> Column:
    """arabic, roman (i, v, x alone), english, russian, ukrainian, other: by the letters that a token has."""
    low = F.lower(token)
    out = F.when(token.rlike("^[0-9]+$"), "arabic").when(token.rlike("^[IVXivx]+$"), "roman").when(low.rlike("[a-z]"), "english").when(low.rlike("[ёъыэ]"), "russian")
    return out.when(low.rlike(f"^[{UK_VOWELS}{UK_CONSONANTS}ь'’-]+$"), "ukrainian").otherwise("other")


def vowel_count(word: Column) -> Column:
    return F.regexp_count(F.lower(word), F.lit(f"[{UK_VOWELS}]"))


# Transliteration, a letter and what stands for it.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "y", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "ju", "я": "ja",
    "є": "e", "і": "i", "ї": "ji", "ґ": "g",
}


def transliterate(text: Column) -> Column:
    """Latin letters for Ukrainian and Russian ones; signs are dropped, anything else beyond ASCII is an underscore."""
    pairs = [*LATIN.items(), *((k.upper(), v.upper()) for k, v in LATIN.items())]
    out = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [p for p in pairs if len(p[1]) > 1], text)
    one = F.translate(out, "".join(k for k, v in pairs if len(v) == 1) + "ЪъЬь", "".join(v for _, v in pairs if len(v) == 1))
    return F.regexp_replace(one, r"[^\x00-\x7F]", "_")


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")


def utterance_words(text: Column) -> Column:
    """Pronunciation codes of an utterance: one leading # goes, {w:x,s:2} becomes x(2), empty parts go."""
    parts = F.filter(F.split(F.regexp_replace(text, "^#", ""), " "), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^\{w:([^,}]*),s:([0-9]+)\}$", r"$1($2)"))


def code_word(code: Column) -> Column:
    return F.regexp_replace(code, r"\([0-9]+\)$", "")


def code_stress(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"\(([0-9]+)\)$", 1), F.lit("")).cast("int")


def roman_value(token: Column) -> Column:
    """I to XXI in capitals; -1 for anything else."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    table = [t + o for t in ("", "X", "XX") for o in ones][1:22]
    at = F.array_position(F.array(*map(F.lit, table)), token)
    return F.when(at > 0, at.cast("int")).otherwise(-1)


def mangled(code: Column) -> Column:
    """A pronunciation code without brackets: w(2) becomes w2."""
    return F.translate(code, "()", "")


def unified(text: Column) -> Column:
    """Dashes as hyphens; words split by an optional hyphen and words with an apostrophe inside as one token's worth of characters."""
    one = F.regexp_replace(F.replace(text, F.lit("—"), F.lit("-")), f"¬(?:(?<={LETTER}¬)(?={LETTER})|(?<=[0-9]¬)(?=[0-9]))", "")
    return F.regexp_replace(one, f"[’`](?<={LETTER}.)(?={LETTER})", "'")
