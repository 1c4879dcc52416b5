"""Secret scans with DataFrame functions alone.

Three patterns give the base spans. Beside them, every run of 20 or more
characters of ``[A-Za-z0-9+/_=-]`` outside base spans is a candidate: its
encoding is inferred, and three statistics of its symbols over that encoding's alphabet are taken:

* chi-squared uniformity (the sum of squared counts),
* runs: of classes (lower case, upper case, digits, signs) in an encoding of several, else about the alphabet's middle,
* lag-one serial correlation of the symbols' places.

Each is used twice. A candidate that a two-sided test against "random" rejects (``|z|`` over ``z_max``) is none. Each also gives
a one-sided p-value of "ordinary", an upper bound: words whose symbols have the shares of ordinary text (``LETTER_SHARES``,
``CLASS_SHARES``), that change class at a rate of ``class_change``, and whose places have a serial correlation of ``persistence`` where
classes mix. Uniformity takes the exact mean and variance of the sum of squares for these shares, runs take Chernoff's bound. Runs and serial correlation
both look at the order of the symbols, so twice the lesser one counts (Bonferroni); uniformity looks at their counts alone, and Fisher's rule
joins the two. So random keys of upper and lower case and digits are found from some 32 characters on, of one case and digits mostly from 64 on,
and random letters of one case from about 200 on: shorter ones are too much like words. Within each class of
lengths, Benjamini and Hochberg's step-up rule over all candidates of the corpus
(kept as counts by p in steps of a tenth of a decade) holds the share of false
discoveries at ``q``; discoveries are spans of kind ``random``.

One pass over the texts writes base spans and the few candidates to the shared
folder; thresholds (four rows) come from a small aggregate; nothing is shuffled by document.

Edge cases: null and empty texts have no spans (counts 0, digest of the empty
string); repeated rows are scanned each on its own; equal p-values fall together; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named

#: The patterns of the base spans, and the least length of group or match.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the narrowest first: a pattern that the whole candidate matches, and the alphabet.
ENCODINGS = [
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+=*$", UPPER + DIGITS[2:8]),
    (r"^[a-z0-9]+$", DIGITS + LOWER),
    (r"^[A-Z0-9]+$", DIGITS + UPPER),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
]
LENGTH_CLASSES = [(0, 32), (1, 48), (2, 64), (3, 128)]  # class, first length beyond it; 4: the rest
RANDOM_RANK = 3
#: Shares of letters in ordinary text, per thousand, from a to z, and of digits from 0 to 9.
LETTER_SHARES = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
DIGIT_SHARES = [180, 200, 140, 100, 80, 80, 60, 60, 50, 50]
#: Shares of lower case, upper case, digits and signs in ordinary words that mix them.
CLASS_SHARES = {"a": 0.8, "A": 0.08, "0": 0.08, "+": 0.04}


def ordinary(alphabet: str) -> dict[str, float]:
    """Of ordinary symbols of an alphabet: the sums of the squares and cubes of their shares, the chance of a change about the alphabet's middle, and whether classes mix."""
    kind = lambda c: "a" if c in LOWER else "A" if c in UPPER else "0" if c in DIGITS else "+"
    shares_of = dict(zip(LOWER, LETTER_SHARES)) | dict(zip(UPPER, LETTER_SHARES)) | dict(zip(DIGITS, DIGIT_SHARES))
    within = [shares_of.get(c, 1) for c in alphabet]
    by_class = {k: sum(w for w, c in zip(within, alphabet) if kind(c) == k) for k in set(map(kind, alphabet))}
    shares = [w / by_class[kind(c)] * CLASS_SHARES[kind(c)] for w, c in zip(within, alphabet)]
    whole = sum(shares)
    shares = [x / whole for x in shares]
    high = sum(shares[len(alphabet) // 2 :])
    return {"p2": sum(x**2 for x in shares), "p3": sum(x**3 for x in shares), "change": 2 * high * (1 - high), "mixed": len(by_class) > 1}


def _when(branches: list[tuple[Column, Column]], rest: Column) -> Column:
    return reduce(lambda out, b: F.when(b[0], b[1]).otherwise(out), reversed(branches), rest)


def _spans(found: Column, pieces: Column, tests: Column, rank: int, least: int) -> Column:
    """array<struct<start, rank, end, text>> of the matches whose tested part is long enough; ends are exclusive, places are code points."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,text:string>>")
    zipped = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(F.length(F.element_at(pieces, i)).alias("gap"), F.element_at(found, i).alias("m"), F.element_at(tests, i).alias("t")))
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.when(F.length(x["t"]) >= least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) == 0, none).otherwise(walked)


def _with(found: Column, keep: str, **more) -> Column:
    """An array of structs with the fields ``keep`` (names with blanks between) and new ones, each a function of the struct, so that it is worked out once."""
    return F.transform(found, lambda c: F.struct(*[c[x].alias(x) for x in keep.split()], *[f(c).alias(name) for name, f in more.items()]))


def _tested(found: Column, z_max: float, class_change: float, persistence: float) -> Column:
    """Candidates with their class of lengths and their bucket: tenths of -log10 of the p-value of "ordinary", 0 if a test of the battery rejects randomness."""
    alphabets = [a for _, a in ENCODINGS] + [UPPER + LOWER + DIGITS + "+/-_="]
    facts = [ordinary(a) for a in alphabets]
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), c["e"])
    total = lambda x, of=lambda v: v: F.aggregate(x, F.lit(0.0), lambda a, v: a + of(v))
    place = "start rank end text"
    out = _with(found, place, body=lambda c: F.rtrim(F.translate(c["text"], "=", " ")), e=lambda c: _when([(c["text"].rlike(p), F.lit(i + 1)) for i, (p, _) in enumerate(ENCODINGS)], F.lit(len(alphabets))))
    out = _with(
        out, place + " body e", n=lambda c: F.length(c["body"]).cast("double"), chars=lambda c: F.filter(F.split(c["body"], ""), lambda x: x != ""), alphabet=lambda c: pick(c, alphabets), k=lambda c: pick(c, [float(len(a)) for a in alphabets]),
        p2=lambda c: pick(c, [f["p2"] for f in facts]), p3=lambda c: pick(c, [f["p3"] for f in facts]), mixed=lambda c: pick(c, [f["mixed"] for f in facts]), change=lambda c: pick(c, [class_change if f["mixed"] else f["change"] for f in facts]),
    )
    out = _with(
        out, place + " body n k p2 p3 mixed change", x=lambda c: F.transform(c["chars"], lambda v: F.call_function("instr", c["alphabet"], v).cast("double")),
        squares=lambda c: total(F.array_distinct(c["chars"]), lambda v: F.pow(c["n"] - F.length(F.call_function("replace", c["body"], v, F.lit(""))), F.lit(2.0))),
    )
    out = _with(
        out, place + " body n k p2 p3 mixed change squares x", n1=lambda c: total(c["x"], lambda v: (v > c["k"] / 2).cast("double")), mean=lambda c: total(c["x"]) / c["n"],
        pairs=lambda c: F.arrays_zip(F.slice(c["x"], 1, F.size(c["x"]) - 1).alias("a"), F.slice(c["x"], 2, F.size(c["x"]) - 1).alias("b")),
    )
    out = _with(
        out, place + " body n k p2 p3 mixed change squares n1", n2=lambda c: c["n"] - c["n1"], runs=lambda c: 1 + total(c["pairs"], lambda v: ((v["a"] > c["k"] / 2) != (v["b"] > c["k"] / 2)).cast("double")),
        power=lambda c: total(c["x"], lambda v: (v - c["mean"]) * (v - c["mean"])), joint=lambda c: total(c["pairs"], lambda v: (v["a"] - c["mean"]) * (v["b"] - c["mean"])),
    )
    product = lambda c: 2 * c["n1"] * c["n2"]
    kinds = lambda c: F.translate(c["body"], LOWER + UPPER + DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "++++")
    out = _with(
        out, place + " n k p2 p3 mixed change squares n1 n2 runs power", spread=lambda c: product(c) * (product(c) - c["n"]) / (c["n"] * c["n"] * (c["n"] - 1)), serial=lambda c: F.when(c["power"] > 0, c["joint"] / c["power"]),
        changes=lambda c: F.when(c["mixed"], F.length(F.regexp_replace(kinds(c), r"(.)\1*", ".")).cast("double")).otherwise(c["runs"]) - 1,
    )
    n = lambda c: c["n"]
    # standardised against "random", against "ordinary", and the rate of changes
    out = _with(
        out, place + " n change", z_chi=lambda c: (c["k"] / n(c) * c["squares"] - n(c) - (c["k"] - 1)) / F.sqrt(2 * (c["k"] - 1) * (n(c) - 1) / n(c)),
        z_runs=lambda c: F.when(c["spread"] > 0, (c["runs"] - (product(c) / n(c) + 1)) / F.sqrt(c["spread"])).otherwise(F.lit(99.0)), z_serial=lambda c: F.coalesce((c["serial"] + 1 / n(c)) * F.sqrt(n(c)), F.lit(99.0)),
        chi=lambda c: (n(c) + n(c) * (n(c) - 1) * c["p2"] - c["squares"]) / F.sqrt(2 * n(c) * (n(c) - 1) * (c["p2"] - c["p2"] * c["p2"]) + 4 * n(c) * (n(c) - 1) * (n(c) - 2) * (c["p3"] - c["p2"] * c["p2"])),
        low=lambda c: F.coalesce((F.when(c["mixed"], F.lit(persistence)).otherwise(F.lit(0.0)) - c["serial"]) * F.sqrt(n(c)), F.lit(0.0)), rate=lambda c: F.least(F.lit(1 - 1e-9), c["changes"] / (n(c) - 1)),
    )
    normal = lambda z: F.when(z > 0, F.lit(0.30103) + z * z * 0.21714724).otherwise(F.lit(0.0))  # noqa: E731  a bound of the upper tail
    chernoff = lambda c: (n(c) - 1) * (c["rate"] * F.log10(F.greatest(c["rate"], F.lit(1e-12)) / c["change"]) + (1 - c["rate"]) * F.log10((1 - c["rate"]) / (1 - c["change"])))
    order = lambda c: F.greatest(F.lit(0.0), F.greatest(normal(c["low"]), F.when(c["rate"] > c["change"], chernoff(c)).otherwise(F.lit(0.0))) - 0.30103)
    both = lambda c: normal(c["chi"]) + order(c)
    best = lambda c: both(c) - F.log10(1 + both(c) * 2.30258509)
    random = lambda c: (n(c) >= 20) & (F.abs(c["z_chi"]) <= z_max) & (F.abs(c["z_runs"]) <= z_max) & (F.abs(c["z_serial"]) <= z_max)
    of_length = lambda c: _when([(c["end"] - c["start"] < to, F.lit(k)) for k, to in LENGTH_CLASSES], F.lit(len(LENGTH_CLASSES)))
    bucket = lambda c: F.when(random(c), F.floor(10 * F.greatest(F.lit(0.0), F.least(best(c), F.lit(60.0)))).cast("int")).otherwise(0)
    return _with(out, place, **{"class": of_length, "bucket": bucket})


def find(docs: DataFrame, keep: list[str], text_col: str = "text", z_max: float = 3.29, class_change: float = 0.15, persistence: float = 0.3) -> DataFrame:
    """The columns ``keep`` as k0, k1, ... with ``base`` (array of start, rank, end, text) and ``candidates`` (start, rank, end, text, class, bucket), written to the shared folder."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], t.alias("t"))
    kinds = [*KINDS, ("candidate", CANDIDATE, 0, 20)]
    df = df.select("*", *[F.regexp_extract_all("t", F.lit(p), 0).alias(f"m{i}") for i, (_, p, _, _) in enumerate(kinds)])
    df = df.select(
        *[f"k{i}" for i in range(len(keep))], *[f"m{i}" for i in range(len(kinds))],
        *[F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).alias(f"p{i}") for i, (_, p, _, _) in enumerate(kinds)],
        F.when(F.size("m0") > 0, F.regexp_extract_all("t", F.lit(KINDS[0][1]), 2)).alias("g0"),
    )
    df = df.select(
        *[f"k{i}" for i in range(len(keep))],
        F.array_sort(F.concat(*[_spans(F.col(f"m{i}"), F.col(f"p{i}"), F.col("g0") if i == 0 else F.col(f"m{i}"), i, least) for i, (_, _, _, least) in enumerate(KINDS)])).alias("base"),
        _spans(F.col("m3"), F.col("p3"), F.col("m3"), RANDOM_RANK, 20).alias("c"),
    )
    outside = F.filter("c", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.select(*[f"k{i}" for i in range(len(keep))], "base", outside.alias("c"))

    return materialize(df.select(*[f"k{i}" for i in range(len(keep))], "base", _tested(F.col("c"), z_max, class_change, persistence).alias("candidates")), "secrets")


def thresholds(found: DataFrame, q: float) -> dict[int, int]:
    """Step-up rule: by class of lengths, the least bucket that is a discovery. Counts by class and bucket reach the driver."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bucket").count()
    out: dict[int, int] = {}
    by: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # at most 5 classes x 601 buckets
        by.setdefault(r["class"], {})[r["bucket"]] = r["count"]
    for k, seen in by.items():
        m, above = sum(seen.values()), 0
        for bucket in sorted(seen, reverse=True):
            above += seen[bucket]
            if bucket > 0 and 10.0 ** (-bucket / 10) <= q * above / m:
                out[k] = bucket
    return out


def _scanned(docs: DataFrame, keep: list[str], text_col: str, q: float = 1e-3) -> DataFrame:
    """k0, k1, ..., base and spans."""
    found = find(docs, keep, text_col)
    least = thresholds(found, q)
    hit = lambda c: reduce(lambda a, b: a | b, [(c["class"] == k) & (c["bucket"] >= b) for k, b in least.items()], F.lit(False))
    more = F.transform(F.filter("candidates", hit), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["text"].alias("text")))
    return found.select(*[f"k{i}" for i in range(len(keep))], "base", F.array_sort(F.concat("base", more)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 1e-3) -> DataFrame:
    """``id_col`` of every row with ``base`` and ``spans``: sorted arrays of struct(start, rank, end, text)."""
    return _scanned(docs, [id_col], text_col, q).select(F.col("k0").alias(id_col), "base", "spans")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` and ``n_chars`` counted anew where it is a column; no row goes."""
    names = docs.columns
    found = _scanned(docs, names, text_col)
    whole = F.col(f"k{names.index(text_col)}")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole))),
    )
    text = F.when(F.size("spans") > 0, cut).otherwise(whole)
    return found.select(*[text.alias(c) if c == text_col else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op2_secret_scans(spark, sf_dir):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), n(3).alias("n_random"))
