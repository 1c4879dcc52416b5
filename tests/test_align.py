"""Edit distances, recipes and alignments: known pairs, and random ones against a matrix filled cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import align

def A():
    return align.letters(F.col("a"))


def B():
    return align.letters(F.col("b"))


#: left, right, both aligned (letters by sound; vowels for vowels are cheap), order, whether the pair turned round gives the pair turned round.
PAIRS = [
    ("pA", "Aq", "pA~", "~Aq", "SRI", True), ("ppA", "Aqq", "ppA~~", "~~Aqq", "SRI", True), ("ppAB", "AqqB", "ppA~~B", "~~AqqB", "SRI", True), ("pAAp", "AqqA", "pA~~Ap", "~AqqA~", "SRI", True),
    ("AqqA", "pAApp", "~AqqA~~", "pA~~App", "SRI", True), ("eat", "et", "eat", "e~t", "SRI", True), ("et", "eat", "e~t", "eat", "SRI", True), ("rests", "stress", "~~rests", "stres~s", "SRI", True),
    ("at nose", "etnos", "at nose", "et~nos~", "SRI", True), ("pAppAAPAp", "AqAqqqAQA", "pA~ppA~~~A~PAp", "~Aq~~AqqqAQ~A~", "SRI", False), ("ppp", "qqq", "~~~ppp", "qqq~~~", "SRI", False), ("ppp", "qqq", "ppp~~~", "~~~qqq", "SIR", False),
]


@pytest.mark.parametrize("order", ["SRI", "SIR"])
def test_alignments(spark, order):
    rows = [(a, b, x, y) for a, b, x, y, o, _ in PAIRS if o == order] + [(b, a, y, x) for a, b, x, y, o, both in PAIRS if o == order and both]
    df = spark.createDataFrame(rows, "a string, b string, x string, y string").withColumn("s", align.recipe(A(), B(), align.PHONATION, order))
    for r in df.select("a", "b", "x", "y", align.aligned(A(), B(), F.col("s")).alias("t"), align.valid(A(), B(), F.col("s")).alias("ok")).collect():
        assert r.ok and (r.t.first, r.t.second) == (r.x, r.y), (r.a, r.b)


@pytest.mark.parametrize("turned", [False, True])
def test_numbers_with_separator(spark, turned):
    x, y = ([77, 2, 79, 13], "~~~77~2~~79~13"), ([12, 66, 11, 68, 6], "12~66~11~68~6~")
    x, y = (y, x) if turned else (x, y)
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(x[0], y[0])], "a array<int>, b array<int>").withColumn("s", align.recipe(a, b, align.MANHATTAN))
    (r,) = df.select(align.aligned(a, b, F.col("s"), "~", "~").alias("t"), align.valid(a, b, F.col("s")).alias("ok")).collect()
    assert r.ok and (r.t.first, r.t.second) == (x[1], y[1])


def test_distances(spark):
    words = [("a1", "b1", 1), ("rests", "stress", 3), ("tea", "toe", 2), ("", "abc", 3), ("ab", "", 2), ("", "", 0)]
    df = spark.createDataFrame(words, "a string, b string, d int")
    assert all(r[0] == r[1] for r in df.select("d", align.distance(A(), B())).collect())
    lists = [(["a", "1"], ["b", "1"], 1), (["a", "1"], ["pre", "a", "1"], 1), (["a", "1"], ["1"], 1), (None, ["1"], None), (["x"], None, None)]
    df = spark.createDataFrame(lists, "a array<string>, b array<string>, d int")
    assert all(r[0] == r[1] for r in df.select("d", align.distance(F.col("a"), F.col("b"))).collect())
    assert all(r[0] is None for r in df.where("d is null").select(align.recipe(F.col("a"), F.col("b"))).collect())


def by_cells(a, b, insert, remove, substitute, borders, order):
    """Costs and steps, a cell at a time."""
    d = {(0, 0): (0.0, "")}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                ways = [(d[i - 1, j][0] + remove(a[i - 1]), "R", (i - 1, j)), (d[i, j - 1][0] + insert(b[j - 1]), "I", (i, j - 1)), (d[i - 1, j - 1][0] + substitute(a[i - 1], b[j - 1]), "S", (i - 1, j - 1))]
            elif i:
                ways = [(d[i - 1, 0][0] + (1 if borders == "count" else remove(a[i - 1])), "R", (i - 1, 0))]
            elif j:
                ways = [(d[0, j - 1][0] + (1 if borders == "count" else insert(b[j - 1])), "I", (0, j - 1))]
            if ways:
                c, s, at = min(ways, key=lambda w: (w[0], order.index(w[1])))
                d[i, j] = (c, d[at][1] + s)
    return d[len(a), len(b)]


KINDS = {
    "unit": (align.UNIT, lambda x: 1, lambda x: 1, lambda x, y: float(x != y)),
    "double": (align.DOUBLE, lambda x: 1, lambda x: 1, lambda x, y: 2.0 * (x != y)),
    "phonation": (align.PHONATION, lambda x: 1, lambda x: 1, lambda x, y: 0.0 if x == y else 1.0 if x in "aeiouy" and y in "aeiouy" else 99.0),
    "own": (align.Costs(lambda x: F.ascii(x) % 3 + 0.5, lambda x: F.ascii(x) % 5 + 0.25, lambda x, y: F.abs(F.ascii(x) - F.ascii(y)) / 2.0, "sum"), lambda x: ord(x) % 3 + 0.5, lambda x: ord(x) % 5 + 0.25, lambda x, y: abs(ord(x) - ord(y)) / 2.0),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("order", ["RIS", "SIR"])
def test_random_pairs(spark, kind, order):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdea") for _ in range(rng.randrange(9)))
    costs, insert, remove, substitute = KINDS[kind]
    df = spark.createDataFrame([(word(), word()) for _ in range(150)], "a string, b string").withColumn("s", align.recipe(A(), B(), costs, order))
    for r in df.select("a", "b", align.distance(A(), B(), costs).alias("d"), F.array_join(F.col("s.op"), "").alias("s"), align.valid(A(), B(), F.col("s")).alias("ok")).collect():
        assert r.ok and (r.d, r.s) == by_cells(r.a, r.b, insert, remove, substitute, costs.borders, order), (r.a, r.b)


def test_invalid_recipes(spark):
    df = spark.createDataFrame([("ab", "b", [("R", 0, None), ("S", 1, 0)]), ("ab", "b", [("S", 0, 0), ("R", 1, None)]), ("ab", "cb", [("S", 0, 0), ("S", 1, 1)]), ("ab", "ab", [("S", 1, 1), ("S", 0, 0)])], "a string, b string, s array<struct<op:string,i:int,j:int>>")
    assert [r[0] for r in df.select(align.valid(A(), B(), F.col("s"))).collect()] == [True, True, True, False]


def test_no_python_worker(spark):
    df = spark.createDataFrame([("ab", "b")], "a string, b string").select(align.distance(A(), B()), align.recipe(A(), B()))
    assert "Python" not in df._jdf.queryExecution().toString()
