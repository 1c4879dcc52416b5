"""Ids of any size and kind beside null ones, and further columns of any type."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import chunks, counts, media, neardup, packing, ppm, quality, sampling, secrets

LARGE = [1, None, 2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]
STRINGS = ["b", None, "a", "", "ü", "9007199254740993"]
#: Texts of different words, so that no two are near copies.
TEXTS = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
OPERATORS = {
    "quality": lambda d, labels: quality.score(d, quality.train(d, labels)),
    "secrets": lambda d, labels: secrets.scan(d),
    "ppm": lambda d, labels: ppm.score(d),
    "media": lambda d, labels: media.describe(media.store(d)),
    "repeated": lambda d, labels: chunks.remove(d),
    "counts": lambda d, labels: counts.count(d),
    "packing": lambda d, labels: packing.pack_texts(d, window=4),
    "classes": lambda d, labels: neardup.classes(d),
    "sampling": lambda d, labels: sampling.sample(d, k=1),
    "decode": lambda d, labels: sampling.decode(sampling.sample(d, k=1)),
    "keep_one": lambda d, labels: neardup.keep_one(d),
    "redact": lambda d, labels: secrets.redact(d),
}


def table(spark, ids, kind):
    """All rows in one partition, so that null ids share a batch with large ones."""
    return spark.createDataFrame([(i, t, "en", None, n) for n, (i, t) in enumerate(zip(ids, TEXTS))], f"doc_id {kind}, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate([*LARGE[2:], *range(20)])], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("ids, kind", [(LARGE, "long"), (STRINGS, "string")], ids=["long", "string"])
def test_ids_stay(spark, labels, name, ids, kind):
    df = table(spark, ids, kind)
    got = OPERATORS[name](df, labels.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert dict(got.dtypes)["doc_id"] == dict(df.dtypes)["doc_id"]
    found = [r["doc_id"] for r in got.select("doc_id").collect()]
    if name == "packing":  # pieces
        found = set(found)
    assert sorted(found, key=repr) == sorted(ids, key=repr)
    if name == "classes":
        assert all(r["class_id"] == r["doc_id"] for r in got.collect())


#: A column of each type, with a value that a detour through pandas would change or refuse.
KINDS = {
    "far": ("timestamp", datetime.datetime(9999, 1, 1)), "near": ("timestamp", datetime.datetime(1500, 1, 1)), "local": ("timestamp_ntz", datetime.datetime(9999, 12, 31, 23)), "day": ("date", datetime.date(1, 1, 1)),
    "whole": ("long", 2**53 + 1), "small": ("int", 7), "tiny": ("byte", -128), "short": ("short", 5), "yes": ("boolean", True), "real": ("double", float("inf")), "single": ("float", 0.5),
    "money": ("decimal(38,18)", decimal.Decimal("1.000000000000000001")), "bytes": ("binary", bytearray(b"\0\xff")), "list": ("array<long>", [2**53 + 1, None]), "map": ("map<string,long>", {"a": 2**53 + 1}),
    "pair": ("struct<a:long,b:array<struct<c:timestamp>>>", (2**53 + 1, [(datetime.datetime(9999, 1, 1),)])), "span": ("interval day to second", datetime.timedelta(days=-1, microseconds=1)), "_metadata": ("string", "own"), "a.b": ("string", "dotted"),
}


@pytest.fixture(scope="module")
def wide(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {k}" for n, (k, _) in KINDS.items())
    rows = [(i, t, "en", "s", 10, *[v if n % 2 else None for _, v in KINDS.values()]) for n, (i, t) in enumerate(zip(LARGE, TEXTS))]
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_further_columns_of_any_type(spark, wide, labels, tmp_path, name, stage):
    none = labels.where("false") if name == "quality" else labels  # without labels every score is 0.5, so all rows stay
    none.write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, wide, str(tmp_path))
    assert got.dtypes == wide.dtypes
    plain = lambda df: sorted(repr([r[c] for c in wide.columns if c != "n_chars"]) for r in df.collect())
    assert plain(got) == plain(wide)


def test_columns_named_as_files_are(spark, wide, tmp_path):
    """A column _metadata hides the reader's own by name, not for op3."""
    wide.drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in ppm.op3_lm_scoring(spark, str(tmp_path)).collect()} == set(LARGE)


def test_marks_of_the_tokenizer():
    """Added tokens are found as they stand; what has other letters is text."""
    coder = packing.Tokens()
    ids = lambda t: memoryview(coder.encode([t.encode()])[0]).cast("I").tolist()
    for text in ["a<|endoftext|>b", "<|startoftext|>", "A B<|endoftext|> C\tD", "<|ENDOFTEXT|> x", "plain Words", "<|endoftext|><|endoftext|>", "É<|endoftext|>É \n ÉÉ"]:
        assert ids(text) == coder.whole.encode(text, add_special_tokens=False).ids
    assert ids("a<|endoftext|>b") == [320, 49407, 321]


def test_training_takes_whole_documents(spark, monkeypatch):
    """The bound is on passages together; a document is taken with all of its passages or not at all."""
    docs = spark.createDataFrame([(i, " ".join(["good" if i % 2 else "bad"] * (32 * (i + 1)))) for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, per_doc, y: seen.append((len(x), sorted(per_doc.tolist()))) or {"constant": 0.5})
    quality.train(docs, marks)
    whole = seen[0][1]
    assert len(whole) == len(set(whole)) and sum(whole) == seen[0][0] and len(whole) > 20
    quality.train(docs, marks, max_train_passages=100)
    assert seen[1][0] <= 100 and set(seen[1][1]) <= set(whole)
