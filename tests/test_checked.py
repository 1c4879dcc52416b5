"""Planted errors come out once each, good rows all stay; catalogues of nested folders."""

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import catalogue, checked


def errors(df):
    return sorted((r.record, r.message) for r in df.collect())


def test_pronunciations(spark, tmp_path):
    (tmp_path / "d.txt").write_text("sure\tsh u e\nsure\tSH O\n\nbad\nно\tN O\n  indented x\nempty\t \nsure\tSH U\nодин\tO QQ\nодин\tO\nx" + "y" * 70 + "\tA\r\n", "utf-8")
    good, bad = checked.pronunciations(spark, str(tmp_path / "d.txt"), ["SH", "U", "E", "O", "N", "A"])
    assert [(r.word, r.prons) for r in good.orderBy("nth").collect()] == [("sure", [["SH", "U", "E"], ["SH", "O"]]), ("но", [["N", "O"]]), ("sure", [["SH", "U"]]), ("один", [["O"]])]
    assert errors(bad) == sorted([("bad", "no phones"), ("empty\t ", "no phones"), ("один\tO QQ", "unknown phone"), ("x" + "y" * 70 + "\tA", "word is too long")])
    every, none = checked.pronunciations(spark, str(tmp_path / "d.txt"), longest=100)
    assert every.count() == 5 and none.count() == 2


def test_lines_keep_their_order_over_parts(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "t.txt").write_text("\n".join(text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = checked.lines(spark, str(tmp_path / "t.txt"))
        assert found.rdd.getNumPartitions() > 3
        assert [r.line for r in checked.numbered(found).orderBy("n").collect()] == text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stresses(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<d><word name="слово" stressedSyllable="2 1"/><word name="так" stressedSyllable="1"/><word name="так" stressedSyllable="2"/><word name="ні" stressedSyllable="0"/><word name="сон" stressedSyllable="x1"/>'
        '<word stressedSyllable="1"/><word name="дім"/><word name="дуб" stressedSyllable="99999999999"/></d>',
        "utf-8",
    )
    good, bad = checked.stresses(spark, str(tmp_path / "s.xml"))
    assert sorted((r.word, r.syllable) for r in good.collect()) == [("слово", 1), ("так", 0)]
    assert errors(bad) == sorted([
        ("так 2", "syllable index is out of range"), ("ні 0", "syllable index is out of range"), ("сон x1", "can't parse stressed syllable"), ("1", "the stress definition is incomplete"),
        ("дім", "the stress definition is incomplete"), ("дуб 99999999999", "can't parse stressed syllable"),
    ])
    assert good.columns == ["file", "word", "syllable"]


def test_declensions(spark, tmp_path):
    w = lambda *names: "".join(f'<word name="{n}" case="n"/>' for n in names)
    (tmp_path / "g.xml").write_text(
        f'<d><group name="він" class="p">{w("він", "його")}</group><group name="він" class="p"></group><group name="дім" class="n">{w("дім")}</group><group name="дім" class="n">{w("дім", "дому")}</group>'
        f'<group class="n">{w("x")}</group><group name="так" class="a">{w("так")}</group><group name="так" class="a">{w("так")}</group><group name="порожнє" class="n"></group></d>',
        "utf-8",
    )
    good, bad = checked.declensions(spark, str(tmp_path / "g.xml"))
    assert sorted((r.lemma, [f.name for f in r.forms]) for r in good.collect()) == [("він", ["він", "його"]), ("порожнє", []), ("так", ["так"])]
    assert errors(bad) == sorted([("дім", "duplicate word groups with different word forms"), ("n", "a group without a name")])


def test_counts_in_the_same_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "x" * (i % 7)) for i in range(100)], "id long, t string").repartition(3)
    good, seen = checked.counted(rows, {"null": F.col("t").isNull(), "empty": F.col("t") == ""}, "checks")
    good.write.parquet(str(tmp_path / "good"))
    assert seen.get == {"rows": 100, "null": 10, "empty": 13} and spark.read.parquet(str(tmp_path / "good")).count() == 77


@pytest.fixture
def tree(tmp_path):
    for name in ["wav/top.WAV", "wav/a/b/one.wav", "wav/a/b/one.flac", "wav/a/two.v2.wav", "wav/a/notes.txt", "xml/a/b/one.xml", "xml/a/two.v2.xml", "xml/lost/three.xml", "xml/top.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    return tmp_path


def test_catalogue(spark, tree):
    sounds, annotations = catalogue.files(spark, str(tree / "wav")), catalogue.files(spark, "file://" + str(tree / "xml"))
    assert sorted((r.relative, r.folder, r["name"], r.ending, r.length) for r in sounds.where("folder <> ''").collect()) == [
        ("a/b/one.flac", "a/b", "one", "flac", 16), ("a/b/one.wav", "a/b", "one", "wav", 15), ("a/notes.txt", "a", "notes", "txt", 15), ("a/two.v2.wav", "a", "two.v2", "wav", 16)]
    got = sorted((r.relative, (r.sound or "")[-4:], r.state) for r in catalogue.paired(sounds, annotations).collect())
    assert got == [("a/b/one", ".wav", "paired"), ("a/b/one", "flac", "paired"), ("a/two.v2", ".wav", "paired"), ("lost/three", "", "no sound"), ("top", ".WAV", "no annotation")]
    assert {(r.folder, r.n, r.bytes) for r in catalogue.by_folder(annotations).collect()} == {("", 1, 11), ("a", 1, 16), ("a/b", 1, 15), ("lost", 1, 18)}


def test_annotation_paths(spark):
    df = spark.createDataFrame([("C:\\data\\wav\\set\\1.v2.WAV",), ("C:/data/wav/2.flac",), ("D:/x/3.wav",)], "p string")
    assert [r[0] for r in df.select(catalogue.annotation_path(F.col("p"), "C:\\data\\wav", "C:/data/xml/")).collect()] == ["C:/data/xml/set/1.v2.xml", "C:/data/xml/2.xml", None]
    assert [r[0] for r in df.select(catalogue.supported(F.col("p"))).collect()] == [True, True, True]
