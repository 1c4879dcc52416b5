"""Segments with samples, by hand and under any partitioning."""

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import assembly

MARKERS = "file string, id long, at long, level string, text string, speaker string"
SOUND = "file string, i long, x int"
#: A file of 100 samples whose values are their numbers: silence, a word with a pause and a click inside, a short pause, a word, silence, the end.
FILE = [
    ("f", 1, 0, "word", "<sil>", None), ("f", 2, 20, "word", "one [sp] two", "s1"), ("f", 3, 30, "phone", "_s", None), ("f", 4, 35, "phone", "", None), ("f", 5, 40, "phone", "_ignore", None),
    ("f", 6, 44, "phone", None, None), ("f", 7, 50, "word", "[sp]", None), ("f", 8, 60, "word", "three", "s2"), ("f", 9, 70, "word", "<sil>", None), ("f", 10, 90, "word", "", None),
]
X = list(range(100))


@pytest.fixture(scope="module")
def data(spark):
    pieces = assembly.cut(spark.createDataFrame([("f", i, i) for i in range(100)], SOUND), "file", "i", "x", 7)
    return spark.createDataFrame(FILE, MARKERS), pieces


def by_id(df, column="samples"):
    return {r["id"]: r[column] for r in df.collect()}


def test_segments_and_samples(data):
    markers, pieces = data
    segments, intervals = assembly.whole(markers)
    got = {r.id: r for r in segments.collect()}
    assert set(got) == {2, 8}
    assert (got[2].start_id, got[2].end_id, got[2].start, got[2].end, got[2].before, got[2].after, got[2].speaker) == (1, 8, 0, 60, 20, 10, "s1")
    assert (got[8].start_id, got[8].end_id, got[8].before, got[8].after) == (7, 10, 10, 20)
    samples = by_id(assembly.read(intervals, pieces, ["file", "id"], 7))
    assert samples[2] == X[20:30] + X[35:40] + X[44:60]
    assert samples[8] == X[60:90]
    kept = by_id(assembly.read(assembly.whole(markers, skip_pauses=False)[1], pieces, ["file", "id"], 7))
    assert kept[2] == X[20:40] + X[44:60]
    whole = by_id(assembly.read(assembly.whole(markers, from_flank=True)[1], pieces, ["file", "id"], 7))
    assert whole[2] == X[0:30] + X[35:40] + X[44:60] and whole[8] == X[50:90]
    bare = assembly.whole(markers, flank_start=False, flank_end=False)[0]
    assert [(r.start, r.end, r.before, r.after) for r in bare.orderBy("id").collect()] == [(20, 50, 0, 0), (60, 70, 0, 0)]


def test_transcript(spark):
    df = spark.createDataFrame([("one [sp] two  <sil> _s three",), (None,), ("_s",)], "t string")
    assert [r[0] for r in df.select(assembly.transcript(F.col("t"))).collect()] == ["one two three", "", ""]
    assert [r[0] for r in df.select(assembly.transcript(F.col("t"), True)).collect()] == ["one <sil> two <sil> <sil> three", "", "<sil>"]


def test_pool_is_the_middle_of_silences(data):
    got = [tuple(r) for r in assembly.silences(data[0]).orderBy("offset").collect()]
    assert got == [("f", 6, 8, 0, 16), ("f", 76, 8, 8, 16)]


def test_padding(data):
    """The stretch is one of the pool, of the length that the flank lacks; longer needs take several."""
    markers, pieces = data
    segments, intervals = assembly.whole(markers)
    pool = X[6:14] + X[76:84]
    built = {r.id: r for r in assembly.build(segments, intervals, markers, pieces, 24, seed=3, size=7).collect()}
    body = by_id(assembly.read(intervals, pieces, ["file", "id"], 7))
    for i, before, after in ((2, 4, 14), (8, 14, 4)):
        s, n = built[i].samples, len(body[i])
        assert built[i].n_speech == n and built[i].missing == 0 and s[before : before + n] == body[i] and len(s) == before + n + after
        for pad in (s[:before], s[before + n :]):
            assert any(pad == pool[k : k + len(pad)] for k in range(17 - len(pad)))
    long = {r.id: r for r in assembly.build(segments, intervals, markers, pieces, 60, seed=3, size=7).collect()}
    pad = long[2].samples[:40]
    assert pad[:16] == pool and pad[16:32] == pool and any(pad[32:] == pool[k : k + 8] for k in range(9))


def test_same_under_any_partitioning(spark, data):
    markers, pieces = data
    out = []
    for n in (1, 3, 11):
        m, p = markers.repartition(n), pieces.repartition(n)
        segments, intervals = assembly.whole(m)
        out.append(by_id(assembly.build(segments, intervals, m, p, 24, size=7)))
    assert out[0] == out[1] == out[2]


def test_file_without_silence(spark):
    rows = [("g", 1, 0, "word", "one", "s"), ("g", 2, 5, "word", "", None)]
    m = spark.createDataFrame(rows, MARKERS)
    pieces = assembly.cut(spark.createDataFrame([("g", i, i) for i in range(5)], SOUND), "file", "i", "x", 4)
    segments, intervals = assembly.whole(m)
    (r,) = assembly.build(segments, intervals, m, pieces, 3, size=4).collect()
    assert r.samples == [0, 1, 2, 3, 4] and r.missing == 6
    none = m.limit(0)
    assert assembly.build(*assembly.whole(none), none, pieces, 3, size=4).count() == 0


def test_active_frames(spark):
    loud, quiet = [20000, -20000, 20000], [0, 0, 0]
    df = spark.createDataFrame([(quiet + loud + quiet + loud + [9],), ([],), ([20000, 1],)], "s array<int>")
    assert [r[0] for r in df.select(assembly.active(F.col("s"), 3)).collect()] == [loud + loud, [], []]


def test_durations(data):
    markers, pieces = data
    built = assembly.build(*assembly.whole(markers), markers, pieces, 24, size=7)
    got = {r.speaker: (r.seconds, r.speech_seconds) for r in assembly.durations(built, ["speaker"], 10.0).collect()}
    assert got == {"s1": (4.9, 3.1), "s2": (4.8, 3.0)}
