"""Edits of markers: the stream gives what the batch replay gives, over restarts, late and repeated edits."""

import datetime
import random

import pytest

from lexiloom.streaming import edits

SCHEMA = "file string, seq long, ts timestamp, op string, marker long, at long, level string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def by_hand(log):
    """One edit after the other."""
    found, seen = {}, set()
    for file, seq, ts, op, marker, place, level, text in sorted((e for e in log if None not in e[:3]), key=lambda e: (e[2], e[1], [(x is not None, x) for x in e[3:]])):
        if (file, ts, seq) in seen or op not in ("insert", "delete", "move"):
            continue
        seen.add((file, ts, seq))
        marker = seq if marker is None and op == "insert" else marker
        key = (file, marker)
        if op == "insert" and key not in found:
            found[key] = [place, level, text]
        elif op == "delete":
            found.pop(key, None)
        elif op == "move" and key in found:
            found[key][0] = place
    return sorted((*k, *v) for k, v in found.items())


def log_of(n, rng):
    out = []
    for i in range(n):
        op = rng.choice(["insert", "insert", "delete", "move", "move", "paint"])
        out.append((rng.choice(["a", "b", "hot", "hot", "hot"]), i, at(rng.randrange(60)), op, rng.choice([None, *range(8)]), rng.randrange(1000), rng.choice(["word", "phone", None]), rng.choice(["x", None, "<sil>"])))
    return out + out[: n // 5] + [("a", None, at(1), "insert", 1, 1, "word", "x"), (None, 5, at(1), "insert", 1, 1, "word", "x")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replay(spark):
    for seed in range(3):
        log = log_of(200, random.Random(seed))
        assert rows(edits.replay(spark.createDataFrame(log, SCHEMA).repartition(3))) == sorted(by_hand(log), key=repr)
    assert edits.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_literals(spark):
    log = [("f", 1, at(0), "insert", None, 50, "word", "one"), ("f", 2, at(1), "insert", 9, 70, "word", "two"), ("f", 3, at(2), "move", 1, 90, None, None), ("f", 4, at(3), "delete", 9, None, None, None),
           ("f", 5, at(4), "move", 9, 5, None, None), ("f", 6, at(5), "insert", 1, 7, "phone", "again"), ("f", 7, at(6), "insert", 9, 8, "phone", "new")]
    assert rows(edits.replay(spark.createDataFrame(log, SCHEMA))) == [("f", 1, 90, "word", "one"), ("f", 9, 8, "phone", "new")]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, log, path):
    spark.createDataFrame(log, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path):
    """What is there is taken, a file a batch, and the stream ends; the next call goes on from the checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = edits.apply(stream, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_replay_over_restarts(rocks, tmp_path):
    spark, log, place = rocks, log_of(120, random.Random(7)), str(tmp_path / "in")
    parts = sorted((e for e in log if e[2] is not None), key=lambda e: e[2])
    cuts = [parts[i::1][: len(parts) // 3] for i in (0, len(parts) // 3, 2 * (len(parts) // 3))] + [parts[3 * (len(parts) // 3) :]]
    seen = []
    for part in cuts:  # three stops and starts; edits of a part come in any order
        if part:
            part = sorted(part, key=lambda e: hash((e[1], 3)))
            put(spark, part, place)
            seen += part
        run(spark, tmp_path)
    put(spark, [("clock", 0, at(500), "insert", 1, 0, "word", "tick")], place)
    changes = run(spark, tmp_path)
    # an edit before the watermark of an earlier run is late: of equal ones the first counts, so only a part's own repeats come in time
    got = [r for r in rows(edits.current(changes)) if r[0] != "clock"]
    assert got == rows(edits.replay(spark.createDataFrame(seen, SCHEMA)))
    assert got == sorted(by_hand(seen), key=repr)
    nth = {}
    for r in changes.orderBy("file", "nth").collect():
        assert r.nth == nth.get(r.file, 0) + 1
        nth[r.file] = r.nth


def test_late_edits_are_dropped(rocks, tmp_path):
    spark, place = rocks, str(tmp_path / "in")
    put(spark, [("f", 1, at(0), "insert", 1, 5, "word", "x"), ("f", 9, at(100), "insert", 2, 5, "word", "x")], place)
    run(spark, tmp_path)  # the watermark is at 90
    put(spark, [("f", 2, at(50), "move", 1, 77, None, None), ("f", 3, at(95), "move", 1, 8, None, None), ("f", 3, at(95), "move", 1, 8, None, None)], place)
    run(spark, tmp_path)
    put(spark, [("g", 1, at(300), "insert", 1, 0, "word", "tick")], place)
    got = edits.current(run(spark, tmp_path))
    assert {tuple(r) for r in got.where("file = 'f'").collect()} == {("f", 1, 8, "word", "x"), ("f", 2, 5, "word", "x")}
