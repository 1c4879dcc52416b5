"""Streams give what whole texts give."""

import duckdb

from lexiloom.plans import catalogue
from lexiloom.plans import speech  # noqa: F401
from lexiloom.streaming import text


def test_split_tail():
    assert text.split_tail("One two. Three?! Fo") == (["One two.", "Three?!"], " Fo")
    assert text.split_tail("На вул. A. Б. ст. два. Так") == (["На вул.", "A. Б. ст. два."], " Так")
    assert text.split_tail("") == ([], "")


def test_sentences_across_blocks(spark, tmp_path):
    blocks = [(1, 0, "One two. Thr"), (1, 1, "ee four! Fi"), (1, 2, "ve six. "), (2, 0, None)]
    for i, b in enumerate(blocks):
        spark.createDataFrame([b], "doc_id long, seq long, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, seq long, text string").json(str(tmp_path / "in"))
    q = text.sentences(stream).writeStream.format("memory").queryName("sents").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r.n, r.sentence) for r in spark.table("sents").orderBy("n").collect()] == [(0, "One two."), (1, "Three four!"), (2, "Five six.")]


def test_sessions_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["activity_sessions"](spark, sf).collect()
    duckdb.sql("SET TimeZone = 'UTC'")
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS FROM '{sf}/events.parquet'")
    want = duckdb.sql(catalogue.ORACLE["activity_sessions"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
