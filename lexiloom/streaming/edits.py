"""Edits of markers: an ordered log of insertions, deletions and moves by file, replayed over a whole log or applied to a stream.

A log has file, seq (the edit's number in the file), ts, op (insert, delete or move), marker, at, level, text. Edits of a file count in the order of (ts, seq). An insertion makes
``marker`` (where that is null, ``seq``) unless it is there already; a deletion or a move of a marker that is not there does nothing; a deleted marker may be inserted
again. Edits that agree in file, ts and seq are one edit, the one with the least op, marker, at, level and text. Edits without a file, seq or ts count for nothing, other ops neither.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INSERT, DELETE, MOVE = "insert", "delete", "move"
EDIT = ["ts", "seq", "op", "marker", "at", "level", "text"]


def _clean(log: DataFrame) -> DataFrame:
    some = F.col("file").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull() & F.col("op").isin(INSERT, DELETE, MOVE)
    return log.where(some).select("file", "ts", "seq", "op", F.when(F.col("op") == INSERT, F.coalesce("marker", "seq")).otherwise(F.col("marker")).alias("marker"), "at", "level", "text")


def replay(log: DataFrame) -> DataFrame:
    """file, marker, at, level, text after all edits of a log. Edits meet by file and marker, so a file with many is spread; windows stream over the edits of a marker."""
    one = Window.partitionBy("file", "ts", "seq").orderBy("op", "marker", "at", "level", "text")
    edits = _clean(log).withColumn("k", F.row_number().over(one)).where("k = 1").drop("k").withColumn("t", F.struct("ts", "seq"))
    of = Window.partitionBy("file", "marker")
    gone = F.max(F.when(F.col("op") == DELETE, F.col("t"))).over(of)
    edits = edits.withColumn("gone", gone).where(F.col("gone").isNull() | (F.col("t") > F.col("gone")))
    edits = edits.withColumn("made", F.min(F.when(F.col("op") == INSERT, F.col("t"))).over(of)).where((F.col("t") == F.col("made")) | ((F.col("op") == MOVE) & (F.col("t") > F.col("made"))))
    first = lambda c: F.min_by(c, "t")
    return edits.groupBy("file", "marker").agg(F.max_by("at", "t").alias("at"), first("level").alias("level"), first("text").alias("text"))


def current(changes: DataFrame) -> DataFrame:
    """file, marker, at, level, text: what stands after the changes that ``apply`` gave."""
    last = changes.groupBy("file", "marker").agg(F.max_by(F.struct("at", "level", "text", "deleted"), F.struct("ts", "seq")).alias("m"))
    return last.where("not m.deleted").select("file", "marker", "m.at", "m.level", "m.text")


class _Edits(StatefulProcessor):
    """Of a file: edits that wait for the watermark (by time and number, so a repeated one stands once), the markers that are there, and how many edits were applied."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts timestamp, seq long", "op string, marker long, at long, level string, text string")
        self.markers = handle.getMapState("markers", "marker long", "at long, level string, text string")
        self.applied = handle.getValueState("applied", "n long")
        self.times = handle.getListState("times", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = {r[0] for r in self.times.get()} if self.times.exists() else set()
        for r in rows:
            at, edit = (r.ts, r.seq), (r.op, r.marker, r["at"], r.level, r.text)
            if self.waiting.containsKey(at):
                edit = min(edit, tuple(self.waiting.getValue(at)), key=lambda e: [(x is not None, x) for x in e])
            self.waiting.updateValue(at, edit)
            ms = int(r.ts.timestamp() * 1000) + 1
            if ms not in times:
                times.add(ms)
                self.times.appendValue((ms,))
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(e)) for k, e in self.waiting.iterator() if int(k[0].timestamp() * 1000) + 1 <= now)
        n = self.applied.get()[0] if self.applied.exists() else 0
        for (ts, seq), (op, marker, at, level, text) in due:
            self.waiting.removeKey((ts, seq))
            there = marker is not None and self.markers.containsKey((marker,))
            if op == INSERT and there or op != INSERT and not there:
                continue
            if op == MOVE:
                _, level, text = self.markers.getValue((marker,))
            if op == DELETE:
                at, level, text = self.markers.getValue((marker,))
                self.markers.removeKey((marker,))
            else:
                self.markers.updateValue((marker,), (at, level, text))
            n += 1
            yield Row(file=key[0], marker=marker, at=at, level=level, text=text, deleted=op == DELETE, ts=ts, seq=seq, nth=n)
        self.applied.update((n,))
        left = [(t[0],) for t in self.times.get() if t[0] > now]
        self.times.clear()
        if left:
            self.times.put(left)

    def close(self) -> None:
        pass


def apply(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """file, marker, at, level, text, deleted, ts, seq, nth (the file's changes so far) of each change that a stream of edits makes.

    An edit waits until the watermark, ``late`` behind the newest edit of all files, has passed it, so edits that come out of order still count in the order of (ts, seq); later ones
    are dropped. What waits, the markers and the count are the file's state; with a checkpoint a stream that was stopped goes on where it was. Needs the state store of RocksDB."""
    rows = _clean(log).withWatermark("ts", late)
    kinds = dict(rows.dtypes)
    out = f"file {kinds['file']}, marker long, at long, level string, text string, deleted boolean, ts timestamp, seq long, nth long"
    return rows.groupBy("file").transformWithState(_Edits(), out, "append", "eventTime")
