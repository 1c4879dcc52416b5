"""Streams: sentences whose end comes in a later block, and sessions of activity with late data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.functions import text as T

_ENDS = re.compile(rf"(?<=[{T.STOP}])(?=[^{T.STOP}])")


def split_tail(text: str) -> tuple[list[str], str]:
    """Sentences that more text follows, and the tail. A stop after an abbreviation or one character ends none."""
    done, start = [], 0
    for m in _ENDS.finditer(text):
        before = re.search(r"(\w*)$", text[start : m.start()].rstrip(T.STOP)).group(1)
        if len(before) > 1 and before.lower() not in T.ABBREVIATIONS:
            done.append(text[start : m.start()].strip())
            start = m.start()
    return done, text[start:]


def sentences(blocks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """doc_id, n, sentence from a stream of doc_id, seq, text. The tail waits in the document's state for the next block and goes out
    when none comes for ``idle``; state is one tail and one number a document. Blocks of a micro-batch are taken by seq. Nulls are empty."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, batches, state: GroupState):
        tail, n = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            if tail.strip():
                yield pd.DataFrame({"doc_id": [key[0]], "n": [n], "sentence": [tail.strip()]})
            return
        for _, text in pd.concat(list(batches)).sort_values("seq")[["seq", "text"]].itertuples(index=False):
            done, tail = split_tail(tail + (text or ""))
            yield pd.DataFrame({"doc_id": [key[0]] * len(done), "n": range(n, n + len(done)), "sentence": done})
            n += len(done)
        state.update((tail, n))
        state.setTimeoutDuration(millis)

    rows = blocks.select("doc_id", "seq", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.groupBy("doc_id").applyInPandasWithState(run, f"doc_id {kind}, n long, sentence string", "tail string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start_ts, end_ts, n: sessions that ``gap`` parts; events later than ``late`` are dropped by the watermark."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
