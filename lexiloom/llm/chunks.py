"""Substring dedup: content-defined chunking with a gear rolling hash.

A chunk starts at a word whose preceding ``WINDOW`` bytes have a gear hash with
``CUT_BITS`` zero bits on top (so inserted text moves no later cut), and at
every ``MAX_WORDS``-th word of a chunk that grew so long. A single chunk is too short to be evidence, so what is
compared is, from each chunk on, the fewest chunks that cover ``MIN_WORDS`` words, as one string of bytes (a window,
by its 64-bit digest): one match is a passage that the other document has word for word. A passage of
50 words loses up to ``WINDOW`` bytes and a chunk at either end. Of the copies of a window the one in
the least id (null ids come first), there in the least text digest, and there the first, is kept. A run is
neighbouring windows whose kept copies are neighbours in one document too, so that document has the
whole run in succession, and no run is shorter than ``MIN_WORDS`` words. Runs of different sources may overlap; what a
kept window covers is never cut, so every kept copy stays whole.

How it is spread: chunking is narrow and cheap, so it runs anew rather than being
kept: once to see which digests repeat (counts, with map-side partial
sums), once to be joined with these. A digest's copies meet in
one task, that picks the kept one, but for hot digests, those of over ``HOT_ROWS`` copies and a thousandth of all repeated windows (at most 1000 digests): their kept copies are found first, by partial sums over another
run, and their rows are joined by one of ``SALTS`` salts, so they are dealt over as many tasks. Only repeated windows are gathered by document.

Edge cases: null and empty texts have no chunks; rows that agree in id and text are one
document, so what only they share is not repeated; rows that share an id or have none take part by id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, free, materialize, mix64, named, slices, utf8

WINDOW, CUT_BITS, MAX_WORDS, MIN_WORDS = 16, 2, 16, 22
HOT_ROWS, SALTS = 1000, 64
BATCH_BYTES = 1 << 20

_GEAR = (mix64(np.arange(256, dtype=U64) + U64(77)) >> U64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes up to and including each place: the sum of gear values shifted left by their age, by doubling."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[age:] = h[:-age]
        h = h + (older << np.uint16(age)).astype(np.uint16)
    return h


def chunk(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Chunks of all texts: number of the text, first byte, end byte (exclusive) in it, and words."""
    w = Words(texts)
    if not len(w.starts):
        return (np.zeros(0, np.int64),) * 4
    h = gear(w.data)
    cut = (h[np.maximum(w.starts - 1, 0)] >> np.uint16(16 - CUT_BITS)) == 0
    cut &= w.starts - w.offsets[w.doc] >= WINDOW  # or the text before it in the batch would count
    place = np.arange(len(w.starts)) - w.first[w.doc]
    cut |= place == 0
    lead = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), 0))
    cut |= (np.arange(len(cut)) - lead) % MAX_WORDS == 0
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(cut)) - 1
    doc = w.doc[at]
    return doc, w.starts[at] - w.offsets[doc], w.ends[last] - w.offsets[doc], last - at + 1


def windows(texts: list[bytes], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """From each chunk on, the fewest chunks of its text that cover ``min_words`` words: text, first byte, end byte, number of the chunk, its words, words of all."""
    doc, start, end, words = chunk(texts)
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    upto = np.cumsum(words)
    last = np.searchsorted(upto, upto - words + min_words)
    whole = np.flatnonzero(last < len(doc))
    whole = whole[doc[last[whole]] == doc[whole]]
    last = last[whole]
    return doc[whole], start[whole], end[last], place[whole], words[whole], upto[last] - upto[whole] + words[whole]


def window_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k (id), t (digest of id and text), d (digest of the window), span (first byte and end byte, 32 bits each), nth (number of the first chunk,
    its words, and the window's: place << 24 | chunk << 16 | words)."""

    def run(batches):
        for batch in batches:
            texts = [utf8(x) for x in batch.column("text").to_pylist()]
            for part in slices(texts, [len(x) for x in texts], BATCH_BYTES):
                own = texts[part]
                doc, start, end, place, first, words = windows(own, min_words)
                digest = np.array([xxhash.xxh3_64_intdigest(own[i][a:b]) for i, a, b in zip(doc.tolist(), start.tolist(), end.tolist())], U64).view(np.int64)
                at = pa.array(doc + part.start)
                columns = [batch.column("k").take(at), batch.column("t").take(at), *map(pa.array, (digest, start << 32 | end, place << 24 | first << 16 | words))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "t", "d", "span", "nth"])

    named = docs.select(F.col(id_col).alias("k"), document(id_col, text_col).alias("t"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, f"k {dict(named.dtypes)['k']}, t long, d long, span long, nth long")


def document(id_col: str, text_col: str) -> Column:
    """64 bits that stand for a document: its id and its text (null: the empty text)."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document with a repeated passage: k, t, ``runs``, an array of struct(start, end, words, kept, with): bytes of the
    passage's covered part, whether this is its kept copy, and the id of the document that has the kept copy; and ``cuts``, an array of struct(start, end):
    bytes that windows kept elsewhere cover, and none that is kept here."""
    table = lambda: window_table(docs, id_col, text_col, min_words)
    repeats = materialize(table().groupBy("d").agg(F.count("*").alias("m")).where("m > 1"), "repeats")
    rows = repeats.agg(F.sum("m")).first()[0] or 0
    ids = [r["d"] for r in repeats.where(F.col("m") > max(HOT_ROWS, rows / 1000)).select("d").collect()]  # at most 1000 numbers
    hot = F.col("d").isin(ids) if ids else F.lit(False)
    copy, place = F.struct("k", "t", "nth"), F.struct("t", "nth")
    ends = [F.min(copy).alias("least"), F.min(place).alias("lo"), F.max(place).alias("hi")]
    known = materialize(table().where(hot).groupBy("d").agg(*ends), "hot")
    salts = F.when(F.col("least").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = repeats.select("d").join(F.broadcast(known), "d", "left").select("d", F.explode(salts).alias("salt"), F.col("least").alias("least_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    found = table().withColumn("salt", F.when(hot, F.pmod(F.xxhash64("t", "nth"), F.lit(SALTS)).cast("int")).otherwise(0)).join(side, ["d", "salt"])
    of_digest = Window.partitionBy("d", "salt")  # all copies of a digest that isn't hot; what a hot one's copies have together is known already
    for name, end in {"least": F.min(copy), "lo": F.min(place), "hi": F.max(place)}.items():
        found = found.withColumn(name, F.coalesce(F.col(f"{name}_"), end.over(of_digest)))
    found = found.where("lo <> hi")  # not what only equal rows share
    found = found.select("k", "t", F.struct("nth", "span", F.col("least.t").alias("lt"), F.col("least.nth").alias("ln"), F.col("least.k").alias("lk")).alias("c"))

    def runs(batches):
        for batch in batches:
            kind = batch.schema.field("k").type
            out, cuts = [], []
            for t, cs in zip(batch.column("t").to_pylist(), batch.column("cs").to_pylist()):
                rows, before = [], None
                for c in cs:
                    place, source = c["nth"] >> 24, (c["lt"], c["ln"] >> 24)
                    if before != (place - 1, source[0], source[1] - 1):
                        rows.append({"start": c["span"] >> 32, "end": 0, "words": 0, "kept": source == (t, place), "with": c["lk"]})
                        words = 0
                    rows[-1]["end"], rows[-1]["words"] = c["span"] & 0xFFFFFFFF, words + (c["nth"] & 0xFFFF)
                    words += c["nth"] >> 16 & 0xFF
                    before = (place, *source)
                out.append(rows)
                cuts.append(_outside([(r["start"], r["end"]) for r in rows if not r["kept"]], [(r["start"], r["end"]) for r in rows if r["kept"]]))
            run = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("kept", pa.bool_()), ("with", kind)])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), pa.array(out, pa.list_(run)), pa.array(cuts, pa.list_(span))], names=["k", "t", "runs", "cuts"])

    kind = dict(docs.dtypes)[id_col]
    gathered = found.groupBy("k", "t").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    return gathered.mapInArrow(runs, f"k {kind}, t long, runs array<struct<start:int,end:int,words:int,kept:boolean,with:{kind}>>, cuts array<struct<start:int,end:int>>")


def _outside(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[dict[str, int]]:
    """What ``spans`` cover and ``kept`` doesn't, as disjoint spans in order. Both are in order of their starts."""
    out: list[dict[str, int]] = []
    at = i = 0
    for start, end in spans:
        at = max(at, start)
        while i < len(kept) and kept[i][1] <= at:
            i += 1
        j = i
        while at < end:
            stop = min(end, kept[j][0]) if j < len(kept) else end
            if at < stop:
                out.append({"start": at, "end": stop})
            at = max(stop, min(end, kept[j][1])) if j < len(kept) else end
            j += 1
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the copies of repeated passages that aren't the kept ones; ``n_chars`` is counted anew where it is a column; no row goes."""
    k, t, cuts = (free(docs.columns, x) for x in ("cut_k", "cut_t", "cut_spans"))
    spans = repeated(docs, id_col, text_col, min_words).select(F.col("k").alias(k), F.col("t").alias(t), F.col("cuts").alias(cuts)).where(F.size(cuts) > 0)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    cut = F.aggregate(
        cuts,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, r: F.struct((r["end"] + 1).alias("at"), F.array_append(a["out"], F.substring(data, a["at"], r["start"] + 1 - a["at"]).cast("string")).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(data, a["at"], F.length(data)).cast("string")),
    )
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(k)) & (document(id_col, text_col) == F.col(t)), "left")
    out = joined.select(*[named(c) for c in docs.columns if c != text_col], F.when(F.col(cuts).isNotNull(), cut).otherwise(F.col(text_col)).alias(text_col))
    return out.select(*[F.length(text_col).cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir):
    """doc_id, start_byte, end_byte, n_words, kept, with_doc_id: a row for each repeated passage; documents without one have none."""
    out = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("k", F.explode("runs").alias("r")).select(F.col("k").alias("doc_id"), F.col("r.start").alias("start_byte"), F.col("r.end").alias("end_byte"), F.col("r.words").alias("n_words"), F.col("r.kept").alias("kept"), F.col("r.with").alias("with_doc_id"))
