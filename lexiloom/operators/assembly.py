"""Segments of recordings with their samples: flanks of silence, pauses cut out, voice activity, padding drawn from a file's own silences.

Samples are kept in pieces of ``size``, (file, piece, samples), so that no row holds a file. An interval finds its pieces by arithmetic, so
reading is a join by (file, piece); what is not contiguous, pauses cut out or padding from several silences, is a list of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recordings import IGNORE, SILENCE, SPACE

SHORT_PAUSE = "[sp]"
PIECE = 4096


def cut(points: DataFrame, file: str, i: str, value: str, size: int = PIECE) -> DataFrame:
    """file, piece, samples from points that have a sample's number in the file (from 0, without gaps) and its value."""
    p = points.select(F.col(file).alias("file"), F.floor(F.col(i) / size).alias("piece"), F.struct(F.col(i).alias("i"), F.col(value).alias("x")).alias("s"))
    return p.groupBy("file", "piece").agg(F.array_sort(F.collect_list("s")).alias("s")).select("file", "piece", F.col("s.x").alias("samples"))


def read(intervals: DataFrame, pieces: DataFrame, keys: list[str], size: int = PIECE) -> DataFrame:
    """keys, samples: of the intervals (keys, file, part, start, end; the end is exclusive) of equal keys the samples, by part. What lies beyond a file has none."""
    some = intervals.where("start < end").withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    met = some.join(pieces, ["file", "piece"])
    lo = F.greatest(F.col("start") - F.col("piece") * size, F.lit(0))
    part = F.slice("samples", (lo + 1).cast("int"), (F.least(F.col("end") - F.col("piece") * size, F.lit(size)) - lo).cast("int"))
    got = met.select(*keys, F.struct("part", "piece", part.alias("samples")).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return got.select(*keys, F.flatten("p.samples").alias("samples"))


def transcript(text: Column, keep_silence: bool = False) -> Column:
    """The words of a text without pauses, or with ``<sil>`` in the place of a short pause or blank."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\r\n]+"), lambda w: w != "")
    if keep_silence:
        return F.array_join(F.transform(words, lambda w: F.when(w.isin(SHORT_PAUSE, SPACE), SILENCE).otherwise(w)), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(SHORT_PAUSE, SILENCE, SPACE)), " ")


def whole(markers: DataFrame, level: str = "word", flank_start: bool = True, flank_end: bool = True, skip_pauses: bool = True, from_flank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments between neighbouring markers of a level, and the intervals of their samples.

    ``markers``: file, id, at, level, text, and what else a segment is to carry (it takes the content marker's). The segments (file, id, start_id, end_id, start,
    end, text, before, after, ...) have a text that is neither empty nor silence; a silence or short pause right before or after becomes their flank, of ``before`` and ``after``
    samples; the one after needs a marker behind it. The intervals (file, id, part, start, end) run from the content marker (``from_flank``: from the flank before it) up
    to the end, over all levels, without spans between two phone-level markers of which the first is a pause (with ``skip_pauses``) or to be ignored."""
    order = Window.partitionBy("file").orderBy("at", "id")
    every = markers.withColumn("pos", F.row_number().over(order))
    m = F.struct("id", "at", "pos", F.coalesce("text", F.lit("")).alias("text"))
    near = every.where(F.col("level") == level).withColumn("m", m)
    near = near.withColumn("m0", F.lag("m").over(order)).withColumn("m1", F.lead("m").over(order)).withColumn("m2", F.lead("m", 2).over(order))
    quiet = lambda c: c["text"].isin(SILENCE, SHORT_PAUSE)
    lead = F.coalesce(quiet(F.col("m0")), F.lit(False)) & F.lit(flank_start)
    tail = F.coalesce(quiet(F.col("m1")), F.lit(False)) & F.col("m2").isNotNull() & F.lit(flank_end)
    found = near.where((F.coalesce("text", F.lit("")) != "") & ~quiet(F.col("m")) & F.col("m1").isNotNull())
    found = found.withColumn("a", F.when(lead, F.col("m0")).otherwise(F.col("m"))).withColumn("b", F.when(tail, F.col("m2")).otherwise(F.col("m1")))
    more = [c for c in markers.columns if c not in ("file", "id", "at", "level", "text")]
    count = lambda there, left, right: F.when(there, right["at"] - left["at"]).otherwise(0).cast("long")
    segments = found.select(
        "file", "id", F.col("a.id").alias("start_id"), F.col("b.id").alias("end_id"), F.col("a.at").alias("start"), F.col("b.at").alias("end"), "text",
        count(lead, F.col("m0"), F.col("m")).alias("before"), count(tail, F.col("m1"), F.col("b")).alias("after"), *more,
    )
    spans = every.select("file", "pos", "level", "text", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.lead("level").over(order).alias("next"))
    skip = (F.col("level") == "phone") & (F.col("next") == "phone") & F.col("text").isin(*([SPACE] if skip_pauses else []), IGNORE)
    spans = spans.where(F.col("end").isNotNull() & ~F.coalesce(skip, F.lit(False))).select("file", "pos", "start", "end")
    first = F.col("a.pos") if from_flank else F.col("pos")
    intervals = found.select("file", "id", F.explode(F.sequence(first, F.col("b.pos") - 1)).alias("pos")).join(spans, ["file", "pos"])
    return segments, intervals.select("file", "id", F.col("pos").alias("part"), "start", "end")


def silences(markers: DataFrame) -> DataFrame:
    """file, start, n, offset, pool: the middle 40 per cent of each silence of a file, put one after the other: where it begins in the file and in the pool, and the pool's size."""
    order = Window.partitionBy("file").orderBy("at", "id")
    long = F.col("until") - F.col("at")
    s = markers.withColumn("until", F.lead("at").over(order)).where((F.col("text") == SILENCE) & F.col("until").isNotNull())
    s = s.select("file", "id", "at", (F.col("at") + F.floor(long * 3 / 10)).alias("start"), F.floor(long * 4 / 10).alias("n")).where("n > 0")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("file", "start", "n", (upto - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("file")).alias("pool"))


def drawn(key: list[Column], below: Column) -> Column:
    """A whole number from 0 to below ``below`` by a hash of the key."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), below)


def padding(needs: DataFrame, pool: DataFrame, seed: int = 0, size: int = PIECE) -> DataFrame:
    """file, id, side, part, start, end: intervals of silence that fill what is needed. ``needs``: file, id, side, n (samples, 0 or more).

    A need takes a stretch of the file's pool that begins at a place drawn by a hash of seed, file, id and side. A need that is longer than the pool takes several
    stretches of the pool's length, drawn anew (with replacement), the last one shorter; a file without silence gives none. Stretch and silence meet
    by the pool's parts of ``size`` that both touch."""
    one = pool.groupBy("file").agg(F.max("pool").alias("pool"))
    draws = needs.where("n > 0").join(one, "file").withColumn("long", F.least("n", "pool"))
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("long")) - 1)))
    n = F.least(F.col("long"), F.col("n") - F.col("draw") * F.col("long"))
    draws = draws.withColumn("take", n).withColumn("from", drawn([F.lit(seed), F.col("file"), F.col("id"), F.col("side"), F.col("draw")], F.col("pool") - F.col("take") + 1))
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size)))
    draws = draws.select("file", "id", "side", "draw", "from", (F.col("from") + F.col("take")).alias("to")).withColumn("bucket", touched(F.col("from"), F.col("to")))
    pool = pool.select("file", F.col("start").alias("at"), "offset", (F.col("offset") + F.col("n")).alias("upto")).withColumn("bucket", touched(F.col("offset"), F.col("upto")))
    lo = F.greatest("from", "offset", F.col("bucket") * size)
    hi = F.least("to", "upto", (F.col("bucket") + 1) * size)
    met = draws.join(pool, ["file", "bucket"]).withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    part = F.col("draw") * F.lit(1 << 40) + F.col("lo") - F.col("from")
    return met.select("file", "id", "side", part.alias("part"), (F.col("at") + F.col("lo") - F.col("offset")).alias("start"), (F.col("at") + F.col("hi") - F.col("offset")).alias("end"))


def active(samples: Column, size: int = 105, least: float = 0.6634) -> Column:
    """The samples of the whole frames of ``size`` in which somebody speaks: log10(mean of (x / 32768)^2) / -7 is not above ``least``. Empty for an array without one."""
    frames = F.transform(F.filter(F.sequence(F.lit(1), F.size(samples)), lambda i: ((i - 1) % size == 0) & (i + size - 1 <= F.size(samples))), lambda i: F.slice(samples, i, F.lit(size)))
    power = lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + F.pow(x / 32768, F.lit(2.0))) / size
    speaks = lambda f: ~(F.coalesce(F.log10(F.nullif(power(f), F.lit(0.0))), F.lit(-99.0)) / -7 > least)
    return F.when(F.size(samples) > 0, F.flatten(F.filter(frames, speaks))).otherwise(samples)


def build(segments: DataFrame, intervals: DataFrame, markers: DataFrame, pieces: DataFrame, least: int, pad_start: bool = True, pad_end: bool = True, vad: int | None = None, seed: int = 0, size: int = PIECE) -> DataFrame:
    """``segments`` with ``samples``, as they are to be written, ``n_speech`` of them without padding, and ``missing``, samples of padding that the file's
    silences could not give. Each padded side gets as much silence as its flank lacks of ``least`` samples. ``vad``: the length of frames, of which only those in which somebody speaks stay."""
    key = ["file", "id"]
    body = segments.join(read(intervals, pieces, key, size).withColumnRenamed("samples", "body"), key, "left")
    body = body.withColumn("body", F.coalesce("body", F.array().cast(dict(pieces.dtypes)["samples"])))
    if vad:
        body = body.withColumn("body", active(F.col("body"), vad))
    lacks = lambda on, flank: F.when(F.lit(on), F.lit(least) - F.least(F.lit(least), F.col(flank))).otherwise(0).cast("long")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), lacks(on, flank).alias("n")) for s, on, flank in ((0, pad_start, "before"), (1, pad_end, "after"))])).alias("s")
    pads = read(padding(segments.select(*key, sides).select(*key, "s.*"), silences(markers), seed, size), pieces, [*key, "side"], size)
    pads = pads.groupBy(*key).agg(*[F.first(F.when(F.col("side") == s, F.col("samples")), ignorenulls=True).alias(f"pad{s}") for s in (0, 1)])
    none = F.array().cast(dict(pieces.dtypes)["samples"])
    both = body.join(pads, key, "left").withColumn("pad0", F.coalesce("pad0", none)).withColumn("pad1", F.coalesce("pad1", none))
    missing = lacks(pad_start, "before") + lacks(pad_end, "after") - F.size("pad0") - F.size("pad1")
    return both.select(*segments.columns, F.concat("pad0", "body", "pad1").alias("samples"), F.size("body").cast("long").alias("n_speech"), missing.cast("long").alias("missing"))


def durations(built: DataFrame, by: list[str], rate: float) -> DataFrame:
    """by, seconds, speech_seconds: what was built, with and without padding."""
    return built.groupBy(*by).agg((F.sum(F.size("samples")) / rate).alias("seconds"), (F.sum("n_speech") / rate).alias("speech_seconds"))
