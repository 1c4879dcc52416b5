"""Annotated recordings: marker rules, trainable segments, voice activity, merging of states and word parts, small conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENCE, INHALE, SPACE, IGNORE = "<sil>", "[inh]", "_s", "_ignore"


def broken_rules(markers: DataFrame, speakers: DataFrame) -> DataFrame:
    """id, message: a row for each broken rule of a marker (id, level, text, language, speaker). ``speakers``: speaker, one row each."""
    known = speakers.select("speaker").distinct().withColumn("defined", F.lit(True))
    m = markers.join(known, "speaker", "left")
    language, speaker = F.col("language").isNotNull(), F.coalesce(F.col("speaker"), F.lit("")) != ""
    text = F.coalesce(F.col("text"), F.lit(""))
    phone, word = F.col("level") == "phone", F.col("level") == "word"
    plain = word & ~text.isin("", SILENCE, INHALE)
    rules = [
        (phone & language, "phone with a language"), (phone & speaker, "phone with a speaker"),
        (word & (text == "") & language, "no text, but a language"), (word & (text == "") & speaker, "no text, but a speaker"),
        (word & (text == SILENCE) & language, "silence with a language"), (word & (text == SILENCE) & speaker, "silence with a speaker"),
        (word & (text == INHALE) & language, "inhale with a language"), (word & (text == INHALE) & ~speaker, "inhale without a speaker"),
        (plain & ~language, "text without a language"), (plain & ~speaker, "text without a speaker"), (plain & speaker & F.col("defined").isNull(), "text with an unknown speaker"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())
    return m.select("id", F.explode(found).alias("message"))


def quiet_files(files: DataFrame, most_db: float) -> DataFrame:
    """Files whose parameter ``noise_db`` is not above ``most_db``; 0 keeps all, and so does a missing parameter."""
    return files.where((F.lit(most_db) == 0) | F.col("noise_db").isNull() | (F.col("noise_db") <= most_db))


def trainable(segments: DataFrame, language: str = "uk") -> DataFrame:
    """Segments (text, language) to train with: some text without #, no word that can't be used, of the language or a lone inhale."""
    text = F.coalesce(F.col("text"), F.lit(""))
    usable = ~text.contains("#") & ~text.contains("<unk>") & ~text.contains("<air>") & ~text.contains("[clk]")
    return segments.where((text != "") & usable & ((F.coalesce(F.col("language"), F.lit("")) == language) | (text == INHALE)))


def without_silence(markers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each marker (key, level, text, at) with the start of the next one, ``until``; spans between two phone-level markers of which the first is a pause or to be ignored go."""
    w = Window.partitionBy(key).orderBy(*order)
    out = markers.withColumn("until", F.lead("at").over(w)).withColumn("next_level", F.lead("level").over(w)).where("until IS NOT NULL")
    skip = (F.col("level") == "phone") & (F.col("next_level") == "phone") & F.col("text").isin(SPACE, IGNORE)
    return out.where(~F.coalesce(skip, F.lit(False))).drop("next_level")


def energy_activity(points: DataFrame, key: str, order: list[str], value: str, size: int = 105, least: float = 0.6634) -> DataFrame:
    """key, run, active, first, last, n: runs of equal activity over whole frames of ``size`` values without overlap. A frame is silent if
    log10(mean of (x / 32768)^2) / -7 exceeds ``least``."""
    w = Window.partitionBy(key).orderBy(*order)
    p = points.select(key, F.col(value).alias("x"), F.floor((F.row_number().over(w) - 1) / size).alias("frame"))
    frames = p.groupBy(key, "frame").agg(F.avg(F.pow(F.col("x") / 32768, F.lit(2.0))).alias("power"), F.count("*").alias("m")).where(F.col("m") == size)
    active = ~(F.coalesce(F.log10("power"), F.lit(-99.0)) / -7 > least)
    return _runs(frames.select(key, "frame", active.alias("active")), key)


def _runs(frames: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("frame")
    p = frames.withColumn("run", F.sum(F.when(F.lag("active").over(w).eqNullSafe(F.col("active")), 0).otherwise(1)).over(w))
    return p.groupBy(key, "run").agg(F.first("active").alias("active"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


def silence_marks(points: DataFrame, key: str, order: list[str], value: str, size: int, shift: int, small: int, below: float, small_below: float) -> DataFrame:
    """key, left, right: silent stretches, cut by ``shift`` at both ends. A window of ``size`` values every ``shift`` is silent if its mean magnitude is under
    ``below`` and that of one of the windows of ``small`` values that start in it every ``shift`` is under ``small_below``."""
    w = Window.partitionBy(key).orderBy(*order)
    ahead = lambda n: F.avg(F.abs(F.col(value))).over(w.rowsBetween(0, n - 1))
    p = points.select(key, (F.row_number().over(w) - 1).alias("i"), F.lead(F.lit(1), size - 1).over(w).isNotNull().alias("whole"), ahead(size).alias("large"), ahead(small).alias("little"))
    p = p.where(F.col("i") % shift == 0)
    least = F.min("little").over(Window.partitionBy(key).orderBy("i").rowsBetween(0, (size - 1) // shift))
    p = p.withColumn("least", least).where("whole")
    runs = _runs(p.select(key, (F.col("i") / shift).cast("long").alias("frame"), ((F.col("large") < below) & (F.col("least") < small_below)).alias("active")), key)
    return runs.where("active").select(key, (F.col("first") * shift + shift).alias("left"), (F.col("last") * shift + size - shift).alias("right"))


def merged_states(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, run, phone, first, last, n: neighbouring states (key, name, at) whose names begin with the same letters are one phone; ? and names that
    begin with no letter stay alone and as they are."""
    w = Window.partitionBy(key).orderBy(*order)
    phone = F.regexp_extract("name", "^[A-Za-z]+", 0)
    p = states.withColumn("phone", F.when(phone != "", phone))
    p = p.withColumn("run", F.sum(F.when(F.lag("phone").over(w) == F.col("phone"), 0).otherwise(1)).over(w))
    return p.groupBy(key, "run").agg(F.coalesce(F.first("phone"), F.first("name")).alias("phone"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def merged_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, word, first, last: parts (keys, pos, part) of which one ends and the next begins with a tilde become one word."""
    w = Window.partitionBy(*keys).orderBy("pos")
    joins = F.coalesce(F.lag("part").over(w).endswith("~") & F.col("part").startswith("~"), F.lit(False))
    p = parts.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    grouped = p.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("all"))
    return grouped.select(*keys, "run", F.replace(F.array_join("all.part", ""), F.lit("~~"), F.lit("")).alias("word"), F.element_at("all.pos", 1).alias("first"), F.element_at("all.pos", -1).alias("last"))


def accepted(words: Column) -> Column:
    """The words before the place where errors gather: up to the last inhale, or without the last word (<s> and </s> after it go as well). One word stays."""
    last = F.array_position(F.reverse(words), INHALE)
    trailing = F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " ")), F.lit(r"( </?s>)(?=( </?s>)*$)"))
    keep = F.when(last > 0, F.size(words) - last + 1).otherwise(F.greatest(F.size(words) - 1 - trailing, F.lit(0)))
    return F.when(F.size(words) <= 1, words).otherwise(F.slice(words, F.lit(1), keep.cast("int")))


def padded(samples: Column, before: int, after: int) -> Column:
    """Samples with zeros on both sides."""
    zeros = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit(0.0)) if n else F.array().cast("array<double>")
    return F.concat(zeros(before), samples.cast("array<double>"), zeros(after))


def frame_samples(first: Column, last: Column, size: int, shift: int, ends: str = "last") -> Column:
    """struct(start, end), end exclusive, of the samples of frames: up to the end of the last one, the start of the next one, or the middle between these."""
    stop = {"last": last * shift + size, "next": (last + 1) * shift, "middle": F.floor((last * shift + size + (last + 1) * shift) / 2)}[ends]
    return F.struct((first * shift).alias("start"), stop.cast("long").alias("end"))


def in_top(scores: Column, label: Column, n: int) -> Column:
    """Whether the score at ``label`` (from 0) is among the ``n`` largest; of equal scores the first counts as larger."""
    own = F.get(scores, label)
    better = F.filter(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (x["s"] > own) | ((x["s"] == own) & (x["i"] < label)))
    return F.size(better) < n


def recipe(lines: Column) -> Column:
    """struct(file, from_id, to_id, times) of ``file;3-15;R3``; what follows # is a comment. Null for a line without a range."""
    line = F.regexp_replace(lines, "#.*$", "")
    parts = F.filter(F.split(line, ";"), lambda x: x != "")
    ids = F.regexp_extract_all(F.get(parts, 1), F.lit("[0-9]+"), F.lit(0))
    times = F.regexp_extract(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), ";"), "(?i)(?:^|;)R([0-9]+)", 1)
    return F.when(F.size(ids) == 2, F.struct(F.get(parts, 0).alias("file"), F.get(ids, 0).cast("long").alias("from_id"), F.get(ids, 1).cast("long").alias("to_id"), F.coalesce(F.nullif(times, F.lit("")).cast("int"), F.lit(1)).alias("times")))


def recipe_ranges(recipes: DataFrame, markers: DataFrame) -> DataFrame:
    """id, nth, start, end: the ranges that recipes (id, line) name by markers (marker, at), as often as they are to be played."""
    r = recipes.select("id", recipe(F.col("line")).alias("r")).where("r IS NOT NULL").select("id", "r.*")
    at = lambda name, out: markers.select(F.col("marker").alias(name), F.col("at").alias(out))
    found = r.join(at("from_id", "start"), "from_id").join(at("to_id", "end"), "to_id").where("times > 0")
    return found.select("id", F.explode(F.sequence(F.lit(1), "times")).alias("nth"), "start", "end")
