"""Alignment of utterances with states that are trained on it: Viterbi paths as array expressions, rounds of alignment and update as grouped sums.

An utterance is a row: ``frames`` (array of feature vectors) and ``states`` (array of names, left to right). A path begins in the first state, stays or goes one state on from frame to frame, and ends in the last
state. Models are tables (state, n, mean, var) of diagonal Gaussians. Their size is bounded by the number of phones, so they go to the tasks as one broadcast row; frames are never shuffled, what is
shuffled are sums by state and dimension.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, stored

LOWEST = float("-inf")


def viterbi(emission: Column) -> Column:
    """struct(score, starts): of the best path through emission[frame][state], log-probabilities, its score and the first frame of each state; where staying is as good as moving on, a path
    stays. With fewer frames than states, or no states, score is null and starts empty."""
    none = F.lit(LOWEST)

    def add(a: Column, e: Column) -> Column:  # v and starts: of the best path to each state; t: frames so far
        below = lambda s: F.coalesce(F.get(a["v"], s - 1), none)
        v = F.transform(e, lambda x, s: F.greatest(F.get(a["v"], s), below(s)) + x)
        moved = lambda s: F.array_append(F.get(a["starts"], s - 1), a["t"])
        starts = F.transform(a["starts"], lambda own, s: F.when(below(s) > F.get(a["v"], s), moved(s)).otherwise(own))
        return F.struct(v.alias("v"), starts.alias("starts"), (a["t"] + 1).alias("t"))

    def best(e: Column) -> Column:
        first = F.get(e, F.lit(0))
        states = F.size(first)
        v, starts = F.transform(first, lambda x, s: F.when(s == 0, x).otherwise(none)), F.transform(first, lambda _: F.array(F.lit(0)))
        start = F.struct(v.alias("v"), starts.alias("starts"), F.lit(1).alias("t"))
        last = lambda a: F.struct(F.get(a["v"], states - 1).alias("score"), F.get(a["starts"], states - 1).alias("starts"))
        found = F.aggregate(F.slice(e, F.lit(2), F.size(e)), start, add, last)
        nothing = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("starts"))
        return F.when((F.size(e) > 0) & (F.size(e) >= states) & (states > 0), found).otherwise(nothing)

    return F.get(F.transform(F.array(emission), best), F.lit(0))  # an array of one, so that emission is worked out once, however often it is read


def log_normal(x: Column, mean: Column, var: Column) -> Column:
    """Log-density of a vector under a diagonal Gaussian."""
    terms = F.zip_with(F.zip_with(x, mean, lambda a, m: (a - m) * (a - m)), var, lambda d, v: F.log(v) + d / v + F.lit(log(2 * pi)))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) * F.lit(-0.5)


def emissions(frames: Column, models: Column) -> Column:
    """emission[frame][state] for an array of struct(mean, var)."""
    return F.transform(frames, lambda f: F.transform(models, lambda m: log_normal(f, m["mean"], m["var"])))


def distributions(emission: Column, starts: Column, tail: int = 0) -> Column:
    """array of struct(offset, log_probs), one for each state: its log-probabilities over its frames and ``tail`` more on both sides, without impossible ones; offset is the first frame of these, null
    if there is none."""
    n = F.size(emission)

    def of(start: Column, s: Column) -> Column:
        stop = F.coalesce(F.get(starts, s + 1), n)
        frames = F.filter(F.sequence(F.greatest(start - tail, F.lit(0)), F.least(stop - 1 + tail, n - 1)), lambda t: F.get(F.get(emission, t), s) > LOWEST)
        return F.struct(F.get(frames, F.lit(0)).alias("offset"), F.transform(frames, lambda t: F.get(F.get(emission, t), s)).alias("log_probs"))

    return F.transform(starts, of)


def _statistics(assigned: DataFrame, least_variance: float) -> DataFrame:
    """state, n, mean, var, score from frames with their states (state, x) and the score of their path (at its first frame, else 0)."""
    x = F.posexplode("x").alias("i", "x")
    dims = assigned.select("state", "score", x).groupBy("state", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("score").alias("score"))
    mean = F.col("s") / F.col("n")
    part = dims.select("state", "n", "score", F.struct("i", mean.alias("m"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(least_variance)).alias("v")).alias("d"))
    whole = part.groupBy("state").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("d")).alias("d"), F.min("score").alias("score"))
    return whole.select("state", "n", F.col("d.m").alias("mean"), F.col("d.v").alias("var"), "score")


def align(utterances: DataFrame, model: DataFrame) -> DataFrame:
    """``utterances`` with ``score`` and ``starts`` under a model; score is null where there is no path or the model lacks a state."""
    one = model.agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("mean", "var")))).alias("model"))  # bounded by the number of phones
    met = utterances.crossJoin(F.broadcast(one)).withColumn("own", F.transform("states", lambda s: F.try_element_at("model", s)))
    path = viterbi(emissions(F.col("frames"), F.col("own")))
    known = F.forall("own", lambda m: m.isNotNull()) & (F.size("states") > 0)
    found = met.withColumn("path", F.explode(F.array(F.when(known, path))))  # a generator: filters stay above it, in a projection they would find the path again
    return found.select(*utterances.columns, "path.score", F.coalesce("path.starts", F.array().cast("array<int>")).alias("starts"))


def by_state(aligned: DataFrame) -> DataFrame:
    """state, x, score: every frame of aligned utterances with its state; the path's score stands beside its first frame, 0 beside others."""
    runs = aligned.select("frames", "states", "starts", "score", F.posexplode("starts").alias("s", "start"))
    stop = F.coalesce(F.get("starts", F.col("s") + 1), F.size("frames"))
    run = F.slice("frames", F.col("start") + 1, stop - F.col("start"))
    t = runs.select(F.get("states", F.col("s")).alias("state"), "start", "score", F.posexplode(run).alias("t", "x"))
    return t.select("state", "x", F.when(F.col("start") + F.col("t") == 0, F.col("score")).otherwise(0.0).alias("score"))


def train(utterances: DataFrame, rounds: int = 10, least_gain: float = 1e-6, least_variance: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """A model of the states of ``utterances`` and the score of all paths in each round, which never falls: starts from equal shares of the frames, then aligns and updates until a round gains less than
    ``least_gain`` of the score's size. Utterances with fewer frames than states, or with nulls in frames, take no part. What does is stored once, a round is one pass over it; each round's
    model is cut from its lineage, and the score alone reaches the driver."""
    bad = F.exists("frames", lambda f: f.isNull() | F.exists(f, lambda x: x.isNull() | F.isnan(x)))
    use = stored(utterances.where((F.size("states") > 0) & (F.size("frames") >= F.size("states")) & ~bad).select("frames", "states"))
    equal = F.transform("states", lambda _, s: F.floor((s * F.size("frames") + F.size("states") - 1) / F.size("states")).cast("int"))
    model, scores = checkpointed(_statistics(by_state(use.withColumn("starts", equal).withColumn("score", F.lit(0.0))), least_variance)), []
    for _ in range(rounds):
        new = checkpointed(_statistics(by_state(align(use, model)), least_variance))
        score = new.agg(F.sum("score")).first()[0]
        if score is None:
            break
        done = bool(scores) and score - scores[-1] < least_gain * abs(scores[-1])
        model = new
        scores.append(score)
        if done:
            break
    return model.drop("score"), scores


def of_segments(segments: DataFrame, frames: DataFrame, size: int, shift: int) -> DataFrame:
    """Features by phone: ``segments`` (file, start, end in samples, phone, ...) with every frame (file, frame, features) that lies wholly in one, found by arithmetic and an equality join."""
    first, last = F.ceil(F.col("start") / shift), F.floor((F.col("end") - size) / shift)
    cut = segments.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    return cut.join(frames.select("file", "frame", "features"), ["file", "frame"])
