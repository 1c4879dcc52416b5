"""Queries that train on the given tables: alignments with trained states, neural classifiers. Some have no SQL; the tests compare them with enumeration and with other models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import alignment, classify, recordings, speech
from lexiloom.plans.catalogue import query, table

_SEGMENTS = """e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS MATERIALIZED (SELECT user_id, i // 64 AS segment, list(value ORDER BY i) AS x FROM e GROUP BY 1, 2),
m AS MATERIALIZED (SELECT user_id, segment, [[-((v - 5.0) * (v - 5.0)), -((v - 50.0) * (v - 50.0)), -((v - 5.0) * (v - 5.0))] for v in x] AS e FROM g),
r(user_id, segment, t, v, moved, e) AS (SELECT user_id, segment, 1, [e[1][1], CAST('-inf' AS DOUBLE), CAST('-inf' AS DOUBLE)], CAST([] AS BOOLEAN[][]), e FROM m WHERE len(e) >= 3 UNION ALL
  SELECT user_id, segment, t + 1, [v[1] + e[t + 1][1], greatest(v[2], v[1]) + e[t + 1][2], greatest(v[3], v[2]) + e[t + 1][3]], list_append(moved, [false, v[1] > v[2], v[2] > v[3]]), e FROM r WHERE t < len(e)),
b(user_id, segment, t, s, starts, moved) AS (SELECT user_id, segment, t - 1, 3, CAST([] AS INTEGER[]), moved FROM r WHERE t = len(e) UNION ALL
  SELECT user_id, segment, t - 1, CASE WHEN moved[t][s] THEN s - 1 ELSE s END, CASE WHEN moved[t][s] THEN list_prepend(CAST(t AS INTEGER), starts) ELSE starts END, moved FROM b WHERE t > 0),
p AS MATERIALIZED (SELECT m.user_id, m.segment, m.e, r.v[3] AS score, CASE WHEN b.t = 0 THEN list_prepend(0, b.starts) ELSE [] END AS starts FROM m LEFT JOIN r ON r.user_id = m.user_id AND r.segment = m.segment AND r.t = len(m.e)
  LEFT JOIN b ON b.user_id = m.user_id AND b.segment = m.segment AND b.t = 0)"""


def _paths(spark, sf_dir):
    cut = speech.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 64)
    level = lambda v, c: -((v - c) * (v - c))
    emission = F.transform("samples", lambda v: F.array(level(v, 5.0), level(v, 50.0), level(v, 5.0)))
    return cut.select("user_id", "segment", emission.alias("e")).withColumn("a", alignment.viterbi(F.col("e")))


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT user_id, segment, round(score, 6) AS score, array_to_string(starts, ' ') AS starts FROM p")
def viterbi_align(spark, sf_dir):
    """three levels aligned with segments of 64 values; a segment of fewer than three values has no path."""
    return _paths(spark, sf_dir).select("user_id", "segment", F.round("a.score", 6).alias("score"), F.array_join("a.starts", " ").alias("starts"))


@query(f"""WITH RECURSIVE {_SEGMENTS}, q AS (SELECT user_id, segment, e, starts, unnest([1, 2, 3]) AS s FROM p WHERE len(starts) = 3),
w AS (SELECT *, greatest(starts[s] - 2, 0) AS f, least(CASE WHEN s < 3 THEN starts[s + 1] ELSE len(e) END + 1, len(e) - 1) AS l FROM q)
SELECT user_id, segment, CAST(s - 1 AS INTEGER) AS state, CAST(f AS INTEGER) AS "offset", CAST(l - f + 1 AS INTEGER) AS n, round(list_sum([z[s] for z in e[f + 1 : l + 1]]), 6) AS total FROM w""")
def state_distributions(spark, sf_dir):
    """log-probabilities of each state over its frames and two more on both sides."""
    d = _paths(spark, sf_dir).select("user_id", "segment", F.posexplode(alignment.distributions(F.col("e"), F.col("a.starts"), 2)).alias("state", "d"))
    return d.select("user_id", "segment", "state", "d.offset", F.size("d.log_probs").alias("n"), F.round(F.aggregate("d.log_probs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def trained_states(spark, sf_dir):
    """F13, F14 with trained states: Gaussians of four states after rounds of alignment over each user's values; users differ in the order of their states."""
    cut = speech.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 32)
    names = F.when(F.col("user_id") % 3 == 0, F.array(*map(F.lit, ["sil", "a", "sil"]))).when(F.col("user_id") % 3 == 1, F.array(*map(F.lit, ["a", "o", "sil"]))).otherwise(F.array(*map(F.lit, ["sil", "k", "a", "k"])))
    frames = F.transform("samples", lambda v: F.array(v))
    model, _ = alignment.train(cut.select(frames.alias("frames"), names.alias("states")), rounds=6)
    return model.select("state", "n", F.round(F.get("mean", F.lit(0)), 6).alias("mean"), F.round(F.get("var", F.lit(0)), 6).alias("var"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type, value FROM events),
f AS (SELECT user_id, i // 2 AS frame, sum(value) AS x FROM p GROUP BY ALL),
s AS (SELECT user_id, event_type AS phone, 4 * i AS start, 4 * i + CAST(floor(value) AS BIGINT) % 23 AS stop FROM p),
c AS (SELECT user_id, phone, unnest(range((start + 7) // 8, (stop - 10) // 8 + 1)) AS frame FROM s WHERE stop >= 10 AND (start + 7) // 8 <= (stop - 10) // 8)
SELECT phone, count(*) AS n, round(avg(x), 6) AS mean FROM c JOIN f USING (user_id, frame) GROUP BY phone""")
def features_by_phone(spark, sf_dir):
    """M9: frames of 10 samples every 8 that lie wholly within a phone's segment, with their features, by phone. A frame's feature is the sum of two values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    frames = p.groupBy(F.col("user_id").alias("file"), F.floor(F.col("i") / 2).alias("frame")).agg(F.sum("value").alias("features"))
    segments = p.select(F.col("user_id").alias("file"), F.col("event_type").alias("phone"), (F.col("i") * 4).alias("start"), (F.col("i") * 4 + F.floor("value") % 23).alias("end"))
    return alignment.of_segments(segments, frames, 10, 8).groupBy("phone").agg(F.count("*").alias("n"), F.round(F.avg("features"), 6).alias("mean"))


@query()
def neural_classes(spark, sf_dir):
    """A perceptron's hits by label on the test part, and labels among its three best."""
    found, _ = classify.best_network(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", [[32], [64, 32]])
    top = recordings.in_top(F.col("scores"), F.col("label_at"), 3)
    return found.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("best") == F.col("label").cast("string")).cast("long")).alias("correct"), F.sum(top.cast("long")).alias("among_three"))
