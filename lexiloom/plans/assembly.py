"""Queries that assemble segments of recordings. A user's events are the markers of a file, four samples apart; samples are made from the events' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import assembly
from lexiloom.plans.catalogue import query, table
from lexiloom.streaming import edits

GAP, SIZE, LEAST = 4, 16, 12

#: Markers, samples of each file in one list, words, segments and what they cover, as DuckDB has them.
_SQL = """
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
m AS MATERIALIZED (SELECT user_id AS file, event_id AS id, 4 * i AS "at", i + 1 AS pos, CASE WHEN value < 12 THEN 'phone' ELSE 'word' END AS level,
  CASE event_type WHEN 'error' THEN '<sil>' WHEN 'signup' THEN CASE WHEN value < 12 THEN '_s' ELSE '[sp]' END WHEN 'view' THEN CASE WHEN value < 6 THEN '_ignore' ELSE 'one [sp] two' END WHEN 'purchase' THEN 'word _s <sil> last' ELSE '' END AS text FROM e),
x AS MATERIALIZED (SELECT user_id AS file, list(CAST(floor(value * 40) AS BIGINT) + k ORDER BY i, k) AS xs FROM e, range(4) t(k) GROUP BY user_id),
n AS MATERIALIZED (SELECT *, lag(id) OVER w AS i0, lag("at") OVER w AS a0, lag(text) OVER w AS t0, lead(id) OVER w AS i1, lead("at") OVER w AS a1, lead(text) OVER w AS t1, lead(pos) OVER w AS p1,
  lead(id, 2) OVER w AS i2, lead("at", 2) OVER w AS a2, lead(pos, 2) OVER w AS p2 FROM m WHERE level = 'word' WINDOW w AS (PARTITION BY file ORDER BY "at", id)),
s AS MATERIALIZED (SELECT file, id, pos, text, CASE WHEN t0 IN ('<sil>', '[sp]') THEN i0 ELSE id END AS start_id, CASE WHEN t0 IN ('<sil>', '[sp]') THEN "at" - a0 ELSE 0 END AS before,
  CASE WHEN t1 IN ('<sil>', '[sp]') AND i2 IS NOT NULL THEN i2 ELSE i1 END AS end_id, CASE WHEN t1 IN ('<sil>', '[sp]') AND i2 IS NOT NULL THEN a2 - a1 ELSE 0 END AS after,
  CASE WHEN t1 IN ('<sil>', '[sp]') AND i2 IS NOT NULL THEN p2 ELSE p1 END AS stop FROM n WHERE text NOT IN ('', '<sil>', '[sp]') AND i1 IS NOT NULL),
g AS MATERIALIZED (SELECT *, lead("at") OVER v AS until, lead(level) OVER v AS nl FROM m WINDOW v AS (PARTITION BY file ORDER BY "at", id)),
b AS MATERIALIZED (SELECT s.file, s.id, flatten(list(xs[g."at" + 1 : g.until] ORDER BY g.pos)) AS body FROM s JOIN g ON s.file = g.file AND g.pos >= s.pos AND g.pos < s.stop JOIN x ON x.file = s.file
  WHERE NOT (g.level = 'phone' AND g.nl = 'phone' AND g.text IN ('_s', '_ignore')) GROUP BY s.file, s.id)"""


def _numbered(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w) - 1)


def _markers(spark, sf_dir) -> DataFrame:
    kind, low = F.col("event_type"), F.col("value") < 12
    text = (
        F.when(kind == "error", "<sil>").when(kind == "signup", F.when(low, "_s").otherwise("[sp]")).when(kind == "view", F.when(F.col("value") < 6, "_ignore").otherwise("one [sp] two"))
        .when(kind == "purchase", "word _s <sil> last").otherwise("")
    )
    level = F.when(low, "phone").otherwise("word")
    return _numbered(spark, sf_dir).select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), (F.col("i") * GAP).alias("at"), level.alias("level"), text.alias("text"), "event_type")


def _pieces(spark, sf_dir) -> DataFrame:
    e = _numbered(spark, sf_dir).select("user_id", "i", F.floor(F.col("value") * 40).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(GAP - 1))).alias("k"))
    return assembly.cut(e.select("user_id", (F.col("i") * GAP + F.col("k")).alias("n"), (F.col("x") + F.col("k")).alias("x")), "user_id", "n", "x", SIZE)


def _digest(column: str):
    return F.md5(F.array_join(F.transform(column, lambda v: v.cast("string")), ",").cast("binary"))


@query(f"""WITH {_SQL} SELECT s.file, s.id, start_id, end_id, before, after, array_to_string(list_filter(string_split(text, ' '), lambda w: w NOT IN ('[sp]', '<sil>', '_s')), ' ') AS text,
CAST(coalesce(len(body), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(body, ','), '')) AS samples FROM s LEFT JOIN b USING (file, id)""")
def whole_segments(spark, sf_dir):
    """Segments with flanks, without pauses and what is to be ignored, and their samples."""
    segments, intervals = assembly.whole(_markers(spark, sf_dir))
    got = segments.join(assembly.read(intervals, _pieces(spark, sf_dir), ["file", "id"], SIZE), ["file", "id"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<bigint>")))
    return got.select("file", "id", "start_id", "end_id", "before", "after", assembly.transcript(F.col("text")).alias("text"), F.size("samples").alias("n"), _digest("samples").alias("samples"))


_BUILT = f"""{_SQL},
q AS MATERIALIZED (SELECT file, id, "at", "at" + (until - "at") * 3 // 10 AS start, (until - "at") * 4 // 10 AS n FROM g WHERE text = '<sil>' AND until IS NOT NULL),
pool AS MATERIALIZED (SELECT q.file, flatten(list(xs[start + 1 : start + n] ORDER BY q."at", q.id)) AS ps FROM q JOIN x ON x.file = q.file WHERE n > 0 GROUP BY q.file),
need AS MATERIALIZED (SELECT file, id, 0 AS side, 12 - least(12, before) AS n FROM s UNION ALL SELECT file, id, 1, 12 - least(12, after) FROM s),
draw AS MATERIALIZED (SELECT file, id, side, unnest(range((n + long - 1) // long)) AS draw, n, long, ps FROM (SELECT need.*, least(n, len(ps)) AS long, ps FROM need JOIN pool USING (file) WHERE n > 0)),
take AS MATERIALIZED (SELECT *, least(long, n - draw * long) AS k FROM draw),
pads AS MATERIALIZED (SELECT file, id, side, flatten(list(ps[f + 1 : f + k] ORDER BY draw)) AS pad FROM (SELECT *, CAST('0x' || left(md5('7:' || file || ':' || id || ':' || side || ':' || draw), 15) AS BIGINT) % (len(ps) - k + 1) AS f FROM take) GROUP BY file, id, side),
built AS MATERIALIZED (SELECT s.file, s.id, CAST([] AS BIGINT[]) || coalesce(a.pad, []) || coalesce(b.body, []) || coalesce(c.pad, []) AS samples, CAST(coalesce(len(b.body), 0) AS BIGINT) AS n_speech,
  24 - least(12, before) - least(12, after) - coalesce(len(a.pad), 0) - coalesce(len(c.pad), 0) AS missing
  FROM s LEFT JOIN b USING (file, id) LEFT JOIN pads a ON a.file = s.file AND a.id = s.id AND a.side = 0 LEFT JOIN pads c ON c.file = s.file AND c.id = s.id AND c.side = 1)"""


def _built(spark, sf_dir, **options) -> DataFrame:
    markers, pieces = _markers(spark, sf_dir), _pieces(spark, sf_dir)
    segments, intervals = assembly.whole(markers)
    return assembly.build(segments, intervals, markers, pieces, LEAST, seed=7, size=SIZE, **options)


@query(f"WITH {_BUILT} SELECT file, id, CAST(len(samples) AS INTEGER) AS n, n_speech, CAST(missing AS BIGINT) AS missing, md5(array_to_string(samples, ',')) AS samples FROM built")
def wav_segments(spark, sf_dir):
    """Segments padded with silence that is drawn from their file."""
    return _built(spark, sf_dir).select("file", "id", F.size("samples").alias("n"), "n_speech", "missing", _digest("samples").alias("samples"))


@query(f"""WITH {_BUILT} SELECT event_type AS speaker, round(sum(len(samples)) / 8000.0, 6) AS seconds, round(sum(n_speech) / 8000.0, 6) AS speech_seconds FROM built JOIN events e ON e.event_id = built.id GROUP BY event_type""")
def wav_durations(spark, sf_dir):
    """Seconds that were built by speaker, with and without padding."""
    d = assembly.durations(_built(spark, sf_dir).withColumnRenamed("event_type", "speaker"), ["speaker"], 8000.0)
    return d.select("speaker", F.round("seconds", 6).alias("seconds"), F.round("speech_seconds", 6).alias("speech_seconds"))


@query(f"""WITH {_SQL}, f AS (SELECT file, id, body, unnest(range(len(body) // 8)) AS k FROM b),
a AS (SELECT file, id, k, body[8 * k + 1 : 8 * k + 8] AS part, list_sum([pow(v / 32768.0, 2) for v in body[8 * k + 1 : 8 * k + 8]]) / 8 AS power FROM f),
c AS (SELECT file, id, flatten(list(part ORDER BY k)) AS spoken FROM a WHERE NOT (coalesce(log10(nullif(power, 0)), -99) / -7 > 0.6634) GROUP BY file, id)
SELECT s.file, s.id, CAST(coalesce(len(spoken), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(spoken, ','), '')) AS samples FROM s LEFT JOIN c USING (file, id)""")
def spoken_segments(spark, sf_dir):
    """Segments of which only the frames stay in which somebody speaks."""
    got = _built(spark, sf_dir, vad=8, pad_start=False, pad_end=False)
    return got.select("file", "id", F.size("samples").alias("n"), _digest("samples").alias("samples"))


@query("""WITH l AS (SELECT user_id % 40 AS file, ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'move' ELSE 'insert' END AS op,
  CASE WHEN event_type = 'signup' THEN event_id ELSE event_id % 9 END AS marker, CAST(floor(value * 100) AS BIGINT) AS "at", event_type AS text FROM events),
g AS (SELECT *, max(CASE WHEN op = 'delete' THEN struct_pack(ts := ts, seq := seq) END) OVER (PARTITION BY file, marker) AS gone FROM l),
h AS (SELECT *, min(CASE WHEN op = 'insert' THEN struct_pack(ts := ts, seq := seq) END) OVER (PARTITION BY file, marker) AS made FROM g WHERE gone IS NULL OR struct_pack(ts := ts, seq := seq) > gone),
k AS (SELECT *, struct_pack(ts := ts, seq := seq) AS t FROM h)
SELECT file, marker, max_by("at", t) AS "at", min_by(text, t) AS text FROM k WHERE t = made OR (op = 'move' AND t > made) GROUP BY file, marker""")
def marker_edits(spark, sf_dir):
    """Markers after a log of insertions, deletions and moves; 40 files, a few markers of which are edited again and again."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind.isin("click", "purchase"), "move").otherwise("insert")
    log = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("file"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.when(kind != "signup", F.col("event_id") % 9).alias("marker"), F.floor(F.col("value") * 100).alias("at"),
        F.lit("word").alias("level"), kind.alias("text"),
    )
    return edits.replay(log).select("file", "marker", "at", "text")
