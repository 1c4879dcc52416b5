"""Queries on annotated recordings. Events stand for markers and samples: a user is a file, the type is the text, the value the sample or its level."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import phonetics, signal
from lexiloom.functions import text as T
from lexiloom.operators import corpus, intervals, recordings
from lexiloom.plans.catalogue import WORDS, query, table
from lexiloom.plans.speech import _DISTINCT, cyrillic_words
from lexiloom.sources import sinks

_M = """m AS (SELECT event_id AS id, user_id, ts, event_id AS "at", CASE WHEN value < 30 THEN 'phone' ELSE 'word' END AS level,
CASE event_type WHEN 'error' THEN '<sil>' WHEN 'signup' THEN '[inh]' WHEN 'view' THEN '_s' WHEN 'purchase' THEN 'a#b' WHEN 'click' THEN CASE WHEN event_id % 7 > 0 THEN 'click' END END AS text,
CASE WHEN event_id % 3 = 0 THEN 'uk' WHEN event_id % 3 = 1 THEN 'ru' END AS language, CASE WHEN event_id % 4 > 0 THEN 's' || (user_id % 5) END AS speaker FROM events)"""
_W = "(PARTITION BY user_id ORDER BY ts, id)"


def markers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    text = F.when(kind == "error", "<sil>").when(kind == "signup", "[inh]").when(kind == "view", "_s").when(kind == "purchase", "a#b").when((kind == "click") & (F.col("event_id") % 7 > 0), "click")
    return e.select(
        F.col("event_id").alias("id"), "user_id", "ts", F.col("event_id").alias("at"), F.when(F.col("value") < 30, "phone").otherwise("word").alias("level"), text.alias("text"),
        F.when(F.col("event_id") % 3 == 0, "uk").when(F.col("event_id") % 3 == 1, "ru").alias("language"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("s"), F.col("user_id") % 5)).alias("speaker"),
    )


@query(f"""WITH {_M}, r AS (SELECT id, unnest([
CASE WHEN level = 'phone' AND language IS NOT NULL THEN 'phone with a language' END, CASE WHEN level = 'phone' AND speaker IS NOT NULL THEN 'phone with a speaker' END,
CASE WHEN level = 'word' AND text IS NULL AND language IS NOT NULL THEN 'no text, but a language' END, CASE WHEN level = 'word' AND text IS NULL AND speaker IS NOT NULL THEN 'no text, but a speaker' END,
CASE WHEN level = 'word' AND text = '<sil>' AND language IS NOT NULL THEN 'silence with a language' END, CASE WHEN level = 'word' AND text = '<sil>' AND speaker IS NOT NULL THEN 'silence with a speaker' END,
CASE WHEN level = 'word' AND text = '[inh]' AND language IS NOT NULL THEN 'inhale with a language' END, CASE WHEN level = 'word' AND text = '[inh]' AND speaker IS NULL THEN 'inhale without a speaker' END,
CASE WHEN level = 'word' AND text NOT IN ('<sil>', '[inh]') AND language IS NULL THEN 'text without a language' END, CASE WHEN level = 'word' AND text NOT IN ('<sil>', '[inh]') AND speaker IS NULL THEN 'text without a speaker' END,
CASE WHEN level = 'word' AND text NOT IN ('<sil>', '[inh]') AND speaker = 's4' THEN 'text with an unknown speaker' END]) AS message FROM m) SELECT id, message FROM r WHERE message IS NOT NULL""")
def marker_rules(spark, sf_dir):
    """All eleven rules."""
    m = markers(spark, sf_dir)
    return recordings.broken_rules(m, m.where("speaker <> 's4'").select("speaker"))


@query(f"""WITH {_M}, f AS (SELECT user_id FROM events GROUP BY user_id HAVING NOT avg(value) > 50), w AS (SELECT *, lead(id) OVER {_W} AS end_id FROM m WHERE level = 'word')
SELECT user_id, id, end_id, text, language FROM w JOIN f USING (user_id) WHERE end_id IS NOT NULL AND text IS NOT NULL AND text NOT LIKE '%#%' AND (language = 'uk' OR text = '[inh]')""")
def trainable_segments(spark, sf_dir):
    """Segments between word markers of files that are quiet enough."""
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("noise_db"))
    words = markers(spark, sf_dir).where("level = 'word'").withColumnRenamed("id", "event_id")
    found = intervals.segments(words).join(recordings.quiet_files(files, 50.0).select("user_id"), "user_id", "left_semi")
    return recordings.trainable(found).select("user_id", F.col("event_id").alias("id"), "end_id", "text", "language")


@query(f"""WITH {_M}, n AS (SELECT *, lead("at") OVER {_W} AS until, lead(level) OVER {_W} AS nl FROM m) SELECT id, "at", until FROM n WHERE until IS NOT NULL AND NOT coalesce(level = 'phone' AND nl = 'phone' AND text IN ('_s', '_ignore'), false)""")
def spoken_spans(spark, sf_dir):
    """spans without pauses."""
    return recordings.without_silence(markers(spark, sf_dir), "user_id", ["ts", "id"]).select("id", "at", "until")


@query("""WITH a AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS frame FROM events),
f AS (SELECT user_id, frame, NOT (coalesce(log10(avg(pow(value * 20 / 32768, 2))), -99) / -7 > 0.6634) AS active FROM a GROUP BY user_id, frame HAVING count(*) = 4),
g AS (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY user_id ORDER BY frame) IS NOT DISTINCT FROM active THEN 0 ELSE 1 END AS new FROM f), h AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS run FROM g)
SELECT user_id, run, any_value(active) AS active, min(frame) AS first, max(frame) AS last, count(*) AS n FROM h GROUP BY user_id, run""")
def voice_activity(spark, sf_dir):
    """Runs of frames by energy."""
    return recordings.energy_activity(table(spark, sf_dir, "events").withColumn("value", F.col("value") * 20), "user_id", ["ts", "event_id"], "value", size=4)


@query("""WITH a AS (SELECT user_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(abs(value)) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS large, avg(abs(value)) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS little
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, min(little) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS least FROM a WHERE i % 2 = 0),
f AS (SELECT user_id, i // 2 AS frame, large < 18 AND least < 12 AS active FROM b WHERE i + 8 <= n),
g AS (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY user_id ORDER BY frame) IS NOT DISTINCT FROM active THEN 0 ELSE 1 END AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM g)
SELECT user_id, min(frame) * 2 + 2 AS "left", max(frame) * 2 + 6 AS "right" FROM h WHERE active GROUP BY user_id, run""")
def silence_marks(spark, sf_dir):
    """markers around silence."""
    return recordings.silence_marks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 8, 2, 4, 18.0, 12.0)


@query("""WITH s AS (SELECT user_id, ts, event_id AS "at", CASE WHEN value < 5 THEN '?' WHEN value > 60 THEN '7' || event_type ELSE (CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'e' END) || CAST(event_id % 3 AS VARCHAR) END AS name FROM events),
p AS (SELECT *, nullif(regexp_extract(name, '^[A-Za-z]+'), '') AS phone FROM s), q AS (SELECT *, CASE WHEN lag(phone) OVER w = phone THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, "at")),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, "at") AS BIGINT) AS run FROM q) SELECT user_id, run, coalesce(min(phone), min(name)) AS phone, min("at") AS first, max("at") AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def merged_states(spark, sf_dir):
    """F10."""
    short = F.concat(F.when(F.col("event_type").isin("view", "click"), "a").otherwise("e"), (F.col("event_id") % 3).cast("string"))
    name = F.when(F.col("value") < 5, "?").when(F.col("value") > 60, F.concat(F.lit("7"), "event_type")).otherwise(short)
    return recordings.merged_states(table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("at"), name.alias("name")), "user_id", ["ts", "at"])


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark), r AS (SELECT item_id, word, i, CASE WHEN length(word) > 5 THEN 2 ELSE 1 END AS n FROM w),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY item_id ORDER BY i) AS BIGINT) AS upto, row_number() OVER (PARTITION BY item_id ORDER BY i) AS run FROM r) SELECT item_id, run, word, upto - n AS first, upto - 1 AS last FROM p""")
def merged_parts(spark, sf_dir):
    """words cut in two and joined again."""
    cut = F.transform(F.split("text", " "), lambda w: F.when(F.length(w) > 5, F.array(F.concat(w.substr(1, 3), F.lit("~")), F.concat(F.lit("~"), w.substr(F.lit(4), F.length(w))))).otherwise(F.array(w)))
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.flatten(cut)).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))
    return recordings.merged_parts(parts, ["item_id"])


@query("""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: CASE WHEN x IN ('la', 'in', 'un') THEN '[inh]' WHEN length(x) > 9 THEN '</s>' ELSE x END) AS l FROM conversations),
p AS (SELECT *, len(l) - coalesce(nullif(list_position(list_reverse(l), '[inh]'), 0), len(l) + 1) + 1 AS inh, len(l) - coalesce((list_filter(range(1, len(l) + 1), lambda i: list_reverse(l)[i] <> '</s>'))[1], len(l) + 1) AS plain FROM w)
SELECT conv_id, turn, CAST(CASE WHEN len(l) <= 1 THEN len(l) WHEN inh > 0 THEN inh ELSE greatest(plain, 0) END AS INTEGER) AS n FROM p""")
def accepted_words(spark, sf_dir):
    """F16: how many words of an utterance are kept."""
    words = F.transform(F.split("text", " "), lambda x: F.when(x.isin("la", "in", "un"), "[inh]").when(F.length(x) > 9, "</s>").otherwise(x))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(recordings.accepted(words)).alias("n"))


@query(f"WITH {_M}, s AS (SELECT id, text, \"at\", lead(\"at\") OVER {_W} AS until FROM m) SELECT id, \"at\" + 3 * (until - \"at\") // 10 AS start, \"at\" + 7 * (until - \"at\") // 10 AS \"end\" FROM s WHERE text = '<sil>' AND until > \"at\"")
def silence_pool(spark, sf_dir):
    """the middle 40 per cent of silences."""
    m = markers(spark, sf_dir).withColumn("until", F.lead("at").over(intervals.order("user_id", "ts", "id"))).where("text = '<sil>' AND until > at")
    return m.selectExpr("id", "at + 3 * (until - at) div 10 AS start", "at + 7 * (until - at) div 10 AS end")


@query("SELECT event_type AS speaker, round(sum(value) / 3600, 6) AS hours FROM events GROUP BY ALL ORDER BY hours DESC, speaker")
def speaker_hours(spark, sf_dir):
    """Speakers by hours, the longest first."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("speaker")).agg(F.round(F.sum("value") / 3600, 6).alias("hours")).orderBy(F.desc("hours"), "speaker")


@query("SELECT 'speaker ' || event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'all', count(*) FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events")
def run_stats(spark, sf_dir):
    """Statistics of a run as names and values."""
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("speaker "), "event_type").alias("name"), "n")
    return by.unionByName(e.agg(F.count("*").alias("n")).select(F.lit("all").alias("name"), "n")).unionByName(e.agg(F.countDistinct("user_id").alias("n")).select(F.lit("users").alias("name"), "n"))


@query("SELECT label, count(*) AS n, CAST(sum(CASE WHEN len(list_filter(range(1, 11), lambda i: embedding[i] > embedding[label + 1] OR (embedding[i] = embedding[label + 1] AND i < label + 1))) < 3 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM embeddings GROUP BY label")
def topn_accuracy(spark, sf_dir):
    """Rows whose label is among the three largest scores (the first ten components), by label."""
    hit = recordings.in_top(F.slice("embedding", 1, 10), F.col("label"), 3)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))


@query("WITH r AS (SELECT event_id AS id, event_id + 5 AS to_id, event_id % 3 + 1 AS times FROM events WHERE event_id % 10 = 0) SELECT id, CAST(unnest(range(1, times + 1)) AS INTEGER) AS nth, a.value AS start, b.value AS \"end\" FROM r JOIN events a ON a.event_id = r.id JOIN events b ON b.event_id = to_id")
def recipe_ranges(spark, sf_dir):
    """P10: ranges that a recipe names; a tenth of the events has a line."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("f.wav;"), "event_id", F.lit("-"), F.col("event_id") + 5, F.lit(";R"), F.col("event_id") % 3 + 1, F.lit(" # note;1-2"))
    return recordings.recipe_ranges(e.where("event_id % 10 = 0").select(F.col("event_id").alias("id"), line.alias("line")), e.select(F.col("event_id").alias("marker"), F.col("value").alias("at")))


@query(f"WITH {_M} SELECT id, coalesce(language, 'uk') AS language FROM m WHERE level = 'word' AND text IS NOT NULL UNION ALL SELECT id, language FROM m WHERE level <> 'word' OR text IS NULL")
def language_backfill(spark, sf_dir):
    """Word markers with text get the usual language where they have none."""
    needs = (F.col("level") == "word") & F.col("text").isNotNull()
    return markers(spark, sf_dir).select("id", F.when(needs, F.coalesce("language", F.lit("uk"))).otherwise(F.col("language")).alias("language"))


@query("SELECT event_id, (event_id % 50) * 160 AS start, (event_id % 50 + 3) * 160 + 400 AS e1, (event_id % 50 + 4) * 160 AS e2, ((event_id % 50 + 3) * 160 + 400 + (event_id % 50 + 4) * 160) // 2 AS e3, CAST(trunc(event_id / 160) AS INTEGER) AS seconds FROM events")
def frame_samples(spark, sf_dir):
    """Samples of frames with three ends, whole seconds."""
    first = F.col("event_id") % 50
    of = lambda ends: recordings.frame_samples(first, first + 3, 400, 160, ends)
    return table(spark, sf_dir, "events").select("event_id", of("last")["start"].alias("start"), of("last")["end"].alias("e1"), of("next")["end"].alias("e2"), of("middle")["end"].alias("e3"), (F.col("event_id") / 160).cast("int").alias("seconds"))


@query("SELECT vec_id, CAST(len(embedding) + 15 AS INTEGER) AS n, len(embedding) // 13 AS frames, len(embedding) % 13 = 0 AS whole, round(CAST(embedding[1] AS DOUBLE), 6) AS eleventh FROM embeddings")
def padded_vectors(spark, sf_dir):
    """Zeros on both sides; whole feature vectors of 13."""
    p, n = recordings.padded(F.col("embedding"), 10, 5), F.size("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(p).alias("n"), F.floor(n / 13).alias("frames"), (n % 13 == 0).alias("whole"), F.round(F.get(p, F.lit(10)), 6).alias("eleventh"))


@query("SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (pow(10, value / 2595) - 1), 6) AS hertz FROM events")
def mel_scale(spark, sf_dir):
    """M2."""
    return table(spark, sf_dir, "events").select("event_id", F.round(signal.mel(F.col("value")), 6).alias("mel"), F.round(signal.mel_inverse(F.col("value")), 6).alias("hertz"))


@query("""SELECT doc_id, CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'validation' ELSE 'test' END AS part, (h * 7919) % 1000 AS start FROM (SELECT doc_id, CAST('0x' || left(md5('split:' || doc_id), 8) AS BIGINT) % 100 AS h FROM documents)""")
def three_way_split(spark, sf_dir):
    """L3, L4: 60, 20 and 20 per cent by a hash of the key, and a start that is drawn by it."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 60, "train").when(h < 80, "validation").otherwise("test").alias("part"), ((h * 7919) % 1000).alias("start"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)[^/0-9]*', 1), '') AS BIGINT) AS sound_id, lpad(CAST(page_id AS VARCHAR), 5, '0') || '-' || lpad(CAST(page_id + 7 AS VARCHAR), 5, '0') AS name FROM pages")
def sound_names(spark, sf_dir):
    """Numbers in file names, names of segments."""
    pad = lambda c: F.lpad(c.cast("string"), 5, "0")
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)[^/0-9]*", 1), F.lit("")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", number.alias("sound_id"), F.concat(pad(F.col("page_id")), F.lit("-"), pad(F.col("page_id") + 7)).alias("name"))


@query(f"""{_DISTINCT} SELECT word, replace(replace(replace(replace(translate(word, 'абгдеіклмнопрстуфхцзєив', 'abhdeiklmnoprstufhczeyv'), 'ж', 'zh'), 'ш', 'sh'), 'ю', 'ju'), 'я', 'ja') AS latin FROM w""")
def transliterated(spark, sf_dir):
    """Words in Ukrainian letters in Latin ones again."""
    return cyrillic_words(spark, sf_dir).select("word", T.transliterate(F.col("word")).alias("latin"))


@query(r"""WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT w, CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'arabic' WHEN regexp_full_match(w, '[IVXivx]+') THEN 'roman' WHEN regexp_matches(lower(w), '[a-z]') THEN 'english' ELSE 'other' END AS class,
CASE w WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'VI' THEN 6 WHEN 'IX' THEN 9 WHEN 'X' THEN 10 WHEN 'XI' THEN 11 WHEN 'XX' THEN 20 ELSE -1 END AS roman FROM t WHERE w <> '')
SELECT class, count(*) AS n, max(roman) AS largest FROM c GROUP BY class""")
def word_classes(spark, sf_dir):
    """Distinct words by class, and the largest Roman number."""
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").distinct()
    return words.groupBy(T.word_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"), F.max(T.roman_value(F.col("w"))).alias("largest"))


@query("WITH c AS (SELECT DISTINCT w || CASE WHEN length(w) % 2 = 0 THEN '(' || length(w) || ')' ELSE '' END AS code FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '') SELECT code, regexp_replace(code, '\\([0-9]+\\)$', '') AS word, CAST(nullif(regexp_extract(code, '\\(([0-9]+)\\)$', 1), '') AS INTEGER) AS stress, replace(replace(code, '(', ''), ')', '') AS mangled FROM c")
def code_parts(spark, sf_dir):
    """Word, stress and plain name of pronunciation codes."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    code = w.select(F.concat("w", F.when(F.length("w") % 2 == 0, F.concat(F.lit("("), F.length("w"), F.lit(")"))).otherwise("")).alias("code")).distinct()
    return code.select("code", T.code_word(F.col("code")).alias("word"), T.code_stress(F.col("code")).alias("stress"), T.mangled(F.col("code")).alias("mangled"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(t, '([a-z])¬([a-z])', '\1\2', 'g'), '—', '-', 'g')) AS n, length(t) - length(replace(t, '—', '')) AS dashes FROM (SELECT doc_id, regexp_replace(replace(replace(text, ', ', ' — '), 'er ', 'e¬r '), '[A-Z]', 'x', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def unified_marks(spark, sf_dir):
    """Dashes become hyphens and words split by optional hyphens one word (put into the texts first)."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace(F.replace(F.replace("text", F.lit(", "), F.lit(" — ")), F.lit("er "), F.lit("e¬r ")), "[A-Z]", "x").alias("t"))
    return d.select("doc_id", F.length(T.unified(F.col("t"))).cast("long").alias("n"), (F.length("t") - F.length(F.replace("t", F.lit("—"), F.lit("")))).cast("long").alias("dashes"))


@query("""SELECT vec_id, CAST(CASE WHEN label < 6 THEN label ELSE -1 END AS INTEGER) AS phone_id, CASE label WHEN 0 THEN 'a' WHEN 1 THEN 'e' WHEN 2 THEN 'y' WHEN 3 THEN 'i' WHEN 4 THEN 'o' WHEN 5 THEN 'u' ELSE '?' END AS phone FROM embeddings""")
def phone_names(spark, sf_dir):
    """Names of vowels by number and back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", phonetics.phone_name(F.col("label")).alias("phone"))
    return e.select("vec_id", phonetics.phone_number(F.col("phone")).alias("phone_id"), "phone")


@query(f"WITH {WORDS} SELECT doc_id, '<s> ' || string_agg(word, ' ' ORDER BY pos) || ' </s>' AS line FROM good GROUP BY doc_id, sent_id")
def corpus_lines(spark, sf_dir):
    """The corpus as sentences of words, a line each."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(corpus.good_sentences(F.col("text"))).alias("words"))
    return found.select("doc_id", sinks.corpus_line(F.col("words")).alias("line"))
