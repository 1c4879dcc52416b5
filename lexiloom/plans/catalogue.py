"""The registered queries of the library and their SQL.

Each query is a function of (spark, sf_dir) over the given tables; its SQL, where
SQL can express it, gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import align
from lexiloom.functions import text as T
from lexiloom.operators import corpus, dictionary, intervals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tokens with classes, sentences and the word stream, as DuckDB has them. The classes and abbreviations are written out here once more.
TOK = r"""
l AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[.?!…]|[_"#$%&+/:;<=>@\\^\[\](){},‚§©«»“”„‟–—*•№\x{F009}¬\-''’`]|[\t\r\n \x{00A0}]+|[0-9]+|[^.?!…_"#$%&+/:;<=>@\\^\[\](){},‚§©«»“”„‟–—*•№\x{F009}¬\-''’`\t\r\n \x{00A0}0-9]+') AS l FROM documents),
tok AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM l),
runs AS MATERIALIZED (SELECT *, CASE WHEN regexp_full_match(tok, '[.?!…]') THEN 'stop' WHEN regexp_full_match(tok, '[_"#$%&+/:;<=>@\\^\[\](){},‚§©«»“”„‟–—*•№\x{F009}¬\-''’`]') THEN 'punct'
  WHEN regexp_full_match(tok, '[\t\r\n \x{00A0}]+') THEN 'space' WHEN regexp_full_match(tok, '[0-9]+') THEN 'digit' ELSE 'alpha' END AS run_type FROM tok)"""
SENT = f"""{TOK},
r1 AS (SELECT *, lag(tok) OVER w AS before, lag(run_type) OVER w AS bt FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r2 AS (SELECT *, last_value(CASE WHEN run_type = 'stop' AND coalesce(bt, '') <> 'stop' THEN
  CASE WHEN before IS NOT NULL AND (length(before) <= 1 OR lower(before) IN ('англ', 'г', 'га', 'гр', 'год', 'грец', 'грн', 'д', 'див', 'дж', 'дол', 'е', 'зв', 'км', 'коп', 'крб', 'л', 'лат', 'мал', 'мед', 'мл', 'млн', 'н', 'напр', 'нім',
    'оп', 'п', 'пер', 'перен', 'р', 'ред', 'рос', 'розд', 'розм', 'рис', 'рр', 'руб', 'с', 'св', 'см', 'ст', 'т', 'тис', 'укр', 'фр', 'хв', 'ч', 'шт', 'ім', 'ін', 'іст')) THEN 0 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS verdict FROM r1),
sent AS MATERIALIZED (SELECT doc_id, pos, tok, run_type, CAST(coalesce(sum(CASE WHEN run_type = 'stop' THEN verdict ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_id FROM r2)"""
WORDS = f"""{SENT},
good AS MATERIALIZED (SELECT doc_id, sent_id, pos, tok AS word FROM (SELECT *, max(CASE WHEN run_type = 'digit' OR tok = '¬' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id) AS bad FROM sent) WHERE bad = 0 AND run_type = 'alpha')"""
STREAM = f"""{WORDS},
marked AS (SELECT doc_id, sent_id, pos, word FROM good UNION ALL SELECT DISTINCT doc_id, sent_id, -1, '<s>' FROM good UNION ALL SELECT DISTINCT doc_id, sent_id, 9000000000, '</s>' FROM good),
stream AS MATERIALIZED (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY sent_id, pos) AS next FROM marked),
uni AS MATERIALIZED (SELECT word, count(*) AS cnt FROM stream GROUP BY word),
bi AS MATERIALIZED (SELECT word AS w1, next AS w2, count(*) AS cnt FROM stream WHERE next IS NOT NULL GROUP BY word, next)"""


def stream(spark, sf_dir):
    return corpus.word_stream(table(spark, sf_dir, "documents"))


@query(f"WITH {TOK} SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok, run_type FROM runs")
def token_runs(spark, sf_dir):
    """Every token with its place and class."""
    return corpus.token_runs(table(spark, sf_dir, "documents")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {TOK} SELECT doc_id, run_type, count(*) AS n, CAST(sum(length(tok)) AS BIGINT) AS chars FROM runs GROUP BY ALL")
def token_class_counts(spark, sf_dir):
    """Tokens and characters by document and class."""
    return corpus.class_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {SENT} SELECT doc_id, sent_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_tokens FROM sent GROUP BY ALL")
def sentences(spark, sf_dir):
    """Extent of each sentence."""
    return corpus.sentence_spans(table(spark, sf_dir, "documents"))


@query(f"WITH {WORDS} SELECT doc_id, count(DISTINCT sent_id) AS n_sentences, count(*) AS n_words FROM good GROUP BY doc_id")
def sentence_filter(spark, sf_dir):
    """Sentences and words left after dropping numbers, optional hyphens and signs."""
    return corpus.sentence_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {STREAM} SELECT word, cnt FROM uni")
def unigram_counts(spark, sf_dir):
    """E1, E3."""
    return corpus.unigrams(stream(spark, sf_dir))


@query(f"WITH {STREAM} SELECT w1, w2, cnt FROM bi")
def bigram_counts(spark, sf_dir):
    """E1, E2, F12."""
    return corpus.bigrams(stream(spark, sf_dir))


@query(f"WITH {STREAM} SELECT CAST(1 AS INTEGER) AS gram, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS usage FROM uni UNION ALL SELECT 2, count(*), CAST(sum(cnt) AS BIGINT) FROM bi")
def ngram_sizes(spark, sf_dir):
    """E4, E5."""
    return corpus.sizes(corpus.pairs(stream(spark, sf_dir)))


@query(f"WITH {STREAM} SELECT word, round(log10(cnt / (SELECT sum(cnt) FROM uni)), 6) AS logprob, round(log10(0.2), 6) AS backoff FROM uni")
def lm_unigram(spark, sf_dir):
    """K5."""
    return corpus.lm_unigram(corpus.unigrams(stream(spark, sf_dir)))


@query(f"WITH {STREAM} SELECT w1, w2, cnt, round(log10(0.8 * cnt / sum(cnt) OVER (PARTITION BY w1)), 6) AS logprob FROM bi")
def lm_bigram(spark, sf_dir):
    """K5, Q11: the flagship query."""
    return corpus.lm_bigram(corpus.bigrams(stream(spark, sf_dir)))


@query(f"WITH {STREAM} SELECT round(sum(pow(10, round(log10(cnt / (SELECT sum(cnt) FROM uni)), 6))), 4) AS total FROM uni")
def lm_prob_sum(spark, sf_dir):
    """Unigram probabilities sum to one."""
    return corpus.lm_unigram(corpus.unigrams(stream(spark, sf_dir))).agg(F.round(F.sum(F.pow(F.lit(10.0), "logprob")), 4).alias("total"))


@query(f"WITH {STREAM}, deny AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT word, cnt FROM uni WHERE cnt >= 10 AND word NOT IN ('<s>', '</s>') AND word NOT IN (SELECT word FROM deny) ORDER BY cnt DESC, word LIMIT 500")
def vocab_topk(spark, sf_dir):
    """The most used words that aren't denied."""
    deny = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    words = corpus.unigrams(stream(spark, sf_dir)).where((F.col("cnt") >= 10) & ~F.col("word").isin("<s>", "</s>"))
    return words.join(deny, "word", "left_anti").orderBy(F.desc("cnt"), "word").limit(500)


@query(f"""WITH {STREAM}, h AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark), b AS (SELECT coalesce(h.word, u.word) AS word, coalesce(cnt, 0) AS cnt, CASE WHEN h.word IS NOT NULL THEN -5.0 END AS hint FROM h FULL JOIN uni u ON h.word = u.word),
s AS (SELECT sum(cnt) AS t, sum(CASE WHEN cnt = 0 THEN 1 ELSE 0 END) AS rare, coalesce(sum(CASE WHEN cnt = 0 THEN pow(10, hint) END), 0) AS hinted FROM b)
SELECT word, CAST(CASE WHEN cnt > 0 THEN cnt WHEN hint IS NULL THEN 1 ELSE greatest(1, floor(pow(10, hint) * floor((t + rare) / (1 - hinted)))) END AS BIGINT) AS cnt FROM b, s""")
def lm_recovered_usage(spark, sf_dir):
    """K4: usage of words that the corpus lacks."""
    hints = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct().withColumn("log10_hint", F.lit(-5.0))
    return corpus.recovered_usage(corpus.unigrams(stream(spark, sf_dir)), hints)


@query("SELECT conv_id, turn, w AS word, ord FROM (SELECT conv_id, turn, unnest(l) AS w, unnest(range(len(l))) AS ord FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations))")
def utterance_split(spark, sf_dir):
    """Pronunciation codes of utterances."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.utterance_words(F.col("text"))).alias("ord", "word")).select("conv_id", "turn", "word", F.col("ord").cast("long").alias("ord"))


_DICT = "d AS (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL)"


def _dict(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", F.explode(F.split("text", " ")).alias("word")).distinct()


_PRIO = {"en": 0, "de": 1, "es": 2, "fr": 3}


@query(f"WITH {_DICT}, k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark), p AS (SELECT word, min(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) AS prio FROM d GROUP BY word) SELECT k.word, CASE prio WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' END AS kind FROM k LEFT JOIN p USING (word)")
def dict_priority_lookup(spark, sf_dir):
    """D3."""
    prio = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "es", 2).otherwise(3)
    entries = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", " ")).alias("word"), prio.alias("prio"), F.col("lang").alias("kind"))
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return dictionary.by_priority(keys, entries)


@query(f"WITH {_DICT} SELECT word, 'en' AS kind FROM d WHERE lang = 'en' UNION ALL SELECT word, 'de' FROM d WHERE lang = 'de' AND word NOT IN (SELECT word FROM d WHERE lang = 'en')")
def dict_merge_new(spark, sf_dir):
    """D12."""
    d = _dict(spark, sf_dir)
    of = lambda lang: d.where(F.col("lang") == lang).select("word", F.lit(lang).alias("kind"))
    return dictionary.merge_new(of("en"), of("de"), ["word"])


@query(f"WITH {_DICT} SELECT word, count(*) AS n FROM d GROUP BY word HAVING count(*) > 1")
def dict_duplicates(spark, sf_dir):
    """H5, D16."""
    return dictionary.duplicates(_dict(spark, sf_dir), ["word"])


@query(f"WITH {_DICT} SELECT word FROM d INTERSECT SELECT unnest(string_split(text, ' ')) FROM benchmark")
def dict_denied(spark, sf_dir):
    """H3."""
    return _dict(spark, sf_dir).select("word").intersect(table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")))


@query("WITH p AS (SELECT DISTINCT lower(w) AS word, w AS code FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY code) AS k, count(*) OVER (PARTITION BY word) AS c FROM p) SELECT word, code, CASE WHEN k = 1 THEN word ELSE word || '(' || k || ')' END AS name FROM k WHERE c > 1 OR code <> word")
def pron_display_names(spark, sf_dir):
    """I11."""
    codes = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("code")).distinct().select(F.lower("code").alias("word"), "code")
    return dictionary.display_names(codes)


@query("SELECT doc_id, CASE WHEN l.toxic = 1 THEN 'train' WHEN l.quality = 0 THEN 'test' WHEN CAST('0x' || left(md5('1932:' || d.doc_id), 8) AS BIGINT) % 100 < 70 THEN 'train' ELSE 'test' END AS phase FROM documents d LEFT JOIN labels l USING (doc_id)")
def train_test_split(spark, sf_dir):
    """L1 with a hash of the key: the same split under any partitioning."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    phase = F.when(F.col("toxic") == 1, "train").when(F.col("quality") == 0, "test").when(F.conv(F.substring(F.md5(F.concat(F.lit("1932:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100 < 70, "train").otherwise("test")
    return d.select("doc_id", phase.alias("phase"))


_SPLIT = f"ph AS ({ORACLE['train_test_split']})"


@query(f"WITH {_SPLIT}, c AS (SELECT DISTINCT phase, doc_id, unnest(string_split(text, '')) AS c FROM documents JOIN ph USING (doc_id)), rare AS (SELECT c FROM c WHERE phase = 'test' EXCEPT SELECT c FROM c WHERE phase = 'train') SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM c WHERE phase = 'test' AND c IN (SELECT c FROM rare)) THEN 'train' ELSE phase END AS phase FROM ph")
def rare_symbol_move(spark, sf_dir):
    """L2, H1: test documents with a character that training lacks move to training."""
    ph = train_test_split(spark, sf_dir)
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").join(ph, "doc_id")
    rare = chars.where("phase = 'test'").select("c").subtract(chars.where("phase = 'train'").select("c"))
    move = chars.where("phase = 'test'").join(rare, "c", "left_semi").select("doc_id").distinct().withColumn("moved", F.lit("train"))
    return ph.join(move, "doc_id", "left").select("doc_id", F.coalesce("moved", "phase").alias("phase"))


@query(f"WITH {_SPLIT} SELECT phase, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN ph USING (doc_id) GROUP BY ROLLUP (phase, source)")
def split_stats(spark, sf_dir):
    """Totals by phase and source with their sums."""
    return table(spark, sf_dir, "documents").join(train_test_split(spark, sf_dir), "doc_id").rollup("phase", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("text", F.when(F.col("event_type") != "error", F.col("event_type")))


_P = "p AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS text FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"WITH {_P}, s AS (SELECT user_id, event_id, text, lead(event_id) OVER w AS end_id, lag(text) OVER w IS NOT NULL AS linked FROM p {_W}) SELECT user_id, event_id, end_id, text, linked FROM s WHERE end_id IS NOT NULL AND text IS NOT NULL")
def marker_segments(spark, sf_dir):
    """F1, F2."""
    return intervals.segments(_points(spark, sf_dir)).select("user_id", "event_id", "end_id", "text", "linked")


@query(f"WITH s AS (SELECT event_id, event_type = 'error' AS q, lag(event_type) OVER w = 'error' AS lq, lag(ts) OVER w AS lt, lead(event_type) OVER w = 'error' AS nq, lead(ts, 2) OVER w AS n2 FROM events {_W}) SELECT event_id, CASE WHEN lq THEN lt END AS flank_start, CASE WHEN nq THEN n2 END AS flank_end FROM s WHERE NOT q")
def segment_flanks(spark, sf_dir):
    """F3."""
    return intervals.flanks(table(spark, sf_dir, "events"), F.col("event_type") == "error").select("event_id", "flank_start", "flank_end")


@query("SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS recent FROM events")
def recent_speaker(spark, sf_dir):
    """F5."""
    return intervals.last_known(table(spark, sf_dir, "events"), F.when(F.col("value") > 50, F.col("event_type"))).select("event_id", "recent")


def _asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("id"), "event_type")
    return intervals.asof(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), "user_id")


_NEAR = """m AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), q AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'error'),
a AS (SELECT q.user_id, q.event_id AS id, q.ts AS t, m.event_id AS left_id, m.ts AS left_t FROM q ASOF LEFT JOIN m ON q.user_id = m.user_id AND q.ts >= m.ts),
b AS (SELECT a.*, m.event_id AS right_id, m.ts AS right_t FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.t <= m.ts)"""


@query(f"WITH {_NEAR} SELECT id, left_id, right_id FROM b")
def asof_marker(spark, sf_dir):
    """D9, P14."""
    return _asof(spark, sf_dir).select("id", "left_id", "right_id")


@query(f"WITH {_NEAR} SELECT id, CASE WHEN right_id IS NULL OR (left_id IS NOT NULL AND t - left_t < right_t - t) THEN left_id ELSE right_id END AS nearest_id FROM b")
def nearest_marker(spark, sf_dir):
    """A tie goes to the right."""
    closer = F.col("left_id").isNotNull() & ((F.col("t") - F.col("left_t")) < (F.col("right_t") - F.col("t")))
    return _asof(spark, sf_dir).select("id", F.when(F.col("right_id").isNull() | closer, F.col("left_id")).otherwise(F.col("right_id")).alias("nearest_id"))


@query(f"WITH a AS (SELECT *, value > 20 AS mask, CASE WHEN lag(value > 20) OVER w IS NOT DISTINCT FROM (value > 20) THEN 0 ELSE 1 END AS new FROM events {_W}), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM a) SELECT user_id, run, any_value(mask) AS mask, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM b GROUP BY user_id, run")
def activity_runs(spark, sf_dir):
    """F9, M14, O3."""
    return intervals.runs(table(spark, sf_dir, "events"), F.col("value") > 20)


@query("WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT user_id, n, unnest(range((n - 10) // 4 + 1)) AS frame FROM (SELECT DISTINCT user_id, n FROM a WHERE n >= 10)) SELECT f.user_id, f.frame, round(avg(abs(value)), 6) AS magnitude, count(*) AS n FROM f JOIN a ON a.user_id = f.user_id AND i >= frame * 4 AND i < frame * 4 + 10 GROUP BY ALL")
def sliding_frames(spark, sf_dir):
    """F6, E17."""
    return intervals.frames(table(spark, sf_dir, "events"), 10, 4)


ORACLE["sliding_frames"] = ORACLE["sliding_frames"].replace("GROUP BY ALL", "GROUP BY f.user_id, f.frame")


@query(f"SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL THEN (1 - 0.97::DOUBLE) * value ELSE value - 0.97::DOUBLE * lag(value) OVER w END, 6) AS y FROM events {_W}")
def pre_emphasis(spark, sf_dir):
    """F7, M24."""
    return intervals.pre_emphasis(table(spark, sf_dir, "events")).select("event_id", F.round("y", 6).alias("y"))


@query(f"""WITH a AS (SELECT event_id, value, lead(value, 1) OVER w AS p1, lead(value, 2) OVER w AS p2, lag(value, 1) OVER w AS m1, lag(value, 2) OVER w AS m2, first_value(value) OVER f AS lo, last_value(value) OVER f AS hi FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round((coalesce(p1, hi) - coalesce(m1, lo) + 2 * (coalesce(p2, hi) - coalesce(m2, lo))) / 10, 6) AS delta FROM a""")
def delta_features(spark, sf_dir):
    """F8, M24."""
    return intervals.deltas(table(spark, sf_dir, "events")).select("event_id", F.round("delta", 6).alias("delta"))


@query("SELECT event_id, m AS message FROM (SELECT event_id, unnest([CASE WHEN value < 0 THEN 'negative' END, CASE WHEN event_type IS NULL THEN 'no type' END, CASE WHEN event_type = 'error' AND value > 50 THEN 'loud silence' END, CASE WHEN user_id IS NULL THEN 'no speaker' END]) AS m FROM events) WHERE m IS NOT NULL")
def marker_validation(spark, sf_dir):
    """A row for each broken rule."""
    rules = [("negative", F.col("value") < 0), ("no type", F.col("event_type").isNull()), ("loud silence", (F.col("event_type") == "error") & (F.col("value") > 50)), ("no speaker", F.col("user_id").isNull())]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in rules]), lambda m: m.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.explode(found).alias("message"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'b') ORDER BY lower(p_name), p_partkey LIMIT 101")
def suggest_prefix(spark, sf_dir):
    """The first 101 suggestions."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").startswith("b")).orderBy(F.lower("p_name"), "p_partkey").limit(101).select("p_partkey", "p_name")


@query("SELECT role, turn, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL")
def speaker_utterances(spark, sf_dir):
    """Utterances by speaker and turn."""
    return table(spark, sf_dir, "conversations").groupBy("role", "turn").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_type, user_id, round(sum(value) / 3600, 6) AS hours, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)")
def duration_rollup(spark, sf_dir):
    """E9, E10, P11."""
    return table(spark, sf_dir, "events").rollup("event_type", "user_id").agg(F.round(F.sum("value") / 3600, 6).alias("hours"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT item_id, translate(text, 'éóèçêäñöíüßÉÈÊÑÓÇÄÜÖÍ', '0123456789{}[]<>()|~^') AS u, text FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, CAST(levenshtein(a.u, b.u) AS INTEGER) AS distance FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def edit_distance_unit(spark, sf_dir):
    """Unit costs, neighbouring items. (DuckDB's function counts bytes, so its SQL puts a letter of one byte for each other one.)"""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("other"))
    return b.withColumnRenamed("item_id", "a").join(other, "a").select("a", "b", F.levenshtein("text", "other").alias("distance"))


_WORDS_BESIDE = """p AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
c AS MATERIALIZED (SELECT a, j, [list_position(list_distinct(x || y), w) for w in x] AS x, list_position(list_distinct(x || y), y[j]) AS y FROM p, unnest(range(1, len(y) + 1)) t(j)),
dp(a, j, r) AS (SELECT a, 0, range(0, len(x) + 1) FROM p UNION ALL
  SELECT a, j, [list_min([z[k] - k for k in range(1, i + 1)]) + i for i in range(1, len(z) + 1)] FROM (
  SELECT dp.a, c.j, CAST([c.j] AS BIGINT[]) || [least(r[i + 1] + 1, r[i] + CASE WHEN x[i] = y THEN 0 ELSE 1 END) for i in range(1, len(x) + 1)] AS z FROM dp JOIN c ON dp.a = c.a AND c.j = dp.j + 1))"""


def _beside(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.split("text", " ").alias("other"))
    return b.select(F.col("item_id").alias("a"), F.split("text", " ").alias("words")).join(other, "a")


@query(f"WITH RECURSIVE {_WORDS_BESIDE} SELECT p.a, p.b, CAST(r[len(p.x) + 1] AS BIGINT) AS errors, CAST(len(p.x) AS INTEGER) AS n_words FROM p JOIN dp ON dp.a = p.a AND dp.j = len(p.y)")
def word_error_rate(spark, sf_dir):
    """Words as symbols, neighbouring items."""
    return _beside(spark, sf_dir).select("a", "b", align.distance(F.col("words"), F.col("other")).cast("long").alias("errors"), F.size("words").alias("n_words"))


@query(f"""WITH RECURSIVE {_WORDS_BESIDE},
back(a, i, j, n, s, x, y) AS (SELECT p.a, len(p.x), len(p.y), 0, '', p.x, p.y FROM p UNION ALL SELECT * FROM (SELECT a, CASE WHEN op = 'I' THEN i ELSE i - 1 END, CASE WHEN op = 'R' THEN j ELSE j - 1 END, n + 1, op || s, x, y FROM (
  SELECT b.*, CASE WHEN b.j = 0 THEN 'R' WHEN b.i = 0 THEN 'I' WHEN l.r[b.i + 1] = k.r[b.i] + CASE WHEN x[b.i] = y[b.j] THEN 0 ELSE 1 END THEN 'S' WHEN l.r[b.i + 1] = l.r[b.i] + 1 THEN 'R' ELSE 'I' END AS op
  FROM back b JOIN dp l ON l.a = b.a AND l.j = b.j LEFT JOIN dp k ON k.a = b.a AND k.j = b.j - 1 WHERE b.i > 0 OR b.j > 0)))
SELECT a, s AS steps FROM back WHERE i = 0 AND j = 0""")
def edit_recipes(spark, sf_dir):
    """The steps from item to item, substitution before removal before insertion."""
    steps = align.recipe(F.col("words"), F.col("other"), order="SRI")
    return _beside(spark, sf_dir).select("a", F.array_join(steps["op"], "").alias("steps"))
