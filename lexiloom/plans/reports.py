"""Queries of checks and reports of a project: form matches, messages, caches, names, phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import build, corpus, reports
from lexiloom.operators.shared import stored
from lexiloom.plans import recordings, vocabulary
from lexiloom.plans.catalogue import ORACLE, STREAM, query, stream, table


@query("""WITH f AS (SELECT DISTINCT ['A', 'N', 'R'][1 + p_partkey % 3] AS lemma, nullif(p_partkey % 8, 7) AS "case", nullif(p_size % 4, 3) AS gender, nullif(p_size % 3, 2) AS number FROM part WHERE p_partkey % 5 < 4),
n AS (SELECT *, lemma || coalesce(CAST("case" AS VARCHAR), '*') || coalesce(CAST(gender AS VARCHAR), '*') || coalesce(CAST(number AS VARCHAR), '*') AS form FROM f),
q AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, l_returnflag AS lemma, l_partkey % 7 AS "case", nullif(l_suppkey % 5, 3) % 3 AS gender, l_linenumber % 2 AS number FROM lineitem)
SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, count(form) AS matches, CASE WHEN count(form) = 1 THEN min(form) END AS form FROM q LEFT JOIN n ON q.lemma = n.lemma AND (n."case" IS NULL OR n."case" = q."case") AND (n.gender IS NULL OR n.gender = q.gender) AND (n.number IS NULL OR n.number = q.number)
GROUP BY r""")
def form_match(spark, sf_dir):
    """Forms that fit by case, gender and number, where a form may leave each open; parts stand for forms, line items for what is asked."""
    p = table(spark, sf_dir, "part").where("p_partkey % 5 < 4")
    feature = lambda c, n: F.nullif(F.col(c) % n, F.lit(n - 1)).cast("long")
    forms = p.select(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("lemma"), feature("p_partkey", 8).alias("case"), feature("p_size", 4).alias("gender"), feature("p_size", 3).alias("number")).distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    forms = forms.withColumn("form", F.concat("lemma", text("case"), text("gender"), text("number")))
    q = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("lemma"), (F.col("l_partkey") % 7).cast("long").alias("case"), (F.nullif(F.col("l_suppkey") % 5, F.lit(3)) % 3).cast("long").alias("gender"), (F.col("l_linenumber") % 2).cast("long").alias("number")
    )
    return reports.match_forms(q, forms, "lemma", ["case", "gender", "number"]).select("l_orderkey", "l_linenumber", "matches", "form")


def _entries(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").distinct()
    return w.select(F.col("w").alias("word"), F.when(F.length("w") % 3 == 0, F.concat("w", F.lit("(1)"))).when(F.length("w") % 5 == 0, F.concat(F.lit("in"), "w")).otherwise(F.col("w")).alias("code"))


_ENTRIES = "d AS MATERIALIZED (SELECT DISTINCT w AS word, CASE WHEN length(w) % 3 = 0 THEN w || '(1)' WHEN length(w) % 5 = 0 THEN 'in' || w ELSE w END AS code FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '')"


@query(f"WITH {_ENTRIES} SELECT DISTINCT word FROM d WHERE lower(word) LIKE 'in%' OR lower(code) LIKE 'in%' ORDER BY word LIMIT 101")
def word_suggestions(spark, sf_dir):
    """Words that begin with what was typed, or whose code does."""
    return reports.suggestions(_entries(spark, sf_dir), "IN")


@query(f"""WITH {_ENTRIES}, k AS (SELECT * FROM d WHERE length(word) % 7 < 5), b AS (SELECT * FROM d WHERE length(word) % 4 = 0), c AS (SELECT DISTINCT w AS code FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> ''),
x AS (SELECT code, EXISTS (FROM k WHERE k.code = c.code) AS ki, EXISTS (FROM b WHERE b.code = c.code) AS bi, (SELECT min(k.code) FROM k WHERE starts_with(k.code, c.code || '(')) AS kl, (SELECT min(b.code) FROM b WHERE starts_with(b.code, c.code || '(')) AS bl,
 EXISTS (FROM k WHERE k.word = c.code) AS kw, EXISTS (FROM b WHERE b.word = c.code) AS bw FROM c),
y AS (SELECT *, coalesce(' ' || kl, '') || CASE WHEN kw THEN 'word ' || code ELSE '' END || coalesce(' ' || bl, '') || CASE WHEN bw THEN 'word ' || code ELSE '' END AS s FROM x),
z AS (SELECT code, CASE WHEN NOT ki AND NOT bi AND s = '' THEN 'PronId ''' || code || ''' is not in the phonetic dictionary' WHEN NOT ki AND NOT bi THEN 'PronId ''' || code || ''' can''t be found. Try ' || s
  WHEN ki AND bi THEN 'PronId ''' || code || ''' has occurence in multiple dictionaries' END AS message FROM y) SELECT * FROM z WHERE message IS NOT NULL""")
def code_messages(spark, sf_dir):
    """What is wrong with codes of utterances, in words."""
    d = _entries(spark, sf_dir)
    codes = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("code")).where("code <> ''")
    return reports.code_messages(codes, d.where(F.length("word") % 7 < 5), d.where(F.length("word") % 4 == 0), d.limit(0))


@query("SELECT round(sum(value) / 3600, 6) AS hours, round(sum(CASE WHEN event_type = 'error' THEN value END) / 3600, 6) AS silence_hours FROM events")
def silence_hours(spark, sf_dir):
    """Hours of all segments and of silence."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return reports.hours(e, "value", "event_type").crossJoin(F.broadcast(reports.hours(e, "value", "event_type", "error").withColumnRenamed("hours", "silence_hours"))).select(F.round("hours", 6).alias("hours"), F.round("silence_hours", 6).alias("silence_hours"))


@query("SELECT 'c' || CAST(conv_id AS VARCHAR) AS speaker, string_agg(lpad(CAST(turn AS VARCHAR), 4, '0'), ' ' ORDER BY turn) AS utterances FROM conversations GROUP BY conv_id")
def speaker_lists(spark, sf_dir):
    """The utterances of each speaker."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("speaker"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("utterance"))
    return reports.lists_by(c, "speaker", "utterance").select("speaker", F.array_join("items", " ").alias("utterances"))


_RESULTS = """r AS (SELECT 'f' || (conv_id % 60) AS path, left(text, 12) AS actual, turn % 3 AS word_dist, conv_id FROM conversations),
old AS (SELECT path, actual, word_dist FROM r WHERE conv_id % 2 = 0), new AS (SELECT path, actual, word_dist FROM r WHERE conv_id % 3 <> 1)"""


def _results(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), F.col("conv_id") % 60).alias("path"), F.substring("text", 1, 12).alias("actual"), (F.col("turn") % 3).alias("word_dist"), "conv_id")
    return r.where("conv_id % 2 = 0").drop("conv_id"), r.where("conv_id % 3 <> 1").drop("conv_id")


@query(f"""WITH {_RESULTS}, o AS (SELECT DISTINCT path, actual FROM old WHERE actual IS NOT NULL), n AS (SELECT DISTINCT path, actual FROM new WHERE actual IS NOT NULL)
SELECT n.path, count(o.path) AS old, count(*) - count(o.path) AS new FROM n LEFT JOIN o USING (path, actual) GROUP BY n.path""")
def cache_counts(spark, sf_dir):
    """Results by file that the cache had and that it lacked."""
    old, new = _results(spark, sf_dir)
    return reports.cached(old.where("actual is not null"), new.where("actual is not null"))[1]


@query(f"WITH {_RESULTS} SELECT path, actual, word_dist FROM new n WHERE word_dist <> 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.path = n.path AND o.actual = n.actual)")
def new_errors(spark, sf_dir):
    """Results with errors that the cache lacks."""
    return reports.new_errors(*_results(spark, sf_dir)).select("path", "actual", "word_dist")


_COUNT = lambda those: f"CAST(length(t) - length(translate(t, '{those}', '')) AS BIGINT)"


@query(f"""WITH d AS (SELECT doc_id, coalesce(replace(replace(text, 'an', 'аї'), 'S', 'Ь'), '') AS t FROM documents)
SELECT doc_id, {_COUNT('bdDfFgGhjJklLmnNqQrRsStuUvVwWyYzZ')} AS english_only, {_COUNT('aeiouAEIOUyY')} AS english_vowels, {_COUNT('ёЁъЪыЫэЭ')} AS russian_only, {_COUNT('аеєиіїоуюяАЕЄИІЇОУЮЯ')} AS vowels,
{_COUNT('бвгґджзйклмнпрстфхцчшщБВГҐДЖЗЙКЛМНПРСТФХЦЧШЩ')} AS consonants, {_COUNT('АБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЮЯ')} AS capitals FROM d""")
def letter_classes(spark, sf_dir):
    """Letters of each text by class, after some Latin ones were put in Ukrainian ones."""
    t = F.replace(F.replace("text", F.lit("an"), F.lit("аї")), F.lit("S"), F.lit("Ь"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    of = {"english_only": reports.ENGLISH_ONLY, "english_vowels": "aeiouAEIOUyY", "russian_only": reports.RUSSIAN_ONLY, "vowels": reports.UKRAINIAN_VOWELS, "consonants": reports.UKRAINIAN_CONSONANTS, "capitals": reports.UKRAINIAN_CAPITALS}
    return d.select("doc_id", *[reports.letters(F.col("t"), those).alias(name) for name, those in of.items()])


@query(r"""WITH p AS (SELECT page_id, page_id * 37 AS a, page_id * 37 + 11 AS b, 'C:\audio\set' || (page_id % 7) || '\rec' || page_id || '.v2.WAV' AS path FROM pages),
n AS (SELECT *, 'rec' || page_id || '.v2_' || CASE WHEN a < 10000 THEN lpad(CAST(a AS VARCHAR), 5, '0') ELSE CAST(a AS VARCHAR) END || '-' || CASE WHEN b < 10000 THEN lpad(CAST(b AS VARCHAR), 5, '0') ELSE CAST(b AS VARCHAR) END AS name FROM p)
SELECT page_id, name, 'train/set' || (page_id % 7) || '/' || name AS relative, 'C:/out/wav/train/set' || (page_id % 7) || '/' || name AS whole FROM n""")
def segment_paths(spark, sf_dir):
    """Names and paths of segments."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("C:\\audio\\set"), F.col("page_id") % 7, F.lit("\\rec"), "page_id", F.lit(".v2.WAV")).alias("path"), (F.col("page_id") * 37).alias("a"))
    return p.select("page_id", reports.segment_paths(F.col("path"), F.col("a"), F.col("a") + 11, "C:/audio", "C:/out/wav", "train").alias("s")).select("page_id", "s.*")


@query("SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}] AS f{i}" for i in range(64)) + " FROM embeddings")
def features_table(spark, sf_dir):
    """Vectors as a table with a column for each component."""
    return reports.features_table(table(spark, sf_dir, "embeddings"), ["vec_id"], "label", "embedding")


@query("""WITH s AS (SELECT d.doc_id, CASE l.toxic WHEN 1 THEN 'test' WHEN 0 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'Train' END END AS exclude, coalesce(d.text LIKE '%password%' OR d.doc_id % 11 = 0, false) AS broken FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT *, coalesce(lower(exclude) = 'train', false) AS te, coalesce(lower(exclude) = 'test', false) OR broken AS tr, CAST('0x' || left(md5('1932:' || doc_id), 8) AS BIGINT) % 10000 AS h FROM s)
SELECT doc_id, CASE WHEN te AND tr THEN 'rejected' WHEN te THEN 'test' WHEN tr THEN 'train' WHEN h < 7000 THEN 'train' ELSE 'test' END AS phase, CASE WHEN te AND tr THEN 'rejected' WHEN te THEN 'test' WHEN tr THEN 'train' WHEN h < 7000 THEN 'test' ELSE 'train' END AS swapped FROM f""")
def phase_split(spark, sf_dir):
    """L1: phases with what is kept out, broken words, conflicts that are rejected, and changed over."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    exclude = F.when(F.col("toxic") == 1, "test").when((F.col("toxic") == 0) & (F.col("doc_id") % 3 == 0), "Train")
    s = d.select("doc_id", exclude.alias("exclude"), F.coalesce(F.contains("text", F.lit("password")) | (F.col("doc_id") % 11 == 0), F.lit(False)).alias("broken"))
    one = reports.phases(s, F.col("doc_id"))
    return reports.phases(one.withColumnRenamed("phase", "straight"), F.col("doc_id"), swap=True).select("doc_id", F.col("straight").alias("phase"), F.col("phase").alias("swapped"))


@query("""WITH e AS (SELECT DISTINCT w AS code, string_split(upper(w), '') AS phones FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL) WHERE regexp_full_match(w, '[a-z]+') AND length(w) < 9),
u AS (SELECT conv_id, turn, pos, w[pos] AS code FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(1, len(w) + 1)) t(pos) WHERE w[pos] <> ''),
j AS (SELECT u.*, phones FROM u LEFT JOIN e USING (code))
SELECT conv_id, turn, CASE WHEN count(*) = count(phones) THEN 'sil ' || string_agg(array_to_string(phones, ' '), ' sp ' ORDER BY pos) || ' sil' END AS phones, coalesce(string_agg(CASE WHEN phones IS NULL THEN code END, ' ' ORDER BY pos), '') AS unknown FROM j GROUP BY conv_id, turn""")
def framed_phones(spark, sf_dir):
    """Utterances as phones between silences, or the words that nobody knows."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("code")).where(F.col("code").rlike("^[a-z]{1,8}$")).distinct()
    entries = w.select("code", F.filter(F.split(F.upper("code"), ""), lambda c: c != "").alias("phones"))
    u = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "code")).where("code <> ''")
    return reports.framed(u, entries, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("phones", " ").alias("phones"), F.array_join("unknown", " ").alias("unknown"))


@query(f"""WITH {STREAM}, k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark), ls AS (SELECT word, max(CASE WHEN length(word) % 3 > 0 THEN 1 ELSE 0 END) AS t FROM k WHERE word <> '' GROUP BY word),
b AS (SELECT ls.word, coalesce(cnt, 0) AS cnt, t FROM ls LEFT JOIN uni USING (word) UNION ALL SELECT word, cnt, 1 FROM uni WHERE cnt >= 5 AND word NOT IN ('<s>', '</s>') AND word NOT IN (SELECT word FROM ls) AND word NOT IN (SELECT unnest(string_split(text, ' ')) FROM conversations WHERE turn = 0))
SELECT 'train' AS phase, word, CAST(cnt AS BIGINT) AS cnt FROM b UNION ALL SELECT 'test', word, CAST(cnt AS BIGINT) FROM b WHERE t = 1""")
def phase_vocabulary(spark, sf_dir):
    """K2: vocabularies of training and testing; broken words are in training alone."""
    listed = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    removed = table(spark, sf_dir, "conversations").where("turn = 0").select(F.explode(F.split("text", " ")).alias("word"))
    return reports.vocabulary_by_phase(stored(corpus.unigrams(stream(spark, sf_dir))), listed.where(F.length("word") % 3 > 0), listed.where(F.length("word") % 3 == 0), removed, 5)


@query("""WITH l AS (SELECT 'texts/' || source || CASE WHEN lang = 'de' THEN '/BROKEN' ELSE '' END AS file, doc_id FROM documents), f AS (SELECT DISTINCT file FROM l WHERE file NOT LIKE '%BROKEN%' ORDER BY file LIMIT 12)
SELECT file, count(*) AS n FROM l WHERE file IN (FROM f) GROUP BY file""")
def kept_files(spark, sf_dir):
    """Rows of the first twelve files that aren't marked as broken; the limit is the feature."""
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("texts/"), "source", F.when(F.col("lang") == "de", "/BROKEN").otherwise("")).alias("file"), "doc_id")
    return reports.first_files(lines, "file", 12).groupBy("file").agg(F.count("*").alias("n"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CASE WHEN event_type IN ('view', 'click') THEN 'train' WHEN event_type = 'signup' THEN 'test' END AS phase,
CASE event_id % 5 WHEN 0 THEN 'Ukrainian' WHEN 1 THEN 'Russian' WHEN 2 THEN 'English' WHEN 3 THEN 'fr' ELSE '-' END AS language FROM events""")
def named_values(spark, sf_dir):
    """Time stamps, phases and languages as text."""
    kind = F.col("event_type")
    phase = F.when(kind == "view", "Train").when(kind == "click", " TRAIN ").when(kind == "signup", "test").when(kind == "error", "both")
    code = F.element_at(F.array(*map(F.lit, ["uk", "ru", "en", "fr", ""])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", reports.stamp(F.col("ts")).alias("stamp"), reports.phase_of(phase).alias("phase"), reports.language_name(code).alias("language"))


_MODELS = f"""{STREAM}, k AS MATERIALIZED (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
b0 AS (SELECT k.word, coalesce(cnt, 0) AS cnt, length(word) % 3 > 0 AS t FROM k LEFT JOIN uni USING (word) UNION ALL SELECT word, cnt, true FROM uni WHERE cnt >= 20 AND word NOT IN ('<s>', '</s>') AND word NOT IN (SELECT word FROM k)
  UNION ALL SELECT word, cnt, true FROM uni WHERE word IN ('<s>', '</s>')),
v AS MATERIALIZED (SELECT 'train' AS phase, word, greatest(cnt, 1) AS cnt FROM b0 UNION ALL SELECT 'test', word, greatest(cnt, 1) FROM b0 WHERE t),
b2 AS (SELECT p.phase, w1, w2, cnt FROM (VALUES ('train'), ('test')) p(phase), bi WHERE EXISTS (FROM v WHERE v.phase = p.phase AND v.word = w1) AND EXISTS (FROM v WHERE v.phase = p.phase AND v.word = w2))"""


@query(f"""WITH {_MODELS} SELECT phase, word AS w1, NULL AS w2, cnt, round(log10(cnt / sum(cnt) OVER (PARTITION BY phase)), 6) AS logprob FROM v
UNION ALL SELECT phase, w1, w2, cnt, round(log10(0.8 * cnt / sum(cnt) OVER (PARTITION BY phase, w1)), 6) FROM b2""")
def phase_models(spark, sf_dir):
    """K8: language models of both phases from one count of the texts."""
    pairs = stored(corpus.pairs(stream(spark, sf_dir)))
    usage = stored(corpus.unigrams_of(pairs))
    listed = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    known, broken, out = listed.where(F.length("word") % 3 > 0), listed.where(F.length("word") % 3 == 0), None
    for phase in build.PHASES:
        _, ones, twos = build.models(phase, usage, corpus.bigrams_of(pairs), known, broken, known.limit(0), 20)
        both = ones.select(F.lit(phase).alias("phase"), F.col("word").alias("w1"), F.lit(None).cast("string").alias("w2"), "cnt", "logprob").unionByName(twos.select(F.lit(phase).alias("phase"), "w1", "w2", "cnt", "logprob"))
        out = both if out is None else out.unionByName(both)
    return out


@query(f"""SELECT 'dictionary' AS part, word AS subject, 'not all pronCodes specify stress' AS message FROM ({ORACLE["stress_in_part"]}) UNION ALL SELECT 'dictionary', code, 'pronCode is not used' FROM ({ORACLE["pron_usage"]}) WHERE n = 0
UNION ALL SELECT 'annotation', CAST(id AS VARCHAR), message FROM ({ORACLE["marker_rules"]}) UNION ALL SELECT 'utterance', code, message FROM ({ORACLE["code_messages"]})""")
def project_report(spark, sf_dir):
    """The report of a project: dictionaries, annotations and utterances."""
    return reports.project(vocabulary.stress_in_part(spark, sf_dir), vocabulary.pron_usage(spark, sf_dir), recordings.marker_rules(spark, sf_dir), code_messages(spark, sf_dir))
