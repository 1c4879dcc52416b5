"""Queries on vocabularies and dictionaries. The given tables hold no phones, so a word's characters stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus, vocabulary
from lexiloom.operators.shared import stored
from lexiloom.plans.catalogue import STREAM, query, stream, table


def words_of(spark, sf_dir, name="benchmark", column="text"):
    return table(spark, sf_dir, name).select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''")


def utterances(spark, sf_dir):
    """conv_id, turn, pos, code."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.utterance_words(F.col("text"))).alias("pos", "code"))


def chosen(spark, sf_dir, pairs=None):
    """The vocabulary and the usage it is chosen by, which is stored, as both read it; ``pairs``: counts to take it from, else the texts."""
    counts = corpus.unigrams(stream(spark, sf_dir)) if pairs is None else corpus.unigrams_of(pairs)
    usage = stored(counts).withColumn("phones", F.array_distinct(F.filter(F.split("word", ""), lambda c: c != "")))
    known = words_of(spark, sf_dir).distinct()
    dictionary = known.select("word", F.lower("word").alias("code"))
    denied = words_of(spark, sf_dir, "part", "p_name").distinct()
    train = known.select(F.explode(F.split("word", "")).alias("phone")).where("phone <> ''").distinct()
    return vocabulary.choose(usage, dictionary, denied, train, 10, 2000), usage


_CHOSEN = f"""{STREAM}, k AS MATERIALIZED (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
tp AS MATERIALIZED (SELECT DISTINCT unnest(string_split(word, '')) AS p FROM k),
bad AS (SELECT DISTINCT word FROM (SELECT word, unnest(string_split(word, '')) AS p FROM uni) WHERE p NOT IN (SELECT p FROM tp)),
cand AS (SELECT word, cnt FROM uni WHERE cnt >= 10 AND word NOT IN ('<s>', '</s>') AND word NOT IN (SELECT word FROM k) AND word NOT IN (SELECT lower(word) FROM k)
  AND word NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part) AND word NOT IN (SELECT word FROM bad) ORDER BY cnt DESC, word LIMIT (SELECT greatest(0, 2000 - count(*)) FROM k)),
voc AS MATERIALIZED (SELECT k.word, coalesce(cnt, 0) AS cnt, true AS known FROM k LEFT JOIN uni USING (word) UNION ALL SELECT word, cnt, false FROM cand),
seed AS MATERIALIZED (SELECT word, cnt FROM voc UNION ALL SELECT word, cnt FROM uni WHERE word IN ('<s>', '</s>'))"""


@query(f"WITH {_CHOSEN} SELECT word, cnt, known FROM voc")
def vocabulary_choice(spark, sf_dir):
    """K2, C16, C17, C18, G1, G2."""
    return chosen(spark, sf_dir)[0]


@query(f"WITH {_CHOSEN}, s AS (SELECT word, greatest(cnt, 1) AS cnt FROM seed) SELECT word, cnt, round(log10(cnt / (SELECT sum(cnt) FROM s)), 6) AS logprob FROM s")
def vocabulary_unigrams(spark, sf_dir):
    """K3, K4, K5: the model's unigrams with sentence marks."""
    return vocabulary.model_unigrams(stored(vocabulary.with_sentence_marks(*chosen(spark, sf_dir))))


@query(f"WITH {_CHOSEN}, b AS (SELECT * FROM bi WHERE w1 IN (SELECT word FROM seed) AND w2 IN (SELECT word FROM seed)) SELECT w1, w2, cnt, round(log10(0.8 * cnt / sum(cnt) OVER (PARTITION BY w1)), 6) AS logprob FROM b")
def vocabulary_bigrams(spark, sf_dir):
    """Bigrams of the vocabulary's words; the sums are over the vocabulary alone."""
    pairs = stored(corpus.pairs(stream(spark, sf_dir)))
    words = stored(vocabulary.with_sentence_marks(*chosen(spark, sf_dir, pairs)))
    return corpus.lm_bigram(stored(vocabulary.within(corpus.bigrams_of(pairs), words)))


@query(f"WITH {STREAM}, k AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '') SELECT coalesce(k.word, uni.word) AS word, coalesce(cnt, 0) AS cnt FROM k FULL JOIN uni ON k.word = uni.word")
def dictionary_usage(spark, sf_dir):
    """Usage of the corpus' words, and 0 for those of the dictionary alone."""
    return vocabulary.usage_of(words_of(spark, sf_dir), corpus.unigrams(stream(spark, sf_dir)))


_PRON = "p AS (SELECT DISTINCT lower(w) AS code, w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '')"
_UTT = "u AS (SELECT conv_id, turn, unnest(l) AS code, unnest(range(len(l))) AS pos FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '^#', ''), ' '), lambda x: x <> '') AS l FROM conversations))"


def prons(spark, sf_dir):
    """code, word: spellings of a word in small letters stand for its pronunciations."""
    return words_of(spark, sf_dir).distinct().select(F.lower("word").alias("code"), "word")


@query(f"WITH {_PRON}, d AS (SELECT code, 'benchmark' AS kind, word FROM p UNION ALL SELECT DISTINCT lower(w), 'part', w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)), {_UTT} SELECT code, kind, word FROM (SELECT DISTINCT code FROM u) JOIN d USING (code)")
def pron_expansions(spark, sf_dir):
    """All entries of two dictionaries for the codes of utterances."""
    part = words_of(spark, sf_dir, "part", "p_name").distinct().select(F.lower("word").alias("code"), F.lit("part").alias("kind"), "word")
    return vocabulary.expansions(utterances(spark, sf_dir), prons(spark, sf_dir).select("code", F.lit("benchmark").alias("kind"), "word"), part)


@query(rf"""WITH {_PRON}, n AS (SELECT code, count(*) AS n, min(word) AS word FROM p GROUP BY code), {_UTT},
x AS (SELECT conv_id, turn, pos, CASE WHEN regexp_matches(u.code, '[\r\n\t]') THEN 'CRLF' WHEN n IS NULL THEN '???' WHEN n > 1 THEN '(...)' ELSE array_to_string(string_split(word, ''), ' ') END AS piece FROM u LEFT JOIN n ON n.code = u.code)
SELECT conv_id, turn, string_agg(piece, '~' ORDER BY pos) AS phones, min(CASE WHEN piece IN ('CRLF', '???', '(...)') THEN 0 ELSE 1 END) = 1 AS valid FROM x GROUP BY conv_id, turn""")
def utterance_phones(spark, sf_dir):
    """Phones of utterances."""
    entries = prons(spark, sf_dir).select("code", F.array_join(F.filter(F.split("word", ""), lambda c: c != ""), " ").alias("phones"))
    return vocabulary.phone_text(utterances(spark, sf_dir), entries, ["conv_id", "turn"])


@query(f"WITH {_PRON}, {_UTT}, n AS (SELECT code, count(*) AS n FROM u GROUP BY code) SELECT code, coalesce(n, 0) AS n FROM (SELECT DISTINCT code FROM p) LEFT JOIN n USING (code)")
def pron_usage(spark, sf_dir):
    """Uses of each code, zero included."""
    return vocabulary.code_usage(prons(spark, sf_dir), utterances(spark, sf_dir))


_PHONES = "list_transform(list_filter(string_split(word, ''), lambda c: c <> ''), lambda c: CASE WHEN c <> lower(c) THEN c || '1' ELSE upper(c) END)"


@query(f"""WITH {_PRON}, s AS (SELECT code, list_filter({_PHONES}, lambda x: regexp_full_match(x, '[AEIOUY]1?')) AS v FROM p),
t AS (SELECT code AS word, count(*) AS n, CAST(sum(CASE WHEN len(v) = 0 OR len(list_filter(v, lambda x: x LIKE '%1')) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS stressed FROM s GROUP BY code) SELECT * FROM t WHERE n > 1 AND stressed > 0 AND stressed < n""")
def stress_in_part(spark, sf_dir):
    """Words of which some pronunciations have stress (capital letters stand for it) and some not."""
    phones = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.when(c != F.lower(c), F.concat(c, F.lit("1"))).otherwise(F.upper(c)))
    return vocabulary.mixed_stress(prons(spark, sf_dir).select(F.col("code").alias("word"), phones.alias("phones")))


@query(f"WITH {_PRON} SELECT code, count(DISTINCT replace(upper(word), 'ẞ', 'SS')) AS n, min(replace(upper(word), 'ẞ', 'SS')) AS phones FROM p GROUP BY code")
def normal_prons(spark, sf_dir):
    """Pronunciations without digits, in capitals, each once."""
    norm = F.array_join(vocabulary.normal_phones(F.split("word", "")), "")
    return prons(spark, sf_dir).select("code", norm.alias("p")).groupBy("code").agg(F.countDistinct("p").alias("n"), F.min("p").alias("phones"))


@query(f"WITH {_UTT} SELECT DISTINCT conv_id, turn FROM u WHERE code IN (SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 10)")
def broken_utterances(spark, sf_dir):
    """Utterances with a word of the broken dictionary (long words stand for it)."""
    broken = words_of(spark, sf_dir).where(F.length("word") >= 10).select(F.col("word").alias("code"))
    return utterances(spark, sf_dir).join(broken, "code", "left_semi").select("conv_id", "turn").distinct()


@query("SELECT lang, count(DISTINCT w) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY lang")
def declined_forms(spark, sf_dir):
    """Distinct forms by language."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", F.explode(F.split("text", " ")).alias("w")).groupBy("lang").agg(F.countDistinct("w").alias("n"))


@query(f"WITH {_PRON}, {_UTT} SELECT code, n FROM (SELECT code, count(*) AS n FROM p GROUP BY code HAVING count(*) > 1) WHERE code IN (SELECT code FROM u)")
def ambiguous_words(spark, sf_dir):
    """Words of transcripts with several pronunciations."""
    several = prons(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    return several.join(utterances(spark, sf_dir), "code", "left_semi")


@query(f"WITH {_PRON} SELECT code, word FROM p WHERE word <> code")
def auto_pron_diff(spark, sf_dir):
    """Entries that differ from what the rules give (small letters stand for them)."""
    return prons(spark, sf_dir).where(F.col("word") != F.lower("word")).select("code", "word")


@query("SELECT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) UNION SELECT unnest(string_split(p_name, ' ')) FROM part")
def word_list(spark, sf_dir):
    """The words of two dictionaries."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).union(words_of(spark, sf_dir, "part", "p_name")).distinct()


@query(f"WITH {_PRON}, {_UTT} SELECT code, word FROM p WHERE code IN (SELECT code FROM u)")
def broken_codes(spark, sf_dir):
    """H4: entries whose code another dictionary has as well."""
    return prons(spark, sf_dir).join(utterances(spark, sf_dir), "code", "left_semi")


@query(f"WITH {_UTT}, a AS (SELECT code AS word, count(*) AS a FROM u GROUP BY code), b AS (SELECT w AS word, count(*) AS b FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '' GROUP BY w) SELECT coalesce(a.word, b.word) AS word, coalesce(a, b) AS cnt, a IS NOT NULL AND b IS NOT NULL AS both FROM a FULL JOIN b ON a.word = b.word")
def one_source_usage(spark, sf_dir):
    """E6."""
    count = lambda df: df.groupBy("word").agg(F.count("*").alias("cnt"))
    return vocabulary.one_source(count(utterances(spark, sf_dir).withColumnRenamed("code", "word")), count(words_of(spark, sf_dir)))


@query(f"WITH {STREAM} SELECT right(word, 2) AS suffix, CAST(sum(cnt) AS BIGINT) AS usage, count(*) AS n_words FROM uni WHERE length(word) > 3 GROUP BY 1")
def suffix_usage(spark, sf_dir):
    """Usage by the last two letters."""
    words = corpus.unigrams(stream(spark, sf_dir)).where(F.length("word") > 3)
    return words.groupBy(F.expr("right(word, 2)").alias("suffix")).agg(F.sum("cnt").alias("usage"), F.count("*").alias("n_words"))


@query("""WITH b AS (SELECT DISTINCT w AS word, lower(w) AS phones FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
c AS (SELECT DISTINCT w AS word, CASE WHEN length(w) > 4 THEN replace(upper(w), 'ẞ', 'SS') END AS phones FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '')
SELECT * FROM b WHERE word NOT IN (SELECT word FROM c) UNION ALL SELECT * FROM c WHERE phones IS NOT NULL""")
def dict_upsert(spark, sf_dir):
    """Entries put in, changed or deleted."""
    base = words_of(spark, sf_dir).distinct().select("word", F.lower("word").alias("phones"))
    changes = words_of(spark, sf_dir, "conversations").distinct().select("word", F.when(F.length("word") > 4, F.upper("word")).alias("phones"))
    return vocabulary.upsert(base, changes, ["word"], "phones")


@query("""WITH w AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) > 5),
p AS (SELECT word, left(word, 3) AS part, 'left' AS side FROM w UNION ALL SELECT word, substr(word, 4), 'right' FROM w) SELECT word, CASE side WHEN 'left' THEN part || '~' ELSE '~' || part END AS part FROM p""")
def word_parts(spark, sf_dir):
    """Parts of words with tildes."""
    words = words_of(spark, sf_dir).where(F.length("word") > 5).distinct()
    side = lambda text, name: F.struct(text.alias("part"), F.lit(name).alias("side"))
    parts = words.select("word", F.inline(F.array(side(F.substring("word", 1, 3), "left"), side(F.expr("substring(word, 4)"), "right"))))
    return parts.select("word", vocabulary.tilde(F.col("part"), F.col("side")).alias("part"))


@query("""WITH p AS (SELECT page_id AS line, url AS path, regexp_extract(url, '([0-9]+)', 1) AS own FROM pages), i AS (SELECT line, CASE WHEN line % 10 = 3 THEN own || 'x' ELSE own END AS id FROM p WHERE line % 50 <> 7)
SELECT p.line, p.path, i.id, coalesce(contains(p.path, i.id), false) AS ok FROM p LEFT JOIN i USING (line)""")
def file_consistency(spark, sf_dir):
    """H6: two files line by line; a tenth of the ids is not in its path, some lines are missing."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line"), F.col("url").alias("path"), F.regexp_extract("url", "([0-9]+)", 1).alias("own"))
    ids = p.where("line % 50 <> 7").select("line", F.when(F.col("line") % 10 == 3, F.concat("own", F.lit("x"))).otherwise(F.col("own")).alias("id"))
    return vocabulary.consistent(p.select("line", "path"), ids)
