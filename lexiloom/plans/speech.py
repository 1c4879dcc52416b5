"""Further queries of the catalogue: numbers, pronunciation, signals, model files, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import numerals, phonetics
from lexiloom.functions import text as T
from lexiloom.operators import corpus, speech
from lexiloom.operators.shared import stored
from lexiloom.plans.catalogue import STREAM, query, stream, table
from lexiloom.sources import sinks
from lexiloom.streaming import text

#: Latin letters to Ukrainian ones, to run pronunciation rules over the given tables.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхіжклмнопкрстувшєиз"


def cyrillic_words(spark, sf_dir):
    """Distinct words of documents that have Latin letters only, in Ukrainian letters."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).distinct().where(F.col("w").rlike("^[A-Za-z]+$"))
    return words.select(F.translate(F.lower("w"), LATIN, CYRILLIC).alias("word")).distinct()


_DISTINCT = """WITH w AS MATERIALIZED (SELECT DISTINCT translate(lower(u), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхіжклмнопкрстувшєиз') AS word FROM (SELECT unnest(l) AS u FROM (
SELECT regexp_extract_all(coalesce(text, ''), '[^.?!…_"#$%&+/:;<=>@\\\\^\\[\\](){},‚§©«»“”„‟–—*•№\\x{F009}¬\\-\'\'’`\\t\\r\\n \\x{00A0}0-9]+') AS l FROM documents)) WHERE regexp_full_match(u, '[A-Za-z]+'))"""


@query()
def number_words(spark, sf_dir):
    """Numbers of documents in Ukrainian words."""
    return numerals.spelled(table(spark, sf_dir, "documents"))


#: Letters with marks as well, so that vowels with a J in them, щ and soft signs are there.
MARKED, LETTERS = "äöüßéèêñóíáç", "яїющєєєнуіац"


def pronounced_words(spark, sf_dir):
    """Distinct words of documents in Latin letters, marked ones too, in Ukrainian letters."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).distinct().where(F.col("w").rlike(f"^[A-Za-z{MARKED}]+$"))
    return words.select(F.translate(F.replace(F.replace("w", F.lit("th"), F.lit("ть")), F.lit("ns"), F.lit("н'ї")), LATIN + MARKED + LATIN.upper(), CYRILLIC + LETTERS + CYRILLIC).alias("word")).distinct()


_STRESS = "CAST(NULL AS INTEGER)"
_CODES = """w AS MATERIALIZED (SELECT DISTINCT translate(replace(replace(u, 'th', 'ть'), 'ns', 'н''ї'), 'abcdefghijklmnopqrstuvwxyzäöüßéèêñóíáçABCDEFGHIJKLMNOPQRSTUVWXYZ', 'абцдефгхіжклмнопкрстувшєизяїющєєєнуіацабцдефгхіжклмнопкрстувшєиз') AS word FROM (SELECT unnest(l) AS u FROM (
SELECT regexp_extract_all(coalesce(text, ''), '[^.?!…_"#$%&+/:;<=>@\\\\^\\[\\](){},‚§©«»“”„‟–—*•№\\x{F009}¬\\-''’`\\t\\r\\n \\x{00A0}0-9]+') AS l FROM documents)) WHERE regexp_full_match(u, '[A-Za-zäöüßéèêñóíáç]+')),
t AS (SELECT word, regexp_extract_all(word, 'нтськ|стськ|нтст|здж|стд|стс|стц|тьс|дз|дж|зж|сш|тс|тц|тч|щ|.') AS t FROM w),
c AS (SELECT word, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] = 'ї' THEN 'Ji' WHEN t[i] = 'ь' THEN '~' WHEN t[i] = '''' THEN '^' WHEN t[i] = 'і' THEN '~i' WHEN t[i] = 'е' THEN '^e'
  WHEN t[i] IN ('є', 'ю', 'я') THEN CASE WHEN i = 1 OR contains('ь''аеиіоуєюяї', right(t[i - 1], 1)) THEN 'J' ELSE '+' END || translate(t[i], 'єюя', 'eua')
  WHEN t[i] IN ('а', 'и', 'о', 'у') THEN translate(t[i], 'аиоу', 'ayou')
  WHEN t[i] = 'нтськ' THEN 'NS~K' WHEN t[i] = 'стськ' THEN 'S~K' WHEN t[i] = 'нтст' THEN 'NST' WHEN t[i] = 'здж' THEN 'WU' WHEN t[i] = 'стд' THEN 'ZD' WHEN t[i] = 'стс' THEN 'SS' WHEN t[i] = 'стц' THEN 'SC' WHEN t[i] = 'тьс' THEN 'C~'
  WHEN t[i] = 'дз' THEN 'E' WHEN t[i] = 'дж' THEN 'U' WHEN t[i] = 'зж' THEN 'WW' WHEN t[i] = 'сш' THEN 'YY' WHEN t[i] = 'тс' THEN 'C' WHEN t[i] = 'тц' THEN 'CC' WHEN t[i] = 'тч' THEN 'XX' WHEN t[i] = 'щ' THEN 'YX'
  WHEN t[i] IN ('б', 'г', 'д', 'ж', 'з') AND regexp_matches(array_to_string(t[i + 1 :], ''), '^ь?[пхктцчсшфщ]') THEN translate(t[i], 'бгджз', 'PQTYS') ELSE translate(t[i], 'бвгґджзйклмнпрстфхцчш', 'BVHGDWZJKLMNPRSTFQCXY') END) AS c FROM t),
p AS (SELECT word, regexp_extract_all(array_to_string(c, ''), '[A-Z][~^+]*|[a-z]') AS p FROM c),
q AS (SELECT word, p, array_to_string([left(x, 1) for x in p], '') AS b, [CASE WHEN length(x) > 1 THEN right(x, 1) ELSE '' END for x in p] AS e FROM p),
s AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: e[i] IN ('~', '+') OR coalesce(b[i] = b[i + 1] AND e[i + 1] = '+', false)) AS soft FROM q),
v AS (SELECT word, b, list_transform(range(1, len(p) + 1), lambda i: soft[i] OR len(list_filter(range(i + 1, len(p) + 1), lambda j: soft[j] AND regexp_full_match(substr(b, i, j - i + 1), '[DETCZSNL]+'))) > 0) AS soft,
  list_transform(range(1, len(p) + 1), lambda i: CASE WHEN regexp_matches(substr(b, i), '^[PQKTCXSY]+[BHGDEUZW]') THEN translate(b[i], 'PQKTCXSY', 'BHGDEUZW') ELSE b[i] END) AS f FROM s),
ph AS MATERIALIZED (SELECT word, CASE WHEN regexp_matches(word, '(^|[аеиіоуєюяї])[- '']*ь') THEN NULL ELSE list_transform(range(1, len(f) + 1), lambda i: CASE f[i] WHEN 'W' THEN 'ZH' WHEN 'Q' THEN 'KH' WHEN 'C' THEN 'TS' WHEN 'X' THEN 'CH' WHEN 'Y' THEN 'SH' WHEN 'E' THEN 'DZ' WHEN 'U' THEN 'DZH' ELSE upper(f[i]) END ||
  CASE WHEN regexp_full_match(f[i], '[a-z]') THEN CASE WHEN len(regexp_extract_all(b, '[a-z]')) = 1 OR coalesce(len(regexp_extract_all(left(b, CAST(i AS INTEGER)), '[a-z]')) = 1 + CAST(NULL AS INTEGER), false) THEN '1' ELSE '' END WHEN soft[i] THEN CASE WHEN contains('DEZLNRSTC', f[i]) THEN '1' WHEN f[i] = 'J' THEN '' ELSE '2' END ELSE '' END) END AS phones FROM v)"""


@query(f"WITH {_CODES} SELECT word, array_to_string(phones, ' ') AS phones FROM ph")
def g2p(spark, sf_dir):
    """Phones of distinct words."""
    return pronounced_words(spark, sf_dir).select("word", F.array_join(phonetics.g2p(F.col("word")), " ").alias("phones"))


@query(f"WITH {_CODES}, x AS (SELECT DISTINCT word, regexp_replace(unnest(phones), '[0-9]+$', '') AS phone FROM ph) SELECT phone, count(*) AS n_words FROM x GROUP BY phone")
def phone_inventory(spark, sf_dir):
    """Phones without their marks and how many words have them."""
    phones = pronounced_words(spark, sf_dir).select("word", F.explode(F.array_distinct(phonetics.strip_modifiers(phonetics.g2p(F.col("word"))))).alias("phone"))
    return phones.groupBy("phone").agg(F.count("*").alias("n_words"))


@query(f"""WITH {_CODES}, r AS (SELECT word, array_to_string(phones, ' ') AS rule FROM ph WHERE phones IS NOT NULL) SELECT word, replace(replace(rule, '2', ''), 'KH', 'H') AS phones, rule FROM r WHERE contains(rule, '2') OR contains(rule, 'KH')""")
def speller_diff(spark, sf_dir):
    """Entries of a dictionary whose phones are not those that the rules give; the dictionary has no palatal phones and another one for KH."""
    phones = F.replace(F.array_join(phonetics.g2p(F.col("word"), palatal=False), " "), F.lit("KH"), F.lit("H"))
    return phonetics.differing(stored(pronounced_words(spark, sf_dir).select("word", phones.alias("phones"))))


@query(f"WITH {_CODES.replace(_STRESS, 'CASE WHEN length(word) % 2 = 0 THEN length(word) % 3 END')} SELECT word, array_to_string(phones, ' ') AS phones FROM ph")
def stressed_phones(spark, sf_dir):
    """Phones with the stress of a dictionary, which half of the words have (by their length)."""
    words = stored(pronounced_words(spark, sf_dir))
    stresses = words.where(F.length("word") % 2 == 0).select("word", (F.length("word") % 3).alias("syllable"))
    return phonetics.stressed_g2p(words, stresses).select("word", F.array_join("phones", " ").alias("phones"))


@query(f"WITH {_CODES} SELECT word, CAST(CASE WHEN regexp_matches(substr(word, 3, 1), '[аеиіоуєюяї]') THEN len(regexp_extract_all(left(word, 2), '[аеиіоуєюяї]')) ELSE -1 END AS INTEGER) AS syllable FROM w")
def vowel_syllables(spark, sf_dir):
    """The syllable of the third letter, -1 if it is no vowel."""
    return pronounced_words(spark, sf_dir).select("word", phonetics.syllable_at(F.col("word"), F.lit(2)).cast("int").alias("syllable"))


_ENDS = f"""{_DISTINCT},
e AS (SELECT word, unnest(range(1, 7)) AS k FROM w), f AS MATERIALIZED (SELECT word, right(word, CAST(k AS INTEGER)) AS suffix, k FROM e WHERE length(word) - k >= 2),
s AS MATERIALIZED (SELECT suffix FROM f WHERE k >= 2 GROUP BY suffix HAVING count(*) >= 5),
b AS MATERIALIZED (SELECT word, max_by(suffix, k) AS suffix FROM f JOIN s USING (suffix) GROUP BY word)
SELECT w.word, left(w.word, CAST(length(w.word) - coalesce(length(b.suffix), 0) AS INTEGER)) AS stem, b.suffix FROM w LEFT JOIN b USING (word)"""


@query(_ENDS)
def suffix_split(spark, sf_dir):
    """Words split before the longest of the endings that five words or more share."""
    words = stored(cyrillic_words(spark, sf_dir))
    ends = words.select("word", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("k")).where(F.length("word") - F.col("k") >= 2)
    return phonetics.suffix_split(words, ends.groupBy(F.expr("right(word, k)").alias("suffix")).agg(F.count("*").alias("n")).where("n >= 5"))


@query(f"{_DISTINCT} SELECT word, CAST(coalesce((list_filter(range(1, length(word) + 1), lambda i: regexp_full_match(word[i], '[аеєиіїоуюя]')))[2], 0) - 1 AS INTEGER) AS second_vowel FROM w")
def syllable_places(spark, sf_dir):
    """The place of the second vowel, -1 without one."""
    return cyrillic_words(spark, sf_dir).select("word", phonetics.vowel_at(F.col("word"), F.lit(1)).cast("int").alias("second_vowel"))


@query(
    f"""WITH {STREAM}, u AS (SELECT word, CAST(round(log10(cnt / (SELECT sum(cnt) FROM uni)), 6) AS DECIMAL(12, 6)) AS lp FROM uni),
b2 AS (SELECT w1, w2, CAST(round(log10(0.8 * cnt / sum(cnt) OVER (PARTITION BY w1)), 6) AS DECIMAL(12, 6)) AS lp FROM bi)
SELECT 1 AS section, '\\data\\' AS line UNION ALL SELECT 1, 'ngram 1=' || count(*) FROM u UNION ALL SELECT 1, 'ngram 2=' || count(*) FROM b2
UNION ALL SELECT 2, '\\1-grams:' UNION ALL SELECT 2, CAST(lp AS VARCHAR) || ' ' || word || ' -0.698970' FROM u
UNION ALL SELECT 3, '\\2-grams:' UNION ALL SELECT 3, CAST(lp AS VARCHAR) || ' ' || w1 || ' ' || w2 FROM b2 UNION ALL SELECT 4, '\\end\\'"""
)
def arpa_lines(spark, sf_dir):
    """B1: the lines of the language model's file."""
    s = stored(corpus.pairs(stream(spark, sf_dir)))
    ones, twos = corpus.lm_unigram(stored(corpus.unigrams_of(s))), corpus.lm_bigram(corpus.bigrams_of(s))
    return sinks.arpa_lines(ones, stored(twos)).select("section", "line")


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents), c AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)
SELECT conv_id, turn, count(*) AS n_words, count(v.word) AS n_known FROM c LEFT JOIN v ON regexp_replace(c.word, '\\([0-9]+\\)$', '') = v.word WHERE c.word <> '' GROUP BY ALL""")
def utterance_validation(spark, sf_dir):
    """Words of utterances that the vocabulary has, without the number of a pronunciation; an equality join."""
    known = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("base")).distinct().withColumn("known", F.lit(1))
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    words = words.groupBy("conv_id", "turn", F.regexp_replace("word", r"\([0-9]+\)$", "").alias("base")).agg(F.count("*").alias("n"))
    return words.join(known, "base", "left").groupBy("conv_id", "turn").agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.expr("n * known")), F.lit(0)).alias("n_known"))


@query("""WITH i AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 60 AS e FROM orders),
m AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(s)) FROM i), (SELECT date_trunc('month', max(e)) FROM i), INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT strftime(month, '%Y-%m') AS month, count(*) AS n FROM i JOIN m ON i.s < m.month + INTERVAL 1 MONTH AND m.month <= i.e GROUP BY month""")
def interval_overlap(spark, sf_dir):
    """Orders whose 60 days overlap each month. An interval names the months it meets: no range join."""
    day = F.col("o_orderdate").cast("date")
    months = F.sequence(F.trunc(day, "month"), F.trunc(F.date_add(day, 60), "month"), F.expr("interval 1 month"))
    return table(spark, sf_dir, "orders").select(F.explode(months).alias("m")).groupBy(F.date_format("m", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text <> '') c
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = c.text)""")
def result_diff(spark, sf_dir):
    """Results that the cache lacks."""
    new = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text <> ''").select("conv_id", "turn", "text").distinct()
    return new.join(table(spark, sf_dir, "documents").select("text"), "text", "left_anti").select("conv_id", "turn")


@query(r"""WITH b AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '<[^>]*>') AS l FROM pages WHERE html IS NOT NULL),
x AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS block FROM b) SELECT page_id, CAST(pos AS INTEGER) AS pos, block FROM x WHERE regexp_matches(block, '[^ \t\r\n]')""")
def text_blocks(spark, sf_dir):
    """Text nodes after the body's start."""
    body = F.regexp_replace("html", r"(?is)^.*?<body[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(body, "<[^>]*>")).alias("pos", "block")).where(F.col("block").rlike(r"[^ \t\r\n]"))


@query()
def gmm_classify(spark, sf_dir):
    """Accuracy by label of two-component mixtures."""
    data = table(spark, sf_dir, "embeddings")
    model = speech.gmm_train(data, "label", "embedding")
    return data.withColumn("best", speech.gmm_classify(F.col("embedding"), model, dict(data.dtypes)["label"])).groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("best") == F.col("label")).cast("int")).alias("correct"))


@query()
def mfcc(spark, sf_dir):
    """M1 to M8: cepstral features of each user's values, in frames of 32 every 16, numbered within the user."""
    return speech.cepstra(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 8000.0, 32, 16)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def activity_sessions(spark, sf_dir):
    """O3: sessions of events; the same plan runs on a stream."""
    return text.activity_sessions(table(spark, sf_dir, "events"))
