"""Queries on prefixes and suffixes of words. A group of forms is the words of a language that share their first three letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import prefixes
from lexiloom.plans.catalogue import query, table

_LETTERS = "[a-zäöüßéèêçñóíá]+"
_CONSONANTS = "bcdfghjklmnpqrstvwxzßçñ"
_WORDS = rf"w AS MATERIALIZED (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_LETTERS}')) AS word FROM documents)"


def _words(spark, sf_dir):
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_LETTERS), 0)
    return table(spark, sf_dir, "documents").select("lang", F.explode(found).alias("word")).distinct()


@query(f"""WITH {_WORDS}, d AS (SELECT DISTINCT word FROM w), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM d)
SELECT left(word, k) AS prefix, count(*) AS n, max(CASE WHEN length(word) = k THEN 1 ELSE 0 END) = 1 AS whole, count(DISTINCT nullif(substr(word, k + 1, 1), '')) AS branches FROM p GROUP BY 1 HAVING count(*) >= 3""")
def prefix_tree(spark, sf_dir):
    """Prefixes that three distinct words or more share."""
    return prefixes.prefix_tree(_words(spark, sf_dir), 3)


_SPLIT = f"""{_WORDS},
s AS MATERIALIZED (SELECT lang AS class, right(word, k) AS suffix FROM w, range(1, 5) t(k) WHERE length(word) - k >= 3 GROUP BY 1, 2 HAVING count(*) >= 20 UNION SELECT NULL, unnest(['s', 'en'])),
f AS MATERIALIZED (SELECT left(word, 3) || ' ' || lang AS name, lang AS class, word AS form FROM w),
e AS (SELECT DISTINCT class, form, k FROM (SELECT class, form, unnest(range(1, 9)) AS k FROM f) x WHERE length(form) > k AND EXISTS (SELECT 1 FROM s WHERE (s.class IS NULL OR s.class = x.class) AND s.suffix = right(form, k))),
b AS (SELECT class, form, max(k) AS k FROM e GROUP BY ALL),
x AS MATERIALIZED (SELECT name, f.class, f.form, left(f.form, length(f.form) - coalesce(k, 0)) AS stem, CASE WHEN k > 0 THEN right(f.form, k) END AS suffix FROM f LEFT JOIN b USING (class, form))"""


def _split(spark, sf_dir):
    w = _words(spark, sf_dir)
    ends = w.select("lang", "word", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).where(F.length("word") - F.col("k") >= 3)
    ends = ends.groupBy(F.col("lang").alias("class"), F.expr("right(word, k)").alias("suffix")).agg(F.count("*").alias("n")).where("n >= 20").drop("n")
    every = spark.createDataFrame([(None, "s"), (None, "en")], "class string, suffix string")
    each = prefixes.forms(w.select(F.concat(F.substring("word", 1, 3), F.lit(" "), "lang").alias("name"), F.col("lang").alias("class"), F.col("word").alias("form")))
    return prefixes.split_forms(each, ends.unionByName(every))


@query(f"WITH {_SPLIT} SELECT class, suffix, count(*) AS n FROM x WHERE suffix IS NOT NULL GROUP BY class, suffix")
def splitter_suffixes(spark, sf_dir):
    """How often words were split before each suffix of the splitter."""
    return prefixes.suffix_usage(_split(spark, sf_dir))


_STEMS = rf"""{_SPLIT}, c AS (SELECT name, stem, count(*) AS n, coalesce(nullif(regexp_extract(stem, '^.*[{_CONSONANTS}{_CONSONANTS.upper()}][ь'']*'), ''), left(stem, 1)) AS core FROM x GROUP BY name, stem),
g AS (SELECT name, core, list(stem) AS l, sum(n) AS n FROM c GROUP BY name, core),
t AS (SELECT name, left(l[1], coalesce(list_max([k for k in range(1, length(l[1]) + 1) if len([q for q in l if left(q, k) = left(l[1], k)]) = len(l)]), 0)) AS stem, CAST(n AS BIGINT) AS n FROM g)"""


@query(f"WITH {_STEMS} SELECT name, stem, n FROM t")
def form_stems(spark, sf_dir):
    """Stems of forms, merged where they differ only after their last consonant."""
    return prefixes.stems(_split(spark, sf_dir), _CONSONANTS)


@query(f"WITH {_STEMS} SELECT name, CAST(sum(CASE WHEN right(stem, 1) IN ('t', 'n') THEN 0 ELSE 1 END) AS BIGINT) AS n FROM t GROUP BY name")
def stem_counts(spark, sf_dir):
    """Different stems by group, without those that end in some letters."""
    return prefixes.different_stems(prefixes.stems(_split(spark, sf_dir), _CONSONANTS), "tn")
