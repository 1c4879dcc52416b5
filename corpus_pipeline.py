"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

1. quality: documents that the attention classifier rejects go,
2. near_dedup: one document of each class of near copies stays,
3. substring_dedup: later copies of repeated passages are cut out,
4. secrets: spans of secrets are replaced by a mark,
5. packing: texts are tokenized and packed; a row for each piece.

Stages 1 to 4 return the columns of documents (``n_chars`` follows the text). Each
stage's result is written as Parquet to the shared folder and read again.

Edge cases, for every stage: an empty table gives an empty one; null ids and nulls in other columns are kept as they are; further columns, of
whatever names, go along in stages 1 to 4 and are left out by the last.
"""

from __future__ import annotations

from lexiloom.llm import chunks, neardup, packing, quality, secrets
from lexiloom.llm.common import materialize


def quality_stage(spark, docs, sf_dir):
    """Documents with a score of 0.3 or more; labels of ids whose remainder is 0 are not used. Null and empty texts are scored like others (a passage of zeros), a
    score of just 0.3 stays, repeated rows stay or go together, very long texts are scored by all of their passages."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs, sf_dir):
    """Of each class of near copies (five words, 0.8), the document with the least id; rows without an id come last, and of rows that share an id the least
    text digest counts, of equal rows one. Null and empty texts are one class; very long texts are compared by all of their words."""
    return neardup.keep_one(docs)


def substring_dedup_stage(spark, docs, sf_dir):
    """All documents, without copies of passages that a kept copy has elsewhere. Null and empty texts stay as they are; the copy in the least id (null ids come first),
    there in the least text digest, is kept; equal rows are one document, so what only they share is not cut."""
    return chunks.remove(docs)


def secrets_stage(spark, docs, sf_dir):
    """All documents, with ``[SECRET]`` in place of each secret; of spans that overlap the first one's mark stands for both. A null text stays null; repeated rows come out equal."""
    return secrets.redact(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of sequences of 4096 tokens. A null or empty text is its closing id alone; repeated rows are packed each on its own; very long texts fill whole sequences."""
    return packing.pack_texts(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Training, similarity classes and tokenizing can't be put in SQL; test_pipeline_against_its_parts compares each stage with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
