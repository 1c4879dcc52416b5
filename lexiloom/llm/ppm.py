"""LM scoring: prediction by partial matching over bytes.

A text is the byte stream of its tokens (runs of bytes other than ASCII white
space, A-Z lowered), a space between two of them and a line end after the last. The
context of a byte is the ``ORDER`` bytes before it, over spaces too; before a text there are line ends.
Escapes are estimated by method D (each distinct symbol gives half a count to novel ones), symbols
seen in a longer context are excluded in shorter ones, and below the empty
context all remaining bytes are equally likely. The model is pretrained: counts
come from the training rows alone, and a document's score is the sum of the
log10 probabilities of its bytes.

How it is spread: a document belongs to a block, a stretch of an input file (or, where the rows don't come from files, a hash). What a task reads is counted in
arrays as it streams by: the distinct (context, byte) codes and words' hashes of each block, 64 bits each, are all that leaves it.
They are kept in a table bucketed by key, so sums by key and the join with the answers shuffle nothing more of it.
Sums by key give the corpus counts; the trie's probabilities follow level by level, in sorted arrays, for the contexts that end in
the same three bytes (many such groups in a task, of about ``GROUP_KEYS`` codes together); each block gets back the
keys that it asked for, packed, and documents are read past them in a stream. A key is asked for once by a block, so no key is hot.
Statistics of contexts of two bytes or fewer (2**24 entries at the very most) go to all tasks.

Edge cases: null and empty texts are one end token; a null id is neither held
out nor used for training; without training rows all bytes are equally likely
and c = N = V = 0; repeated rows score alike (each counts in training). Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bucketed, materialize, remainder, slices, utf8

ORDER = 5
LOW = 3  # codes of as many bytes, the last one's context has two, are known to all tasks
BLOCK_BYTES = 64 << 20
GROUP_KEYS = 100_000
BATCH_BYTES = 2 << 20
MERGE_KEYS = 1 << 20
BUCKET_BYTES = 16 << 20
END_KEY = -1


def below(order: int) -> int:
    """A mask of the last byte and a context of ``order`` bytes."""
    return (1 << (8 * (order + 1))) - 1


def stream(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, Words]:
    """The code of each byte of the texts' streams (its context's bytes and itself, the latest lowest), where each text's codes begin, and the words."""
    parts = [b" ".join(t.lower().split()) for t in texts]
    gap = b"\n" * (order + 1)
    d = np.frombuffer(gap[1:] + gap.join(parts) + b"\n", np.uint8).astype(np.int64)
    code = d.copy()
    for j in range(1, order + 1):
        code[j:] |= d[:-j] << (8 * j)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begin = np.cumsum(sizes + order) - sizes
    first = np.cumsum(sizes) - sizes
    return code[np.arange(int(sizes.sum())) + np.repeat(begin - first, sizes)], first, Words(parts)


def word_keys(words: Words) -> np.ndarray:
    """Negative numbers that stand for words."""
    return (words.hashes() | U64(1 << 63)).view(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(n, new)


class Counts:
    """Counts by key, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, train: bool) -> None:
        if len(keys):
            own, n = np.unique(keys, return_counts=True)
            self.parts.append((own, n if train else np.zeros_like(n)))
            if len(self.parts) > 2 and sum(len(k) for k, _ in self.parts[1:]) > max(MERGE_KEYS, len(self.parts[0][0])):
                self.parts = [self.all()]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*self.parts)))


class Level:
    """The contexts of one length: distinct codes with counts, and each context's total and number of distinct bytes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        context = codes >> 8
        new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
        self.contexts = context[new]
        self.of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(codes))))
        self.total = np.add.reduceat(n, new) if len(new) else n
        self.distinct = np.bincount(self.of, minlength=len(new))


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def levels(codes: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> list[Level]:
    """The trie by length of context, from codes with counts; lengths of two and less come from ``low``."""
    seen = n > 0
    codes, n, out = codes[seen], n[seen], []
    for k in range(order, -1, -1):
        if k == min(order, LOW - 1):
            codes, n = low
        codes, n = summed(codes & below(k), n)
        out.append(Level(codes, n))
    return out[::-1]


def log10_p(codes: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of the probability of each code's last byte after the others."""
    out = np.zeros(len(codes))
    open_, longer = np.ones(len(codes), bool), np.full(len(codes), -1)
    above: Level | None = None
    for k in range(len(trie) - 1, -1, -1):
        level = trie[k]
        if above is not None:  # counts here of the bytes that each longer context has seen
            at, _ = find(level.codes, above.codes & below(k))
            taken = np.bincount(above.of, level.n[at], len(above.contexts))
        here, there = find(level.contexts, (codes & below(k)) >> 8)
        total, novel = np.zeros(len(codes)), np.zeros(len(codes))
        total[there], novel[there] = level.total[here[there]], level.distinct[here[there]]
        some = longer >= 0
        if above is not None and some.any():
            total[some] -= taken[longer[some]]
            novel[some] -= above.distinct[longer[some]]
        at, known = find(level.codes, codes & below(k))
        go = open_ & there & (total > 0)
        hit, miss = go & known, go & ~known
        out[hit] += np.log10((level.n[at[hit]] - 0.5) / total[hit])
        out[miss] += np.log10(0.5 * novel[miss] / total[miss])
        open_ &= ~hit
        longer = np.where(there, here, -1)
        above = level
    rest = 256 - (len(trie[0].codes) if len(trie[0].codes) else 0)
    out[open_] -= np.log10(rest) if rest else 0.0
    return out


def count(rows: DataFrame) -> DataFrame:
    """block, key, n: the keys that each task sees of each block, with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Counts] = {}
        for batch in batches:
            texts, train, block = [utf8(t) for t in batch.column("t").to_pylist()], batch.column("train").to_numpy(zero_copy_only=False).astype(bool), batch.column("block").to_numpy()
            for part in slices(texts, [len(t) for t in texts], BATCH_BYTES):
                for b in np.unique(block[part]).tolist():
                    for side in (True, False):
                        own = [t for t, x, y in zip(texts[part], train[part], block[part]) if x == side and y == b]
                        if own:
                            codes, _, words = stream(own)
                            counts = kept.setdefault(b, Counts())
                            counts.add(codes, side)
                            counts.add(np.append(word_keys(words), np.full(len(own), END_KEY)), side)
        for b, counts in kept.items():
            keys, n = counts.all()
            for lo in range(0, len(keys), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), b)), pa.array(keys[part]), pa.array(n[part])], names=["block", "key", "n"])

    return rows.select("block", "t", "train").mapInArrow(run, "block long, key long, n long")


def weigh(pairs: DataFrame) -> DataFrame:
    """key, value: log10 of the probability of each code, from key, n."""
    low = pairs.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(below(LOW - 1))).alias("key")).agg(F.sum("n").alias("n")).toPandas()  # at most 2**24 rows by construction
    low_all = pairs.sparkSession.sparkContext.broadcast(summed(low["key"].to_numpy(np.int64), low["n"].to_numpy(np.int64)))

    def of_group(pdf):
        codes, n = summed(pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"key": codes, "value": log10_p(codes, levels(codes, n, low_all.value))})

    groups = max(1, -(-pairs.count() // GROUP_KEYS))
    ending = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    return pairs.select("key", "n", F.pmod(F.xxhash64(ending), F.lit(groups)).alias("group")).groupBy("group").applyInPandas(lambda pdf: of_group(pdf), "key long, value double")


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys with their values (counts of words, in 64 bits; logarithms of codes, in 32), compressed: differences of sorted keys, byte by byte."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    words = int(np.searchsorted(keys, 0))
    steps = np.ascontiguousarray(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T)
    body = steps.tobytes() + values[:words].astype(np.int64).tobytes() + values[words:].astype(np.float32).tobytes()
    return np.array([len(keys), words, len(body)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, words, size = np.frombuffer(data[:24], np.int64).tolist()
    body = pa.Codec("zstd", 1).decompress(data[24:], size, asbytes=True)
    keys = np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n).reshape(8, n).T).view(np.int64).ravel())
    return keys, np.concatenate([np.frombuffer(body, np.int64, words, 8 * n).astype(float), np.frombuffer(body, np.float32, n - words, 8 * (n + words)).astype(float)])


def pack(answers: DataFrame) -> DataFrame:
    """block, data: what each task has of each block's answers (block, key, value), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(batch.column(c).to_numpy() for c in ("block", "key", "value")) for batch in batches]
        if parts:
            block, key, value = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(block, kind="stable")
            block, key, value = block[order], key[order], value[order]
            cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)).tolist()
            for i in range(0, len(cuts) - 1, 1000):
                own = list(zip(cuts[i : i + 1000], cuts[i + 1 : i + 1001]))
                yield pa.RecordBatch.from_arrays([pa.array(block[[lo for lo, _ in own]]), pa.array([packed(key[lo:hi], value[lo:hi]) for lo, hi in own], pa.binary())], names=["block", "data"])

    return answers.select("block", "key", "value").mapInArrow(run, "block long, data binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, block_bytes: int = BLOCK_BYTES, file_rows: tuple[Column, Column] | None = None) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score for every row. ``file_rows`` names a row's file and its
    number there, so that blocks are stretches of files; without it blocks are dealt by a hash, and tasks ask for more keys."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(t)).alias("size"), F.count("*").alias("n")).first()
    n_blocks = max(1, -(-int(size["size"] or 0) // block_bytes))
    if file_rows is None:
        block = F.pmod(F.xxhash64(F.col(id_col), t), F.lit(n_blocks))
    else:
        block = F.xxhash64(file_rows[0], F.floor(file_rows[1] / F.lit(max(1, -(-size["n"] // n_blocks)))))
    df = docs.select(F.col(id_col).alias("k"), t.alias("t"), F.coalesce(remainder(id_col) != held_out, F.lit(False)).alias("train"), F.coalesce(remainder(id_col) == held_out, F.lit(False)).alias("held_out"), block.alias("block"))

    asked = bucketed(count(df), "ppm_asked", "key", max(4, -(-int(size["size"] or 0) // BUCKET_BYTES)))
    known = materialize(asked.groupBy("key").agg(F.sum("n").alias("n")), "ppm-known")
    words = known.where("key < 0 and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, base_c = words["n"] or 0, (words["n"] or 0) + 0.5 * (words["v"] + 1)
    answers = weigh(known.where("key >= 0")).unionByName(known.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    got = pack(asked.groupBy("key", "block").agg(F.lit(1)).join(answers, "key"))
    kind = dict(df.dtypes)["k"]
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    both = got.select("block", F.lit(0).alias("side"), "data", none("k", kind), none("t", "string"), none("held_out", "boolean")).unionByName(
        df.select("block", F.lit(1).alias("side"), none("data", "binary"), "k", "t", "held_out")
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        keys, values, of, whole = np.zeros(0, np.int64), np.zeros(0), None, False
        for batch in batches:
            block, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1, [len(block)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                if block[lo] != of:
                    parts, of, whole = [], block[lo], False
                rows = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    parts += map(unpacked, rows.column("data").to_pylist())
                    continue
                if not whole:
                    keys, values = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    keys, values, parts, whole = keys[order], values[order], [], True
                texts = [utf8(t) for t in rows.column("t").to_pylist()]
                for part in slices(texts, [len(t) for t in texts], BATCH_BYTES):
                    codes, first, words = stream(texts[part])
                    c = values[np.searchsorted(keys, word_keys(words))]
                    end = values[np.searchsorted(keys, END_KEY)]
                    n = len(first)
                    known = np.bincount(words.doc[c > 0], minlength=n) + int(end > 0)
                    base = np.bincount(words.doc, np.log10((c + 0.5) / base_c), n) + np.log10((end + 0.5) / base_c)
                    logs = np.add.reduceat(values[np.searchsorted(keys, codes)], first)
                    at = rows.slice(part.start, n)
                    columns = [at.column("k"), at.column("held_out"), *map(pa.array, (words.counts + 1, known.astype(np.int64), np.full(n, n_train), base, logs))]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(total, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", id_col)


def op3_lm_scoring(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs.metadataColumn("_metadata")  # also where a column of the table has this name
    return score(docs, file_rows=(at["file_path"], at["row_index"]))
