"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 32 words. Each passage is encoded (byte-class
shares, hashed byte pairs, word statistics, then a learned tanh layer), gated
attention learned from document labels weighs the passages, and the weighted
representation is scored by a logistic unit.

Training takes a bounded sample of labelled rows, in the order of a hash of the id: ``max_train_docs`` rows at most, and as many as have ``MAX_TRAIN_PASSAGES`` passages together; of
each all passages. They are encoded in parallel, and their features, 210 MB at most, are all that reaches the driver. Scores are of all passages of all rows.
Scoring is one narrow pass over all rows without a shuffle; only texts go through Python, further columns stay where they are.

Edge cases: null and empty texts are one passage of zeros and get a score like
any other; of rows that share a labelled id the one with the least hash of its text is learned from; a labelled row with more than ``MAX_TRAIN_PASSAGES`` passages is not; with no labels, or labels of one class only, every score is that
class's smoothed share (0.5 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, free, materialize, mix64, named, remainder, sizes, slices, utf8

PASSAGE_WORDS = 32
MAX_TRAIN_DOCS, MAX_TRAIN_PASSAGES = 4000, 512_000
BATCH_BYTES = 1 << 20
N_CLASSES, N_PAIRS = 32, 64

#: ASCII bytes with a class of their own; the rest fall into lower, upper, digit, space, line end, beyond ASCII, other.
_SINGLE = b"!#$%&*|.,;:?'\"-_/@+=()<>"


def _classes() -> np.ndarray:
    table = np.full(256, 6)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[ord(" ")], table[ord("\n")], table[128:] = 3, 4, 5
    for i, b in enumerate(_SINGLE):
        table[b] = 7 + i
    return table.astype(np.int32)


_CLASS = _classes()
_PAIR = (mix64(np.arange(65536, dtype=np.uint64)) % np.uint64(N_PAIRS)).astype(np.int32)


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text (1 at least)."""
    w = Words(texts)
    per_doc = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
    base = np.cumsum(per_doc) - per_doc
    n = int(per_doc.sum())
    place = np.arange(len(w.starts)) - w.first[w.doc]
    of_word = base[w.doc] + place // PASSAGE_WORDS
    begin = np.zeros(n + 1, np.int64)
    begin[base] = w.offsets
    heads = (place % PASSAGE_WORDS == 0) & (place > 0)
    begin[of_word[heads]] = w.starts[heads]
    begin[n] = len(w.data)
    size = np.diff(begin)
    of_byte = np.repeat(np.arange(n, dtype=np.int64), size)
    by_class = np.bincount(of_byte * N_CLASSES + _CLASS[w.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    pair = _PAIR[w.data[:-1].astype(np.int32) << 8 | w.data[1:]]
    by_pair = np.bincount(of_byte[:-1] * N_PAIRS + pair, minlength=n * N_PAIRS).reshape(n, N_PAIRS)
    words = np.bincount(of_word, minlength=n)
    some = np.maximum(words, 1)
    length = (w.ends - w.starts).astype(np.float64)
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    stats = [
        np.bincount(of_word, length, n) / some / 10,
        np.bincount(of_word[length > 12], minlength=n) / some,
        np.bincount(of_word[length < 3], minlength=n) / some,
        np.bincount(of_word[again], minlength=n) / some,
        np.bincount(of_word[order][new], minlength=n) / some,
        np.log1p(words) / 4,
    ]
    share = 1.0 / np.maximum(size, 1)[:, None]
    return np.hstack([by_class * share, by_pair * share, np.stack(stats, 1)]).astype(np.float32), per_doc


N_FEATURES = N_CLASSES + N_PAIRS + 6


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, per_doc: np.ndarray) -> dict:
    """Scores of documents from their passages' features."""
    starts = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    x = np.clip((x - m["mean"]) / m["std"], -6, 6)
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "doc": doc, "starts": starts, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"][0])}


def gradients(m: dict, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted log loss of documents, by each of the weights."""
    f = forward(m, x, per_doc)
    d = (f["p"] - y) * weight / len(y)
    dz = d[:, None] * m["c"]
    da = (dz[f["doc"]] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["doc"]])
    dg = de[:, None] * m["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[f["doc"]] + dt @ m["V"].T + ds @ m["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"W": f["x"].T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}


def fit(x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 24, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the log loss of document labels; returns the weights as arrays."""
    rng = np.random.default_rng(seed)
    m = {"mean": x.mean(0), "std": x.std(0) + 1e-3}
    m |= {k: rng.normal(0, 1 / np.sqrt(a), (a, b)) for k, (a, b) in {"W": (x.shape[1], hidden), "V": (hidden, gate), "U": (hidden, gate)}.items()}
    m |= {"b": np.zeros(hidden), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "c0": np.zeros(1)}
    names = ["W", "V", "U", "b", "w", "c", "c0"]
    moment, square, step = {k: 0 * m[k] for k in names}, {k: 0 * m[k] for k in names}, 0
    at = np.cumsum(per_doc) - per_doc
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) ** 0.5
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            rows = np.concatenate([np.arange(at[i], at[i] + per_doc[i]) for i in pick])
            g = gradients(m, x[rows], per_doc[pick], y[pick], weight[pick])
            step += 1
            for k in names:
                grad = g[k] + 1e-4 * m[k]
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad**2
                m[k] = m[k] - rate * (0.5 if epoch > epochs // 2 else 1) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 0, max_train_docs: int = MAX_TRAIN_DOCS, max_train_passages: int = MAX_TRAIN_PASSAGES) -> dict:
    """Weights learned from at most ``max_train_docs`` labelled documents, and ``max_train_passages`` of their passages, whose remainder is not ``held_out``."""
    chosen = (
        labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isNotNull() & (remainder("k") != held_out))
        .groupBy("k").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(max_train_docs)
    )

    def encode(batches):
        for pdf in batches:
            for part in slices(pdf, sizes(pdf["text"]), BATCH_BYTES):
                x, per_doc = passage_features([utf8(t) for t in pdf["text"].iloc[part]])
                bags = [c.tobytes() if len(c) <= max_train_passages else b"" for c in np.split(x, np.cumsum(per_doc)[:-1])]
                yield pd.DataFrame({"o": pdf["o"].iloc[part], "y": pdf["y"].iloc[part], "n": per_doc, "x": bags})

    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    rows = (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "k")  # at most max_train_docs ids
        .groupBy("k", "y").agg(least)
        .select(F.xxhash64("k").alias("o"), "y", "least.text")
    )
    rows = materialize(rows.mapInPandas(encode, "o long, y double, n long, x binary").where(F.col("n") <= max_train_passages), "bags")
    counts = rows.select("o", "n").toPandas().sort_values(["o", "n"])  # two numbers for each of max_train_docs rows
    fits = counts["o"][counts["n"].cumsum() <= max_train_passages]
    found = rows.where(F.col("o") <= int(fits.max())).toPandas().sort_values(["o", "x"]) if len(fits) else rows.limit(0).toPandas()
    discard(rows)
    y = (found["y"].to_numpy(float) > 0).astype(float)
    if len(y) < 2 or y.min() == y.max():
        return {"constant": (y.sum() + 0.5) / (len(y) + 1)}
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["x"]]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def scorer(model: dict):
    """A function of a text column: struct(s (score), n (passages))."""

    @F.pandas_udf("s double, n long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p, n = np.zeros(len(texts)), np.ones(len(texts), np.int64)
            for part in slices(texts, sizes(texts), BATCH_BYTES):
                if "constant" in model:
                    p[part] = model["constant"]
                    continue
                x, per_doc = passage_features([utf8(t) for t in texts.iloc[part]])
                p[part], n[part] = forward(model, x, per_doc)["p"], per_doc
            yield pd.DataFrame({"s": p, "n": n})

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of every row, with ``score`` and the number of passages ``n_passages``."""
    kept = docs.select(F.col(id_col).alias("k"), scorer(model)(F.col(text_col)).alias("r"))
    return kept.select(F.col("k").alias(id_col), F.col("r.s").alias("score"), F.col("r.n").alias("n_passages"))


THRESHOLD = 0.3


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    r = free(docs.columns, "quality_score")
    return docs.withColumn(r, scorer(train(docs, labels))(F.col("text"))).where(F.col(f"{r}.s") >= THRESHOLD).select(*map(named, docs.columns))


def op1_quality_classifier(spark, sf_dir):
    """doc_id, held_out, score, predicted, n_passages for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
