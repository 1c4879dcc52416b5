"""Token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

The distinct new pre-tokens of a batch are inserted in a trie (arrays of nodes: character, parent, depth). The
pieces that end at each node are found by walking up from all nodes at once along a trie of reversed pieces.
Then the best scores (forward, Viterbi: the most probable pieces) are computed depth by depth, once for each
node, so once for a prefix that many pre-tokens share; each
terminal stores the number of its pieces, and documents sum their terminals.

One narrow pass, no shuffle; counts stay with the task in two generations of ``CACHE`` pre-tokens at most, of which the older one
goes when the younger one is full, so frequent pre-tokens stay.
Edge cases: null and empty texts have 0 pre-tokens and 0 tokens; of segmentations
of equal probability the one whose last piece starts first counts; repeated rows count alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import Pieces, Table, Trie, n_bytes, pretokens

BATCH_CHARS = 8 << 20
CACHE = 500_000


class Reversed:
    """A trie of the pieces, last character first: (node, character) -> node."""

    def __init__(self, pieces: Pieces):
        nodes, logs = {}, [np.nan]
        for text, (_, log) in pieces.of.items():
            node = 0
            for c in reversed(text):
                if (to := nodes.get(key := node << 21 | ord(c))) is None:
                    to = nodes[key] = len(logs)
                    logs.append(np.nan)
                node = to
            logs[node] = log
        self.child = Table(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64))
        self.logs = np.array(logs)
        self.byte_log = next(iter(pieces.byte.values()))[1]

    def arcs(self, trie: Trie) -> tuple[np.ndarray, ...]:
        """All pieces in the trie: the node where one ends, the one before its first character, log probability, number of pieces (a
        character that is none counts as its bytes'); by node, the longest first."""
        live = up = np.arange(1, len(trie.char))
        node, size, found = np.zeros(len(live), np.int64), 0, []
        while len(live):
            to = self.child.get(node << 21 | trie.char[up])
            there = to >= 0
            live, node, up, size = live[there], to[there], trie.parent[up[there]], size + 1
            log = self.logs[node]
            piece = ~np.isnan(log)
            if size == 1:
                spelled = np.ones(len(trie.char), bool)
                spelled[0] = spelled[live[piece]] = False
                lost = np.flatnonzero(spelled)
                n = n_bytes(trie.char[lost])
                found.append((lost, trie.parent[lost], n * self.byte_log, n, np.ones(len(lost), np.int64)))
            found.append((live[piece], up[piece], log[piece], np.ones(int(piece.sum()), np.int64), np.full(int(piece.sum()), size)))
            more = up > 0
            live, node, up = live[more], node[more], up[more]
        to, start, log, count, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-size, to))
        return to[order], start[order], log[order], count[order]


def terminal_counts(words: list[str], pieces: Reversed) -> dict[str, int]:
    """Pieces of the best segmentation of each distinct word."""
    if not words:
        return {}
    words = sorted(words)
    trie = Trie(words)
    to, start, log, count = pieces.arcs(trie)
    best, n = np.zeros(len(trie.char)), np.zeros(len(trie.char), np.int64)
    cuts = np.searchsorted(to, trie.levels)
    first = np.append(True, to[1:] != to[:-1])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        score = best[start[lo:hi]] + log[lo:hi]
        head = np.flatnonzero(first[lo:hi])
        top = np.maximum.reduceat(score, head)
        own = np.repeat(np.arange(len(head)), np.diff(np.append(head, hi - lo)))
        hit = np.flatnonzero(score == top[own])
        hit = hit[np.append(True, own[hit[1:]] != own[hit[:-1]])]  # of equal ones the longest last piece
        nodes = to[lo:hi][head]
        best[nodes], n[nodes] = top, n[start[lo:hi][hit]] + count[lo:hi][hit]
    return dict(zip(words, n[trie.ends].tolist()))


def counter(model_path: str | None = None):
    """A function of a text column: struct(n_pretokens, n_tokens)."""

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = Reversed(Pieces(model_path))
        young: dict[str, int] = {}
        old: dict[str, int] = {}
        for column in batches:
            texts = list(column)
            for part in slices(column, [len(t) if isinstance(t, str) else 0 for t in texts], BATCH_CHARS):
                split = [pretokens(t) for t in texts[part]]
                new = set().union(*split) - young.keys()
                if len(young) > CACHE:
                    young, old = {}, young
                    new = set().union(*split)
                again = {w: old[w] for w in new & old.keys()}
                young |= again
                young |= terminal_counts(list(new - again.keys()), pieces)
                look = young.__getitem__
                yield pd.DataFrame({"n_pretokens": [len(s) for s in split], "n_tokens": [sum(map(look, s)) for s in split]})

    return run


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``id_col``, n_pretokens, n_tokens for every row."""
    kept = docs.select(F.col(id_col).alias("k"), counter(model_path)(F.col(text_col)).alias("r"))
    return kept.select(F.col("k").alias(id_col), "r.*")


def op6_token_counts(spark, sf_dir):
    """doc_id, n_pretokens, n_tokens for every document."""
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
