"""SentencePiece encoding and decoding with sampled segmentations.

Gumbel top-k without replacement: among all segmentations of a text, a priori
weighed by the unigram model of ``pieces``, the k with the largest
Gumbel-perturbed log probabilities are emitted, which is a sample without
replacement. They are found by A-star search from the top down: a region is the
set of segmentations that follow a found one up to a decision and leave it there; its
bound is the maximum of its perturbed log probabilities, drawn at once from its
mass (a Gumbel truncated at its parent's bound), so the region with the
largest bound holds the next segmentation, which is then drawn in it. The (k+1)-th bound
kappa gives each one's inclusion score, 1 - exp(-exp(log p - kappa)), and its logarithm, as the score itself is 0 in doubles for long texts.

The lattice of a text is a chain of pre-tokens; what a piece may be depends on
the rest of its pre-token alone, so states are such rests, shared by all places in an Arrow batch where
a pre-token occurs, with their backward masses computed once, for the new pre-tokens of ``BATCH_CHARS`` characters together. Texts of ``SEARCH_CHARS`` characters are
searched together, in flat arrays. Draws are hashes of (row key,
text, sample, place, step), and what is summed along a text is in whole numbers, so a row gives the same samples wherever it runs.

Two bounds of the arithmetic, the same for texts of any length: a state's arcs have whole numbers of 2**-37 as probabilities, so an arc rarer than half of that is never drawn (less than 2**-30 of a state's mass, as
states have under a hundred arcs); and decisions are regions only as long as the found segmentation up to them has a probability above exp(-100 - 50 k) within its own region. A further sample that shares
more of it than that would be missed; the chance that one of k samples does so is below k exp(-100 - 50 k), about 10**-108 for k = 3.

One narrow pass, no shuffle; each Arrow batch has states of its own, and starts anew before ``BATCH_CHARS`` more characters once it has over ``STATES``.
Edge cases: null and empty texts have one segmentation, the empty one (score 1); where
fewer than k segmentations exist, all are emitted, with inclusion 1; rows that agree in id and text get the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, slices, unit
from .pieces import Pieces, Trie, coded_pretokens, n_bytes, pieces_of

SAMPLES, STATES = 3, 1_200_000
BATCH_CHARS, SEARCH_CHARS = 2 << 20, 1 << 19  # characters whose pre-tokens are added together, and those searched together
LOG_ONE, CUT_BITS = 2.0**32, 36  # logarithms and shares as whole numbers


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of so many numbers each, in a row."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Lattice:
    """States (rests of pre-tokens) and their arcs (pieces), the most probable first, as flat arrays, grown on demand. State 0 is the end of a pre-token.
    Of an arc: the state after it and its first arc (-1 at the end), the logarithms of its probability and of the state's other arcs', where its share ends, its piece."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.child, self.node_id, self.node_log = pieces.nodes
        self.byte_log = next(iter(pieces.byte.values()))[1]
        kinds = {"first": np.int64, "n": np.int32, "next": np.int32, "to": np.int32, "log": np.int64, "others": np.float64, "cut": np.int64, "piece": np.int32}
        self.room = {name: np.empty(1 << 16, kind) for name, kind in kinds.items()}
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.n_states = self.n_arcs = 0
        self.extend(np.zeros(1, np.int64), {})

    def extend(self, n: np.ndarray, arcs: dict[str, np.ndarray]) -> None:
        """Append states and their arcs; the arrays' room doubles, so each is copied a few times at most."""
        more = {"first": self.n_arcs + np.cumsum(n) - n, "n": n, **arcs}
        for name, room in self.room.items():
            values = more.get(name, room[:0])
            size = self.n_states if name in ("first", "n") else self.n_arcs
            if size + len(values) > len(room):
                old, self.room[name] = room, np.empty(2 * (size + len(values)), room.dtype)
                room = self.room[name]
                room[:size] = old[:size]
            room[size : size + len(values)] = values
            setattr(self, f"a_{name}", room[: size + len(values)])
        self.n_states += len(n)
        self.n_arcs += len(arcs.get("next", ()))

    def match(self, trie: Trie) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All pieces that the rests (nodes of a trie of words read backwards) begin with, by length: nodes, the nodes after the piece, ids (of a
        character in bytes: -1 less its code point), log probabilities."""
        live = up = np.arange(1, len(trie.char))
        node, size, found = np.zeros(len(live), np.int64), 0, []
        while len(live):
            to = self.child.get(node << 21 | trie.char[up])
            there = to >= 0
            live, node, up, size = live[there], to[there], trie.parent[up[there]], size + 1
            piece = self.node_id[node] >= 0
            if size == 1:
                spelled = np.ones(len(trie.char), bool)
                spelled[0] = spelled[live[piece]] = False
                lost = np.flatnonzero(spelled)
                found.append((lost, trie.parent[lost], -1 - trie.char[lost], n_bytes(trie.char[lost]) * self.byte_log))
            found.append((live[piece], up[piece], self.node_id[node[piece]], self.node_log[node[piece]]))
            more = up > 0
            live, node, up = live[more], node[more], up[more]
        return found

    def add(self, words: list[str]) -> None:
        """Pre-tokens into the index, with their states."""
        if new := set(words) - self.index.keys():
            back = sorted(w[::-1] for w in new)
            self.index |= zip((w[::-1] for w in back), self.grow(Trie(back)).tolist())

    def states(self, words: pa.Array) -> np.ndarray:
        """New states of distinct pre-tokens, which do not go into the index."""
        out = np.zeros(len(words), np.int64)
        if len(words):
            back = pc.utf8_reverse(words)
            order = pc.array_sort_indices(back)
            out[order.to_numpy()] = self.grow(Trie(back.take(order)))
        return out

    def grow(self, trie: Trie) -> np.ndarray:
        """States of all rests of words, given as a trie of them read backwards, with the log mass (beta) of all ways from there to the end; the words' states."""
        found = self.match(trie)
        base = self.n_states - 1  # what is added to a node; the root is state 0
        n = np.zeros(len(trie.char), np.int64)
        for start, *_ in found:
            n[start] += 1
        first = np.cumsum(n) - n
        free = first.copy()
        ids, to, logs = (np.zeros(int(n.sum()), kind) for kind in (np.int64, np.int64, float))
        for start, after, piece, log in found:
            at = free[start]
            ids[at], logs[at], to[at] = piece, log, after
            free[start] += 1
        beta = np.zeros(len(trie.char))
        for lo, hi in zip(trie.levels[:-1].tolist(), trie.levels[1:].tolist()):
            begin, many = first[lo:hi] - first[lo], n[lo:hi]
            arc = slice(first[lo], first[hi - 1] + n[hi - 1])
            x = logs[arc] + beta[to[arc]]
            top = np.maximum.reduceat(x, begin)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), begin))
        n, first = n[1:], first[1:]
        state = np.repeat(np.arange(len(n)), n)
        log = np.minimum(0.0, logs + beta[to] - beta[1 + state])
        top = np.flatnonzero(log == np.maximum.reduceat(log, first)[state])
        top = top[np.append(True, state[top[1:]] != state[top[:-1]])]
        swap = np.arange(len(log))  # the most probable arc of a state comes first
        swap[first], swap[top] = top, first
        ids, to, log = ids[swap], to[swap], log[swap]
        share = np.rint(np.exp(log) * 2**CUT_BITS).astype(np.int64)
        total = np.cumsum(share)
        cut = np.minimum(total - np.repeat((total - share)[first], n), 1 << CUT_BITS)
        cut[first + n - 1] = 1 << CUT_BITS
        whole = np.rint(log * LOG_ONE)
        alone = np.repeat(n, n) == 1
        others = np.where(alone, -np.inf, np.log(np.maximum(1 - np.exp(whole / LOG_ONE), 1e-300)))
        head = np.append(-1, self.n_arcs + first)[to]
        self.extend(n, {"next": np.where(to > 0, base + to, 0), "to": head, "log": whole.astype(np.int64), "others": others, "cut": cut, "piece": ids})
        return base + trie.ends

    def draw(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start state, the number of arcs to the end of its pre-token, and the arcs of all in order."""
        n, step, found = np.zeros(len(states), np.int64), 0, []
        live = np.flatnonzero(states)
        arc, keys = self.a_first.take(states.take(live)), keys.take(live)
        while len(live):
            u = (mix64(keys + U64(step * 0x9E3779B1)) >> U64(64 - CUT_BITS)).view(np.int64)
            past = np.flatnonzero(u >= self.a_cut.take(arc))
            if len(past):
                u = u.take(past)
            while len(past):
                at = arc.take(past) + 1
                arc[past] = at
                more = np.flatnonzero(u >= self.a_cut.take(at))
                past, u = past.take(more), u.take(more)
            found.append((live, arc))
            step += 1
            n[live] = step
            arc = self.a_to.take(arc)
            go = np.flatnonzero(arc >= 0)
            live, arc, keys = live.take(go), arc.take(go), keys.take(go)
        first, out = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
        for step, (live, arc) in enumerate(found):
            out[first.take(live) + step] = arc
        return n, out


def below(g: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The maximum of a region from its draw ``g``, a Gumbel about the region's log mass, given that its parent's is ``top``."""
    return -np.logaddexp(-top, -g)


class Search:
    """The segmentations found so far of many texts: arcs in a row, and by segmentation its text, place, bound (perturbed log
    probability) and open regions. A region leaves the segmentation at a place and takes none of the arcs that others have taken there.
    Regions of a segmentation have the same parent, so the one with the largest draw has the largest bound, and only that draw is put below the parent's."""

    def __init__(self, lattice: Lattice, states: np.ndarray, sizes: np.ndarray, keys: np.ndarray, k: int):
        self.lattice, self.states, self.sizes, self.keys, self.k = lattice, states, sizes, keys, k
        self.begin = np.cumsum(sizes) - sizes
        self.arcs = np.zeros(0, np.int64)
        self.g = np.zeros(0)
        whole = np.zeros(0, np.int64)
        self.text, self.off, self.size, self.log, self.g_off, self.g_size, self.shared = (whole,) * 7
        self.top = self.most = self.best = np.zeros(0)  # bound; the largest draw of its open regions, and the bound that this gives
        self.without = np.zeros((0, k), np.int64)
        self.of = np.full((k, len(sizes)), -1)  # by sample and text

    def grow(self, name: str, more: np.ndarray) -> None:
        setattr(self, name, np.concatenate([getattr(self, name), more]))

    def first(self) -> None:
        """Draw one segmentation of each text."""
        n = len(self.sizes)
        none = np.zeros(n, np.int64)
        self.found(0, np.arange(n), none, none, None, none, none, -np.log(-np.log(unit(mix64(self.keys)))), np.full((n, self.k), -1))

    def next(self, r: int) -> None:
        """Of each text that has an open region, take the one with the largest bound and draw a segmentation in it."""
        best = np.where(self.of[:r] >= 0, np.append(self.best, -np.inf)[self.of[:r]], -np.inf)
        text = np.flatnonzero(best.max(0) > -np.inf)
        if not len(text):
            return
        old = self.of[best.argmax(0)[text], text]
        g_at = ranges(self.g_off[old], self.g_size[old])
        cut = np.cumsum(self.g_size[old]) - self.g_size[old]
        hit = np.flatnonzero(self.g[g_at] == np.repeat(self.most[old], self.g_size[old]))
        owner = np.searchsorted(cut, hit, "right") - 1
        hit = hit[np.append(True, owner[1:] != owner[:-1])]
        inside = hit - cut  # the place among the segmentation's regions
        top = self.best[old]
        self.g[g_at[hit]] = -np.inf
        self.most[old] = np.maximum.reduceat(self.g[g_at], cut)
        self.best[old] = below(self.most[old], self.top[old])
        kept = self.shared[old] + inside
        base = self.arcs[self.off[old] + kept]
        without = np.where((inside == 0)[:, None], self.without[old], -1)
        without = np.hstack([base[:, None], without[:, : self.k - 1]])

        a = self.lattice
        state = np.searchsorted(a.a_first, base, "right") - 1
        many = a.a_n[state]
        option, owner = ranges(a.a_first[state], many), np.repeat(np.arange(len(base)), many)
        p = np.exp(a.a_log[option] / LOG_ONE)
        p[(option[:, None] == without[owner]).any(1)] = 0
        cut = np.cumsum(many) - many
        share = np.floor(p / np.add.reduceat(p, cut)[owner] * 2**CUT_BITS).astype(np.int64)
        total = np.cumsum(share)
        upto = total - np.repeat((total - share)[cut], many)
        u = unit(mix64(self.keys[text] + U64(r * 7919 + 1)))
        goal = np.floor(u * upto[cut + many - 1]).astype(np.int64)
        free = np.flatnonzero((p > 0) & (upto > goal[owner]))
        free = free[np.append(True, owner[free[1:]] != owner[free[:-1]])]
        last = np.maximum.reduceat(np.where(p > 0, np.arange(len(p)), -1), cut)
        last[owner[free]] = free
        ended = np.concatenate([[0], np.cumsum(a.a_next[self.arcs[ranges(self.off[old], kept)]] == 0)])
        upto = np.cumsum(kept)
        word = ended[upto] - ended[upto - kept]  # pre-tokens that end before
        self.found(r, text, self.off[old], kept, option[last], word, a.a_next[option[last]], top, without)

    def found(self, r: int, text: np.ndarray, start: np.ndarray, kept: np.ndarray, arc: np.ndarray | None, word: np.ndarray, after: np.ndarray, top: np.ndarray, without: np.ndarray) -> None:
        """Add a segmentation of each text: the first ``kept`` arcs from ``start``, ``arc``, and the rest drawn."""
        a, one = self.lattice, int(arc is not None)
        rest = self.sizes[text] - word
        at = np.cumsum(rest) - rest
        states = self.states
        if one:
            states = states[ranges(self.begin[text] + word, rest)]
            states[at] = after
        place = ranges(np.zeros(len(rest), np.int64), rest)
        seeds = mix64(self.keys[text] + U64((r + 1) * 0x1000003))
        n, drawn = a.draw(states, mix64(np.repeat(seeds, rest) + place.astype(U64) * U64(0x2545F4914F6CDD1D)))
        upto = np.concatenate([[0], np.cumsum(n)])
        new = upto[at + rest] - upto[at]
        size = kept + one + new
        off = np.cumsum(size) - size
        if one:
            arcs = np.zeros(int(size.sum()), np.int64)
            arcs[ranges(off, kept)], arcs[off + kept] = self.arcs[ranges(start, kept)], arc
            arcs[ranges(off + kept + one, new)] = drawn
        else:
            arcs = drawn

        log = a.a_log.take(arcs)
        total = np.concatenate([[0], np.cumsum(log)])
        # beyond here there are regions enough before, and a region has no mass to speak of (an arc's logarithm is -25 or more)
        deep = np.searchsorted(-total, -total[off] + int((100 + 50 * self.k) * LOG_ONE), "right")
        g_size = np.maximum(np.minimum(deep, off + size) - off - kept, 0)
        g_off = np.cumsum(g_size) - g_size
        open_ = ranges(off + kept, g_size)
        phi = (total[open_] - np.repeat(total[off], g_size)) / LOG_ONE + a.a_others.take(arcs[open_])
        heads = g_off[g_size > 0]
        if one:
            fewer, at = without[g_size > 0], open_[heads]
            there = fewer >= 0
            taken = np.exp(log[at] / LOG_ONE) + np.where(there, np.exp(a.a_log[np.maximum(fewer, 0)] / LOG_ONE), 0).sum(1)
            left = a.a_n[np.searchsorted(a.a_first, arcs[at], "right") - 1] - 1 - there.sum(1)
            before = (total[at] - total[off[g_size > 0]]) / LOG_ONE
            phi[heads] = np.where(left > 0, before + np.log(np.maximum(1 - taken, 1e-300)), -np.inf)
        u = unit(mix64(np.repeat(self.keys[text] + U64(r * 104729 + 13), g_size) + ranges(np.zeros(len(text), np.int64), g_size).view(U64) * U64(0xC2B2AE3D27D4EB4F)))
        g = phi - np.log(-np.log(u))
        most = np.full(len(text), -np.inf)
        if len(heads):
            most[g_size > 0] = np.maximum.reduceat(g, heads)

        self.of[r, text] = len(self.text) + np.arange(len(text))
        for name, more in {"text": text, "off": off + len(self.arcs), "size": size, "log": total[off + size] - total[off], "g_off": g_off + len(self.g), "g_size": g_size, "shared": kept, "top": top, "most": most, "best": below(most, top), "without": without, "arcs": arcs, "g": g}.items():
            self.grow(name, more)


def top_k(lattice: Lattice, states: np.ndarray, sizes: np.ndarray, keys: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k segmentations of each text, given as start states of its pre-tokens: text, sample (from 1), off and size in ``arcs``, log_p, score
    (perturbed), log_inclusion; by text, then sample."""
    search = Search(lattice, states, sizes, keys, k)
    search.first()
    for r in range(1, k):
        search.next(r)
    pick = search.of.T.ravel()
    sample = np.tile(np.arange(1, k + 1), len(sizes))[pick >= 0]
    pick = pick[pick >= 0]
    kappa = np.where(search.of >= 0, np.append(search.best, -np.inf)[search.of], -np.inf).max(0)[search.text[pick]]
    log_p = search.log[pick] / LOG_ONE
    x = log_p - kappa
    with np.errstate(over="ignore", divide="ignore"):
        inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50.0)))))
    return {"text": search.text[pick], "sample": sample, "off": search.off[pick], "size": search.size[pick], "log_p": log_p, "score": search.top[pick], "log_inclusion": inclusion, "arcs": search.arcs}


def ids_of(lattice: Lattice, arcs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids along the arcs, and how many there are for each run of so many arcs; a character that no piece has gives its bytes' pieces."""
    ids = lattice.a_piece.take(arcs)
    ends = np.cumsum(sizes)
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids.astype(np.int32), sizes
    chars, which = np.unique(-1 - ids[spelled], return_inverse=True)
    table = np.array([(*lattice.pieces.whole(chr(c))[0], 0, 0, 0)[:4] for c in chars.tolist()])
    n = np.ones(len(ids), np.int64)
    n[spelled] = n_bytes(chars)[which]
    out = np.repeat(ids, n)
    first = np.cumsum(n) - n
    out[ranges(first[spelled], n[spelled])] = table[np.repeat(which, n[spelled]), ranges(np.zeros(len(spelled), np.int64), n[spelled])]
    upto = np.concatenate([[0], np.cumsum(n)])
    return out.astype(np.int32), upto[ends] - upto[ends - sizes]


def sampled(batches: Iterator[pa.RecordBatch], k: int, seed: int, model_path: str | None) -> Iterator[pa.RecordBatch]:
    """``sample`` of the rows of one task: k (kept as it is), id (as text), t (text)."""
    lattice = Lattice(pieces_of(model_path))
    for batch in batches:
        texts, names = batch.column("t").to_pylist(), batch.column("id").to_pylist()
        sizes = [len(t or "") for t in texts]
        words, codes, n_words = coded_pretokens(batch.column("t"))
        upto = np.concatenate([[0], np.cumsum(n_words)])
        state_of = np.full(len(words), -1)
        lattice.reset()
        for whole in slices(texts, sizes, BATCH_CHARS):
            if lattice.n_states > STATES:
                lattice.reset()
                state_of[:] = -1
            there = np.zeros(len(words), bool)
            there[codes[upto[whole.start] : upto[whole.stop]]] = True
            new = np.flatnonzero(there & (state_of < 0))
            state_of[new] = lattice.states(words.take(pa.array(new)))
            for part in slices(texts[whole], sizes[whole], SEARCH_CHARS):
                own = slice(whole.start + part.start, whole.start + part.stop)
                keys = np.array([xxhash.xxh64_intdigest(f"{i}|{t}".encode("utf-8", "replace"), seed) for i, t in zip(names[own], texts[own])], U64)
                got = top_k(lattice, state_of[codes[upto[own.start] : upto[own.stop]]], n_words[own], keys, k)
                ids, n = ids_of(lattice, got["arcs"][ranges(got["off"], got["size"])], got["size"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                columns = [batch.column("k").take(pa.array(got["text"] + own.start)), pa.array(got["sample"], pa.int32()), lists]
                columns += map(pa.array, (got["log_p"], got["score"], np.exp(got["log_inclusion"]), got["log_inclusion"]))
                yield pa.RecordBatch.from_arrays(columns, names=["k", "sample", "ids", "log_prob", "perturbed", "inclusion", "log_inclusion"])


def sample(docs: DataFrame, k: int = SAMPLES, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``id_col``, sample (1 to k, best first), ids (array of int), log_prob, perturbed, inclusion, log_inclusion: a row for each segmentation."""
    kept = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t"))
    out = kept.mapInArrow(lambda batches: sampled(batches, k, seed, model_path), f"k {dict(kept.dtypes)['k']}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, log_inclusion double")
    return out.withColumnRenamed("k", id_col)


def decode(sampled: DataFrame, id_col: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """``id_col``, sample, text: what the pieces spell, without the space put before the first word."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_of(model_path)
        for ids in batches:
            yield pd.Series([pieces.decode(x)[1:] for x in ids], dtype=object)

    return sampled.select(id_col, "sample", run(F.col("ids")).alias("text"))


def op10_sampled_segmentations(spark, sf_dir):
    """doc_id, sample, n_pieces, log_prob, perturbed, inclusion, log_inclusion, ids_sha256: three segmentations of every document."""
    out = sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "perturbed", "inclusion", "log_inclusion", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))
