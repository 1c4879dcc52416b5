"""The pieces of a public SentencePiece model and a unigram reading of them.

The model is never trained. Its pieces' ranks give the log probabilities:
Zipf's law, p proportional to 1 / (rank + 10). A byte piece stands for a byte
of a character that no piece has.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


class Pieces:
    """text -> (id, log probability), the longest piece in characters, and the bytes' pieces."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_MODEL)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        norm = log(sum(1 / (r + 10) for r in range(len(usual) + 256)))
        self.of = {model.id_to_piece(i): (i, -log(r + 10) - norm) for r, i in enumerate(usual)}
        last = -log(len(usual) + 266) - norm
        self.byte = {int(model.id_to_piece(i)[3:5], 16): (i, last) for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.longest = max(map(len, self.of))
        self.text = {i: t for t, (i, _) in self.of.items()}
        self.value = {i: b for b, (i, _) in self.byte.items()}

    @cached_property
    def nodes(self) -> tuple[Table, np.ndarray, np.ndarray]:
        """A trie of the pieces: (node << 21 | character) -> node, and the nodes' ids (-1 where no piece ends) and log probabilities."""
        nodes, ids, logs = {}, [-1], [0.0]
        for text, (piece, log) in self.of.items():
            node = 0
            for c in text:
                if (to := nodes.get(key := node << 21 | ord(c))) is None:
                    to = nodes[key] = len(ids)
                    ids.append(-1)
                    logs.append(0.0)
                node = to
            ids[node], logs[node] = piece, log
        return Table(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64)), np.array(ids), np.array(logs)

    def whole(self, char: str) -> tuple[tuple[int, ...], float]:
        """The byte pieces of a character and their log probability."""
        parts = [self.byte[b] for b in char.encode("utf-8", "replace")]
        return tuple(i for i, _ in parts), sum(p for _, p in parts)

    def decode(self, ids) -> str:
        """The text of pieces, with the spaces of ``pretokens``."""
        out = bytearray()
        for i in ids:
            out += bytes([self.value[i]]) if i in self.value else self.text[i].encode()
        return out.decode("utf-8", "replace").replace(SPACE, " ")


def pretokens(text: object) -> list[str]:
    """A text cut before each space, a space written as the model's mark and put before the first word. No piece crosses such a cut."""
    if not isinstance(text, str) or not text:
        return []
    return [SPACE + w for w in text.split(" ")]


def coded_pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``pretokens`` of many texts: the distinct ones, the numbers of those that all texts have in a row, and how many each text has."""
    filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    words = pc.split_pattern(texts if pc.all(filled, min_count=0).as_py() else texts.filter(filled), " ")
    n = np.zeros(len(texts), np.int64)
    n[filled.to_numpy(zero_copy_only=False)] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    codes = words.flatten().dictionary_encode()
    return pc.binary_join_element_wise(SPACE, codes.dictionary, ""), codes.indices.to_numpy(zero_copy_only=False), n


@lru_cache(maxsize=2)
def pieces_of(path: str | None = None) -> Pieces:
    """The pieces of a model, read once by a worker for all its tasks."""
    return Pieces(path)


class Table:
    """Numbers by distinct keys, in arrays: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none. Keys and values are 0 or more."""
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot_ = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = slot_
            there, wanted = self.keys[slot_], keys[todo]
            hit = there == wanted
            out[todo[hit]] = self.values[slot_[hit]]
            todo = todo[~hit & (there >= 0)]
        return out


def n_bytes(char: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8; one ('?') of a half of a surrogate pair."""
    return np.where((char >= 0xD800) & (char < 0xE000), 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))


class Trie:
    """A trie of distinct, sorted, non-empty words. Node 0 is the root; nodes are numbered by depth, ``ends`` are the words' nodes."""

    def __init__(self, words: list[str] | pa.Array):
        if isinstance(words, list):
            sizes, text = np.array([len(w) for w in words]), "".join(words)
        else:
            sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "")[0].as_py()
        begin = np.cumsum(sizes) - sizes
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - begin[word]
        there = (word > 0) & (place < sizes[word - 1])
        same = there & (chars == chars[np.where(there, begin[word - 1] + place, 0)])
        shared = np.minimum.reduceat(np.where(same, len(chars), place), begin)  # characters in common with the word before
        new = place >= shared[word]
        depth = np.append(0, place[new] + 1)
        n = len(depth)
        order = np.argsort(depth, kind="stable")
        parent = np.arange(n) - 1
        branch = np.flatnonzero(np.append(False, (place == shared[word])[new]))  # the parent is the latest node one level up
        parent[branch] = order[np.searchsorted(depth[order] * n + order, (depth[branch] - 1) * n + branch) - 1]
        parent[0] = 0
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.char, self.depth, self.parent = np.append(0, chars[new])[order], depth[order], rank[parent[order]]
        self.ends = rank[np.cumsum(new)[begin + sizes - 1]]
        self.levels = np.searchsorted(self.depth, np.arange(1, int(self.depth[-1]) + 2))  # where each depth begins, from 1 on
