"""Packing: vector bin packing by the dot-product heuristic.

An example is a vector of tokens, one segment, and loss-bearing tokens (its
last ``loss`` ones); a sequence has limits on all three. Examples are cut to
whole sequences first. The rests, largest first, go each to the open
sequence that has room in every dimension and the largest dot product of the
example's vector with what the sequence has left (both as shares of the limits).
Then sequences with the least content are cut up to fill the gaps of others, and
what cannot be filled is closed as sequences of powers of two, which need no
padding. So every sequence is of ``TOKENS`` tokens or of a power of two.

How it is spread: tokenizing and packing run together in one narrow pass, over
windows of ``WINDOW`` examples of a partition; sequence ids hold the partition's
number. Nothing is shuffled, and a lost task is simply run again.

Edge cases: null and empty texts are the closing id alone; an empty table gives no
piece; repeated rows are packed each on its own; a very long text fills whole sequences first; of sequences of equal dot product the one opened first
takes an example, of examples of equal size the earlier row goes first; a limit of loss below the sequence's
length makes shorter sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

TOKENS, SEGMENTS, CLOSING_ID = 4096, 512, 2
WINDOW, CACHE = 2048, 300_000

Piece = tuple[int, int, int]  # example, start, length


#: Words of these characters alone are cut into pre-tokens here; their lower case and their classes are the same everywhere.
_USUAL = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Words(dict):
    """Kept results of a function of a word."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        self[word] = out = self.of(word)
        return out


class Tokens:
    """Ids of texts. White space that the tokenizer drops in any case (space, line end, tab) cuts a text into words; each is encoded once and kept.
    ASCII letters are lowered first, as the tokenizer does itself. Usual words fall into pre-tokens here and get their merges from
    the vocabulary by rank, with a zero byte as the mark of a pre-token's end; a merge rule per piece in the order of the ids makes that the same
    as the tokenizer's own merges (the tests compare every seventh piece of the vocabulary). Other words go to the tokenizer whole."""

    def __init__(self, path: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(path)
        byte = {c: b for b, c in _byte_letters().items()}
        ranks = {}
        for piece, n in self.whole.get_vocab(with_added_tokens=False).items():
            if n not in self.whole.get_added_tokens_decoder():
                end = piece.endswith("</w>")
                ranks[bytes(byte[c] for c in piece.removesuffix("</w>")) + b"\0" * end] = n
        self.ranks = ranks
        self.usual = tiktoken.Encoding("by_rank", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self._word)
        self.marks = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]

    def _word(self, word: bytes) -> bytes:
        if not word:
            return b""
        text = word.decode("utf-8", "replace")
        if _USUAL.fullmatch(text):
            ids = self.usual("\0".join(_PRE_TOKENS.findall(text if text.isascii() else text.lower())) + "\0")
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(self.words) > CACHE:
            self.words = _Words(self._word)
        look = self.words.__getitem__
        return [b"".join(map(self._marked if any(m in t for m in self.marks) else look, self._cut(t))) for t in texts]

    def _cut(self, text: bytes) -> list[bytes]:
        text = text if any(m in text for m in self.marks) else text.lower()
        return text.replace(b"\n", b" ").replace(b"\t", b" ").split(b" ")

    def _marked(self, word: bytes) -> bytes:
        """A word of a text with marks, whose letters aren't lowered yet: marks are found in the letters as they stand."""
        if any(m in word for m in self.marks):
            return array("I", self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        return self.words[word.lower()]


def _loss(tokens: int, loss: int, start: int, length: int) -> int:
    return max(0, start + length - max(start, tokens - loss))


def _longest(tokens: int, loss: int, start: int, room: int, loss_room: int) -> int:
    """The longest piece from ``start`` within both rooms."""
    free = max(0, tokens - loss - start)
    return min(room, tokens - start, free + loss_room)


def pack(tokens: list[int], loss: list[int], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> list[list[Piece]]:
    """Sequences of pieces for examples of so many tokens and loss-bearing tokens."""
    size, most, loss_most = limits
    done: list[list[Piece]] = []
    rests: list[tuple[int, int]] = []
    for i, (n, own) in enumerate(zip(tokens, loss)):
        at = 0
        while n - at >= size and loss_most > 0 and _longest(n, own, at, size, loss_most) == size:
            done.append([(i, at, size)])
            at += size
        if at < n:
            rests.append((i, at))
    rests.sort(key=lambda r: at_most(tokens[r[0]] - r[1], size), reverse=True)

    bins: list[list[Piece]] = []
    left = np.zeros((len(rests) + 1, 3))
    whole = np.array([size, most, max(1, loss_most)], float)
    waiting: list[Piece] = []
    for i, at in rests:
        n = tokens[i] - at
        need = np.array([n, 1, _loss(tokens[i], loss[i], at, n)], float)
        if (need > [size, most, loss_most]).any():
            waiting.append((i, at, n))
            continue
        open_ = left[: len(bins)]
        fits = (open_ >= need).all(1)
        if fits.any():
            b = int(np.where(fits, (open_ / whole) @ (need / whole), -1).argmax())
        else:
            b = len(bins)
            bins.append([])
            left[b] = [size, most, loss_most]
        bins[b].append((i, at, n))
        left[b] -= need

    order = sorted(range(len(bins)), key=lambda b: left[b, 0])  # the fullest first
    room = [left[b].copy() for b in order]
    bins = [bins[b] for b in order]
    stock = waiting
    give = len(bins) - 1  # the emptiest sequence is the next to be cut up
    for b, here in enumerate(bins):
        if b > give:
            break
        while room[b][0] > 0 and room[b][1] > 0:
            if not stock:
                if give <= b:
                    break
                stock = bins[give]
                bins[give] = []
                give -= 1
            i, at, n = stock[-1]
            take = min(n, _longest(tokens[i], loss[i], at, int(room[b][0]), int(room[b][2])))
            if take <= 0:
                break
            here.append((i, at, take))
            room[b] -= [take, 1, _loss(tokens[i], loss[i], at, take)]
            if take == n:
                stock.pop()
            else:
                stock[-1] = (i, at + take, n - take)
        if room[b][0] > 0:  # no padding: to be closed as powers of two
            stock, bins[b] = stock + here, []
        else:
            done.append(here)
    for b in range(len(bins)):
        if b > give or not bins[b] or room[b][0] == 0:
            continue
        stock += bins[b]
    done += _powers(stock, tokens, loss, limits)
    return done


def at_most(n: int, size: int) -> int:
    return min(n, size)


def _powers(pieces: list[Piece], tokens: list[int], loss: list[int], limits: tuple[int, int, int]) -> Iterator[list[Piece]]:
    """Sequences whose lengths are powers of two (or whole sequences) from pieces in hand."""
    size, most, loss_most = limits
    if loss_most < 1 and any(_loss(tokens[i], loss[i], at, n) for i, at, n in pieces):
        raise ValueError("no sequence may hold a loss-bearing token")
    todo = [p for p in reversed(pieces) if p[2]]
    while todo:
        total, segments, borne, take = 0, 0, 0, []
        for i, at, n in reversed(todo):  # as much as one sequence can hold
            if segments == most or total == size:
                break
            got = min(n, _longest(tokens[i], loss[i], at, size - total, loss_most - borne))
            if got <= 0:
                break
            total, segments, borne = total + got, segments + 1, borne + _loss(tokens[i], loss[i], at, got)
            take.append(got)
            if got < n:
                break
        goal = total if total == size else 1 << (total.bit_length() - 1)
        out: list[Piece] = []
        while goal:
            i, at, n = todo.pop()
            got = min(n, goal)
            out.append((i, at, got))
            goal -= got
            if got < n:
                todo.append((i, at + got, n - got))
        yield out


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), window: int = WINDOW, loss_col: str | None = None) -> DataFrame:
    """``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece. ``loss_col`` gives the tokens of a row that bear
    loss, which the third limit holds down by sequence (at least none, at most all of a row's); without it, and where it is null, every token does."""

    def run(batches):
        coder, closing = Tokens(tokenizer_path), np.array([CLOSING_ID], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        n_seq = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, window):
                part = batch.slice(lo, window)
                ids = [x + closing for x in coder.encode([utf8(t) for t in part.column("t").to_pylist()])]
                sizes = [len(x) // 4 for x in ids]
                rows = []
                loss = [n if x is None else min(max(x, 0), n) for n, x in zip(sizes, part.column("loss").to_pylist())]
                for seq in pack(sizes, loss, limits):
                    offset = 0
                    for i, at, n in seq:
                        rows.append((i, at, n, zlib.crc32(memoryview(ids[i])[4 * at : 4 * (at + n)]), sizes[i], base + n_seq, offset))
                        offset += n
                    n_seq += 1
                at, *rest = zip(*rows)
                names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in rest)], names=names)

    kept = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), (F.col(loss_col) if loss_col else F.lit(None)).cast("long").alias("loss"))
    return kept.mapInArrow(run, f"k {dict(kept.dtypes)['k']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("k", id_col)


def op8_packing(spark, sf_dir):
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document."""
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
