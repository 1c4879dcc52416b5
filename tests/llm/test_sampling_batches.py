"""Sampled segmentations of Arrow batches: what is done once for a batch, a pre-token or a segmentation, and that cuts change no row."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexiloom.llm import sampling
from lexiloom.llm.pieces import Pieces, Trie, coded_pretokens, pretokens

TEXTS = [None, "", " ", "  ", "one", "a  b ", "\n\n", "one two three two one", "ä ö\tü", "世界 🙂 x" * 20, "\x00 \x00", "▁ ▁▁ x", "a longer text of some words " * 30, None]


def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids.cast(pa.string()), pa.array(texts, pa.string())], names=["k", "id", "t"])


def rows(texts, step=1000):
    parts = (batch(texts).slice(i, step) for i in range(0, len(texts), step))
    return [r for out in sampling.sampled(parts, 3, 0, None) for r in out.to_pylist()]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:2], TEXTS[4:5], TEXTS[4:6], []])
def test_coded_pretokens(texts):
    words, codes, n = coded_pretokens(pa.array(texts, pa.string()))
    words = words.to_pylist()
    ends = np.cumsum(n)
    assert len(set(words)) == len(words) and len(codes) == n.sum()
    assert [[words[c] for c in codes[e - m : e]] for e, m in zip(ends, n)] == [pretokens(t) for t in texts]


def test_trie_of_an_array():
    words = sorted({w[::-1] for t in TEXTS for w in pretokens(t)})
    a, b = Trie(words), Trie(pa.array(words))
    for name in ("char", "depth", "parent", "ends", "levels"):
        assert getattr(a, name).tolist() == getattr(b, name).tolist()


def test_rows_are_those_of_each_text_alone():
    got = rows(TEXTS)
    for i, text in enumerate(TEXTS):
        lattice = sampling.Lattice(Pieces())
        lattice.add(pretokens(text))
        states = np.array([lattice.index[w] for w in pretokens(text)], np.int64)
        key = np.array([xxhash.xxh64_intdigest(f"{i}|{text}", 0)], np.uint64)
        alone = sampling.top_k(lattice, states, np.array([len(states)]), key, 3)
        mine = [r for r in got if r["k"] == i]
        assert [r["perturbed"] for r in mine] == alone["score"].tolist() and [r["log_prob"] for r in mine] == alone["log_p"].tolist()
        assert all(Pieces().decode(r["ids"])[1:] == (text or "").replace("▁", " ") for r in mine)  # the mark stands for a space


def test_cuts_change_no_row(monkeypatch):
    whole = rows(TEXTS)
    assert rows(TEXTS, 3) == whole
    monkeypatch.setattr(sampling, "SEARCH_CHARS", 20)
    assert rows(TEXTS) == whole
    monkeypatch.setattr(sampling, "BATCH_CHARS", 60)
    assert rows(TEXTS) == whole
    monkeypatch.setattr(sampling, "STATES", 10)
    assert rows(TEXTS) == whole


def test_a_pretoken_gets_its_state_once_in_a_batch(monkeypatch):
    seen, states = [], sampling.Lattice.states
    monkeypatch.setattr(sampling.Lattice, "states", lambda self, words: seen.extend(words.to_pylist()) or states(self, words))
    monkeypatch.setattr(sampling, "BATCH_CHARS", 40)
    rows(["one two three two one", "three two one and some more words"] * 50)
    assert sorted(seen) == sorted(set(seen)) and len(seen) == 7


def test_only_the_largest_draw_is_put_below_the_parents(monkeypatch):
    """Before, each open region's was: hundreds of a text of 180 words, of which two at most are looked at for k = 3."""
    count, plain = [], np.logaddexp
    monkeypatch.setattr(np, "logaddexp", lambda *args: count.append(np.broadcast(*args).size) or plain(*args))
    lattice, words = sampling.Lattice(Pieces()), pretokens("a longer text of some words " * 30)
    lattice.add(words)
    states = np.array([lattice.index[w] for w in words] * 4, np.int64)
    got = sampling.top_k(lattice, states, np.full(4, len(words)), np.arange(4, dtype=np.uint64), 3)
    assert len(got["text"]) == 12 and len(np.unique(got["score"])) == 12
    assert sum(count) <= 12 + 8  # one when a segmentation is found, one when its best region is taken
