"""Hot digests give what all others give: the same passages and cuts whether every digest is hot or none."""

import random

import pytest

from lexiloom.llm import chunks

rng = random.Random(12)
COMMON = [" ".join(f"{p}{i}" for i in range(60)) for p in ("alpha", "beta", "gamma")]


@pytest.fixture(scope="module")
def docs(spark):
    own = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))
    rows = [(rng.choice([None, i, i % 7]), f"{own()} {rng.choice(COMMON)} {own()} {rng.choice(COMMON) if rng.random() < 0.4 else ''}") for i in range(150)]
    rows += [(1000 + i, COMMON[0]) for i in range(40)] + [(5, COMMON[1])] * 5 + [(None, None), (3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_hot_and_others_agree(docs, monkeypatch):
    plain = sorted(map(repr, chunks.repeated(docs).collect())), sorted(map(repr, chunks.remove(docs).collect()))
    assert any("kept=False" in r for r in plain[0])
    for salts in (64, 3):
        monkeypatch.setattr(chunks, "HOT_ROWS", 1)
        monkeypatch.setattr(chunks, "SALTS", salts)
        hot = sorted(map(repr, chunks.repeated(docs).collect())), sorted(map(repr, chunks.remove(docs).collect()))
        assert hot == plain
