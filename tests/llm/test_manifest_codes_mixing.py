"""Brute force and edge cases of the manifest, the vector codes and the mix of sources."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import codes, merkle, mixing

MORE = "id grp leaf changed block at m u g node parent hops top k v label code distance part size rows h bucket rest left taken of_source copies words target".split()
rng = random.Random(11)


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows):
    """The contract by plain loops: (doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        members.append(mine)
        trees.append(levels_of([leaf_of(r) for r in mine]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, (mine, tree) in enumerate(zip(members, trees)):
        for i, r in enumerate(mine):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at, folded, siblings = i, leaf_of(r, 1) if tampered else leaf_of(r), []
            for nodes in [*tree[:-1], None, *top[:-1]]:
                if nodes is None:
                    at = g
                    continue
                pair = nodes[at - at % 2 : at - at % 2 + 2]
                siblings += [x for j, x in enumerate(pair) if j != at % 2]
                folded = sha(*(folded if j == at % 2 else x for j, x in enumerate(pair)))
                at //= 2
            out.append((r[0], leaf_of(r), tree[-1][0], top[-1][0], sha(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"{c} string" for c in MORE)
    spark.createDataFrame([(*r, *["x"] * len(MORE)) for r in rows], schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(i * 3, f"src{i % 4}", ["en", "de", "é", "", "zz"][i % 5] if i % 7 else "en", rng.choice([None, i, 2**63 - 1]), rng.choice([None, "", "a", "tëxt 🙂", "w " * 5000])) for i in range(700)]
    rows += [(None, None, None, None, None), (None, None, None, 4, "x"), (3, "s", "en", 1, "a"), (3, "s", "en", 1, "a"), (3, "s", "en", 1, "b"), (9, "s", "alone", 2, "c")]
    assert sorted(made(spark, rows, tmp_path), key=repr) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 513])
def test_manifest_of_one_group(spark, tmp_path, n):
    rows = [(2**53 + i, "s", "en", i, str(i)) for i in range(n)]
    assert sorted(made(spark, rows, tmp_path), key=repr) == expected(rows)


def test_manifest_of_several_steps(spark, tmp_path, monkeypatch):
    """With blocks of four rows there are many steps in groups, and over groups."""
    monkeypatch.setattr(merkle, "HOP", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, "s", f"g{min(i % 40, 23)}", i, str(i)) for i in range(500)]
    assert sorted(made(spark, rows, tmp_path), key=repr) == expected(rows)


def test_recursion_limit_is_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    made(spark, [(1, "s", "en", 1, "a")], tmp_path)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# ---- vector codes


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Complete rescans with whole numbers of any size; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    wide = max((len(r[1]) for r in kept), default=0)
    size = -(-wide // parts)
    floors = [[math.floor(int(x) * scale) if abs(x) > 2**53 else math.floor(x * scale) for x in r[1]] + [0] * (size * parts - len(r[1])) for r in kept]
    cut = [[f[p * size : (p + 1) * size] for p in range(parts)] for f in floors]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])) for p, x in enumerate(row)] for row in cut]

    for _ in range(rounds):
        met = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [row[p] for row, m in zip(cut, met) if m[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    met = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(d for d, _ in m) for m in met]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    top = 2**63 - 1
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in m), min(e, top), min(by_label[r[2]], top), digest) for r, m, e in zip(kept, met, errors)), key=repr)


def coded(spark, rows, tmp_path, kind="float"):
    schema = f"vec_id long, embedding array<{kind}>, label int, " + ", ".join(f"{c} string" for c in MORE if c != "label")
    spark.createDataFrame([(*r, *["x"] * (len(MORE) - 1)) for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted((tuple(r) for r in codes.op12_vector_codes(spark, str(tmp_path)).collect()), key=repr)


def near(n, wide, step=0.125):
    """Vectors on a coarse grid, so that there are many ties and equal entries."""
    return [[round(rng.gauss(0, 0.6) / step) * step for _ in range(wide)] for _ in range(n)]


def test_codes_of_odd_rows(spark, tmp_path):
    rows = [(i * 7 % 301, v, rng.choice([None, 1, 2])) for i, v in enumerate(near(300, 24))]
    rows += [(None, [0.5] * 24, 1), (4, None, 2), (5, [None] * 24, 3), (6, [float("nan")] * 24, 3), (7, [float("inf")] + [0.0] * 23, None), (3, [0.25] * 24, 9), (3, [0.25] * 24, 9), (800, [1.0, -1.0], None), (801, [], 5)]
    assert coded(spark, rows, tmp_path) == lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_rows(spark, tmp_path, n):
    rows = [(i, v, i % 2) for i, v in enumerate(near(n, 8))]
    assert coded(spark, rows, tmp_path) == lloyd(rows)


def test_codes_of_large_components(spark, tmp_path):
    rows = [(i, [x * 10.0 ** rng.choice([0, 3, 9, 30, 300]) for x in v], 0) for i, v in enumerate(near(60, 16))]
    assert coded(spark, rows, tmp_path, "double") == lloyd(rows)
    assert lloyd(rows)[0][3] == 2**63 - 1


def test_empty_vectors(spark, tmp_path):
    rows = [(i, [], 0) for i in range(3)]
    assert [r[1:4] for r in coded(spark, rows, tmp_path)] == [("00" * 8, 0, 0)] * 3


def test_only_moved_entries_are_compared():
    """Active entries give what complete rescans give, over random moves, ties among them."""
    r = np.random.default_rng(5)
    for _ in range(50):
        x = r.integers(-3, 4, (200, 8, 2))
        book = r.integers(-3, 4, (8, 16, 2))
        code, far = codes.nearest(x, book, np.ones((8, 16), bool), None, None)
        moved = r.random((8, 16)) < 0.3
        after = np.where(moved[:, :, None], r.integers(-3, 4, book.shape), book)
        got, want = codes.nearest(x, after, moved, code, far), codes.nearest(x, after, moved, None, None)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


# ---- mixing


def water(sizes, weights, share, most):
    """Targets by the contract's rounds: what is above a limit goes to the others by weight."""
    budget, at_limit = share * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in at_limit]
        left = budget - sum(most * sizes[i] for i in at_limit)
        total = sum(weights[i] for i in open_)
        got = [most * sizes[i] if i in at_limit else left * weights[i] / total for i in range(len(sizes))]
        above = {i for i in open_ if got[i] > most * sizes[i]}
        if not above:
            return got
        at_limit |= above


def mixed(spark, rows):
    schema = "doc_id long, source string, text string, " + ", ".join(f"{c} string" for c in MORE)
    return spark.createDataFrame([(*r, *["x"] * len(MORE)) for r in rows], schema).repartition(4)


def checked(spark, rows, weights=(3, 1, 2), share=1.5, most=2):
    df = mixed(spark, rows)
    got = [r.asDict() for r in mixing.mix(df, weights, share, most).withColumnRenamed("doc_id", "d").collect()]
    assert len(got) == len(rows)
    assert sorted((repr(r["d"]), r["size"]) for r in got) == sorted((repr(d), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, _, t in rows)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, s, t in rows if s == n) for n in names]
    want = water(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= most * r["size"] and r["taken"] == r["copies"] * r["size"] + r["words"]
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for size, target in zip(sizes, want):
        taken = by[size, round(target, 6)]
        assert abs(sum(taken) - target) <= len(rows) if size else sum(taken) == 0
    return got, dict(zip(names, want))


def test_mix_of_odd_rows(spark):
    rows = [(i, rng.choice(["a", "a", "b", "c", "é", "Z", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 400]))) for i in range(600)]
    rows += [(None, "a", "x y z"), (7, "b", None), (8, "empty", ""), (9, "empty", None), (10, "tiny", "one"), (99999, "long", "word\t" * 50000)]
    got, _ = checked(spark, rows)
    one = [r for r in got if r["d"] == 99999][0]
    assert one["taken"] == min(2 * one["size"], int(one["target"]))


def test_mix_of_equal_rows(spark):
    """Rows that agree in everything share the rest."""
    got, want = checked(spark, [(1, "a", "one two three")] * 300 + [(2, "b", "x")] * 10)
    assert len({r["taken"] for r in got if r["d"] == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, "a", "one")], [(1, None, None)]])
def test_mix_of_few_rows(spark, rows):
    checked(spark, rows)


def test_mixes_are_nested_and_agree(spark):
    rows = [(i, rng.choice("ab"), " ".join(["w"] * rng.randrange(1, 60))) for i in range(500)]
    small, large, again = (sorted((r["d"], r["taken"]) for r in checked(spark, rows, (1,), share)[0]) for share in (0.3, 0.8, 0.3))
    assert small == again
    assert all(a[1] <= b[1] for a, b in zip(small, large))


def test_the_mix_itself(spark):
    rows = [(i, "a", f"one two\tthree {i}") for i in range(40)] + [(100 + i, "b", "x y") for i in range(40)]
    df = mixed(spark, rows)
    m = mixing.mix(df)
    out = mixing.emit(df, m)
    assert out.columns == df.columns
    words = F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))
    assert out.groupBy("doc_id").agg(F.sum(words).alias("n")).count() == m.where("taken > 0").count()
    assert {(r[0], r[1]) for r in out.groupBy("doc_id").agg(F.sum(words)).collect()} == {(r["doc_id"], r["taken"]) for r in m.where("taken > 0").collect()}


def test_native_plan(spark):
    """No Python worker on the way."""
    plan = mixing.mix(mixed(spark, [(1, "a", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
