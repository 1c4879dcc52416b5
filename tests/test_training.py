"""Alignments by enumeration, training against the same steps in plain Python, classifiers on data that can be told apart."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import alignment, classify

rng = random.Random(2)


def best_paths(e):
    """The best score, and the starts of the path that stays where that is as good, over all ways to start the states in order."""
    n, states = len(e), len(e[0])
    found = []
    for cuts in itertools.combinations(range(1, n), states - 1):
        edges = [0, *cuts, n]
        found.append((sum(e[t][s] for s in range(states) for t in range(edges[s], edges[s + 1])), [0, *cuts]))
    return max(found, key=lambda f: f[0])[0] if found else None, found


def test_paths_by_enumeration(spark):
    rows = [[[rng.gauss(0, 1) for _ in range(states)] for _ in range(n)] for states, n in [(1, 1), (1, 4), (2, 2), (2, 7), (3, 8), (4, 4), (4, 9), (3, 2), (5, 1)] for _ in range(5)]
    df = spark.createDataFrame([(e,) for e in rows], "e array<array<double>>").withColumn("a", alignment.viterbi(F.col("e")))
    for e, a in df.collect():
        score, _ = best_paths(e)
        if len(e) < len(e[0]):
            assert a.score is None and a.starts == []
            continue
        edges = [*a.starts, len(e)]
        assert math.isclose(a.score, score) and math.isclose(a.score, sum(e[t][s] for s in range(len(e[0])) for t in range(edges[s], edges[s + 1])))


def test_ties_stay_and_empty_input(spark):
    df = spark.createDataFrame([([[0.0, 0.0]] * 4,), ([],), ([[]],), (None,)], "e array<array<double>>")
    assert [(r[0].score, r[0].starts) for r in df.select(alignment.viterbi(F.col("e"))).collect()] == [(0.0, [0, 1]), (None, []), (None, []), (None, [])]


def test_distributions_with_tails(spark):
    e = [[float(-10 * t - s) for s in range(3)] for t in range(6)]
    e[1][0] = float("-inf")
    df = spark.createDataFrame([(e, [0, 2, 5])], "e array<array<double>>, starts array<int>")
    (got,) = df.select(alignment.distributions(F.col("e"), F.col("starts"), 1)).first()
    assert [(d.offset, d.log_probs) for d in got] == [(0, [0.0, -20.0]), (1, [-11.0, -21.0, -31.0, -41.0, -51.0]), (4, [-42.0, -52.0])]
    (none,) = df.select(alignment.distributions(F.transform("e", lambda f: F.transform(f, lambda x: F.lit(float("-inf")))), F.col("starts"))).first()
    assert [(d.offset, d.log_probs) for d in none] == [(None, [])] * 3


def density(x, mean, var):
    return -0.5 * sum(math.log(v) + (a - m) ** 2 / v + math.log(2 * math.pi) for a, m, v in zip(x, mean, var))


def plain_training(utterances, rounds, floor):
    def update(parts):
        model = {}
        for s in {s for s, _ in parts}:
            xs = [x for q, x in parts if q == s]
            mean = [sum(c) / len(xs) for c in zip(*xs)]
            model[s] = (len(xs), mean, [max(sum(v * v for v in c) / len(xs) - m * m, floor) for c, m in zip(zip(*xs), mean)])
        return model

    model = update([(u[1][t * len(u[1]) // len(u[0])], x) for u in utterances for t, x in enumerate(u[0])])
    scores = []
    for _ in range(rounds):
        parts, total = [], 0.0
        for frames, states in utterances:
            e = [[density(x, *model[s][1:]) for s in states] for x in frames]
            score, found = best_paths(e)
            starts = next(c for f, c in sorted(found, key=lambda f: [-k for k in f[1]]) if math.isclose(f, score, rel_tol=1e-12))
            total += score
            parts += [(states[sum(k <= t for k in starts) - 1], x) for t, x in enumerate(frames)]
        scores.append(total)
        model = update(parts)
    return model, scores


def said(states, mean, rng):
    frames = []
    for s in states:
        frames += [[rng.gauss(mean[s], 1), rng.gauss(-mean[s], 1)] for _ in range(rng.randrange(1, 4))]
    return frames, states


def test_training_by_plain_steps(spark):
    mean = {"a": 0.0, "b": 4.0, "c": 9.0}
    utterances = [said(list(s), mean, rng) for s in ["abc", "cab", "ba", "acb", "bca", "aba", "c"] * 3]
    schema = "frames array<array<double>>, states array<string>"
    odd = [([[1.0, 1.0]], ["a", "b"]), ([], ["a"]), ([[1.0, None]], ["a"]), ([[1.0, 1.0]], []), (None, ["a"]), ([[1.0, 2.0]], None)]
    model, scores = alignment.train(spark.createDataFrame(utterances + odd, schema).repartition(3), rounds=4, least_gain=-1.0)
    want, want_scores = plain_training(utterances, 4, 1e-3)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(scores, want_scores)) and len(scores) == 4
    for r in model.collect():
        n, m, v = want[r.state]
        assert r.n == n and all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip([*r.mean, *r["var"]], [*m, *v]))


def test_scores_never_fall_and_training_stops(spark):
    mean = {"sil": 0.0, "a": 3.0, "o": 6.0}
    utterances = [said([rng.choice(list(mean)) for _ in range(rng.randrange(1, 6))], mean, rng) for _ in range(60)]
    df = spark.createDataFrame(utterances, "frames array<array<double>>, states array<string>")
    model, scores = alignment.train(df, rounds=12, least_gain=1e-4)
    assert len(scores) < 12 and all(b >= a - 1e-9 * abs(a) for a, b in zip(scores, scores[1:]))
    found = {r.state: r.mean[0] for r in model.collect()}
    assert all(abs(found[s] - m) < 1 for s, m in mean.items())
    aligned = alignment.align(df.withColumn("more", F.lit(1)).limit(3), model)
    assert aligned.columns == ["frames", "states", "more", "score", "starts"] and aligned.where("score is null").count() == 0
    unknown = alignment.align(spark.createDataFrame([([[0.0, 0.0]], ["x"])], "frames array<array<double>>, states array<string>"), model).first()
    assert unknown.score is None and unknown.starts == []
    none, nothing = alignment.train(df.limit(0))
    assert none.count() == 0 and nothing == []


def test_frames_of_segments(spark):
    segments = spark.createDataFrame([("f", 0, 26, "a"), ("f", 26, 40, "o"), ("f", 3, 12, "short")], "file string, start long, end long, phone string")
    frames = spark.createDataFrame([("f", i, [float(i)]) for i in range(6)], "file string, frame long, features array<double>")
    got = sorted((r.phone, r.frame) for r in alignment.of_segments(segments, frames, 10, 8).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2)]  # 26..40 holds no whole frame that starts at a multiple of 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Three classes, one of which lies around another one: no line parts them."""
    rows = []
    for i in range(900):
        label = i % 3
        angle, radius = rng.uniform(0, 2 * math.pi), (0.5, 3.0, 6.0)[label] + rng.gauss(0, 0.3)
        rows.append((i, [radius * math.cos(angle), radius * math.sin(angle)], label))
    return spark.createDataFrame([*rows, (900, None, 1), (901, [1.0, None], 1), (902, [0.0, 0.0], None)], "id long, v array<double>, label int")


def test_network_parts_rings(vectors):
    found, right = classify.best_network(vectors, "id", "label", "v", [[2], [16, 8]], 150)
    rows = found.collect()
    assert len(right) == 2 and max(right) > 0.9
    assert sum(r.best == str(r.label) for r in rows) / len(rows) > 0.9
    assert all(len(r.scores) == 3 and abs(sum(r.scores) - 1) < 1e-6 for r in rows)
    parts = {r.id: r.part for r in vectors.withColumn("part", classify.three_parts(F.col("id"))).collect()}
    assert {r.id for r in rows} == {i for i, p in parts.items() if p == "test" and i < 900}
