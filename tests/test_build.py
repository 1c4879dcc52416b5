"""A build that is stopped between any two steps and started again gives the files of one that ran through."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import build


class Stopped(Exception):
    pass


class Fragile(build.Steps):
    """Stops after so many steps, once before and once after a step is noted."""

    left = 0

    def once(self, step, write):
        if self.path(step) is None:
            if self.left == 0:
                write(f"{self.folder}/{step}-left-behind")  # as if it were stopped before the step is noted
                raise Stopped(step)
            self.left -= 1
        return super().once(step, write)


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.createDataFrame([(1, "one two three. one two four! broke one"), (2, "two three one. many many many words words words"), (3, None)], "doc_id long, text string")
    d = lambda rows: spark.createDataFrame(rows, "word string, code string, phones array<string>")
    known = d([("one", "one(1)", ["W", "A"]), ("one", "one(2)", ["O"]), ("two", "two", ["T", "U"]), ("unused", "unused", ["U"])])
    return docs, known, d([("broke", "broke", ["B"])]), d([("<sil>", "<sil>", ["SIL"])]), spark.createDataFrame([("words",)], "word string")


def spell(word):
    return F.filter(F.split(F.upper(word), ""), lambda c: c != "")


def lines(path):
    out = []
    for f in sorted(glob.glob(os.path.join(path.removeprefix("file://"), "part-*"))):
        out += open(f, encoding="utf-8").read().splitlines()
    return out


def texts(files):
    return {name: lines(path) for name, path in files.items()}


def test_files(spark, inputs, tmp_path):
    steps = build.Steps(spark, str(tmp_path / "b"))
    got = texts(build.build(steps, *inputs, spell, 3))
    assert got["filler.dict"] == ["<sil>\tSIL"]
    assert got["train.vocab"] == ["broke", "many", "one", "two", "unused"] and got["test.vocab"] == ["many", "one", "two", "unused"]
    assert got["train.dict"] == ["broke\tB", "many\tM A N Y", "one(1)\tW A", "one(2)\tO", "two\tT U", "unused\tU"] and got["test.dict"] == [x for x in got["train.dict"] if x != "broke\tB"]
    assert got["train.arpa"][:2] == ["\\data\\", "ngram 1=7"] and got["test.arpa"][:2] == ["\\data\\", "ngram 1=6"] and got["test.arpa"][-1] == "\\end\\"
    assert len(steps.made) == 2 + 1 + 2 * 7
    again = build.Steps(spark, str(tmp_path / "b"))
    assert texts(build.build(again, *inputs, spell, 3)) == got and again.made == []
    other = build.Steps(spark, str(tmp_path / "b"), {"min_usage": 1})
    assert "three" in texts(build.build(other, *inputs, spell, 1))["test.vocab"] and len(other.made) == 17


def test_restarts(spark, inputs, tmp_path):
    whole = texts(build.build(build.Steps(spark, str(tmp_path / "whole")), *inputs, spell, 3))
    made = []
    for left in (3, 4, 1, 5, 99):
        steps = Fragile(spark, str(tmp_path / "parts"))
        steps.left = left
        try:
            got = texts(build.build(steps, *inputs, spell, 3))
        except Stopped:
            os.system(f"mv {tmp_path}/parts/*-left-behind {tmp_path}/ 2>/dev/null; mkdir -p {tmp_path}/old-{left}; mv {tmp_path}/*-left-behind {tmp_path}/old-{left}/")
            got = None
        made += steps.made
    assert got == whole and len(made) == len(set(made)) == 17


def test_broken_codes_stop_the_test_dictionary(spark, inputs, tmp_path):
    docs, known, broken, filler, removed = inputs
    steps = build.Steps(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="1 codes .* two"):
        build.build(steps, docs, known, broken.union(known.where("word = 'two'")), filler, removed, spell, 3)
    assert "train.dict" in steps.made and "test.dict" not in steps.made
