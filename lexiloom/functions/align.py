"""Comparison of two sequences (arrays of symbols): edit distance, recipe and alignment with costs that are column functions.

The matrix is filled by anti-diagonals: a cell needs the two before it alone, so a diagonal is one ``transform`` over its cells and the matrix one ``aggregate`` over
diagonals, without a Python worker. A pair costs as many steps as its matrix has cells, and only the last two diagonals and a letter a cell (for a recipe) are kept. Null sequences give null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """What it costs to insert, remove or substitute a symbol. ``borders``: what the first row and column hold: ``count`` the number of symbols, ``sum`` their costs."""

    insert: Callable[[Column], Column] = lambda x: F.lit(1.0)
    remove: Callable[[Column], Column] = lambda x: F.lit(1.0)
    substitute: Callable[[Column, Column], Column] = lambda x, y: F.when(x == y, 0.0).otherwise(1.0)
    borders: str = "count"


UNIT = Costs()
DOUBLE = Costs(substitute=lambda x, y: F.when(x == y, 0.0).otherwise(2.0))


def _vowel(x: Column) -> Column:
    return F.lower(x).isin(*"aeiouy")


#: A vowel for a vowel is cheap, any other substitution is out of the question.
PHONATION = Costs(substitute=lambda x, y: F.when(x == y, 0.0).when(_vowel(x) & _vowel(y), 1.0).otherwise(99.0))
#: Numbers: what they differ by.
MANHATTAN = Costs(insert=lambda x: x.cast("double"), remove=lambda x: x.cast("double"), substitute=lambda x, y: F.abs(x - y).cast("double"))


def letters(text: Column) -> Column:
    """A string as an array of its characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _cell(costs: Costs, a: Column, b: Column, d: Column, i: Column, last: Column, before: Column, lo1: Column, lo2: Column, order: str) -> Column:
    """struct(c, r, s): cost, rank of the step and the step (R, I or S) of the cell (i, d - i)."""
    j = d - i
    x, y = F.get(a, i - 1), F.get(b, j - 1)
    rank = {step: order.index(step) for step in "RIS"}
    of = lambda cost, step: F.struct(cost.alias("c"), F.lit(rank[step]).alias("r"), F.lit(step).alias("s"))
    one = F.lit(1.0)
    removed = F.get(last, i - 1 - lo1) + (one if costs.borders == "count" else costs.remove(x))
    inserted = F.get(last, i - lo1) + (one if costs.borders == "count" else costs.insert(y))
    inside = F.array_min(F.array(of(F.get(last, i - 1 - lo1) + costs.remove(x), "R"), of(F.get(last, i - lo1) + costs.insert(y), "I"), of(F.get(before, i - 1 - lo2) + costs.substitute(x, y), "S")))
    return F.when(j == 0, of(removed, "R")).when(i == 0, of(inserted, "I")).otherwise(inside)


def _filled(a: Column, b: Column, costs: Costs, order: str, keep: bool) -> Column:
    """struct(last, before, steps): the costs of the last two diagonals and, with ``keep``, the steps of all cells but the first, a string for each diagonal."""
    n, m = F.size(a), F.size(b)
    lo = lambda d: F.greatest(F.lit(0), d - m)

    def add(state: Column, d: Column) -> Column:
        cells = F.transform(F.sequence(lo(d), F.least(d, n)), lambda i: _cell(costs, a, b, d, i, state["last"], state["before"], lo(d - 1), lo(d - 2), order))
        done = F.array(F.struct(cells.alias("cells")))  # an array of one, so that the diagonal is worked out once
        return F.element_at(
            F.transform(done, lambda t: F.struct(t["cells"]["c"].alias("last"), state["last"].alias("before"), (F.array_append(state["steps"], F.array_join(t["cells"]["s"], "")) if keep else state["steps"]).alias("steps"))), 1
        )

    start = F.struct(F.array(F.lit(0.0)).alias("last"), F.array(F.lit(0.0)).alias("before"), F.array().cast("array<string>").alias("steps"))
    diagonals = F.when(n + m > 0, F.sequence(F.lit(1), F.greatest(n + m, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(diagonals, start, add)


def distance(a: Column, b: Column, costs: Costs = UNIT) -> Column:
    """The least cost of turning ``a`` into ``b``."""
    return F.when(a.isNotNull() & b.isNotNull(), F.get(_filled(a, b, costs, "RIS", False)["last"], F.lit(0)))


def recipe(a: Column, b: Column, costs: Costs = UNIT, order: str = "RIS") -> Column:
    """Steps from start to end that turn ``a`` into ``b`` at the least cost: array of struct(op, i, j), with op R (removes a's symbol i), I (inserts b's symbol j before a's i) or
    S (puts b's j for a's i, an equal one too). Where steps into a cell cost the same, the one that comes first in ``order`` is taken."""
    n, m = F.size(a), F.size(b)
    steps = _filled(a, b, costs, order, True)["steps"]

    def back(state: Column, _: Column) -> Column:
        i, j = state["i"], state["j"]
        d = i + j
        op = F.substring(F.element_at(state["all"], F.greatest(d, F.lit(1))), i - F.greatest(F.lit(0), d - m) + 1, F.lit(1))
        i2, j2 = F.when(op == "I", i).otherwise(i - 1), F.when(op == "R", j).otherwise(j - 1)
        step = F.struct(op.alias("op"), F.when(op == "I", i).otherwise(i - 1).alias("i"), F.when(op != "R", j - 1).alias("j"))
        more = F.struct(i2.cast("int").alias("i"), j2.cast("int").alias("j"), F.array_append(state["out"], step).alias("out"), state["all"].alias("all"))
        return F.when(d > 0, more).otherwise(state)

    start = F.struct(n.alias("i"), m.alias("j"), F.array().cast("array<struct<op:string,i:int,j:int>>").alias("out"), steps.alias("all"))
    path = F.aggregate(F.sequence(F.lit(1), F.greatest(n + m, F.lit(1))), start, back, lambda s: F.reverse(s["out"]))
    return F.when(a.isNotNull() & b.isNotNull(), path)


def valid(a: Column, b: Column, steps: Column) -> Column:
    """Whether the steps use every symbol of ``a`` once, in order, and give ``b``."""
    used = F.transform(F.filter(steps, lambda s: s["op"] != "I"), lambda s: s["i"])
    made = F.transform(F.filter(steps, lambda s: s["op"] != "R"), lambda s: F.get(b, s["j"]))
    all_of = F.filter(F.sequence(F.lit(0), F.size(a)), lambda k: k < F.size(a))
    return (used == all_of) & (made == b)


def aligned(a: Column, b: Column, steps: Column, pad: str = "~", separator: str = "", text: Callable[[Column], Column] = lambda x: x.cast("string")) -> Column:
    """struct(first, second): both sequences as strings of one length. What one has alone the other has as pads, the shorter of two symbols is padded behind."""
    none = F.lit("")

    def side(own: Column, other: Column, skip: str, at: str, beside: str) -> Column:
        def part(s: Column) -> Column:
            mine = F.when(s["op"] == skip, none).otherwise(text(F.get(own, s[at])))
            theirs = F.when(s["op"] == ("I" if skip == "R" else "R"), none).otherwise(text(F.get(other, s[beside])))
            return F.rpad(mine, F.greatest(F.length(mine), F.length(theirs)), F.lit(pad))

        return F.array_join(F.transform(steps, part), separator)

    return F.struct(side(a, b, "I", "i", "j").alias("first"), side(b, a, "R", "j", "i").alias("second"))
