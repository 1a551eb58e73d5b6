"""The small tables of the behavioural tests, made by rule."""

from __future__ import annotations


def _spread(i: int, width: float) -> float:
    """A number between -width and width that differs from row to row."""
    return width * (((i * 37) % 21) / 10 - 1)


#: Bottles of three sorts: neck and label hardly tell them apart, the volume does. Three rows of unknown sort follow.
BOTTLES = [(6.0 + _spread(i, 0.8), 2.0 + _spread(i + 5, 0.3), 10.0 + 25.0 * (i % 3) + _spread(i + 11, 2.0), i % 3 if i < 12 else None) for i in range(15)]
#: Ropes of three kinds, which all three measures tell apart; two of unknown kind follow.
ROPES = [(2.0 + 3.0 * (i % 3) + _spread(i, 0.4), 0.9 - 0.3 * (i % 3) + _spread(i + 3, 0.05), 50.0 + 40.0 * (i % 3) + _spread(i + 8, 6.0), i % 3 if i < 9 else None) for i in range(11)]
ONE_LABEL = [(1.5, 0.5, 20.0), (1.7, 0.6, None), (8.0, 7.0, None), (1.4, 0.4, None)]
#: Wind, whether it rained, a constant with a gap, and the sort of day; unknown days follow, one with a wind that no known day had.
MESSY = [(w, r, 3.0 if i != 4 else None, k) for i, (w, r, k) in enumerate([("west", True, 2), ("west", True, 2), ("east", False, 0), ("east", None, 0), ("north", True, 1), ("north", True, 1), ("west", True, 2), ("east", False, 0), ("north", True, 1)])]
MESSY += [("east", False, 3.0, None), ("north", True, 3.0, None), ("west", True, 3.0, None), ("south", True, 3.0, None)]


def frame(spark, rows, columns, parts=3):
    """A table with id 1, 2, ... in several partitions, not in order."""
    numbered = [(i + 1, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered[::-1], "id long, " + columns).repartition(parts)


def bottles(spark):
    return frame(spark, BOTTLES, "neck double, label double, volume double, sort int")


def ropes(spark):
    return frame(spark, ROPES, "width double, stretch double, load double, kind int")


def plane(n, extra=()):
    """Points of a plane over a grid that is not regular: y = 2 a - 3 b + 5."""
    return [(a := g * 0.13, b := (g * 3 % 8) * 0.4, 2 * a - 3 * b + 5) for g in range(1, n + 1)] + list(extra)


def saddle(n, extra=()):
    """y = a b - a a / 2 over the same points."""
    return [(a := g * 0.13, b := (g * 3 % 8) * 0.4, a * b - a * a / 2) for g in range(1, n + 1)] + list(extra)


ABY = "a double, b double, y double"
FAR = [(2.0, 1.2, None), (4000.0, -2500.0, None)]
