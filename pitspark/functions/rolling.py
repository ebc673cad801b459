"""Rolling statistics of row windows, assembled from short blocks.

Spark evaluates a sliding aggregate frame anew for every row, so a 60-row
frame costs 60 updates per row and function. Here a window is put together
from pieces instead: five neighbouring values form a block, four blocks a
20-row window, three of those a 60-row window. Each step only looks rows up at
a fixed offset, which costs the same for any window length, and the arithmetic
between the steps is ordinary generated code. All steps share one window
specification, hence one exchange and one sort.

Plain ``+`` yields NULL once a value is missing, which is the rule for rolling
statistics: no value before the window is full, none while it holds a NULL.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window, WindowSpec, functions as F

BLOCK = 5
BLOCKS = 4
WINDOW = BLOCK * BLOCKS


def by_time(key: str, time: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def change(now: Column, before: Column) -> Column:
    """Relative change; NULL if either value is missing or the earlier one is zero."""
    return F.try_divide(now, before) - 1


def block_mean(values: list[Column]) -> Column:
    """Mean of a block, as an offset from its newest value.

    Taking offsets first makes the mean of equal values exactly that value.
    """
    return values[0] + _offset_mean(values)


def _offset_mean(values: list[Column]) -> Column:
    return reduce(add, [v - values[0] for v in values[1:]]) / len(values)


def block_spread(values: list[Column]) -> Column:
    """Sum of squared deviations within a block; exactly zero for equal values."""
    mean = _offset_mean(values)
    return reduce(add, [_square(v - values[0] - mean) for v in values])


def _square(x: Column) -> Column:
    return x * x


def merged_mean(means: list[Column]) -> Column:
    """Mean of a window from the means of its equally long parts."""
    return reduce(add, means) / len(means)


def merged_std(means: list[Column], spreads: list[Column]) -> Column:
    """Population standard deviation of a window from its blocks.

    Within-block and between-block deviations are added, which avoids the
    cancellation of a sum of squares.
    """
    mean = merged_mean(means)
    between = reduce(add, [_square(m - mean) for m in means]) * BLOCK
    return F.sqrt((reduce(add, spreads) + between) / WINDOW)


def present(values: list[Column]) -> Column:
    """Whether no value is missing."""
    return reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
