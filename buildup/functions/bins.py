"""Equal-width bins whose edges are ``low + i * step`` in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of ``value`` in [low, high]; the last bin is closed.

    The quotient only guesses the bin. The guess is corrected against the
    edges, so a value such as 0.3, whose edge is 0.30000000000000004, lands in
    the bin below that edge. An empty range puts every value in bin 0; a null
    value has no bin.
    """
    step = (high - low) / F.lit(float(bins))
    top = F.lit(bins - 1)
    guess = F.coalesce(F.floor(F.try_divide(value - low, step)), F.lit(0))
    guess = F.least(F.greatest(guess, F.lit(0)), top)
    below = (guess > 0) & (value < low + guess * step)
    above = (guess < top) & (value >= low + (guess + 1) * step)
    fixed = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when(value.isNotNull(), F.when(high == low, 0).otherwise(fixed)).cast("bigint")


def unit_bin(value: Column, bins: int) -> Column:
    """Half-open bins of [0, 1); null outside, so a value of exactly 1 is in no bin."""
    inside = (value >= 0) & (value < 1)
    return F.when(inside, edge_bin(value, F.lit(0.0), F.lit(1.0), bins))
