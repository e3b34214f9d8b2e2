"""Score arithmetic as columns; everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from leadrank.functions.fixed import DIMENSION_WEIGHTS, STAGES


def clamp(value: Column) -> Column:
    """Value limited to 0..10; null for what is not a finite number."""
    number = value.cast("double")
    # Infinity minus itself is not a number, so the difference is 0 only for finite values.
    return F.when(number - number == 0.0, F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)))


# Splits a double into two halves of 26 bits whose products with a small number are exact.
_SPLITTER = float((1 << 27) + 1)


def round_binary(value: Column) -> Column:
    """A value of 0 to 2^40 at two decimals, rounded from its exact binary value; ties go to the even digit.

    A hundred times the value is taken as a product and the error of that product, both exact. Where the product lies
    beside a tie, the error decides, so the result is the double that a correctly rounded decimal text would give.
    """
    whole = F.floor(value * 100.0).cast("double")
    # Halves of the value: the product of either with 100 has no rounding error.
    shifted = value * F.lit(_SPLITTER)
    high = shifted - (shifted - value)
    error = (high * 100.0 - value * 100.0) + (value - high) * 100.0
    beyond_tie = (value * 100.0 - whole - 0.5) + error
    up = (beyond_tie > 0.0) | ((beyond_tie == 0.0) & (whole % 2.0 == 1.0))
    return (whole + up.cast("double")) / 100.0


def weighted_total(dimensions: Mapping[str, Column], parity: str = "sql") -> Column:
    """Sum of clamped dimensions times weights, 0..100, two decimals.

    `parity="sql"` rounds half up as SQL does. `parity="python"` rounds the exact binary value, for totals
    that must equal ones stored earlier to the last bit.
    """
    total = reduce(
        lambda left, right: left + right,
        [clamp(dimensions[name]) * F.lit(weight) for name, weight in DIMENSION_WEIGHTS.items()],
    )
    return round_binary(total) if parity == "python" else F.round(total, 2)


def stage_mean(ratings: Sequence[Column]) -> Column:
    """Mean of the five integer ratings of one stage."""
    return reduce(lambda left, right: left + right, ratings).cast("double") / F.lit(5.0)


def priority(need: Column, win: Column, deliver: Column) -> Column:
    """Ten times the geometric mean of the three stage means, 0..100, two decimals."""
    return F.round(F.lit(10.0) * F.pow(need * win * deliver, F.lit(1.0 / 3.0)), 2)


def evaluation_means(evaluation: Column) -> dict[str, Column]:
    """Stage means of an evaluation struct, by stage."""
    return {
        stage: stage_mean([evaluation[stage][name] for name in names]) for stage, names in STAGES.items()
    }


def evaluation_priority(evaluation: Column) -> Column:
    means = evaluation_means(evaluation)
    return priority(means["need"], means["win"], means["deliver"])
