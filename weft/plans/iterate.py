"""Fix-point loops over tables: each round is cut from its lineage by a table in the shared folder."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import discard, materialize


def until(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], *, rounds: int, name: str = "round", warn: str | None = None) -> DataFrame:
    """Apply ``step`` until ``done(old, new)`` or ``rounds`` are over; ``warn`` is then said, if given."""
    now = materialize(state, name)
    for i in range(rounds):
        new = materialize(step(now, i), name)
        ended = done(now, new)
        discard(now)
        now = new
        if ended:
            return now
    if warn:
        warnings.warn(warn, stacklevel=2)
    return now
