"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.tables import discard, looked_up, materialize, shared_dir

__all__ = ["WORD_SPLIT", "discard", "let", "looked_up", "materialize", "read_table", "shared_dir", "take_memory", "text_batches", "words"]

#: Splits words on ASCII white space only, as the contracts do.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a lambda variable isn't inlined where it is used again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


_remembers: list[tuple[str, Callable[[], None]]] = []


def take_memory(owner: str, release: Callable[[], None]) -> None:
    """Called by a task that remembers things in its worker process: what another operator remembers there is let go first.

    Workers outlive tasks and serve one stage after the other, so else the memories of all operators of a pipeline would add up.
    """
    if _remembers and _remembers[0][0] != owner:
        _remembers.pop()[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # freed memory goes back to the system where its library can do that
            ctypes.CDLL(None).malloc_trim(0)
    if not _remembers:
        _remembers.append((owner, release))
    pa.default_memory_pool().release_unused()


def text_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, and its session hands at most ``rows`` rows at a time to Python: texts are long, and both sides buffer a batch as a whole.
    A setting other than Spark's default stays."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return df
