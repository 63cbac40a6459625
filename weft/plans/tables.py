"""Cutting lineage with tables in the shared folder, and joins that neither broadcast nor gather what isn't bounded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast (about 16 bytes each where this is used).
BROADCAST_ROWS = 1_000_000
#: Bytes on disk up to which a materialised side is broadcast; in memory it is two to three times as large.
BROADCAST_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. A temporary one is taken where that is unset and driver and executors are
    one process, as in tests; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = held or tempfile.mkdtemp(prefix="weft-")
        if not held:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    Parquet rather than ``checkpoint()`` because it is compressed and columnar, so later readers prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df`` once nothing reads it any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes that ``materialize`` wrote for ``df``."""
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._weft_path)
    return target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(target).getLength()


def looked_up(
    rows: DataFrame, keys: DataFrame, on: str, n_keys: int | None = None, *, how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 1, of: DataFrame | None = None
) -> DataFrame:
    """Equi-join of ``rows`` with ``keys``, each of which is there once: broadcast by hand only what has a known size. That is either their number ``n_keys``, up to
    ``limit``, or, without a count, the bytes of the materialised table ``of`` which ``keys`` is a selection (by default they themselves), up to ``BROADCAST_BYTES``.

    Beyond it both sides are shuffled. A key with a large share of the rows is split by adaptive execution, which repeats only the keys of
    the partitions it splits; where such keys are sure and keys are few beside rows, ``salts`` deals each key's rows over so many tasks
    beforehand, whatever the size.
    """
    if n_keys <= limit if n_keys is not None else stored_bytes(keys if of is None else of) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), on, how)
    if salts == 1:
        return rows.join(keys, on, how)
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != on]), F.lit(salts)))
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [on, "_salt"], how).drop("_salt")


def sums_before(rows: DataFrame, key: str, value: str, name: str, *, span: int = 1 << 16) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows with a smaller integer ``key``, each key being there once.

    Summed within ranges of ``span`` keys and over the ranges before, so the only task that sees more than a range sees one number
    for each range.
    """
    own = rows.withColumn("_range", F.floor(F.col(key) / span))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("_range").agg(F.sum(value).alias("_t")).select("_range", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_t") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return own.join(ranges, "_range").withColumn(name, total.cast("long")).drop("_range", "_t")
