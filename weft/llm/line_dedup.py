"""Removal of lines that many sites share.

Each line's spread over distinct sites is a HyperLogLog sketch, merged by aggregation: map tasks send one small sketch for each of
their lines, however often a line occurs. Estimates clearly over the threshold decide; lines near it get an exact count of
their distinct sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, looked_up, materialize

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 8
LG_K = 12
#: Tasks over which a frequent line's rows are dealt, where there are too many shared lines to broadcast.
SALTS = 16

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Hash of a line without white space around it; null if nothing is left."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(bare != "", F.xxhash64(bare))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines on at least ``min_sites`` distinct sites; a null site is none."""
    rows = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(lines_of(F.col(text_col))).alias("line"))
    rows = rows.select("site", line_key(F.col("line")).alias("key")).where("key IS NOT NULL AND site IS NOT NULL")
    spread = rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    band = max(1, math.ceil(min_sites * 4 * 1.04 / math.sqrt(1 << LG_K)))
    found = materialize(spread.where(F.col("sites") >= min_sites - band), "line-spread")
    clear = found.where(F.col("sites") > min_sites + band).select("key")
    near = found.where(F.col("sites") <= min_sites + band).select("key")
    # one row for each line and site, so a frequent line isn't one key with many rows
    exact = looked_up(rows, near, "key", near.count(), salts=SALTS).distinct().groupBy("key").agg(F.count("site").alias("n"))
    return clear.unionByName(exact.where(F.col("n") >= min_sites).select("key"))


def remove_shared_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    keep_copies: bool = False,
) -> DataFrame:
    """``docs`` with shared lines taken out of the text, plus ``_n_lines`` and ``_n_removed``.

    Lines are what line feeds part; they are compared without white space around them, and blank ones always stay. All
    occurrences go, in every document; with ``keep_copies`` except in those that are shown to be copies, for an operator on whole documents to deal with:
    all their lines are shared, and another row has the same text. Null text: null stays, no lines. Repeated
    rows and null ids are kept as they are; an empty table stays empty; other columns pass through whatever their names.
    Keys are 64-bit hashes of lines, those of copies of whole texts. A document's lines are handled in one pass, however many are shared.
    """
    keys = materialize(shared_lines(docs, text_col=text_col, site_col=site_col, min_sites=min_sites), "shared-lines")
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.posexplode(lines_of(F.col(text_col))).alias("at", "line"))
    own = own.select("_id", "_h", "at", line_key(F.col("line")).alias("key")).where("key IS NOT NULL")
    hit = looked_up(own, keys, "key", keys.count(), salts=SALTS).groupBy("_id", "_h").agg(F.collect_set("at").alias("_gone"))
    if keep_copies:
        texts = docs.select(F.xxhash64(F.col(text_col)).alias("_h")).groupBy("_h").agg(F.count("*").alias("m")).where("m > 1")
        texts = materialize(texts.select("_h", F.lit(True).alias("_copied")), "repeated-texts")
        hit = looked_up(hit, texts, "_h", texts.count(), how="left")
    # The row travels as one value, so its columns' names can't clash with those used here.
    tagged = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    both = tagged.join(hit, tagged["id"].eqNullSafe(hit["_id"]) & (tagged["h"] == hit["_h"]), "left")

    def cleaned(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        kept = F.transform(places, lambda i: F.get(lines, i))
        if not keep_copies:
            return kept
        return let(kept, lambda k: F.when(F.col("_copied") & ~F.exists(k, lambda l: line_key(l).isNotNull()), lines).otherwise(k))

    own_text = F.col(f"row.`{text_col}`").cast("string")
    kept = F.when(F.col("_gone").isNotNull(), let(lines_of(own_text), cleaned))
    n = F.when(own_text.isNull(), 0).otherwise(F.regexp_count(own_text, F.lit("\n")) + 1).cast("long")
    out = both.select("row", kept.alias("kept"), n.alias("n"))
    gone = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long")
    out = out.select("row", "kept", "n", gone.alias("gone"))
    text = F.when(F.col("gone") > 0, F.array_join("kept", "\n")).otherwise(own_text)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("n").alias("_n_lines"), F.col("gone").alias("_n_removed"))
