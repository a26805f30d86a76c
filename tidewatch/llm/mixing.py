"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame functions only.

Each document has a 64-bit hash. What a source gives beyond whole copies of itself is the
documents whose hash lies under a threshold. The threshold is found without sorting: sizes
are summed by source and leading hash bits, the bucket in which the budget ends is found,
and only its documents are summed again by the next bits, until all 64 are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import discard, stored

#: Rows of a table of sources that are broadcast; a larger one is joined with its rows copied for SALTS shares of each source.
BROADCAST_SOURCES, SALTS = 20_000, 64
#: Hash bits of each histogram; their sum is 64.
LEVELS = (12, 16, 18, 18)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(df: DataFrame, key: str, source: str, text: str) -> list[Column]:
    """Source, size and hash of each row, under names of the mix."""
    return [F.col(source).alias("__mix_source"), word_count(F.col(text)).alias("__mix_size"), F.xxhash64(key, text).alias("__mix_hash")]


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source.

    Level w * x is the target of weight w, and x solves sum(min(most * size, w * x)) = sum(size).
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(Window.orderBy(F.col("__mix_source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    every, before = Window.partitionBy(), Window.orderBy("full_at", F.col("__mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("w", weight)
        .withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.lit(float(most)) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("x", F.col("left") / F.col("w_left"))
    )
    level = F.min(F.when(F.col("x") <= F.col("full_at"), F.struct("full_at", "x"))).over(every)["x"]
    return rows.withColumn("level", F.coalesce(level, F.lit(0.0))).select("__mix_source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.col("w") * F.col("level")).alias("target"))


def thresholds(rows: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """For each source: source_size, target, whole copies of every document, and the last hash that gets one more."""
    sizes = rows.groupBy("__mix_source").agg(F.sum("__mix_size").alias("source_size"))
    found = (
        targets(sizes, weights, most)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("whole", F.lit(False))
    )
    used = 0
    for bits in LEVELS:
        b = found.select(F.col("__mix_source").alias("b_source"), "source_size", "target", "copies", "budget", "prefix", "whole")
        # documents that share the boundary's leading bits, by the next bits
        at = F.lit(True) if used == 0 else F.shiftrightunsigned("__mix_hash", 64 - used) == F.col("prefix")
        bucket = F.shiftrightunsigned("__mix_hash", 64 - used - bits)
        sums = (
            rows.filter(F.col("__mix_size") > 0)
            .join(b, F.col("__mix_source").eqNullSafe(F.col("b_source")) & at)
            .groupBy("b_source", "source_size", "target", "copies", "budget", bucket.alias("bucket"))
            .agg(F.sum("__mix_size").alias("words"))
        )
        by_source = Window.partitionBy("b_source").orderBy(F.col("bucket").bitwiseXOR(F.lit(-(1 << 63))) if used + bits == 64 else F.col("bucket"))
        ends = sums.withColumn("upto", F.sum("words").over(by_source)).withColumn("before", F.col("upto") - F.col("words"))
        # the first bucket that the budget doesn't cover whole; else the last one
        ends = ends.groupBy("b_source", "source_size", "target", "copies", "budget").agg(
            F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), F.struct("upto", "before", "bucket"))), F.max(F.struct("upto", "before", "bucket"))).alias("e")
        )
        used += bits
        reached = ends.select(
            F.col("b_source").alias("__mix_source"), "source_size", "target", "copies", (F.col("budget") - F.col("e.before")).alias("budget"), F.col("e.bucket").alias("prefix"),
            # at the last level the boundary is one hash value: in or out, whichever comes nearer
            (F.col("e.upto") - F.col("budget") <= F.col("budget") - F.col("e.before")).alias("whole"),
        )
        found = reached
    kept = targets(sizes, weights, most).select(F.col("__mix_source").alias("t_source"), F.col("source_size").alias("t_size"), F.col("target").alias("t_target"))
    return kept.join(found, F.col("t_source").eqNullSafe(F.col("__mix_source")), "left").select(
        "t_source", F.col("t_size").alias("source_size"), F.col("t_target").alias("target"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"), "prefix", F.coalesce("whole", F.lit(False)).alias("whole")
    )


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (1, 2, 3), most: float = 3, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """`df` with size, source_size, target, copies and taken (size * copies) of each row.

    Size is the number of words of the text (null: 0). Sources by code point, null last, take
    the weights in turn and share all words; a target stops at `most` times its source's size.
    A source of no words has target 0. Columns of `df` that clash with the added ones are
    replaced; others may have any name. Rows equal in key and text have one hash, and are taken
    together. An empty table gives none. Words are counted twice, for the histograms and for the
    rows: carrying the first count over would shuffle every text.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in df.columns if c not in added]
    slim = stored(df.select(*measured(df, key, source, text)), "mix")
    bounds = stored(thresholds(slim, weights, most), "bounds")
    # the columns of `df` travel in a struct, so that none can clash with those of the mix
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *measured(df, key, source, text))
    same = F.col("__mix_source").eqNullSafe(F.col("t_source"))
    if bounds.count() <= broadcast_sources:
        rows = rows.join(F.broadcast(bounds), same, "left")
    else:
        salted = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__mix_salt", F.pmod("__mix_hash", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__mix_salt") == F.col("salt")), "left")
    discard(slim)
    low = F.lit(-(1 << 63))
    hashed, bound = F.col("__mix_hash").bitwiseXOR(low), F.col("prefix").bitwiseXOR(low)
    more = F.when((F.col("__mix_size") > 0) & ((hashed < bound) | ((hashed == bound) & F.col("whole"))), 1).otherwise(0)
    size, copies = F.col("__mix_size"), F.col("copies") + more
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), size.alias("size"), "source_size", "target", copies.alias("copies"), (size * copies).alias("taken"))
