"""Snapshots into history: fragments, changes, runs of equal observations, estimated dates, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import times


def merged_fragments(df: DataFrame, key: str = "id", order: str = "ord", fields: tuple[str, ...] = ("review_text", "reply_text"), photos: str | None = None) -> DataFrame:
    """One row an id: each field's first value that isn't blank, photos once each in order. Rows without an id stay alone."""
    alone = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.monotonically_increasing_id())
    first = [F.coalesce(F.min_by(F.when(F.col(f) != "", F.col(f)), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(order))), F.lit("")).alias(f) for f in fields]
    extra = [] if photos is None else [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(photos).alias("p")))), lambda x: x["p"]))).alias(photos)]
    return df.groupBy(F.col(key), alone.alias("__alone")).agg(F.count("*").alias("fragments"), *first, *extra).drop("__alone")


def change_events(df: DataFrame, keys: list[str], order: str, content: Column, reply: Column | None = None) -> DataFrame:
    """`df` with `event`: new, updated or none against the snapshot before; reply_added or reply_removed beside it."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("content_hash", content).withColumn("before", F.lag("content_hash").over(w)).withColumn("place", F.row_number().over(w))
    event = F.when(F.col("place") == 1, "review_new").when(F.col("before") != F.col("content_hash"), "review_updated").otherwise("none")
    rows = rows.withColumn("event", event)
    if reply is not None:
        rows = rows.withColumn("reply_hash", reply).withColumn("reply_before", F.lag("reply_hash").over(w))
        changed = (F.col("place") > 1) & ~F.col("reply_before").eqNullSafe(F.col("reply_hash"))
        rows = rows.withColumn("reply_event", F.when(changed & (F.col("reply_hash") == ""), "owner_reply_removed").when(changed, "owner_reply_added").otherwise("none")).drop("reply_before")
    return rows.drop("before", "place")


def new_versions(history: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest capture of each (keys, content_hash) over history and incoming: an insert that ignores repeats."""
    both = history.unionByName(incoming)
    rest = [c for c in both.columns if c not in (*keys, "content_hash", "captured_at")]
    return both.groupBy(*keys, "content_hash").agg(F.min("captured_at").alias("captured_at"), *(F.min_by(c, "captured_at").alias(c) for c in rest))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Rows of `new` over those of `old`; columns `kept` keep the old value."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new = F.coalesce(*(F.col(f"n.{k}").isNotNull() for k in keys[:1]))
    return joined.select(*(F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in kept or c in keys else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns))


def observation_runs(df: DataFrame, key: str, order: str, at: str, text: str) -> DataFrame:
    """Runs of equal observations: (key, run, unit, value, kind, first_at, last_at, observations, text)."""
    rows = df.withColumn("age", times.parsed(F.col(text)))
    w = Window.partitionBy(key).orderBy(order)
    shown = F.when(F.col("age.kind") == "unparsed", F.col(text))
    rows = rows.withColumn("same_as", F.struct(F.col("age.unit").alias("unit"), F.col("age.value").alias("value"), shown.alias("text")))
    rows = rows.withColumn("starts", F.when(F.col("same_as").eqNullSafe(F.lag("same_as").over(w)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(
        F.min(F.col("age.unit")).alias("unit"), F.min(F.col("age.value")).alias("value"), F.min(F.col("age.kind")).alias("kind"),
        F.min_by(at, order).alias("first_at"), F.max_by(at, order).alias("last_at"), F.count("*").alias("observations"), F.min(text).alias("text"),
    )


def transition_estimates(runs: DataFrame, key: str, zone: str = "Asia/Taipei") -> DataFrame:
    """(key, back_at, estimated_date): the first short observation's instant, or the first long step's date.

    A short observation blocks every later estimate; the first estimate stays.
    """
    w = Window.partitionBy(key).orderBy("run")
    age = F.struct("value", "unit", "kind")
    rows = runs.withColumn("back", times.calculated_back(F.col("first_at"), age))
    rows = rows.withColumn("unit_before", F.lag("unit").over(w)).withColumn("value_before", F.lag("value").over(w)).withColumn("last_before", F.lag("last_at").over(w))
    rows = rows.withColumn("short_so_far", F.max((F.col("kind") == "short").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = (F.col("kind") == "long") & (F.col("unit") == F.col("unit_before")) & (F.col("value") > F.col("value_before")) & (F.col("short_so_far") == 0)
    rows = rows.withColumn("estimate", F.when(steps, times.estimated(F.col("last_before"), F.col("first_at"), age, zone)))
    return rows.groupBy(key).agg(F.min_by("back", F.when(F.col("back").isNotNull(), F.col("run"))).alias("back_at"), F.min_by("estimate", F.when(F.col("estimate").isNotNull(), F.col("run"))).alias("estimated_date"))


def failure_alerts(df: DataFrame, key: str, order: str, failed: Column, after: int = 3) -> DataFrame:
    """Rows that raise `alert` (the failure that makes a streak of `after`) or `recovered` (the success that ends such a streak)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("failed", failed).withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(key, "island").orderBy(order)
    rows = rows.withColumn("streak", F.sum(F.col("failed").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak_before", F.coalesce(F.lag("streak").over(w), F.lit(0)))
    signal = F.when(F.col("failed") & (F.col("streak") == after), "alert").when(~F.col("failed") & (F.col("streak_before") >= after), "recovered")
    return rows.withColumn("signal", signal).filter("signal is not null").drop("failed", "island", "streak", "streak_before")


def edited(df: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with a flag: whether the row has an archived version."""
    marked = versions.select(*keys).distinct().withColumn("edited", F.lit(True))
    return df.join(marked, keys, "left").withColumn("edited", F.coalesce("edited", F.lit(False)))


def lookup(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """`wanted` keys with `known`, and the columns of `df` where it is true."""
    return wanted.select(*keys).distinct().join(df.withColumn("known", F.lit(True)), keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def one_row(df: DataFrame, **key):
    """The row of one key; a LookupError if there is none."""
    found = df
    for name, value in key.items():
        found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
    row = found.head()
    if row is None:
        raise LookupError(f"no row has {key}")
    return row


def cascaded(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (rows, its columns that hold the parent's key) without the rows of the parents in `gone`, whose columns are that key."""
    out = {}
    for name, (rows, columns) in tables.items():
        keys = gone.distinct().toDF(*(f"__gone_{i}" for i in range(len(columns))))
        match = [F.col(c).eqNullSafe(F.col(f"__gone_{i}")) for i, c in enumerate(columns)]
        out[name] = rows.join(keys, match, "left_anti")
    return out


def scan_states(scans: DataFrame, shop: str = "shop_key", order: str = "scan_no", ok: str = "ok", baseline: str | None = None, after: int = 3) -> DataFrame:
    """`scans` with the shop's state at each: initialized (a scan before succeeded), failures in a row, whether an alert is active, and notify.

    A shop's events count only once it is initialized, and never in a baseline scan.
    """
    w = Window.partitionBy(shop).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = scans.withColumn("initialized", F.coalesce(F.max(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False)))
    rows = rows.withColumn("__island", F.sum(F.col(ok).cast("int")).over(so_far))
    rows = rows.withColumn("failures", F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(shop, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    quiet = F.lit(False) if baseline is None else F.coalesce(F.col(baseline), F.lit(False))
    return rows.withColumn("alert_active", F.col("failures") >= after).withColumn("notify", F.col("initialized") & ~quiet).drop("__island")
