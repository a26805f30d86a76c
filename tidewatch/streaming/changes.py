"""Snapshots as a stream: state by review and by shop, events once, the same as the batch queries over the same log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import times

EVENTS = "review_key string, seq long, event string, reply_event string, event_key string, notify boolean"
STATE = "content_hash string, reply_hash string"


def classify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one review's new snapshots, in the order of seq; order across batches is that of arrival."""
    content, reply = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, c, r, notify in zip(rows.seq, rows.content_hash, rows.reply_hash, rows.notify, strict=True):
        event = "review_new" if content is None else "review_updated" if c != content else "none"
        change = "none" if content is None or r == reply else "owner_reply_removed" if r == "" else "owner_reply_added"
        out.append((key[0], seq, event, change, f"{event}:{key[0]}:{c[:16]}", notify))
        content, reply = c, r
    state.update((content, reply))
    yield pd.DataFrame(out, columns=["review_key", "seq", "event", "reply_event", "event_key", "notify"])


def change_stream(snapshots: DataFrame) -> DataFrame:
    """Events of a streaming frame (review_key, seq, content_hash, reply_hash, and if there, notify), with `notify`."""
    rows = snapshots if "notify" in snapshots.columns else snapshots.withColumn("notify", F.lit(True))
    return rows.groupBy("review_key").applyInPandasWithState(classify, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def enqueue(events: DataFrame, folder: str, checkpoint: str, ready: bool | str = True):
    """Write real events into the outbox, each key once, whatever batches are repeated after a failure.

    `ready`: whether events count, or the column that says so row by row (a shop's first scan
    and baseline scans don't; see ingest.scan_states()).
    """

    def put(batch: DataFrame, number: int) -> None:
        counts = F.coalesce(F.col(ready), F.lit(False)) if isinstance(ready, str) else F.lit(ready)
        fresh = batch.filter((F.col("event") != "none") & counts).dropDuplicates(["event_key"])
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        earlier = [s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")) or [] if int(s.getPath().getName().split("=")[1]) < number]
        if earlier:
            fresh = fresh.join(spark.read.parquet(*earlier).select("event_key"), "event_key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


AGES = "review_key string, seq long, run long, unit string, value int, kind string, back_at timestamp, estimated_date date"
AGE_STATE = "run long, unit string, value int, text string, last_at timestamp, blocked boolean, back_at timestamp, estimated_date date"


def age_stream(observations: DataFrame, zone: str = "Asia/Taipei") -> DataFrame:
    """Runs of equal ages and the times they tell, of a streaming frame (review_key, seq, observed_at timestamp, time_text).

    One row an observation, with the review's state after it: the same as ingest.observation_runs()
    and transition_estimates() over the whole log. Rows of one batch are taken in the order of seq.
    """
    age = times.parsed(F.col("time_text"))
    rows = observations.withColumn("age", age).select("review_key", "seq", "observed_at", "time_text", "age.unit", "age.value", "age.kind")

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, unit, value, text, last_at, blocked, back_at, date = state.get if state.exists else (0, None, None, None, None, False, None, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            now_unit = None if pd.isna(row.unit) else row.unit
            now_value = None if pd.isna(row.value) else int(row.value)
            same = run and (now_unit, now_value) == (unit, value) and (row.kind != "unparsed" or row.time_text == text)
            if not same:
                blocked = blocked or row.kind == "short"
                if row.kind == "short" and back_at is None:
                    back_at = row.observed_at - pd.Timedelta(seconds=now_value * times.SECONDS[now_unit])
                if row.kind == "long" and not blocked and date is None and now_unit == unit and value is not None and now_value > value:
                    date = stepped(pd.Timestamp(last_at) + (row.observed_at - pd.Timestamp(last_at)) / 2, now_unit, now_value, zone)
                run += 1
            unit, value, text, last_at = now_unit, now_value, row.time_text, row.observed_at
            out.append((key[0], row.seq, run, unit, value, row.kind, back_at, date))
        state.update((run, unit, value, text, last_at, blocked, back_at, date))
        frame = pd.DataFrame(out, columns=["review_key", "seq", "run", "unit", "value", "kind", "back_at", "estimated_date"])
        frame["value"] = frame["value"].astype("Int32")
        frame["back_at"] = pd.to_datetime(frame["back_at"])
        yield frame

    return rows.groupBy("review_key").applyInPandasWithState(follow, AGES, AGE_STATE, "append", GroupStateTimeout.NoTimeout)


def stepped(at: pd.Timestamp, unit: str, value: int, zone: str):
    """The local date `value` weeks, months or years before an instant (UTC); the day is cut to the month's end."""
    local = pd.Timestamp(at).tz_localize("UTC").tz_convert(zone).tz_localize(None).normalize()
    return (local - pd.DateOffset(**{unit + "s": value})).date()


SHOP_EVENTS = "shop_key string, scan_no long, notify boolean, failures int, signal string"
SHOP_STATE = "initialized boolean, failures int, alert_active boolean"


def shop_stream(scans: DataFrame, after: int = 3) -> DataFrame:
    """State of each shop over a streaming frame (shop_key, scan_no, ok): whether its events count, failures in a row, alert or recovered."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        initialized, failures, alert = state.get if state.exists else (False, 0, False)
        out = []
        for scan, ok in pd.concat(list(batches)).sort_values("scan_no", kind="stable")[["scan_no", "ok"]].itertuples(index=False):
            notify, signal = initialized, None
            if ok:
                signal = "recovered" if alert else None
                initialized, failures, alert = True, 0, False
            else:
                failures += 1
                if failures >= after and not alert:
                    alert, signal = True, "alert"
            out.append((key[0], scan, notify, failures, signal))
        state.update((initialized, failures, alert))
        yield pd.DataFrame(out, columns=["shop_key", "scan_no", "notify", "failures", "signal"])

    return scans.groupBy("shop_key").applyInPandasWithState(follow, SHOP_EVENTS, SHOP_STATE, "append", GroupStateTimeout.NoTimeout)
