"""Queries of ingestion: observations, changes, versions, failures, fragments, the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text, times
from tidewatch.operators import ingest, outbox
from tidewatch.plans.registry import query
from tidewatch.plans.views import FRAGMENTS, OBSERVATIONS, PARTS, table, view

OBS = f"WITH observations_v AS ({OBSERVATIONS})"
PARSED = f"""{OBS}, p AS (SELECT review_key, seq, observed_at, time_text, CASE WHEN time_text LIKE '%unknown' THEN NULL ELSE CAST(split_part(time_text, ' ', 1) AS INT) END AS value,
  CASE split_part(time_text, ' ', 2) WHEN 'minutes' THEN 'minute' WHEN 'days' THEN 'day' WHEN 'weeks' THEN 'week' WHEN 'months' THEN 'month' END AS unit FROM observations_v),
k AS (SELECT *, CASE WHEN unit = 'minute' OR unit = 'day' AND value < 7 THEN 'short' WHEN unit IN ('week', 'month') THEN 'long' ELSE 'unparsed' END AS kind FROM p)"""
RUNS = f"""{PARSED}, s AS (SELECT *, row(unit, value, CASE WHEN kind = 'unparsed' THEN time_text END) AS same_as FROM k),
l AS (SELECT *, CASE WHEN same_as IS NOT DISTINCT FROM lag(same_as) OVER w THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY review_key ORDER BY seq)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY review_key ORDER BY seq) AS run FROM l),
runs AS (SELECT review_key, CAST(run AS BIGINT) AS run, min(unit) AS unit, min(value) AS value, min(kind) AS kind, min(observed_at) AS first_at, max(observed_at) AS last_at,
  count(*) AS observations, arg_min(observed_at, seq) AS f, arg_max(observed_at, seq) AS t FROM n GROUP BY review_key, run)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBSERVATIONS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.observation_runs(observations(spark, sf_dir), "review_key", "seq", "observed_at", "time_text")


@query(f"{PARSED} SELECT seq, value, unit, kind FROM k")
def relative_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = times.parsed(F.col("time_text"))
    return observations(spark, sf_dir).select("seq", age.alias("age")).select("seq", "age.value", "age.unit", "age.kind")


@query(f"{PARSED} SELECT seq, epoch_us(observed_at - CASE WHEN unit = 'minute' THEN value * INTERVAL 1 MINUTE ELSE value * INTERVAL 1 DAY END) AS back_micros FROM k WHERE kind = 'short'")
def back_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("back", times.calculated_back(F.col("observed_at"), times.parsed(F.col("time_text"))))
    return rows.filter("back is not null").select("seq", times.epoch_micros(F.col("back")).alias("back_micros"))


@query(f"{RUNS} SELECT review_key, run, unit, value, kind, observations, epoch_us(f) AS first_micros, epoch_us(t) AS last_micros FROM runs")
def observation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("review_key", "run", "unit", "value", "kind", "observations", times.epoch_micros(F.col("first_at")).alias("first_micros"), times.epoch_micros(F.col("last_at")).alias("last_micros"))


@query(f"""{RUNS}, w AS (SELECT *, lag(unit) OVER o AS unit_before, lag(value) OVER o AS value_before, lag(t) OVER o AS t_before, max(CASE WHEN kind = 'short' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS short_so_far
  FROM runs WINDOW o AS (PARTITION BY review_key ORDER BY run)),
e AS (SELECT *, CASE WHEN kind = 'long' AND unit = unit_before AND value > value_before AND short_so_far = 0 THEN
  CAST(CAST(make_timestamp((epoch_us(t_before) + epoch_us(f)) // 2) + INTERVAL 8 HOUR AS DATE) - CASE WHEN unit = 'week' THEN value * INTERVAL 7 DAY ELSE value * INTERVAL 1 MONTH END AS DATE) END AS estimate,
  CASE WHEN kind = 'short' THEN epoch_us(f - CASE WHEN unit = 'minute' THEN value * INTERVAL 1 MINUTE ELSE value * INTERVAL 1 DAY END) END AS back FROM w)
SELECT review_key, arg_min(back, run) FILTER (WHERE back IS NOT NULL) AS back_micros, CAST(arg_min(estimate, run) FILTER (WHERE estimate IS NOT NULL) AS VARCHAR) AS estimated_date FROM e GROUP BY review_key""")
def transition_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.transition_estimates(runs(spark, sf_dir), "review_key")
    return found.select("review_key", times.epoch_micros(F.col("back_at")).alias("back_micros"), F.col("estimated_date").cast("string").alias("estimated_date"))


CHANGES = "WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)), e AS (SELECT conv_id, turn, role, text, CASE WHEN place = 1 THEN 'review_new' WHEN text <> before THEN 'review_updated' ELSE 'none' END AS event FROM c)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as snapshots: one review is what one role says, turn after turn."""
    return table(spark, sf_dir, "conversations")


@query(f"{CHANGES} SELECT conv_id, turn, role, event, concat_ws(':', event, role, CAST(conv_id AS VARCHAR), left(sha256(text), 16)) AS event_key FROM e")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.change_events(snapshots(spark, sf_dir), ["conv_id", "role"], "turn", F.sha2("text", 256))
    key = hashing.event_key(F.col("event"), F.col("role"), F.col("conv_id").cast("string"), F.left("content_hash", F.lit(16)))
    return rows.select("conv_id", "turn", "role", "event", key.alias("event_key"))


@query("SELECT conv_id, role, sha256(text) AS content_hash, min(turn) AS captured_at FROM conversations GROUP BY ALL")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).select("conv_id", "role", F.sha2("text", 256).alias("content_hash"), F.col("turn").alias("captured_at"))
    return ingest.new_versions(rows.filter("captured_at % 2 = 0"), rows.filter("captured_at % 2 <> 0"), ["conv_id", "role"])


@query("""WITH f AS (SELECT *, event_type = 'error' AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f),
s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM i), b AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS streak_before FROM s),
g AS (SELECT event_id, user_id, CASE WHEN failed AND streak = 3 THEN 'alert' WHEN NOT failed AND streak_before >= 3 THEN 'recovered' END AS signal FROM b) SELECT * FROM g WHERE signal IS NOT NULL""")
def failure_streak_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ingest.failure_alerts(rows, "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", "signal")


@query(f"WITH fragments_v AS ({FRAGMENTS}) SELECT id, count(*) AS fragments, coalesce(arg_min(review_text, ord) FILTER (WHERE review_text <> ''), '') AS review_text, coalesce(arg_min(reply_text, ord) FILTER (WHERE reply_text <> ''), '') AS reply_text FROM fragments_v GROUP BY id")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merged_fragments(view(spark, sf_dir, FRAGMENTS))


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS edited FROM orders")
def edited_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.edited(table(spark, sf_dir, "orders").select("o_orderkey"), versions, ["o_orderkey"])


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_acctbal AS c_acctbal, coalesce(b.c_mktsegment, a.c_mktsegment) AS c_mktsegment FROM customer a JOIN (SELECT c_custkey, 'MOVED' AS c_mktsegment FROM customer WHERE c_nationkey = 3) b USING (c_custkey) UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey IS DISTINCT FROM 3")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New snapshots over stored ones; the balance is a counter and keeps its old value."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    new = old.filter("c_nationkey = 3").withColumns({"c_mktsegment": F.lit("MOVED"), "c_acctbal": F.lit(0.0)})
    return ingest.upserted(old, new, ["c_custkey"], ["c_acctbal"]).drop("c_nationkey")


DUE = f"WITH parts_v AS ({PARTS})"


@query(f"{DUE} SELECT event_id, part_no, attempts, o_orderpriority FROM parts_v JOIN orders ON o_orderkey = event_id WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '1995-06-17' ORDER BY event_id, part_no LIMIT 100")
def due_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 parts that a run of the queue takes first."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderpriority")
    now = F.expr("TIMESTAMP_NTZ'1995-06-17'")
    return outbox.due(view(spark, sf_dir, PARTS), events, now, 100).select("event_id", "part_no", "attempts", "o_orderpriority")


@query(f"{DUE} SELECT event_id, part_no, CAST(least(3600, 30 * pow(2, least(attempts, 7))) AS INT) AS delay_seconds, attempts + 1 AS attempts, epoch_us(next_attempt_at) + 1000000 * CAST(least(3600, 30 * pow(2, least(attempts, 7))) AS BIGINT) AS next_micros FROM parts_v WHERE status = 'pending'")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox.after_failure(view(spark, sf_dir, PARTS).filter("status = 'pending'"), F.lit("timed out"))
    return rows.select("event_id", "part_no", "delay_seconds", "attempts", times.epoch_micros(F.col("next_attempt_at")).alias("next_micros"))


@query("SELECT DISTINCT event_type || ':' || user_id AS event_key, true AS fresh FROM events WHERE event_type || ':' || user_id NOT IN (SELECT event_type || ':' || user_id FROM events WHERE value < 2)")
def fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent enqueueing: keys seen before (here: of events of little value) are dropped, repeats count once."""
    rows = table(spark, sf_dir, "events").withColumn("event_key", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")))
    known = rows.filter("value < 2").select("event_key").distinct()
    return outbox.fresh_events(rows.select("event_key"), known).withColumn("fresh", F.lit(True))


@query()
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_key"), text.split_text(F.col("text"), 1000).alias("parts"))
    return outbox.numbered_parts(parts).select("event_key", "part_no", F.length("part").alias("n_chars"))


@query("SELECT o_custkey, CAST(ceil(count(*) / 10.0) AS INT) AS n_batches, count(*) - 10 * (CAST(ceil(count(*) / 10.0) AS BIGINT) - 1) AS last_size FROM orders GROUP BY o_custkey")
def media_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.batches(F.collect_list("o_orderkey"), 10).alias("b"))
    return paths.select("o_custkey", F.size("b").alias("n_batches"), F.size(F.element_at("b", -1)).cast("long").alias("last_size"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))
