"""Queries of single functions and small views, on texts built so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text, times
from tidewatch.operators import ingest, lists, outbox
from tidewatch.plans.registry import query
from tidewatch.plans.views import REVIEWS, reviews, table

R = f"WITH reviews_v AS ({REVIEWS})"
#: Ages as sources write them, by event_id % 16: text, value, unit.
AGES = (
    ("Edited 2 weeks ago", 2, "week"), ("1月前", 1, "month"), ("現在", 0, "second"), ("17 分鐘前", 17, "minute"), ("上次編輯：3 週間前", 3, "week"), ("a day ago", 1, "day"), ("an  HOUR ago", 1, "hour"), ("昨日", 1, "day"),
    ("８ 日前", 8, "day"), ("5 ヶ月前", 5, "month"), ("12 years ago", 12, "year"), ("たった今", 0, "second"), ("無日期", None, None), ("6時間前 ", 6, "hour"), ("99999999999 days ago", None, None), ("3 weeks", None, None),
)


def case(column: str, values: tuple, quoted: bool = True) -> str:
    spelled = ["NULL" if v is None else f"'{v}'" if quoted else str(v) for v in values]
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(spelled)) + " END"


def pick(column, values: tuple):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (column % len(values) + 1).cast("int"))


@query(f"WITH a AS (SELECT event_id, CAST({case('event_id % 16', tuple(x[1] for x in AGES), False)} AS INT) AS value, {case('event_id % 16', tuple(x[2] for x in AGES))} AS unit FROM events) SELECT event_id, value, unit, CASE WHEN unit IN ('second', 'minute', 'hour') OR unit = 'day' AND value < 7 THEN 'short' WHEN unit IN ('week', 'month', 'year') THEN 'long' ELSE 'unparsed' END AS kind FROM a")
def ages_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages within other words, in three languages, with wide digits."""
    rows = table(spark, sf_dir, "events").select("event_id", times.parsed(pick(F.col("event_id"), tuple(x[0] for x in AGES))).alias("age"))
    return rows.select("event_id", "age.value", "age.unit", "age.kind")


COUNTS = (("1，123 reviews · 45 photos", 1123, 45), ("reviews · 45 photos", None, 45), ("Local Guide · 12 則評論 · 3 張照片", 12, 3), ("reviews 7, photos： 9", 7, 7), ("１８ reviews", 18, None), ("", None, None))


@query(f"SELECT p_partkey, CAST({case('p_partkey % 6', tuple(x[1] for x in COUNTS), False)} AS INT) AS reviews, CAST({case('p_partkey % 6', tuple(x[2] for x in COUNTS), False)} AS INT) AS photos FROM part")
def counts_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(F.col("p_partkey"), tuple(x[0] for x in COUNTS))
    return table(spark, sf_dir, "part").select("p_partkey", text.count_label(said, "則評論|reviews?").alias("reviews"), text.count_label(said, "張照片|photos?").alias("photos"))


#: Stored times of a review: back-calculated, estimated, status.
STORED = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 61 SECOND, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '+00:00' ELSE '' END WHEN o_orderkey % 5 = 1 THEN 'not a time' END AS back,
  o_orderdate + INTERVAL 61 SECOND AS moment, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS estimate, CASE o_orderkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'unparsed' WHEN 2 THEN 'short' END AS status FROM orders"""


def stored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    at = F.timestamp_add("SECOND", F.lit(61), date)
    back = F.when(key % 5 == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(key % 2 == 0, "+00:00").otherwise(""))).when(key % 5 == 1, "not a time")
    status = F.when(key % 4 == 0, "long").when(key % 4 == 1, "unparsed").when(key % 4 == 2, "short")
    return table(spark, sf_dir, "orders").select("o_orderkey", back.alias("back"), at.alias("moment"), F.when(key % 3 == 0, F.date_format(date, "yyyy-MM-dd")).alias("estimate"), status.alias("status"))


@query(f"""WITH s AS ({STORED}), t AS (SELECT *, CASE WHEN back = 'not a time' THEN back ELSE strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS local FROM s)
SELECT o_orderkey, CASE WHEN back IS NOT NULL THEN local WHEN estimate IS NOT NULL OR status IN ('long', 'short') THEN '—' WHEN status = 'unparsed' THEN '無法解析' ELSE '尚未更新' END AS back_shown,
  CASE WHEN back IS NOT NULL THEN '—' WHEN estimate IS NOT NULL THEN estimate WHEN status = 'long' THEN '觀察中' WHEN status = 'unparsed' THEN '無法解析' WHEN status IS NULL THEN '尚未更新' ELSE '—' END AS estimate_shown FROM t""")
def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = times.time_columns(F.col("back"), F.col("estimate"), F.col("status"), "Asia/Taipei")
    return stored_times(spark, sf_dir).select("o_orderkey", shown.alias("x")).select("o_orderkey", F.col("x.back").alias("back_shown"), F.col("x.estimate").alias("estimate_shown"))


@query(f"""WITH s AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN moment END AS moment) FROM ({STORED}))
SELECT o_orderkey, CASE WHEN moment IS NOT NULL THEN strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') WHEN status = 'unparsed' THEN '無法解析' WHEN status = 'pending' THEN '尚未更新' ELSE '—' END AS back_shown,
  CASE WHEN moment IS NOT NULL THEN '—' WHEN estimate IS NOT NULL THEN estimate WHEN status = 'long' THEN '觀察中' WHEN status = 'unparsed' THEN '無法解析' WHEN status = 'pending' THEN '尚未更新' ELSE '—' END AS estimate_shown FROM s""")
def listed_time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 5 == 0, F.col("moment"))
    shown = times.listed_time_columns(at, F.col("estimate"), F.col("status"))
    return stored_times(spark, sf_dir).select("o_orderkey", shown.alias("x")).select("o_orderkey", F.col("x.back").alias("back_shown"), F.col("x.estimate").alias("estimate_shown"))


@query(f"""WITH s AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN moment END AS moment) FROM ({STORED})), a AS (SELECT o_orderkey, coalesce(epoch_us(moment), epoch_us(CAST(estimate AS TIMESTAMP) + INTERVAL 12 HOUR)) AS axis FROM s)
SELECT row_no, o_orderkey, axis FROM (SELECT *, CAST(row_number() OVER (ORDER BY axis IS NULL, axis DESC, o_orderkey) AS INT) AS row_no FROM a) WHERE row_no BETWEEN 11 AND 20""")
def browser_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page by time: calculated back, else noon of the estimated date."""
    axis = times.posted_axis(F.when(F.col("o_orderkey") % 5 == 0, F.col("moment")), F.col("estimate").cast("date"))
    rows = stored_times(spark, sf_dir).select("o_orderkey", axis.alias("axis"))
    return lists.page_of(rows, [F.col("axis").isNull(), F.desc("axis"), F.col("o_orderkey")], 2, 10).select("row_no", "o_orderkey", "axis")


@query(f"WITH s AS ({STORED}), p AS (SELECT o_orderkey, coalesce(estimate, back) AS posted, moment FROM s) SELECT o_orderkey, posted, CASE WHEN posted IS NULL OR posted = 'not a time' THEN NULL WHEN length(posted) = 10 THEN CAST(epoch(CAST(posted AS TIMESTAMP)) AS DOUBLE) ELSE CAST(epoch(moment) AS DOUBLE) END AS seconds FROM p")
def posted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_times(spark, sf_dir).withColumn("posted", times.posted(F.col("estimate"), F.col("back")))
    return rows.select("o_orderkey", "posted", times.epoch_seconds(F.col("posted")).alias("seconds"))


NAMES = "WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE lower(s_name) END || CASE WHEN s_suppkey % 3 = 0 THEN 'É' ELSE 'é' END AS name FROM supplier)"


@query(f"{NAMES} SELECT s_suppkey, CAST(row_number() OVER (ORDER BY translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), s_suppkey) AS INT) AS row_no FROM n QUALIFY row_no <= 20")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first names, A-Z folded and no other letter."""
    key = F.col("s_suppkey")
    name = F.concat(F.when(key % 2 == 0, F.upper("s_name")).otherwise(F.lower("s_name")), F.when(key % 3 == 0, "É").otherwise("é"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return lists.page_of(rows, [lists.nocase(F.col("name")), F.col("s_suppkey")], 1, 20).select("s_suppkey", "row_no")


@query("SELECT o_custkey, count(*) AS total, CAST(least(2, greatest(1, ceil(count(*) / 10.0)) - 1) AS INT) AS page FROM orders GROUP BY o_custkey")
def page_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")).withColumn("page", lists.clamped_page(F.col("total"), F.lit(2), 10))


#: Reviews as a list has them: some names stand for nobody, some are written in other ways.
NAMED = f"""{R}, named AS (SELECT *, CASE review_id % 23 WHEN 0 THEN '匿名評論者' WHEN 1 THEN ' Anonymous ' WHEN 2 THEN '' WHEN 3 THEN upper(author) ELSE author END AS said FROM reviews_v),
k AS (SELECT *, lower(trim(said)) AS name FROM named WHERE lower(trim(said)) NOT IN ('', 'anonymous', '匿名評論者')), g AS (SELECT name FROM k GROUP BY name HAVING count(DISTINCT shop_key) >= 2)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("review_id") % 23
    said = F.when(n == 0, "匿名評論者").when(n == 1, " Anonymous ").when(n == 2, "").when(n == 3, F.upper("author")).otherwise(F.col("author"))
    return reviews(spark, sf_dir).withColumn("author", said)


@query(f"{NAMED} SELECT name, review_id, CAST(row_number() OVER (PARTITION BY name ORDER BY first_seen_seq DESC) AS INT) AS place FROM k WHERE name IN (SELECT name FROM g)")
def same_name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews under each name that several shops have, newest first."""
    rows = named(spark, sf_dir)
    return lists.same_name_members(rows, lists.same_names(rows)).select("name", "review_id", "place")


@query(f"{NAMED}, c AS (SELECT min(said) AS author, count(DISTINCT shop_key) AS shop_count, count(*) AS review_count FROM k WHERE name IN (SELECT name FROM g) GROUP BY name) SELECT author, shop_count, review_count FROM c ORDER BY shop_count DESC, review_count DESC, author DESC LIMIT 10")
def same_name_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.same_names(named(spark, sf_dir)).orderBy(*lists.same_name_order()).limit(10).select("author", "shop_count", "review_count")


@query(f"{R}, f AS (SELECT review_id, first_seen_seq FROM reviews_v WHERE contains(lower(shop_key || ' ' || author || ' ' || text), 'src1') AND contains(lower(shop_key || ' ' || author || ' ' || text), 'user')), s AS (SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'src1') AND contains(lower(s_name), 'user')) SELECT review_id, (SELECT count(*) FROM f) + (SELECT count(*) FROM s) AS total FROM (SELECT * FROM f ORDER BY first_seen_seq DESC LIMIT 100)")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 reviews that hold all words in shop, author or text, and how many rows were found in all."""
    shops = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    shown, total = lists.search_all({"shops": (shops, ["s_name"], [F.col("s_suppkey")], None), "reviews": (reviews(spark, sf_dir), ["shop_key", "author", "text"], [F.desc("first_seen_seq")], 100)}, "ＳＲＣ1　user")
    return shown["reviews"].select("review_id").crossJoin(F.broadcast(total))  # one row


@query("SELECT CAST(NULL AS BIGINT) AS review_id WHERE false")
def blank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.matching(reviews(spark, sf_dir), "text", " 　 ").select("review_id")


@query(f"{R} SELECT first_seen_seq, first_seen_seq || ' | ' || shop_key || ' | ' || coalesce(CAST(stars AS VARCHAR), 'None') || '★ | ' || author || ' | ' || left(text, 80) AS line FROM reviews_v ORDER BY first_seen_seq DESC LIMIT 15")
def recent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.recent(reviews(spark, sf_dir).withColumn("shop_name", F.col("shop_key")), 15)


@query("SELECT DISTINCT o_custkey AS c_custkey, c_name, o_custkey % 3 <> 0 AND c_name IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    return ingest.lookup(stored, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name", "known")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)")
def cascaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of deleted parents go with them."""
    gone = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select("o_orderkey")
    return ingest.cascaded({"lines": (table(spark, sf_dir, "lineitem"), ["l_orderkey"])}, gone)["lines"].select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS event_id, l_linenumber AS part_no, CASE WHEN bool_or(l_returnflag = 'R') THEN 'sent' ELSE 'pending' END AS status FROM lineitem GROUP BY ALL")
def sent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that went out are marked, the others wait on."""
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("part_no"), F.lit("pending").alias("status")).distinct()
    sent = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("part_no"))
    return outbox.after_delivery(parts, sent)


@query("""WITH s AS (SELECT user_id AS shop, event_id AS scan, event_type <> 'error' AS ok, event_id % 10 = 0 AS baseline FROM events), i AS (SELECT *, coalesce(max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY shop ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS initialized, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY shop ORDER BY scan) AS island FROM s)
SELECT shop, scan, initialized, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY shop, island ORDER BY scan) AS BIGINT) AS failures, initialized AND NOT baseline AS notify FROM i""")
def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a shop's events count at each scan: not before its first success, and not in baseline scans."""
    scans = table(spark, sf_dir, "events").select(F.col("user_id").alias("shop"), F.col("event_id").alias("scan"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 10 == 0).alias("baseline"))
    return ingest.scan_states(scans, "shop", "scan", "ok", "baseline").select("shop", "scan", "initialized", "failures", "notify")


@query("SELECT user_id, arg_max(event_id, (event_type = 'view', event_id)) AS shown FROM events GROUP BY user_id")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run to show: one that is running, else the latest."""
    running = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(running, "event_id")).alias("shown"))


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews to notify of; each optional line is there for some."""
    key = F.col("o_orderkey")
    review = F.struct(
        F.concat(F.lit("shop"), F.col("o_custkey").cast("string")).alias("shop_name"), F.lit("https://s").alias("shop_url"), F.lit("A").alias("author"), F.when(key % 3 > 0, (key % 10) / 2).alias("stars"),
        F.when(key % 4 > 0, "2 週前").alias("time_text"), F.when(key % 5 > 0, F.col("o_orderpriority")).otherwise("").alias("text"),
        F.struct(F.when(key % 2 == 0, "https://p").otherwise("").alias("url"), (key % 7 == 0).alias("local_guide"), F.when(key % 3 == 0, key.cast("int")).alias("review_count"), F.lit(None).cast("int").alias("photo_count")).alias("profile"),
        F.when(key % 6 == 0, F.struct(F.lit("thanks").alias("text"), F.lit("").alias("time_text"))).alias("owner_reply"), F.array_repeat(F.lit("x"), (key % 13).cast("int")).alias("photo_paths"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", review.alias("review"), F.when(key % 2 == 0, "2026-07-19 14:23:35 CST").alias("back"))


@query("""SELECT o_orderkey, sha256(concat_ws(chr(10), CASE o_orderkey % 4 WHEN 0 THEN '🆕 新評論' WHEN 1 THEN '✏️ 評論已更新' WHEN 2 THEN '💬 店家回覆新增／已更新' ELSE '🗑️ 店家回覆已移除' END, '店家：shop' || o_custkey, '評論者：A',
  '星等：' || CASE WHEN o_orderkey % 3 = 0 THEN '未知' ELSE (o_orderkey % 10) // 2 || CASE WHEN o_orderkey % 2 = 1 THEN '.5' ELSE '' END || ' / 5' END, 'Google 顯示時間：' || CASE WHEN o_orderkey % 4 > 0 THEN '2 週前' ELSE '未提供' END, '首次偵測：now',
  CASE WHEN o_orderkey % 2 = 0 THEN '回推發文時間：2026-07-19 14:23:35 CST' END, '', '評論內容：', CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '（無文字評論）' END,
  CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || '店家回覆（時間未提供）：' || chr(10) || 'thanks' END,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN chr(10) || '評論者摘要：' || concat_ws('、', CASE WHEN o_orderkey % 7 = 0 THEN 'Local Guide' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || ' 則評論' END) END,
  CASE WHEN o_orderkey % 2 = 0 THEN '評論者頁面：https://p' END, '店家連結：https://s', '照片：' || o_orderkey % 13 || ' 張')) AS message_sha256, 1 + CAST(ceil((o_orderkey % 13) / 10.0) AS INT) AS n_parts FROM orders""")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered messages and the number of their parts."""
    event = pick(F.col("o_orderkey"), tuple(text.TITLES))
    rows = message_rows(spark, sf_dir).withColumn("message", text.review_message(event, F.col("review"), F.lit("now"), F.col("back")))
    pieces = rows.select("o_orderkey", "message", F.size(text.split_text(F.col("message"))).alias("n"), F.size(text.batches(F.col("review.photo_paths"), 10)).alias("albums"))
    return pieces.select("o_orderkey", F.sha2("message", 256).alias("message_sha256"), (F.col("n") + F.col("albums")).alias("n_parts"))


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN '未提供星等' ELSE repeat('★', p_size % 6) END AS marks, CAST(p_size AS VARCHAR) || '%' AS percent FROM part")
def star_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.star_marks((F.col("p_size") % 6).cast("double")).alias("marks"), text.percent_text(F.col("p_size") / 100).alias("percent"))


@query("SELECT p_partkey, p_name AS name, replace(replace(p_name, 'a', ''), 'n', '') AS rest FROM part")
def phrases_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate of names, and phrases one after another."""
    name = F.concat(F.lit("鬆肌LAY 運動筋膜放鬆 "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "（預約制） ").otherwise("(預約制)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.short_shop_name(name).alias("name"), text.without_phrases(F.col("p_name"), ["a", "n"]).alias("rest"))


@query("SELECT p_partkey, '/media/' || replace(url_encode('shop/' || p_name || '*~' || CASE WHEN p_partkey % 2 = 0 THEN 'é' ELSE '+&' END), '%2F', '/') AS url, p_partkey % 3 = 0 AS local FROM part")
def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(F.lit("shop\\"), F.col("p_name"), F.lit("*~"), F.when(key % 2 == 0, "é").otherwise("+&"))
    video = F.when(key % 3 == 0, "videos/a.mp4").when(key % 3 == 1, "http://v/a").otherwise("https://v/a")
    return table(spark, sf_dir, "part").select("p_partkey", text.media_url(path).alias("url"), text.local_video(video).alias("local"))


@query("SELECT event_id, 'POST /bot[REDACTED]/send ' || event_type AS line FROM events")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.concat((F.col("event_id") + 1_000_000).cast("string"), F.lit(":AAE-abc_defGHIJKLmnop1234567890"))
    return table(spark, sf_dir, "events").select("event_id", text.redacted(F.concat(F.lit("POST /bot"), secret, F.lit("/send "), F.col("event_type"))).alias("line"))


@query(f"{R} SELECT count(*) AS contents FROM (SELECT DISTINCT author, stars, text FROM reviews_v)")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are as many hashes as different contents."""
    return reviews(spark, sf_dir).agg(F.count_distinct(hashing.content_hash(F.col("author"), F.col("stars"), F.col("text"))).alias("contents"))


@query(f"{R} SELECT review_id, CASE WHEN profile_url = '' THEN '' ELSE sha256(profile_url) END AS reply_hash, 'fallback-' || left(sha256(shop_key || chr(0) || author), 24) AS fallback FROM reviews_v")
def reply_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = hashing.reply_hash(F.nullif(F.col("profile_url"), F.lit("")))
    return reviews(spark, sf_dir).select("review_id", reply.alias("reply_hash"), hashing.fallback_id(F.col("shop_key"), F.col("author")).alias("fallback"))
