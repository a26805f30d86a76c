"""Queries of the pages: shops, search, same names, the review list, export, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text
from tidewatch.operators import lists
from tidewatch.plans.registry import query
from tidewatch.plans.views import REVIEWS, reviews, table

R = f"WITH reviews_v AS ({REVIEWS})"


@query("SELECT c_custkey AS shop_key, count(o_orderkey) AS reviews, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, CASE WHEN max(o_orderdate) IS NULL THEN 'pending' WHEN c_acctbal < 0 THEN 'failure' ELSE 'success' END AS last_result FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def shop_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shop, also those without reviews; reviews are summed before the join."""
    each = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("shop_key")).agg(F.count("*").alias("reviews"), F.max("o_orderdate").alias("last"))
    shops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shop_key"), "c_acctbal")
    result = F.when(F.col("last").isNull(), "pending").when(F.col("c_acctbal") < 0, "failure").otherwise("success")
    return shops.join(each, "shop_key", "left").select("shop_key", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), result.alias("last_result"))


PAGE = f"{R}, p AS (SELECT shop_key, review_id, stars, row_number() OVER (PARTITION BY shop_key ORDER BY first_seen_seq DESC) AS row_no FROM reviews_v)"


@query(f"{PAGE}, c AS (SELECT shop_key, count(*) AS n FROM p GROUP BY shop_key) SELECT shop_key, review_id, stars, n > 40 AS has_next FROM p JOIN c USING (shop_key) WHERE row_no > 20 AND row_no <= 40")
def shop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shop's second page of 20 reviews, newest first."""
    return lists.pages(reviews(spark, sf_dir), ["shop_key"], [F.desc("first_seen_seq")], 2, 20).select("shop_key", "review_id", "stars", "has_next")


@query("SELECT 'shop' AS kind, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || ' ' || n_name), 'supplier') AND contains(lower(s_name || ' ' || n_name), 'a') UNION ALL SELECT 'review', doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'a')")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shop and review that holds all words of a query; the haystack is folded once a row."""
    shops = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    words = "The  A"
    found = lists.matching(shops.select(F.lit("shop").alias("kind"), F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", "n_name").alias("hay")), "hay", "supplier a")
    return found.unionByName(lists.matching(table(spark, sf_dir, "documents").select(F.lit("review").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("hay")), "hay", words)).select("kind", "id")


@query(f"""{R} SELECT author, count(DISTINCT shop_key) AS shop_count, count(*) AS review_count, count(DISTINCT CASE WHEN profile_url <> '' THEN profile_url END) AS profile_count, count_if(profile_url = '') AS missing_profiles,
  CASE WHEN count(DISTINCT CASE WHEN profile_url <> '' THEN profile_url END) > 1 THEN 'different_profiles' WHEN count(DISTINCT CASE WHEN profile_url <> '' THEN profile_url END) = 1 AND count_if(profile_url = '') = 0 THEN 'same_profile' ELSE 'insufficient' END AS identity_status
  FROM reviews_v GROUP BY author HAVING count(DISTINCT shop_key) >= 2""")
def same_name_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.same_names(reviews(spark, sf_dir)).drop("name")


@query(f"""{R}, p AS (SELECT row_number() OVER (ORDER BY posted_day IS NULL, posted_day DESC, first_seen_seq DESC) AS row_no, review_id,
  CASE WHEN length(author) > 5 THEN left(author, 5) || '…' ELSE author END AS author, coalesce(regexp_replace(CAST(stars AS VARCHAR), '\\.0$', ''), 'unknown') AS stars,
  CASE WHEN length(t) > 24 THEN left(t, 24) || '……' ELSE t END AS summary FROM (SELECT *, coalesce(nullif(trim(translate(text, chr(13) || chr(10), '  ')), ''), '(none)') AS t FROM reviews_v)) SELECT * FROM p WHERE row_no <= 10""")
def browser_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten reviews by date, numbered. A top-k: each task keeps ten rows, and only those are numbered."""
    order = [F.col("posted_day").isNull(), F.desc("posted_day"), F.desc("first_seen_seq")]
    page = reviews(spark, sf_dir).orderBy(*order).limit(10)
    return page.select(
        F.row_number().over(Window.orderBy(*order)).alias("row_no"), "review_id", text.clipped(F.col("author"), 5, "…").alias("author"), text.stars_text(F.col("stars")).alias("stars"),
        text.clipped(text.one_line(F.col("text"), "(none)"), 24, "……").alias("summary"),
    )


@query(f"{R} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 10.0) AS INT)) AS pages FROM reviews_v WHERE shop_key = 'src3' AND (author ILIKE '%user1%' OR text ILIKE '%the%')")
def browser_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = (F.col("shop_key") == "src3") & (F.col("author").ilike("%user1%") | F.col("text").ilike("%the%"))
    return reviews(spark, sf_dir).filter(keyword).agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 10).cast("int")))


@query(f"{R} SELECT shop_key, review_id, author, coalesce(CAST(stars AS VARCHAR), '') AS stars, sha256(text) AS text_sha256, '[\"' || profile_url || '\"]' AS photo_urls FROM reviews_v")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened; arrays as JSON."""
    nested = reviews(spark, sf_dir).select("shop_key", "review_id", "author", "stars", "text", F.struct(F.array("profile_url").alias("photos")).alias("profile"))
    return nested.select("shop_key", "review_id", "author", F.coalesce(F.col("stars").cast("string"), F.lit("")).alias("stars"), F.sha2("text", 256).alias("text_sha256"), F.to_json("profile.photos").alias("photo_urls"))


@query("SELECT page_id, left(sha256(url), 16) AS shop_key FROM pages")
def shop_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hashing.shop_key(F.col("url")).alias("shop_key"))


@query("""WITH u AS (SELECT page_id, url, split_part(url, '#', 1) AS b, CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS f FROM pages)
SELECT page_id, b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'hl=en' || f AS url FROM u""")
def with_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.with_locale(F.col("url"), "en").alias("url"))


@query("SELECT p_partkey, CAST(p_size % 6 AS DOUBLE) + 0.5 * (p_size % 2) * CASE WHEN p_size % 6 < 5 THEN 1 ELSE 0 END AS stars, 1000 + p_size AS reviews, p_size AS photos FROM part")
def review_labels_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star and count labels as a page shows them, read back."""
    n = F.col("p_size")
    half = ((n % 2) * F.when(n % 6 < 5, 1).otherwise(0)) == 1
    stars = F.concat(F.lit("Rated "), (n % 6).cast("string"), F.when(half, F.lit(",5")).otherwise(F.lit("")), F.lit(" stars"))
    counts = F.concat(F.lit("Local Guide · "), F.format_number(n + 1000, 0), F.lit(" reviews · "), n.cast("string"), F.lit(" photos"))
    rows = table(spark, sf_dir, "part").select("p_partkey", stars.alias("s"), counts.alias("c"))
    return rows.select("p_partkey", text.star_label(F.col("s")).alias("stars"), text.count_label(F.col("c"), "reviews?").alias("reviews"), text.count_label(F.col("c"), "photos?").alias("photos"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS asset, coalesce(c_name, 'unknown') AS shop_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_name")
def latest_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("asset"))
    shops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return newest.join(shops, "o_custkey", "left").select("o_custkey", "asset", F.coalesce("c_name", F.lit("unknown")).alias("shop_name"))
