import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text, times, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True))) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_normalized(spark):
    assert one(spark, text.normalized(F.col("t")), t="服務 很好！會再來。") == one(spark, text.normalized(F.col("t")), t="服務很好，會再來")
    assert one(spark, text.normalized(F.col("t")), t="ＡＢ－c ﬁn_é") == "abcfin_é"
    assert one(spark, text.search_key(F.col("t")), t="  Straße　 Ａ ") == "strasse a"


@pytest.mark.parametrize(
    "said, value, unit, kind",
    [("17 分鐘前", 17, "minute", "short"), ("2 週前", 2, "week", "long"), ("3 個月前", 3, "month", "long"), ("1年前", 1, "year", "long"), ("17分前", 17, "minute", "short"), ("2 weeks ago", 2, "week", "long"),
     ("昨天", 1, "day", "short"), ("an hour ago", 1, "hour", "short"), ("just now", 0, "second", "short"), ("無日期", None, None, "unparsed"), ("9 days ago", 9, "day", "unparsed")],
)
def test_relative_time(spark, said, value, unit, kind):
    assert tuple(one(spark, times.parsed(F.col("t")), t=said)) == (value, unit, kind)


def test_dates(spark):
    at = F.expr("TIMESTAMP_NTZ'2026-07-19 06:40:35'")
    age = F.struct(F.lit(17).alias("value"), F.lit("minute").alias("unit"), F.lit("short").alias("kind"))
    assert one(spark, times.shown(times.calculated_back(at, age), "Asia/Taipei")) == "2026-07-19 14:23:35"
    week = F.struct(F.lit(3).alias("value"), F.lit("week").alias("unit"))
    between = (F.expr("TIMESTAMP_NTZ'2026-07-20 03:00:00'"), F.expr("TIMESTAMP_NTZ'2026-07-20 04:00:00'"))
    assert one(spark, times.estimated(*between, week, "Asia/Taipei")) == dt.date(2026, 6, 29)
    month = F.struct(F.lit(1).alias("value"), F.lit("month").alias("unit"))
    end = F.expr("TIMESTAMP_NTZ'2026-03-31 03:00:00'")
    assert one(spark, times.estimated(end, end, month, "Asia/Taipei")) == dt.date(2026, 2, 28)
    assert [one(spark, times.retry_seconds(F.lit(n))) for n in (0, 1, 6, 7, 50)] == [30, 60, 1920, 3600, 3600]


def test_labels(spark):
    assert [one(spark, text.star_label(F.col("t")), t=x) for x in ("5 顆星", "Rated 4.5 stars", "3,5", "")] == [5.0, 4.5, 3.5, None]
    label = "Local Guide · 1,123 reviews · 45 photos"
    assert one(spark, text.count_label(F.col("t"), "reviews?"), t=label) == 1123
    assert one(spark, text.count_label(F.col("t"), "photos?"), t="photos 7") == 7
    assert one(spark, text.with_locale(F.col("t"), "en"), t="https://x/y?a=1&hl=de#f") == "https://x/y?a=1&hl=en#f"
    assert one(spark, text.stars_text(F.lit(5.0))) == "5" and one(spark, text.stars_text(F.lit(4.5))) == "4.5"


def test_chunks_and_batches(spark):
    parts = text.chunks_of("x" * 9000, 1000)
    assert len(parts) == 9 and "".join(p.split("\n", 1)[1] for p in parts) == "x" * 9000
    assert text.chunks_of("short", 1000) == ["short"]
    assert text.chunks_of("a" * 700 + "\n" + "b" * 600, 1000)[0].endswith("a" * 700)
    assert one(spark, F.transform(text.batches(F.sequence(F.lit(1), F.lit(12)), 10), F.size)) == [10, 2]
    assert one(spark, text.batches(F.array(), 10)) == []


def test_hashes(spark):
    assert one(spark, hashing.shop_key(F.lit("u"))) == "0bfe935e70c321c7"
    a = hashing.content_hash(F.lit("x"), F.lit(None).cast("double"), F.lit("t"))
    assert one(spark, a) != one(spark, hashing.content_hash(F.lit("x"), F.lit(0.0), F.lit("t")))
    assert one(spark, hashing.fingerprint(F.array(F.lit("b:1"), F.lit("a:2")))) == one(spark, hashing.fingerprint(F.array(F.lit("a:2"), F.lit("b:1"))))


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.unit(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.cosine(vectors.unit(v), vectors.unit(v))) == pytest.approx(1.0)
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]
