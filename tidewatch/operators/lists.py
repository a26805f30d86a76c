"""Lists and pages: numbering, searching, grouping by name, views and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import search_key

#: Names that stand for nobody.
ANONYMOUS = ("", "anonymous", "匿名評論者")
#: Labels that each view of a shop's reviews shows.
VIEWS = {"all": None, "similar": ("highly_similar", "suspected"), "suspected": ("suspected",)}
SCOPES, DIRECTIONS, SORTS = ("same", "cross"), ("all", "positive", "negative", "mixed"), ("count", "similarity", "latest")


def one_of(value: str, allowed, what: str) -> str:
    """A parameter's value, if it is one of those allowed."""
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def from_one(page: int) -> int:
    if page < 1:
        raise ValueError("pages count from 1")
    return page


def pages(df: DataFrame, keys: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of one page of each key's list, with `row_no` from 1 and `has_next`."""
    from_one(page)
    w = Window.partitionBy(*keys).orderBy(*order)
    near = df.withColumn("row_no", F.row_number().over(w)).filter((F.col("row_no") > (page - 1) * size) & (F.col("row_no") <= page * size + 1))
    last = Window.partitionBy(*keys)
    return near.withColumn("has_next", F.max("row_no").over(last) > page * size).filter(F.col("row_no") <= page * size)


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the whole list, with `row_no` and `has_next`: a top-k of page * size + 1 rows, of which only the last ones are numbered."""
    rows = df.orderBy(*order).limit(from_one(page) * size + 1)
    numbered = rows.withColumn("row_no", F.row_number().over(Window.orderBy(*order))).filter(F.col("row_no") > (page - 1) * size)
    return numbered.withColumn("has_next", F.max("row_no").over(Window.partitionBy()) > page * size).filter(F.col("row_no") <= page * size)


def clamped_page(total: Column, page: Column, size: int) -> Column:
    """The page that is shown: `page` (from 0), but no later than the last one."""
    return F.least(page, F.greatest(F.lit(1), F.ceil(total / size).cast("int")) - 1)


def nocase(text: Column) -> Column:
    """A sort key that folds A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query_words(session, words: str) -> list[str]:
    """The words of a query, folded; at most 100 characters of it count."""
    return session.range(1).select(search_key(F.lit(words.strip()[:100])).alias("k")).first().k.split()


def matching(df: DataFrame, hay: str | list[str], words: str) -> DataFrame:
    """Rows whose texts hold every word, whatever its case or width. A query without words finds nothing."""
    found = query_words(df.sparkSession, words)
    if not found:
        return df.filter(F.lit(False))
    hay = [hay] if isinstance(hay, str) else hay
    folded = search_key(F.array_join(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in hay)), " "))
    out = df.withColumn("__hay", folded)
    for word in found:
        out = out.filter(F.contains("__hay", F.lit(word)))
    return out.drop("__hay")


def search_all(tables: dict[str, tuple[DataFrame, list[str], list[Column], int | None]], words: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What each table (rows, fields searched, order, most rows shown) has for a query, and `total`: the number found, also beyond what is shown."""
    shown, counts = {}, None
    for name, (rows, fields, order, most) in tables.items():
        found = matching(rows, fields, words)
        shown[name] = found.orderBy(*order) if most is None else found.orderBy(*order).limit(most)
        n = found.agg(F.count("*").alias("total"))
        counts = n if counts is None else counts.union(n)
    return shown, counts.agg(F.sum("total").alias("total"))


def name_key(author: Column) -> Column:
    return search_key(author)


def same_names(reviews: DataFrame, least_shops: int = 2) -> DataFrame:
    """Names seen in several shops, and what their profiles say about identity; the order is that of same_name_order()."""
    rows = reviews.withColumn("name", name_key(F.col("author"))).filter(~F.col("name").isin(*ANONYMOUS))
    url = F.nullif(F.trim("profile_url"), F.lit(""))
    groups = rows.groupBy("name").agg(
        F.min("author").alias("author"), F.count_distinct("shop_key").alias("shop_count"), F.count("*").alias("review_count"),
        F.count_distinct(url).alias("profile_count"), F.count_if(url.isNull()).alias("missing_profiles"),
    ).filter(F.col("shop_count") >= least_shops)
    status = F.when(F.col("profile_count") > 1, "different_profiles").when((F.col("profile_count") == 1) & (F.col("missing_profiles") == 0), "same_profile").otherwise("insufficient")
    return groups.withColumn("identity_status", status)


def same_name_order() -> list[Column]:
    return [F.desc("shop_count"), F.desc("review_count"), F.desc("author")]


def same_name_members(reviews: DataFrame, groups: DataFrame, newest: str = "first_seen_seq") -> DataFrame:
    """The reviews of each name, with `place` from 1, newest first; rows and no nested list, as a name may have any number."""
    rows = reviews.withColumn("name", name_key(F.col("author"))).join(groups.select("name"), "name", "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc_nulls_last(newest))))


def viewed(reviews: DataFrame, view: str, label: str = "label") -> DataFrame:
    """The reviews that a view shows by their label."""
    labels = VIEWS[one_of(view, VIEWS, "view")]
    return reviews if labels is None else reviews.filter(F.col(label).isin(*labels))


def group_order(sort: str = "count") -> list[Column]:
    """The order of groups; ties as in the default order, then by id."""
    first = {
        "count": [F.desc("review_count"), F.desc("max_semantic")],
        "similarity": [F.greatest("max_lexical", "max_semantic").desc(), F.desc("review_count")],
        "latest": [F.desc_nulls_last("latest_day"), F.desc("review_count")],
    }[one_of(sort, SORTS, "sort")]
    return [*first, F.desc("review_count"), F.desc("max_semantic"), F.desc_nulls_last("latest_day"), F.col("group_id")]


def filtered_groups(groups: DataFrame, scope: str | None = None, direction: str = "all", shop: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """Groups that aren't excluded, of one scope, direction, and with a member of one shop."""
    out = groups.filter("excluded_reason is null")
    if scope is not None:
        out = out.filter(F.col("scope") == one_of(scope, SCOPES, "scope"))
    if one_of(direction, DIRECTIONS, "direction") != "all":
        out = out.filter(F.col("direction") == direction)
    if shop is not None:
        out = out.join(members.filter(F.col("shop_key") == shop).select("group_id").distinct(), "group_id", "left_semi")
    return out


def recent(reviews: DataFrame, limit: int, newest: str = "first_seen_seq") -> DataFrame:
    """The newest reviews as lines, texts cut to 80 characters."""
    stars = F.coalesce(F.col("stars").cast("string"), F.lit("None"))
    line = F.array_join(F.array(F.col(newest).cast("string"), F.coalesce("shop_name", F.lit("")), F.concat(stars, F.lit("★")), F.coalesce("author", F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(80))), " | ")
    return reviews.orderBy(F.desc_nulls_last(newest)).limit(limit).select(F.col(newest), line.alias("line"))


def boxed(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a box of text, for a terminal."""
    return df._jdf.showString(rows, 0, False)
