"""Near-duplicate reviews: eligible texts, similar pairs, admission, groups, evidence, labels."""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.functions.hashing import fingerprints
from tidewatch.functions.text import HAN, normalized, without_phrases
from tidewatch.functions.vectors import unit
from tidewatch.operators.alike import HELD, PAIRS, alike, blocks_of, each_alike, meetings, ordered, unblocked, with_bigrams
from tidewatch.operators.components import connected_components
from tidewatch.operators.ratios import Texts, near, ratios
from tidewatch.plans.storage import released, stored

#: Rows of one block of a blocked self-join; of vectors, which meet in strips.
BLOCK, VECTORS = 1024, 4096
#: Bytes of a block of vectors.
VECTOR_BYTES = 8_400_000
#: Bytes and rows of a block of texts.
TEXT_BYTES, TEXT_ROWS = 4_000_000, 4096


def eligible(df: DataFrame, text: str = "text", counted: str = HAN, least: int = 12, copies: int = 3, excluded: Column | None = None, phrases: list[str] = ()) -> DataFrame:
    """`df` with normalized, text_key, n_counted, copies and eligible.

    A text takes part if it isn't excluded or empty and has `least` characters of the class
    `counted`, or occurs `copies` times among all rows, the excluded ones included. Normalised
    `phrases` are taken out first. The text is normalised once and stored; copies are counted by
    its hash with map-side sums, and only texts with several are joined back.
    """
    clean = without_phrases(normalized(F.col(text)), list(phrases))
    rows = stored(df.withColumn("normalized", clean).withColumns({"n_counted": F.regexp_count("normalized", F.lit(counted)), "text_key": F.sha2("normalized", 256)}), "normalized")
    counts = rows.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    rows = rows.join(counts, "text_key", "left").withColumn("copies", F.coalesce("copies", F.when(F.col("normalized").isNotNull(), 1)).cast("long"))
    out = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    return rows.withColumn("eligible", ~out & (F.col("normalized") != "") & ((F.col("n_counted") >= least) | (F.col("copies") >= copies)))


def blocked_self_join(df: DataFrame, size: Column | None, ratio: float, score, schema: str, block: int = BLOCK, split: list[str] = ()) -> DataFrame:
    """score(left, right or None) over pairs of blocks, each a task of bounded size; no pair of rows is made in the plan.

    With `size`, only rows whose sizes differ by less than `ratio` can match: blocks lie in
    bands of that width and meet their own and the next band. `split` columns must be equal.
    """
    band = F.lit(0) if size is None else F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -np.log(ratio)).cast("int")
    rows = df.withColumn("__band", band)
    counts = rows.groupBy(*split, "__band").agg(F.count("*").alias("__n"))
    parts = counts.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__n") / block)).cast("int")).drop("__n")
    own = parts.withColumnRenamed("__parts", "__own")
    near = parts.select(*split, (F.col("__band") + 1).alias("__band"), F.col("__parts").alias("__below"))
    above = parts.select(*split, (F.col("__band") - 1).alias("__band"), F.col("__parts").alias("__above"))
    keys = [*split, "__band"]
    rows = rows.join(own, keys).join(near, keys, "left").join(above, keys, "left")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*df.columns[:1]), F.col("__own")).cast("int"))

    def names(band: Column, n: Column) -> Column:
        whole = F.coalesce(n, F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: i < whole), lambda i: F.struct(band.alias("band"), i.alias("part")))

    here = F.struct(F.col("__band").alias("band"), F.col("__part").alias("part"))
    others = names(F.col("__band"), F.col("__own"))
    if size is not None:
        others = F.concat(names(F.col("__band") - 1, F.col("__below")), others, names(F.col("__band") + 1, F.col("__above")))
    rows = rows.withColumn("__other", F.explode(others)).withColumn("__here", here)
    rows = rows.withColumn("__low", F.least("__here", "__other")).withColumn("__high", F.greatest("__here", "__other")).withColumn("__first", F.col("__here") == F.col("__low"))
    columns, empty = df.columns, to_arrow_schema(T.DataType.fromDDL(schema)).empty_table()

    def meet(group: pa.Table) -> pa.Table:
        first = group.column("__first").to_numpy()
        left = group.filter(pa.array(first)).select(columns)
        same = group.column("__low")[0].as_py() == group.column("__high")[0].as_py()
        if not left.num_rows or not same and first.all():
            return empty
        return score(left, None if same else group.filter(pa.array(~first)).select(columns))

    return rows.groupBy(*split, "__low", "__high").applyInArrow(meet, schema)


def gram_counts(texts: list[str]) -> list[dict[str, int]]:
    out = []
    for t in texts:
        counts: dict[str, int] = {}
        for i in range(max(1, len(t) - 1)):
            g = t[i : i + 2]
            counts[g] = counts.get(g, 0) + 1
        out.append(counts)
    return out


def dice_pairs(df: DataFrame, threshold: float, scope: str | None = None, key: str = "review_id", text: str = "normalized", shop: str = "shop_key", digits: int | None = None) -> DataFrame:
    """(left_id, right_id, dice) of pairs whose bigram multisets have Dice >= threshold; left_id < right_id.

    scope: "same" shop, "cross" for different shops, None for both. Exact. Empty texts match nothing.
    Pairs are found as they are read and stored nowhere. `digits`: those of the rounded Dice.
    """
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("id"), F.col(shop).alias("shop"), F.col(text).alias("t"))
    rows = rows if scope is None else rows.filter("shop is not null")  # as in SQL, an unknown shop is neither the same nor another
    rows = stored(with_bigrams(rows, "t"), "texts")
    found = each_alike(rows, threshold, scope, digits)
    released(rows)
    return found


def dice_members(df: DataFrame, threshold: float, key: str = "review_id", text: str = "normalized") -> DataFrame:
    """(review_id, component): every text that dice_pairs() links to another, by component. Copies of a text link to the least of them; no pair is a row."""
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("id"), F.lit("").alias("shop"), F.sha2(text, 256).alias("digest"), F.col(text).alias("t"))
    rows = stored(with_bigrams(rows, "t"), "texts")
    near = alike(rows, threshold, forest=True, copies=["digest"]).select(F.col("node").alias("left_id"), F.col("root").alias("right_id"))
    found = members_of(near.unionByName(copy_links(rows.select("id", "digest"))))
    released(rows)
    return found


def cosine_pairs(df: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(left_id, right_id, cosine) of all pairs with cosine >= threshold, exactly; left_id < right_id.

    Blocks of vectors meet where they lie, and pairs are found as they are read. Products in
    single precision rule pairs out by more than their error, double precision decides.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), unit(F.col(vector)).alias("v"))
    kind, name = dict(rows.dtypes)["id"], uuid.uuid4().hex
    held = T.StructType([rows.schema["id"]]).add("n", "integer").add("v", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, np.float64).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([0] * len(packed), pa.int32()), pa.array(packed, pa.binary())], schema=to_arrow_schema(held))

    whole = stored(rows.mapInArrow(pack, held), "packed")  # ordered() reads its rows three times
    kept, chunks = ordered(whole, (), VECTOR_BYTES, VECTORS, ("v",))
    released(whole)
    blocks = blocks_of(kept, chunks)
    released(kept)
    schema = f"left_id {kind}, right_id {kind}, cosine double"
    arrow = to_arrow_schema(T.DataType.fromDDL(schema))

    def unpacked(rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = unblocked(rows)
        v = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(table.num_rows, -1)
        return np.array(table.column("id").to_pylist()), v, v.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l_chunk, l_rows, r_chunk, r_rows in zip(*batch.columns, strict=True):
                l_chunk, r_chunk = l_chunk.as_py(), r_chunk.as_py()
                if (name, l_chunk) not in HELD:
                    HELD.clear()
                    HELD[name, l_chunk] = unpacked(l_rows.as_py())
                a, x, x_single = HELD[name, l_chunk]
                b, y, y_single = (a, x, x_single) if l_chunk == r_chunk else unpacked(r_rows.as_py())
                error = 2e-7 * (x.shape[1] + 8)
                for at in range(0, len(x), 256):  # a strip of products at a time
                    i, j = np.nonzero(x_single[at : at + 256] @ y_single.T >= threshold - error)
                    if l_chunk == r_chunk:
                        i, j = i[i + at < j], j[i + at < j]
                    for k in range(0, len(i), 8192):
                        p, q = i[k : k + 8192] + at, j[k : k + 8192]
                        cosine = np.clip(np.einsum("ij,ij->i", x[p], y[q]), -1, 1)
                        hits = cosine >= threshold
                        p, q, cosine = a[p[hits]], b[q[hits]], cosine[hits]
                        if len(p):
                            yield pa.RecordBatch.from_arrays([pa.array(np.where(p < q, p, q), arrow[0].type), pa.array(np.where(p < q, q, p), arrow[1].type), pa.array(cosine)], schema=arrow)

    return meetings(blocks, chunks, lambda most: most, run, schema)


def dice_of(a: dict[str, int], b: dict[str, int]) -> float:
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return 2 * sum(min(n, many.get(g, 0)) for g, n in few.items()) / (sum(a.values()) + sum(b.values()))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of `a`."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = free = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & every
    return start + end + len(a) - free.bit_count()


def letters_bound(a: str, b: str) -> float:
    """What the ratio is at most: the letters that both have."""
    counts = Counter(a)
    shared = sum(min(n, counts.get(c, 0)) for c, n in Counter(b).items())
    return 2 * shared / (len(a) + len(b))


def lexical_scores(a: str, b: str, dice: float, least: float = 0.0) -> tuple[float, float]:
    """The greater of Dice and Ratcliff and Obershelp's ratio, for (a, b) and (b, a): the ratio depends on the order.

    The ratio is taken only where its bound by letters exceeds both Dice and what is below
    `least` anyhow.
    """
    if a == b:
        return 1.0, 1.0
    floor = max(dice, math.nextafter(least, 0))
    if not a or not b or letters_bound(a, b) <= floor:
        return dice, dice
    ab, ba = ratios(a, b, floor)
    return max(dice, ab), max(dice, ba)


def lexical_pairs(df: DataFrame, threshold: float, key: str = "text_id", text: str = "normalized", ratio: bool = True) -> DataFrame:
    """(left_id, right_id, forward, backward) of pairs of texts of which either lexical score is `threshold` or more; left_id < right_id.

    forward is lexical_scores(left, right)[0], backward that of (right, left). Exact: both scores
    are at most 2 * min / (n + m) of the lengths, which picks the blocks that meet; within them
    counts of letters and grams rule pairs out, see near(). Empty texts match nothing. The work
    is that of all pairs of like length, in tasks of bounded size, and pairs are found as they are
    read. `ratio`: False leaves Dice alone.
    """
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("id"), F.col(text).alias("t"), F.length(text).alias("n"))
    kind, name = dict(rows.dtypes)["id"], uuid.uuid4().hex
    schema = f"left_id {kind}, right_id {kind}, forward double, backward double"
    arrow = to_arrow_schema(T.DataType.fromDDL(schema))
    kept, chunks = ordered(rows, (), TEXT_BYTES, TEXT_ROWS, ("t",))
    blocks = blocks_of(kept, chunks)
    released(kept)

    def scores(a: str, b: str, dice: float) -> tuple[float, float]:
        """lexical_scores(); near() has compared the letters."""
        ab, ba = ratios(a, b, max(dice, math.nextafter(threshold, 0)))
        return max(dice, ab), max(dice, ba)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l_chunk, l_rows, r_chunk, r_rows in zip(*batch.columns, strict=True):
                l_chunk, r_chunk = l_chunk.as_py(), r_chunk.as_py()
                if (name, l_chunk) not in HELD:
                    HELD.clear()
                    HELD[name, l_chunk] = Texts(unblocked(l_rows.as_py()))
                left = HELD[name, l_chunk]
                pairs = near(left, left if l_chunk == r_chunk else Texts(unblocked(r_rows.as_py())), threshold, ratio, scores)
                while some := list(itertools.islice(pairs, PAIRS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return meetings(blocks, chunks, lambda most: most * (2 - threshold) / threshold + 1e-6, run, schema)


@F.pandas_udf(T.DoubleType())
def dice(left: pd.Series, right: pd.Series) -> pd.Series:
    """Dice of two texts' bigrams; 0 of an empty one."""
    return pd.Series([dice_of(*gram_counts([a, b])) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("forward", T.DoubleType()), T.StructField("backward", T.DoubleType())]))
def lexical(left: pd.Series, right: pd.Series, dice: pd.Series, least: pd.Series) -> pd.DataFrame:
    """lexical_scores() of two texts in both orders, their Dice known."""
    out = [lexical_scores(*x) for x in zip(left, right, dice, least, strict=True)]
    return pd.DataFrame(out, columns=["forward", "backward"], dtype=float)


def admitted(lexical: Column, semantic: Column, short: Column, equal: Column, copies: Column, least_copies: int = 3, lexical_at: float = 0.85, semantic_at: float = 0.92) -> Column:
    """Whether a pair links: short texts only as equal ones with enough copies in scope, others by either score."""
    return F.when(short, equal & (copies >= least_copies)).otherwise((F.coalesce(lexical, F.lit(0.0)) >= lexical_at) | (F.coalesce(semantic, F.lit(-1.0)) >= semantic_at))


def exact_links(df: DataFrame, key: str = "review_id", text: str = "normalized") -> DataFrame:
    """Links between texts that are equal: each to the least key of its copies, one row a copy."""
    return copy_links(df.filter(F.col(text) != "").select(F.col(key).alias("id"), F.sha2(text, 256).alias("digest")))


def copy_links(rows: DataFrame) -> DataFrame:
    """exact_links() of (id, digest)."""
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(least, "digest").filter("id <> least").select(F.col("least").alias("left_id"), F.col("id").alias("right_id"))


def members_of(links: DataFrame) -> DataFrame:
    """(review_id, component): every linked review, by component; the least number in it names it."""
    found = connected_components(links.select("left_id", "right_id"))
    return found.select(F.col("node").alias("review_id"), F.col("root").alias("component"))


def direction(stars: Column) -> Column:
    """Of a group's stars, nulls aside: positive if all >= 4, negative if all <= 2, else mixed."""
    return F.when(F.min(stars) >= 4, "positive").when(F.max(stars) <= 2, "negative").otherwise("mixed")


def group_rollup(members: DataFrame, group: str = "component") -> DataFrame:
    """One row a group of (group, review_id, shop_key, stars, posted_day)."""
    summed = members.groupBy(group).agg(
        F.count("*").alias("review_count"), F.count_distinct("shop_key").alias("shop_count"), F.max("posted_day").alias("latest_day"), direction(F.col("stars")).alias("direction")
    )
    return summed.join(fingerprints(members, group, member_name()), group)


def member_name() -> Column:
    return F.concat_ws(":", "shop_key", F.col("review_id").cast("string"))


def member_rollup(pairs: DataFrame, score: str) -> DataFrame:
    """The greatest score among each review's pairs."""
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("review_id"), score)
    return ends.groupBy("review_id").agg(F.max(score).alias(f"max_{score}"), F.count("*").alias("pair_count"))


def time_cluster(rows: DataFrame, group: str, day: str = "posted_day", posts: int = 3, days: int = 14) -> DataFrame:
    """(group, has_cluster): whether some `posts` dates lie within `days` days, ends included."""
    w = Window.partitionBy(group).orderBy(day)
    dated = rows.filter(F.col(day).isNotNull()).withColumn("gap", F.lead(day, posts - 1).over(w) - F.col(day))
    hits = dated.groupBy(group).agg(F.max(F.coalesce(F.col("gap") <= days, F.lit(False))).alias("hit"))
    return rows.select(group).distinct().join(hits, group, "left").select(group, F.coalesce("hit", F.lit(False)).alias("has_cluster"))


def repeated_profile(rows: DataFrame, group: str) -> DataFrame:
    """(group, repeats_profile): whether one profile url occurs in two shops or more."""
    each = rows.filter("profile_url <> ''").groupBy(group, "profile_url").agg(F.count_distinct("shop_key").alias("shops"))
    hits = each.groupBy(group).agg((F.max("shops") >= 2).alias("hit"))
    return rows.select(group).distinct().join(hits, group, "left").select(group, F.coalesce("hit", F.lit(False)).alias("repeats_profile"))


def cross_shop(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(((F.count("*") >= 3) & (F.count_distinct("shop_key") >= 2)).alias("crosses_shops"))


def evidence(cluster: Column, profile: Column, shops: Column) -> Column:
    """Texts of what was found, in fixed order."""
    found = F.array(F.when(cluster, "3 posts within 14 days"), F.when(profile, "same profile in several shops"), F.when(shops, "3 reviews across shops"))
    return F.filter(found, lambda x: x.isNotNull())


def review_label(same: Column, cross: Column) -> Column:
    """Label of a review in up to two groups: suspected wins, then the same-shop group's."""
    return F.when(cross == "suspected", cross).when(same == "suspected", same).otherwise(F.coalesce(same, cross, F.lit("")))


