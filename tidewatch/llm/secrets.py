"""Secret scans: fixed patterns, and a battery of randomness tests; DataFrame functions only.

A candidate is a run of 20 or more characters of [A-Za-z0-9+/_=-]. Its encoding is inferred
(digits, hexadecimal, base 32, base 64, ...), which gives its alphabet of k symbols. Where
signs cut a piece of 20 or more characters out of the run (key=..., sk_live_...), the longest
one is judged in its place. Two hypotheses are tested:

* random data: chi-squared against equal use of the alphabet, runs above and below its
  middle, and lag-1 serial correlation of the symbols' places. A run that fails one of them
  (p < VETO) is orderly.
* prose, names and numbers as people write them: a chain of letter pairs and of changes
  between lower case, capitals, digits and signs, with likelihood P. Uniform symbols have
  likelihood k^-n; under the chain, P * k^n is as small as r with a chance of r at most
  (Markov's inequality), so it is the p-value. It falls with every pair that prose
  avoids, in small alphabets too.

Benjamini and Hochberg's step-up at rate RATE is applied over all candidates of the corpus
within each band of length. P-values are rounded up to a grid, so that the step-up needs
counts by (band, grid point) only: at most 5 * 1024 rows, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by the pattern that infers them, first match wins.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "-_+/="),
)
#: Costs of a letter after another in quarters of a nat (a = 0), rows and columns from a to z, rounded down:
#: prose in four languages and the words of program source in equal parts, and 0.1 of equal use.
PAIRS = """
qomnptrslvskogqpvkjhlrstsv ksorfuvvnpveuuksvppslvvvlv lvrtluvehwnntvitvptlpvvvtw lqsoesuoivvnuoiuvpmnnvrvsw ksnknqssnvunphqprgimrrsott jqrsjlrqivtnurfsviokntuvst
jpruetqllvtnsmmswmkmnsrvvt gqtuevuojvuqtpjuvnolrurwuu prmpkqqusvunoeiqupkivqvtwr custhvvtquptuujrutqujvvvtu pussbtsukvunupttvrlssuowtv jutpesvvjvvjuulsvtoppuuwhv
jqvtdvvvhwusqulkwupspvvwsv lqmijsipmvsptoksuqlhqrrwtu rronslsvovspneqovhmnirpuvv evttjgvtowvlvvjnvlqmqvvwow suuuvvuuuwututvutqsuavuvvv jqqqetqplvsqqnjsvlmkpsrwqu
nskthusilusqrrnptrlfmvsvrw lsqthsufhwvrtrlsvlnnpusvqq mopsgqqrnwulnhomtklkuttkwu iuuvduvvfvvvtukvwvuvvvuvvv htusluvdhvwsvnmvwmpuvvsuww jrjriqvtkvvonukkomshuounqv
moqsisumlvvnqkkjvoihusnupr lqpsfuqsltsqquprtsqqestsrl
""".split()
#: Chances of a lower-case letter, a capital, a digit and a sign after each of them, and at the start.
CHANGES = ((0.90, 0.03, 0.02, 0.05), (0.25, 0.70, 0.02, 0.03), (0.05, 0.05, 0.80, 0.10), (0.55, 0.20, 0.20, 0.05))
SIGNS = "+/_=-"
SYMBOLS = LOWER + UPPER + DIGITS + SIGNS
BANDS = (20, 32, 48, 64, 128)
RATE, VETO = 0.01, 0.001
GRID, GRID_STEP = 1024, 16.0
CHUNK = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches in code points; work grows in proportion to their number."""
    lit = F.lit(pattern)
    kind = "array<struct<start:int,end:int,match:string>>"
    gaps = F.zip_with(F.regexp_extract_all(text, lit, F.lit(0)), F.split(text, pattern, -1), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def within(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, x: Column) -> Column:
            span = F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("match"))
            return F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(part, first, step, lambda a: a["out"])

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), within))

    def chunked(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(CHUNK)), lambda i: F.slice(pairs, i + 1, F.lit(CHUNK)))

    # the piece after the last match has none beside it
    spans = let(F.filter(gaps, lambda x: x["m"].isNotNull()), lambda pairs: let(chunked(pairs), placed))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by Karagiannidis and Lioumpas' approximation."""

    def tail(x: Column) -> Column:
        return F.least(F.lit(0.5), (1 - F.exp(-1.4 * x)) * F.exp(-x * x / 2) / (1.135 * math.sqrt(2 * math.pi) * x))

    return let(z, lambda v: let(tail(F.greatest(F.abs(v), F.lit(1e-6))), lambda t: F.when(v >= 0, t).otherwise(1 - t)))


def alphabet_of(run: Column) -> Column:
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(run.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    return alphabet


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def neighbours(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over neighbouring values."""
    n = F.size(values) - 1
    return total(F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), f))


def pair_costs() -> list[float]:
    """-log of the chance of each symbol after each other one, row by row."""
    sorts = [0] * 26 + [1] * 26 + [2] * 10 + [3] * len(SIGNS)
    within = lambda p, q: 1 / 10 if sorts[q] == 2 else 1 / len(SIGNS) if sorts[q] == 3 else math.exp(-(ord(PAIRS[p % 26][q % 26]) - 97) / 4) if p < 52 else 1 / 26
    places = range(len(SYMBOLS))
    return [-math.log(CHANGES[sorts[p]][sorts[q]] * within(p, q)) for p in places for q in places]


def log_p_prose(x: Column) -> Column:
    """log of the chance that prose is as likely under equal use of the alphabet; case counts only where it changes."""
    costs = F.split(F.lit(",".join(f"{c:.3f}" for c in pair_costs())), ",").cast("array<double>")
    one_case = F.when(x["s"] == F.upper(x["s"]), F.lower(x["s"])).otherwise(x["s"])
    places = F.transform(F.split(one_case, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    # the start: a symbol of any kind, one of len(SYMBOLS)
    spent = let(places, lambda p: neighbours(p, lambda a, b: F.get(costs, (a - 1) * len(SYMBOLS) + b - 1))) + math.log(len(SYMBOLS))
    return x["n"] * F.log(x["k"]) - spent


def p_even(x: Column) -> Column:
    """Chance that random data use the alphabet as unevenly, by Wilson and Hilferty's cube root."""
    counts = F.transform(F.split(x["alphabet"], ""), lambda c: (F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit("")))).cast("double"))
    chi = total(F.transform(counts, lambda c: c * c)) * x["k"] / x["n"] - x["n"]
    part = 2 / (9 * (x["k"] - 1))
    return upper_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / (x["k"] - 1)) - (1 - part)) / F.sqrt(part))


def p_runs(x: Column, places: Column) -> Column:
    above = F.transform(places, lambda v: F.when(v > x["k"] / 2, 1.0).otherwise(0.0))

    def tested(v: Column) -> Column:
        n1, n = v["n1"], x["n"]
        expected = 2 * n1 * (n - n1) / n + 1
        deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        return F.when((n1 == 0) | (n1 == n), 0.0).otherwise(2 * upper_tail(F.abs((v["runs"] - expected) / deviation)))

    return let(above, lambda a: let(F.struct(total(a).alias("n1"), (neighbours(a, lambda p, q: F.abs(p - q)) + 1).alias("runs")), tested))


def p_serial(x: Column, places: Column) -> Column:
    def tested(centred: Column) -> Column:
        square = total(F.transform(centred, lambda v: v * v))
        return let(square, lambda q: F.when(q > 0, 2 * upper_tail(F.abs(neighbours(centred, lambda a, b: a * b) / F.greatest(q, F.lit(1e-9)) + 1 / x["n"]) * F.sqrt(x["n"]))).otherwise(0.0))

    return let(total(places) / x["n"], lambda mean: let(F.transform(places, lambda v: v - mean), tested))


def grid_point(run: Column) -> Column:
    """The battery on one candidate: struct<band, g>; its p-value is at most exp(-g / GRID_STEP). An orderly run has g = 0."""

    def battery(x: Column) -> Column:
        places = F.transform(F.split(x["s"], ""), lambda c: F.instr(x["alphabet"], c).cast("double"))
        orderly = (p_even(x) < VETO) | let(places, lambda p: (p_runs(x, p) < VETO) | (p_serial(x, p) < VETO))
        g = F.when(x["n"] < BANDS[0], 0).when(orderly, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(-log_p_prose(x) * GRID_STEP).cast("int"))))
        band = F.lit(0)
        for i, least in enumerate(BANDS[1:], 1):
            band = F.when(x["n"] >= least, i).otherwise(band)
        return F.struct(band.alias("band"), g.alias("g"))

    def described(s: Column) -> Column:
        return let(alphabet_of(s), lambda a: let(F.struct(s.alias("s"), a.alias("alphabet"), F.length(s).cast("double").alias("n"), F.length(a).cast("double").alias("k")), battery))

    def core(s: Column) -> Column:
        longest = F.aggregate(F.split(s, "[=_-]"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
        return let(longest, lambda piece: F.when(F.length(piece) >= BANDS[0], piece).otherwise(s))

    return let(let(F.regexp_replace(run, "=+$", ""), core), described)


def with_candidates(df: DataFrame, text: str, into: str = "__candidates") -> DataFrame:
    spans = df.withColumn(into, found(F.coalesce(F.col(text), F.lit("")), CANDIDATE))
    return spans.withColumn(into, F.transform(into, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), grid_point(x["match"]).alias("test"))))


def limits(df: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """The least grid point that counts as random in each band, over all texts of `df`; at most 5 rows reach the driver."""
    from pyspark.sql import Window

    tests = with_candidates(df.select(text), text).select(F.explode("__candidates.test").alias("t")).groupBy("t.band", "t.g").agg(F.count("*").alias("n"))
    as_random = Window.partitionBy("band").orderBy(F.col("g").desc())
    steps = tests.withColumn("upto", F.sum("n").over(as_random)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    passed = steps.filter(F.exp(-F.col("g") / GRID_STEP) <= rate * F.col("upto") / F.col("all"))
    return {r.band: r.g for r in passed.groupBy("band").agg(F.min("g").alias("g")).collect()}


def scan(df: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """`df` with `secrets`, array<struct<start, kind, end>> by start, then kind (0 assign, 1 access, 2 hex, 3 random).

    Places are code points, ends exclusive. Null and empty texts have none. Spans of one kind
    don't overlap; spans of different kinds may. A column named `secrets` is replaced.
    """
    least = limits(df, text, rate)
    body = F.coalesce(F.col(text), F.lit(""))
    tested = "__candidates_" + "_" * max(map(len, df.columns))  # longer than any column's name
    rows = with_candidates(df.drop("secrets"), text, tested)
    random = F.lit(False)

    def is_random(x: Column) -> Column:
        out = random
        for band, g in sorted(least.items()):
            out = out | ((x["test"]["band"] == band) & (x["test"]["g"] >= g))
        return out

    def kind(spans: Column, i: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    assigned = F.filter(found(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 12)
    spans = F.concat(kind(assigned, 0), kind(found(body, ACCESS), 1), kind(found(body, HEX), 2), kind(F.filter(tested, is_random), 3))
    return rows.withColumn("secrets", F.array_sort(spans)).drop(tested)


def spelled(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = scan(df.select(key, text), text)
    count = lambda i: F.size(F.filter("secrets", lambda x: x["kind"] == i)).cast("long")
    return rows.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.filter("secrets", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"), count(3).alias("n_random")
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`df` with every secret in `text` replaced by `mark`; overlapping spans give one mark. A null text stays null.

    Rows that repeat stay, and every other column is as it was, whatever its name. An empty table gives none.
    """
    spans = "__secrets_" + "_" * max(map(len, df.columns))
    found_ = scan(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("text")), "text").withColumnRenamed("secrets", spans)
    rows = found_.select("row", F.col("text").alias("__text"), spans)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        piece = F.concat(F.col("__text").substr(a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.col("__text").substr(a["at"] + 1, F.length("__text"))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col("__text"))
    return rows.select(*((clean if c == text else F.col("row").getField(c)).alias(c) for c in df.columns))
