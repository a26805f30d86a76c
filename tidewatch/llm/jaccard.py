"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles of five words, as 64-bit hashes. Documents of
equal sets are one node. Two sets of n shingles or more whose similarity is at least t
share a = ceil(t * n) of them, so in any one order of all shingles, prefixes of n - a + l
share l or more, for every l up to a.

1. Document frequencies of all shingles, from sorted delta-coded runs. The most frequent
   ones (a bounded list, at most HOT_LIMIT) come last in the order; the rest follow their hash.
2. Each node picks l by estimated cost: a longer prefix is more to scan, but a candidate then
   needs l shared shingles, and there are at most sum(frequency - 1) / l of those.
   Two similar sets share ceil(t / (1 + t) * (n + n')) shingles, of which no more lie beyond
   both prefixes than the longer rest of the two; the prefixes must share what is left. One
   of these is among the first n - ceil(2t / (1 + t) * n) + 1 of the smaller set.
3. Prefix shingles meet by value. Of the nodes that meet (and whose sizes allow it), the least
   is the hub, and each goes into the hub's bundle. Near copies meet by many shingles, but the
   least of them is mostly the same, so a node goes into few bundles. No pair is made.
4. A bundle's sets are compared within one task: shared prefix shingles are counted for all
   its nodes at once, pairs that share enough are verified on whole sets, and only a forest
   of the links leaves the task: fewer rows than it took in.
5. A bundle of over BLOCK_NODES nodes is dealt into blocks, twice and in different ways. Nodes
   that are then outside the bundle's largest component meet, block by block, all of its nodes
   of other components; links within a component are of no consequence. So no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.arrays import RollingHash, U64, byte_table, mix, slices, space_words, spread, tidy, utf8
from tidewatch.llm.packing import deltas, pack, undeltas, unpack
from tidewatch.llm.shared import discard, stored
from tidewatch.operators.components import connected_components, roots

WIDTH, PERCENT = 5, 75
#: Bits of a shingle's hash: in frequency counts, in prefixes and sets.
COUNT_BITS, TOKEN_BITS = 40, 48
#: Shingles in fewer sets are not told apart; shingles that the order puts last.
LEAST_FREQUENCY, HOT_LIMIT = 8, 1_000_000
#: Shingles in more sets find their hub by aggregation over all tasks, not in one.
SPLIT_FREQUENCY = 1 << 20
#: Nodes and shingles of one block of a large bundle; times that blocks are dealt.
BLOCK_NODES, BLOCK_SHINGLES, DEALS = 2048, 1 << 21, 2
#: Nodes that one step compares, if they are of small bundles; nodes and columns of a matrix product.
STEP_NODES, STEP_SHINGLES, DENSE, COLUMNS = 512, 1 << 19, 32, 2048
FLUSH = 2_000_000
FILTER_BITS = 1 << 26
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text; the texts' offsets into them; the texts' nodes (0: no words)."""
    raw, offsets = utf8(batch.column(text))
    raw = LOWER[raw]
    starts, ends, first = space_words(raw, offsets)
    words = RollingHash(RollingHash(byte_table()[raw]).of(starts, ends))  # over word hashes
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    n = len(text_of)
    at = np.flatnonzero(text_of[: n - WIDTH + 1] == text_of[WIDTH - 1 :]) if n >= WIDTH else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    values = np.concatenate([words.of(at, at + WIDTH), words.of(first[short], first[short] + counts[short])])
    owner = np.concatenate([text_of[at], short]).astype(np.uint16 if len(counts) < 1 << 16 else np.uint32)
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values), out=sums[1:])
    size = np.diff(bounds)
    nodes = mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(U64) * U64(0x9FB21C651E98DF25)) >> U64(1)
    return values, bounds, np.where(size > 0, nodes.astype(np.int64), 0)


def in_prefixes(n: np.ndarray, rest: np.ndarray, m: np.ndarray, rest_m: np.ndarray, percent: int) -> np.ndarray:
    """Prefix shingles that similar sets of n and m shingles share, with `rest` of them beyond each prefix."""
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)) - np.maximum(rest, rest_m))


def first_of(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the start of a prefix in which a set of n shingles meets any similar one that isn't smaller."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that any similar set shares with one of n."""
    return -(-n * percent // 100)


def by_part(tokens: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Bounds of the parts among ascending tokens."""
    edges = (np.arange(parts + 1, dtype=object) << bits) // parts
    return np.searchsorted(tokens, np.array([int(x) for x in edges], U64))


def frequent(df: DataFrame, text: str, parts: int) -> DataFrame:
    """(token, frequency) of the shingles in LEAST_FREQUENCY texts or more, by the leading COUNT_BITS bits of their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            bounds = by_part(tokens, COUNT_BITS, parts)
            full = np.flatnonzero(np.diff(bounds))
            blobs = [pack(deltas(tokens[a:b]), counts[a:b].astype(np.uint32)) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "run"])

        for batch in batches:
            for part in slices(batch, text):
                values = shingles(part, text)[0] >> U64(64 - COUNT_BITS)
                held.append(values)
                size += len(values)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        runs = [unpack(x) for x in group.column("run").to_pylist()]
        tokens, counts = np.concatenate([undeltas(x[0]) for x in runs]), np.concatenate([x[1] for x in runs])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        total = np.add.reduceat(counts.astype(np.int64), first)
        often = total >= LEAST_FREQUENCY
        return pa.table({"token": tokens[first][often].astype(np.int64), "frequency": total[often]})

    return df.select(text).mapInArrow(tidy(count), "part int, run binary").groupBy("part").applyInArrow(merge, "token long, frequency long")


def hottest(counted: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending tokens of the most frequent classes (powers of 2) that together hold at most `limit`, and their classes."""
    classed = counted.withColumn("class", F.floor(F.log2("frequency")).cast("int"))
    sizes = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    for c in sorted(sizes, reverse=True):
        held += sizes[c]
        if held > limit:
            break
        least = c
    rows = classed.filter(F.col("class") >= least).select("token", "class").toArrow()
    tokens, kinds = rows.column("token").to_numpy().astype(U64), rows.column("class").to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], kinds[order]


class Classes:
    """Class of each shingle; a bit map answers for most of those that are in none."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray):
        self.tokens, self.kinds = tokens, kinds
        self.near = np.zeros(1 << 24, bool)
        self.near[(tokens >> U64(COUNT_BITS - 24)).astype(np.int64)] = True

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint8)
        if len(self.tokens):
            token = values >> U64(64 - COUNT_BITS)
            at = np.flatnonzero(self.near[(token >> U64(COUNT_BITS - 24)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.tokens, token[at]), len(self.tokens) - 1)
            hit = self.tokens[place] == token[at]
            out[at[hit]] = self.kinds[place[hit]]
        return out


def six_bytes(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def prefix_sizes(n: np.ndarray, bounds: np.ndarray, kind: np.ndarray, percent: int) -> np.ndarray:
    """Length of each set's prefix, of the least estimated cost. `kind`: classes of all shingles in order."""
    need = required(n, percent)
    before = np.append(0, np.cumsum(np.where(kind > 0, 2.0**kind, 1.0) - 1))
    best, least, matches = np.ones(len(n), np.int64), np.full(len(n), np.inf), 1
    while len(n) and (matches <= need).any():
        size = np.minimum(n, n - need + matches)
        met = before[bounds[:-1] + size] - before[bounds[:-1]]
        cost = np.where(matches <= need, size + met + n * met / matches, np.inf)
        best, least = np.where(cost < least, matches, best), np.minimum(cost, least)
        matches += 1 + matches // 4
    return np.where(n > 0, np.minimum(n, n - need + best), 0)


def arranged(values: np.ndarray, bounds: np.ndarray, classes: Classes, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set in the order of all sets, rare ones first, and the length of its prefix."""
    n = np.diff(bounds)
    kind = classes.of(values)
    order = np.argsort(kind, kind="stable")
    owner = np.repeat(np.arange(len(n)), n)[order].astype(np.uint16 if len(n) < 1 << 16 else np.uint32)
    order = order[np.argsort(owner, kind="stable")]
    return values[order], prefix_sizes(n, bounds, kind[order], percent)


def blobs(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each run of tokens, six bytes a token."""
    ends = np.append(0, 6 * np.cumsum(sizes)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(six_bytes(tokens).tobytes())])
    return whole.cast(pa.binary())


def tokens_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all values of such a column in a row, and the number of each."""
    raw, offsets = utf8(column)
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.reshape(-1).view("<u8"), np.diff(offsets) // 6


def prefixes(df: DataFrame, key: str, text: str, hot, percent: int) -> DataFrame:
    """(row, key, n, node, prefix) of each text; prefix holds six bytes a shingle, in order. `row` is a hash of key and text."""
    rows = df.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([*rows.drop("text").schema, *T.DataType.fromDDL("n long, node long, prefix binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(*hot.value)
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds, nodes = shingles(part, "text")
                n = np.diff(bounds)
                values, size = arranged(values, bounds, classes, percent)
                prefix = blobs(values[spread(bounds[:-1], size)] >> U64(64 - TOKEN_BITS), size)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), pa.array(n), pa.array(nodes, mask=n == 0), prefix], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def posted(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row of the batch, whether it is early in its set) of all prefix shingles of (node, n, prefix)."""
    token, counts = tokens_in(batch.column("prefix"))
    early = spread(np.zeros(len(counts), np.int64), counts) < np.repeat(first_of(batch.column("n").to_numpy(), percent), counts)
    return token, np.repeat(np.arange(len(counts)), counts), early


def postings(nodes: DataFrame, hot, parts: int, percent: int, split: int) -> DataFrame:
    """(part, run): prefix shingles of all nodes in ascending order, dealt by value; without those in `split` sets or more."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, owners = [], 0, 0
        classes = Classes(*(x[hot.value[1] >= np.log2(split)] for x in hot.value))

        def flush() -> pa.RecordBatch:
            node, n, token, owner, early = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token)
            token, owner, early = token[order], owner[order], early[order]
            bounds = by_part(token, TOKEN_BITS, parts)
            full = np.flatnonzero(np.diff(bounds))
            runs = []
            for a, b in zip(bounds[full], bounds[full + 1], strict=True):
                who, local = np.unique(owner[a:b], return_inverse=True)
                runs.append(pack(deltas(token[a:b]), local.astype(np.uint32), early[a:b].astype(np.uint8), node[who].astype(np.uint64), n[who].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(runs, pa.binary())], ["part", "run"])

        for batch in batches:
            token, owner, early = posted(batch, percent)
            if len(classes.tokens):
                few = classes.of(token << U64(64 - TOKEN_BITS)) == 0
                token, owner, early = token[few], owner[few], early[few]
            held.append((batch.column("node").to_numpy(), batch.column("n").to_numpy(), token, owners + owner, early))
            owners += batch.num_rows
            size += len(token)
            if size >= FLUSH:
                yield flush()
                held, size, owners = [], 0, 0
        if size:
            yield flush()

    return nodes.select("node", "n", "prefix").mapInArrow(tidy(deal), "part int, run binary")


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def met(runs: DataFrame, percent: int) -> DataFrame:
    """(hub, node) of the nodes that some shingle brings together, the hub with itself."""

    def merge(group: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for raw in group.column("run").to_pylist():
            token, local, early, node, n = unpack(raw)
            for to, x in zip(columns, (undeltas(token), node[local], n[local].astype(np.int64), early > 0), strict=True):
                to.append(x)
        token, node, n, early = (np.concatenate(x) for x in columns)
        order = np.lexsort((node, ~early, n, token))
        order = order[starts_of(token[order], node[order])]
        token, node, n, early = token[order], node[order].astype(np.int64), n[order], early[order]
        # nodes of one shingle ascend by size; where the next one is too large, no pair crosses
        first = starts_of(token)
        gap = np.zeros(len(token), bool)
        gap[first] = True
        gap[1:] |= 100 * n[:-1] < percent * n[1:]
        run = np.cumsum(gap)
        # the shingle has to be early in the smaller set of a pair
        last_early = np.maximum.accumulate(np.where(early, np.arange(len(token)), -1))
        before = np.append(-1, last_early[:-1]) if len(token) else last_early
        useful = (before >= 0) & (run[before] == run) & (100 * n[before] >= percent * n)
        useful[:-1] |= early[:-1] & (run[:-1] == run[1:])
        run, node = run[useful], node[useful]
        start = starts_of(run)
        size = np.diff(np.append(start, len(run)))
        hub = np.repeat(np.minimum.reduceat(node, start), size) if len(start) else node
        several = np.repeat(size, size) > 1
        hub, node = hub[several], node[several]
        order = np.lexsort((node, hub))
        order = order[starts_of(hub[order], node[order])]
        return pa.table({"hub": hub[order], "node": node[order]})

    return runs.groupBy("part").applyInArrow(merge, "hub long, node long")


def met_by_split(nodes: DataFrame, hot, percent: int, split: int, salts: int = 64) -> DataFrame:
    """met() for shingles in `split` sets or more: their hubs by aggregation, and the nodes by a join with `salts` copies of these few rows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(*(x[hot.value[1] >= np.log2(split)] for x in hot.value))
        for batch in batches:
            token, owner, _ = posted(batch, percent)
            many = classes.of(token << U64(64 - TOKEN_BITS)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(token[many].astype(np.int64)), batch.column("node").take(pa.array(owner[many]))], ["token", "node"])

    rows = nodes.select("node", "n", "prefix").mapInArrow(tidy(listed), "token long, node long")
    hubs = rows.groupBy("token").agg(F.min("node").alias("hub"))
    salted = hubs.select("token", "hub", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod("node", F.lit(salts)).cast("int")).join(salted, ["token", "salt"]).select("hub", "node")


def row_filter(rows: DataFrame) -> np.ndarray:
    """A bit map of the rows' hashes, FILTER_BITS long whatever their number; it may hold others too."""
    bit = rows.select(F.pmod("row", F.lit(FILTER_BITS)).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def texts_of(df: DataFrame, key: str, text: str, reps: DataFrame) -> DataFrame:
    """(row, text) of the rows of `df` that may be in `reps` (row): all of those, and few others."""
    wanted = df.sparkSession.sparkContext.broadcast(row_filter(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            bit = np.mod(batch.column("row").to_numpy(), FILTER_BITS)
            yield batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))

    return df.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).mapInArrow(tidy(run), "row long, text string")


def counts_between(owner: np.ndarray, token: np.ndarray, k: int) -> np.ndarray:
    """Matrix of the tokens that any two of k owners share: products of 0/1 matrices for frequent tokens, pairs of owners for rare ones."""
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = starts_of(token)
    frequency = np.diff(np.append(start, len(token)))
    out = np.zeros((k, k), np.float32)
    each = np.repeat(frequency, frequency)
    column = np.repeat(np.cumsum(frequency >= DENSE) - 1, frequency)
    often = np.flatnonzero(each >= DENSE)
    who, where = owner[often], column[often]
    for at in range(0, int(where[-1]) + 1 if len(where) else 0, COLUMNS):
        a, b = np.searchsorted(where, (at, at + COLUMNS))
        part = np.zeros((k, min(COLUMNS, int(where[-1]) + 1 - at)), np.float32)
        part[who[a:b], where[a:b] - at] = 1
        out += part @ part.T
    rare = (each < DENSE) & (each > 1)
    token, owner = token[rare], owner[rare].astype(np.int64)
    step, codes, size = 1, [], 0
    while step < DENSE and len(token) > step:
        same = token[step:] == token[:-step]
        if not same.any():
            break
        a, b = owner[:-step][same], owner[step:][same]
        codes.append(np.minimum(a, b) * k + np.maximum(a, b))
        size += len(a)
        step += 1
        if size > 1 << 21 or step == DENSE:
            add_pairs(out, codes, k)
            codes, size = [], 0
    add_pairs(out, codes, k)
    return out


def add_pairs(out: np.ndarray, codes: list[np.ndarray], k: int) -> None:
    if codes:
        code, times = np.unique(np.concatenate(codes), return_counts=True)
        out[code // k, code % k] += times
        out[code % k, code // k] += times


def shared_by(owner: np.ndarray, token: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens that each pair of owners (i, j) shares, by search; tokens of owner x start at first[x]."""
    keys = np.sort(owner.astype(U64) << U64(TOKEN_BITS) | token)
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    out = np.zeros(len(i), np.int64)
    ends = np.cumsum(n[i])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 21), side="right")))
        ask = np.repeat(j[a:b], n[i[a:b]]).astype(U64) << U64(TOKEN_BITS) | token[spread(first[i[a:b]], n[i[a:b]])]
        hit = keys[np.minimum(np.searchsorted(keys, ask), len(keys) - 1)] == ask
        out[a:b] = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[i[a:b]]) - n[i[a:b]])
        a = b
    return out


def linked(group: np.ndarray, component: np.ndarray, n: np.ndarray, size: np.ndarray, token: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group and different components whose sets are similar; prefixes must share enough first."""
    k = len(n)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(k), n)
    inside = np.repeat(size, n) > spread(np.zeros(k, np.int64), n)
    within = counts_between(owner[inside], token[inside] ^ mix(group)[owner[inside]], k)
    rest = n - size
    pairs = []
    for a in range(0, k, 256):
        x = slice(a, min(a + 256, k))
        share = within[x] > 0
        share &= group[x, None] == group[None, :]
        share &= component[x, None] != component[None, :]
        share &= np.arange(a, a + len(share))[:, None] < np.arange(k)[None, :]
        i, j = np.nonzero(share)
        i += a
        enough = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (within[i, j] >= in_prefixes(n[i], rest[i], n[j], rest[j], percent))
        pairs.append((i[enough], j[enough]))
    del within
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(i):
        return i, j
    if len(i) <= 16 * k:
        both = shared_by(owner, token, first, n, i, j)
    else:
        both = counts_between(owner, token ^ mix(group)[owner], k)[i, j].astype(np.int64)
    good = 100 * both >= percent * (n[i] + n[j] - both)
    return i[good], j[good]


def compared(rows: DataFrame, hot, percent: int) -> DataFrame:
    """Forest (a, b) of the links among rows (hub, block, node, component, text) of equal hub and block.

    A task has one block in memory, of bounded size, or some small ones. A node may be there twice.
    """
    names = ["hub", "block", "node", "component"]

    def links(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        hub, block, node, component, n, size, token = (np.concatenate(x) for x in zip(*held, strict=True))
        group = np.zeros(len(hub), np.int64)
        group[starts_of(hub, block)] = 1
        i, j = linked(np.cumsum(group), component, n, size, token, percent)
        a, b = roots(node[i], node[j]) if len(i) else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(*hot.value)
        held: list[list[np.ndarray]] = []  # of whole groups, but for the last one
        rows = shingled = 0
        for batch in batches:
            for part in slices(batch, "text"):
                values, ends, nodes = shingles(part, "text")
                right = nodes == part.column("node").to_numpy()
                if not right.all():  # texts whose row hashes collide
                    part = part.filter(pa.array(right))
                    values, ends, _ = shingles(part, "text")
                columns = [part.column(c).to_numpy() for c in names]
                n = np.diff(ends)
                values, size = arranged(values, ends, classes, percent)
                values >>= U64(64 - TOKEN_BITS)
                bounds = np.append(starts_of(columns[0], columns[1]), len(n))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    same = held and held[-1][0][-1] == columns[0][a] and held[-1][1][-1] == columns[1][a]
                    if not same and (rows >= STEP_NODES or shingled >= STEP_SHINGLES):
                        yield links(held)
                        held, rows, shingled = [], 0, 0
                    held.append([*(c[a:b] for c in columns), n[a:b], size[a:b], values[ends[a] : ends[b]]])
                    rows += b - a
                    shingled += int(ends[b] - ends[a])
        if rows > 1:
            yield links(held)

    dealt = rows.select(*names, "text").repartition("hub", "block").sortWithinPartitions("hub", "block")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, hot_limit: int = HOT_LIMIT, block_nodes: int = BLOCK_NODES, split: int = SPLIT_FREQUENCY) -> DataFrame:
    """(row, key, n, component) of each row of `df`.

    `n` is the number of distinct shingles, `row` a hash of key and text, and `component` is
    the same for all rows that links connect. A text with fewer than five words is one shingle;
    null and empty texts, and those without words, have component null and no links. Rows that
    repeat, and rows with a null key, take part like others. An empty table gives an empty one.
    """
    spark = df.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(frequent(df, text, parts), "frequencies")
    hot = spark.sparkContext.broadcast(hottest(counted, hot_limit))
    listed = stored(prefixes(df, key, text, hot, percent), "prefixes")
    nodes = listed.filter("n > 0")
    bundles = met(postings(nodes, hot, parts, percent, split), percent)
    if (hot.value[1] >= np.log2(split)).any():
        bundles = bundles.unionByName(met_by_split(nodes, hot, percent, split))
    bundles = stored(bundles.distinct(), "bundles")
    reps = nodes.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"))  # copies are one before the join
    bundles = stored(bundles.join(reps, "node"), "members")
    texts = texts_of(df, key, text, bundles)
    # blocks of each bundle; one, unless it is large
    needed = F.ceil(F.greatest(F.count("*") / block_nodes, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = stored(bundles.groupBy("hub").agg(needed.alias("blocks")).filter("blocks > 1"), "large")
    labels, links, none = None, None, large.isEmpty()
    for seed in range(1 if none else DEALS):
        rows = bundles.join(large, "hub", "left" if seed == 0 else "inner")
        rows = labelled(rows, labels).select("hub", "node", "row", "component", F.pmod(F.xxhash64("node", F.lit(seed)), F.coalesce("blocks", F.lit(1))).alias("block"))
        more = stored(compared(rows.join(texts, "row"), hot, percent), "links")
        links = links.unionByName(more) if links else more
        labels = connected_components(links)
    if not none:
        rows = across(bundles.join(large, "hub"), labels, block_nodes)
        links = links.unionByName(stored(compared(rows.join(texts, "row"), hot, percent), "links"))
        labels = connected_components(links)
    groups = stored(labelled(listed.select("row", "key", "n", "node"), labels).select("row", "key", "n", "component"), "groups")
    discard(counted, listed, bundles, large)
    return groups


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with the component of each node; without labels, a node is its own."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")


def across(members: DataFrame, labels: DataFrame, block_nodes: int) -> DataFrame:
    """(hub, block, node, row, component): nodes outside their bundle's largest component, in blocks, each block beside each block of the whole bundle.

    Bundles of one component are done. `members` are (hub, node, row, blocks) of the large bundles.
    """
    rows = stored(labelled(members, labels), "members")
    counts = rows.groupBy("hub", "component").agg(F.count("*").alias("size"))
    most = counts.groupBy("hub").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all"))
    open_ = most.filter("most.size < all").select("hub", F.col("most.component").alias("largest"), F.ceil((F.col("all") - F.col("most.size")) / block_nodes).cast("int").alias("outer"))
    rows = rows.join(open_, "hub")
    place = lambda seed, blocks: F.pmod(F.xxhash64("node", F.lit(seed)), blocks)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    outside = rows.filter("component <> largest").select("hub", "node", "row", "component", "blocks", place(5, F.col("outer")).alias("i"), every(F.col("blocks")).alias("j"))
    whole = rows.select("hub", "node", "row", "component", "blocks", every(F.col("outer")).alias("i"), place(6, F.col("blocks")).alias("j"))
    both = outside.unionByName(whole).distinct()  # a node may be on both sides of its own block
    return both.select("hub", "node", "row", "component", (F.col("i").cast("long") * F.col("blocks") + F.col("j")).alias("block"))


def join_result(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that links reach; a row without words has its own."""
    rows = similar_groups(df, key, text)
    least = stored(rows.filter("component is not null").groupBy("component").agg(F.min("key").alias("least")), "least")
    return rows.join(least, "component", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of the smallest key (null last), then smallest hash. Rows without words all stay.

    Of rows equal in key and text one stays; if other columns differ, any of them. Columns may be of any type and name.
    """
    rows = similar_groups(df, key, text)
    none = F.col("key").isNull().alias("none")
    kept = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(none, "key", "row")).alias("x")).select("x.key", "x.row")
    wordless = rows.filter("component is null").select("key", "row").distinct()
    ids = kept.unionByName(wordless)
    repeated = rows.filter("component is not null").groupBy("key", "row").count().filter("count > 1").select("key", "row", F.lit(True).alias("again"))
    # names that no column of `df` has; null keys meet too
    k, r, again_ = (f"__{x}_{len(''.join(df.columns))}" for x in ("key", "row", "again"))
    marked = df.withColumns({k: F.struct(F.col(key).alias("x")), r: F.xxhash64(key, text)})
    boxed = lambda x: x.withColumn("key", F.struct(F.col("key").alias("x"))).withColumnsRenamed({"key": k, "row": r})
    left = marked.join(boxed(ids), [k, r], "left_semi").join(boxed(repeated.withColumnRenamed("again", again_)), [k, r], "left")
    once = left.filter(F.col(again_).isNull()).select(*df.columns)
    again = left.filter(F.col(again_)).dropDuplicates([k, r]).select(*df.columns)
    return once.unionByName(again)
