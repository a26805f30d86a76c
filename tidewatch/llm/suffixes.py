"""Exact removal of strings of 200 bytes that occur twice, by a logarithmic family of suffix arrays.

A window is a string of SPAN bytes at one place. Its anchor is the place within it at which
the hash of CORE bytes is least (leftmost, if equal), so equal windows have equal anchors at
equal distances. The consecutive windows of one anchor make a piece of the text; 2 / (SPAN -
CORE + 2) of all places are anchors. A window can only recur where its anchor's core recurs.

1. Pieces are counted by (core, piece) hashes, first within each slice, then over all texts.
   Cores that occur once are done. Of the others, one copy of each different piece goes on.
2. Pieces are dealt by core, to as many tasks as their number asks for. Each task takes them batch by batch: the windows of a batch become
   a suffix array (suffixes in order of the fingerprint of their first SPAN bytes, the only
   order the search needs), which is merge-scanned against the arrays of all levels so far;
   equals on either side are marked. Then it becomes a level, and levels of like size merge,
   so each suffix is merged O(log n) times.
3. Marked windows return to all texts that hold their piece, and their bytes are cut out.

Equality is decided by 64-bit fingerprints, within cores of equal 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.arrays import RollingHash, U64, byte_table, mix, slices, spread, tidy, utf8
from tidewatch.llm.shared import discard, stored

SPAN, CORE = 200, 48
FILTER_BITS = 1 << 26
#: Places that fit beside a hash in a 64-bit word; windows that are taken at once, and that a task's family is to hold.
PLACE_BITS, MOST = 24, 4 << 20


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, core: int = CORE):
    """(text, core hash, piece hash, first window's start, number of windows) of each piece; starts count from the text's start."""
    out = []
    sizes = np.diff(offsets)
    jobs = [(raw, offsets, 0)]
    if len(raw) > MOST:  # one giant text: stretches that overlap by a window
        jobs = [(raw[a : a + MOST + span - 1], np.array([0, min(MOST + span - 1, len(raw) - a)]), a) for a in range(0, max(1, len(raw) - span + 1), MOST)]
        assert len(sizes) == 1
    for part, ends, shift in jobs:
        counts = np.maximum(0, np.diff(ends) - span + 1)
        if not counts.sum():
            continue
        rolling = RollingHash(byte_table()[part])
        place = np.arange(len(part) - core + 1, dtype=np.uint64)
        ranked = (mix(rolling.windows(core)) >> U64(PLACE_BITS) << U64(PLACE_BITS)) | place
        least = least_in_window(ranked, span - core + 1)
        at = spread(ends[:-1], counts)
        anchor = (least[at] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
        n = np.diff(np.append(first, len(at)))
        start, anchor, text = at[first], anchor[first], text[first]
        piece = rolling.of(start, start + n - 1 + span) ^ mix((anchor - start).astype(U64) + U64(1))
        out.append((text, rolling.of(anchor, anchor + core), piece, start - ends[text] + shift, n))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, U64, U64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Level:
    """A suffix array: fingerprints in order, and which suffix each is of."""

    __slots__ = ("keys", "piece", "window", "again")

    def __init__(self, keys, piece, window, again):
        self.keys, self.piece, self.window, self.again = keys, piece, window, again

    def __len__(self) -> int:
        return len(self.keys)


class SuffixFamily:
    """Suffix arrays of all batches so far, in levels of geometric size."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, piece: np.ndarray, window: np.ndarray) -> None:
        order = np.argsort(keys)
        new = Level(keys[order], piece[order], window[order], np.zeros(len(keys), bool))
        same = new.keys[1:] == new.keys[:-1]
        new.again[1:] |= same
        new.again[:-1] |= same
        for level in self.levels:
            self.scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))

    @staticmethod
    def scan(new: Level, level: Level) -> None:
        """Mark the equals on both sides. Equals within a level have marks already."""
        place = np.searchsorted(level.keys, new.keys)
        hit = np.flatnonzero(level.keys[np.minimum(place, len(level) - 1)] == new.keys) if len(level) else []
        new.again[hit] = True
        level.again[place[hit]] = True

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        keys = np.concatenate([a.keys, b.keys])
        order = np.argsort(keys, kind="stable")  # two runs in order: merged in one pass
        join = lambda x, y: np.concatenate([x, y])[order]
        return Level(keys[order], join(a.piece, b.piece), join(a.window, b.window), join(a.again, b.again))

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(piece, window) of every suffix that has an equal, in ascending order."""
        piece = np.concatenate([x.piece[x.again] for x in self.levels]) if self.levels else np.zeros(0, np.int64)
        window = np.concatenate([x.window[x.again] for x in self.levels]) if self.levels else np.zeros(0, np.int64)
        order = np.lexsort((window, piece))
        return piece[order], window[order]


def runs(piece: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows of a piece: piece, first, last."""
    if not len(piece):
        return piece, window, window
    first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)))
    last = np.append(first[1:], len(piece)) - 1
    return piece[first], window[first], window[last]


def bit_map(keys: DataFrame, column: str) -> np.ndarray:
    """A bit map of hashes, FILTER_BITS long whatever their number; it may hold others too."""
    bit = keys.select(F.pmod(column, F.lit(FILTER_BITS)).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def held_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = np.mod(hashes.astype(np.int64), FILTER_BITS)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def listed(rows: DataFrame, bits=None, span: int = SPAN, core: int = CORE) -> DataFrame:
    """Pieces of (row, check, text). Without `bits`: one of each kind in a slice and their number; with it: all whose core is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, head, piece, start, n = pieces(*utf8(part.column("text")), span, core)
                row, check = part.column("row").to_numpy(), part.column("check").to_numpy()
                if bits is None:
                    order = np.lexsort((piece, head))
                    first = np.flatnonzero(np.append(True, (head[order][1:] != head[order][:-1]) | (piece[order][1:] != piece[order][:-1]))) if len(order) else order
                    count = np.diff(np.append(first, len(order)))
                    pick = order[first]
                else:
                    pick = np.flatnonzero(held_in(bits.value, head))
                    count = np.ones(len(pick), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(head[pick].view(np.int64)), pa.array(piece[pick].view(np.int64)), pa.array(row[text[pick]]), pa.array(check[text[pick]]), pa.array(start[pick].astype(np.int32)), pa.array(n[pick].astype(np.int32)), pa.array(count.astype(np.int32))], ["core", "piece", "row", "check", "start", "n", "copies"])

    return rows.mapInArrow(tidy(run), "core long, piece long, row long, check long, start int, n int, copies int")


def recurring(found: DataFrame) -> DataFrame:
    """One of each kind of piece whose core occurs twice or more, with the number of its copies."""
    from pyspark.sql import Window

    kinds = found.repartition("core").groupBy("core", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "check", "start", "n")).alias("at"))
    return kinds.withColumn("all", F.sum("copies").over(Window.partitionBy("core"))).filter("all > 1").select("core", "piece", "copies", "at.row", "at.check", "at.start", "at.n")


def repeated_windows(texts: DataFrame, tasks: int, span: int = SPAN) -> DataFrame:
    """(core, piece, spans) of (core, piece, copies, bytes): the windows of each piece that recur, as runs first..last.

    `tasks` bounds what a family holds, but for the pieces of one core, which are in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily()
        cores, names, whole, sizes, total = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, "bytes"):
                raw, offsets = utf8(part.column("bytes"))
                n = np.diff(offsets) - span + 1
                at = spread(offsets[:-1], n)
                keys = mix(RollingHash(byte_table()[raw]).windows(span))[at]
                family.add(keys, (total + np.repeat(np.arange(len(n)), n)).astype(np.int32), (at - np.repeat(offsets[:-1], n)).astype(np.int32))
                cores.append(part.column("core").to_numpy())
                names.append(part.column("piece").to_numpy())
                whole.append(part.column("copies").to_numpy() > 1)
                sizes.append(n)
                total += len(n)
        if not total:
            return
        core, name, copied, size = (np.concatenate(x) for x in (cores, names, whole, sizes))
        piece, first, last = runs(*family.repeated())
        alone = ~copied[piece]
        every = np.flatnonzero(copied)
        piece, first, last = np.concatenate([piece[alone], every]), np.concatenate([first[alone], np.zeros(len(every), np.int64)]), np.concatenate([last[alone], size[every] - 1])
        order = np.argsort(piece, kind="stable")
        piece, first, last = piece[order], first[order], last[order]
        owner, begins = np.unique(piece, return_index=True)
        ends = np.append(begins[1:], len(piece)).astype(np.int32)
        for a in range(0, len(owner), 50_000):
            b = min(a + 50_000, len(owner))
            base, stop = int(begins[a]), int(ends[b - 1])
            bounds = np.append(begins[a:b], stop).astype(np.int32) - base
            values = pa.StructArray.from_arrays([pa.array(first[base:stop].astype(np.int32)), pa.array(last[base:stop].astype(np.int32))], ["first", "last"])
            yield pa.RecordBatch.from_arrays([pa.array(core[owner[a:b]]), pa.array(name[owner[a:b]]), pa.ListArray.from_arrays(bounds, values)], ["core", "piece", "spans"])

    return texts.select("core", "piece", "copies", "bytes").repartition(tasks, "core").mapInArrow(tidy(run), "core long, piece long, spans array<struct<first:int,last:int>>")


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], len(starts)) - 1].tolist(), strict=True)) if len(first) else []


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, core: int = CORE, kept: bool = False, most: int = MOST) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, removed, and with `kept` the bytes left) of each row of `df`.

    `removed` has the maximal runs of bytes of the UTF-8 text that some string of `span` bytes
    covers which also starts anywhere else in the column. Null and empty texts have no bytes.
    Rows that repeat are removed whole, if they have `span` bytes. Texts may have any length; other
    columns of `df` don't matter, and an empty table gives none. `most`: suffixes that
    a task's family is to hold.
    """
    spark = df.sparkSession
    # a text is known by 128 bits: two hashes over key and text
    twice = (F.xxhash64(key, text).alias("row"), F.xxhash64(text, F.lit(17), key).alias("check"))
    rows = df.select(*twice, F.col(key).alias("key"), F.col(text).alias("text"))
    long_enough = rows.filter(F.octet_length("text") >= span).select("row", "check", "text")
    kinds = stored(recurring(listed(long_enough, None, span, core)), "pieces")
    # one copy of each kind, cut from its text
    wanted = spark.sparkContext.broadcast(bit_map(kinds, "row"))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held_in(wanted.value, batch.column("row").to_numpy())))

    cuts = kinds.groupBy("row", "check").agg(F.collect_list(F.struct("core", "piece", "copies", "start", "n")).alias("cuts"))
    sources = long_enough.mapInArrow(tidy(only), "row long, check long, text string").join(cuts, ["row", "check"])
    sources = sources.select(F.encode("text", "utf-8").alias("bytes"), F.explode("cuts").alias("c"))
    texts = sources.select("c.core", "c.piece", "c.copies", F.substring("bytes", F.col("c.start") + 1, F.col("c.n") + span - 1).alias("bytes"))
    windows = kinds.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // most))
    verdicts = stored(repeated_windows(texts, tasks, span), "windows")
    # back to every text that holds the piece
    cores = spark.sparkContext.broadcast(bit_map(verdicts, "core"))
    found = listed(long_enough, cores, span, core).select("core", "piece", "row", "check", "start").join(verdicts, ["core", "piece"])
    spans = stored(found.groupBy("row", "check").agg(F.collect_list(F.struct("start", "spans")).alias("found")), "spans")
    touched = spark.sparkContext.broadcast(bit_map(spans, "row"))
    discard(kinds, verdicts)
    base = T.StructType([df.select(F.col(key).alias("key")).schema[0]])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = held_in(touched.value, batch.column("row").to_numpy())
            whole = [None if m else (x or "").encode() for m, x in zip(maybe.tolist(), batch.column("text").to_pylist(), strict=True)]
            digest = [None if x is None else hashlib.sha256(x).hexdigest() for x in whole]
            left = pa.array([x if kept else None for x in whole], pa.binary())
            text = pa.array(batch.column("text").to_pylist(), pa.string(), mask=~maybe)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("check"), batch.column("key"), pa.array([0 if x is None else len(x) for x in whole], pa.int64()), pa.array(digest, pa.string()), left, text], ["row", "check", "key", "n_bytes", "digest", "left", "text"])

    first = T.StructType([T.StructField("row", T.LongType()), T.StructField("check", T.LongType()), base[0], *T.DataType.fromDDL("n_bytes long, digest string, left binary, text string")])
    result = T.StructType([T.StructField(key, base[0].dataType), *T.DataType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>" + ", kept binary" * kept)])
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for n, digest, left, text, pieces_found in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "digest", "left", "text", "found")), strict=True):
                gone: list[tuple[int, int]] = []
                if digest is None:
                    raw = (text or "").encode()
                    n = len(raw)
                    if pieces_found:
                        at = np.array([(p["start"] + s["first"], p["start"] + s["last"] + span) for p in pieces_found for s in p["spans"]], np.int64)
                        gone = merge_spans(at[:, 0], at[:, 1])
                    edges = [0, *(x for pair in gone for x in pair), n]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    digest = hashlib.sha256(left).hexdigest()
                for to, x in zip(out, (n, sum(b - a for a, b in gone), len(gone), digest, [{"start": a, "end": b} for a, b in gone], left), strict=True):
                    to.append(x)
            columns = [batch.column("key"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), run_type, pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns[: len(result)], result.names)

    return rows.mapInArrow(tidy(untouched), first).join(spans, ["row", "check"], "left").select("key", "n_bytes", "digest", "left", "text", "found").mapInArrow(tidy(removed), result)
