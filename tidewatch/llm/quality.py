"""Quality rules: counts of words, symbols and repeats, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. The ratio (compressed
bytes / bytes) of repetitive text is low and that of random text is high; how low and how
high ordinary prose goes depends on the length, so each length has limits of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrays import RollingHash, U64, byte_table, mix, slices, space_words, tidy, utf8

#: (least bytes, least ratio, greatest ratio, greatest ratio in other scripts) of a text or chunk; shorter ones are not judged.
#: Set on 10,000 documents in four languages (their bound is this sample, not the table that is judged): texts labelled good
#: have ratios of 0.58 to 0.82 at 200 to 400 bytes, 0.51 to 0.71 to 1,000, 0.45 to 0.58 to 4,000 and 0.40 to 0.47 beyond.
#: The least ratio is about 0.4 to 0.5 of the least among these, as prose of a small vocabulary has 0.22; lines of one
#: template with a number each lie below it.
#: The greatest lies between them and base 64 of that length. Other scripts take more bytes a character than their texts need
#: in bits, and short ones compress no better than noise: texts with over OTHER_SHARE of their bytes beyond ASCII have the fourth.
BANDS = (
    (200, 0.28, 0.90, 1.02), (250, 0.28, 0.89, 1.02), (300, 0.27, 0.865, 1.02), (400, 0.26, 0.825, 1.02), (500, 0.25, 0.79, 0.92), (700, 0.24, 0.76, 0.92),
    (1000, 0.22, 0.73, 0.86), (1500, 0.20, 0.71, 0.86), (2000, 0.18, 0.69, 0.80), (4000, 0.16, 0.66, 0.76), (16000, 0.15, 0.62, 0.74),
)
OTHER_SHARE = 0.2
CHUNK_BYTES = 4096
#: Share of a text's chunks that must lie outside their band.
CHUNK_SHARE = 0.5
LEVEL = 3
#: Fixed values of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = b"#*$%&|<>", 5, 10, 20
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "whole_ratio": "double", "chunks_out": "long", "kept": "boolean"}


def outside(n_bytes: int, ratio: float, other: bool = False, bands=BANDS) -> bool:
    for least, low, high, high_other in reversed(bands):
        if n_bytes >= least:
            return not low <= ratio <= (high_other if other else high)
    return False


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of `width` words found twice or more in it."""
    n = len(hashes)
    counts = np.diff(first)
    covered = np.zeros(n + 1, np.int64)
    if n >= width:
        text = np.repeat(np.arange(len(counts)), counts)
        whole = text[: n - width + 1] == text[width - 1 :]
        at = np.flatnonzero(whole)
        key = mix(RollingHash(hashes).windows(width)[at] + text[at].astype(U64) * U64(0x9FB21C651E98DF25))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = at[order[twice]]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + width, -1)
    return per_text(np.cumsum(covered)[:n] > 0, first)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judged(batch: pa.RecordBatch, text: str, compressor, bands=BANDS) -> dict[str, np.ndarray]:
    raw, offsets = utf8(batch.column(text))
    starts, ends, first = space_words(raw, offsets)
    n_words = np.diff(first)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) & ((raw & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    hashes = RollingHash(byte_table()[raw]).of(starts, ends)
    repeats = repeated_words(hashes, first)
    n = batch.num_rows
    lines, ratio, out = np.zeros(n, np.int64), np.ones(n), np.zeros(n, np.int64)
    kept = np.ones(n, bool)
    other = per_text(raw >= 0x80, offsets) > OTHER_SHARE * np.diff(offsets)
    view = memoryview(raw)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines[i] = duplicate_lines(bytes(view[a:b]))
        if b - a < bands[0][0]:
            continue
        ratio[i] = len(compressor.compress(view[a:b])) / (b - a)
        chunks = [(c, min(c + CHUNK_BYTES, b)) for c in range(a, b, CHUNK_BYTES)]
        chunks = [c for c in chunks if c[1] - c[0] >= bands[0][0]]
        out[i] = sum(outside(d - c, len(compressor.compress(view[c:d])) / (d - c), other[i], bands) for c, d in chunks) if len(chunks) > 1 else 0
        kept[i] = not outside(b - a, ratio[i], other[i], bands) and not (out[i] and out[i] > CHUNK_SHARE * len(chunks))
    failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": per_text(solid, offsets), "n_symbols": per_text(symbol[raw], offsets), "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": failed, "whole_ratio": ratio, "chunks_out": out, "kept": ~failed & kept}


def rate(df: DataFrame, text: str = "text", prefix: str = "", bands=BANDS) -> DataFrame:
    """`df` with the counts and the verdict of each text; the added columns' names begin with `prefix`, and replace columns so named.

    A null or empty text has no words and fails. A text under 200 bytes is not judged by its
    compression. Whole texts are judged, whatever their length; repeated rows get equal verdicts, and
    an empty table gives none.
    """
    keep = [c for c in df.columns if c not in {prefix + x for x in COLUMNS}]
    schema = df.select(*keep).schema
    for name, kind in COLUMNS.items():
        schema = schema.add(prefix + name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for batch in batches:
            for part in slices(batch, text):
                found = judged(part, text, compressor, bands)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[c]) for c in COLUMNS)], [*keep, *(prefix + c for c in COLUMNS)])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is kept; columns as they were."""
    mark = "__quality_"
    return rate(df, text, mark).filter(F.col(f"{mark}kept")).select(*df.columns)
