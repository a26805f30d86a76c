"""Token ids as files of patched frame-of-reference blocks.

One file per range of documents, documents in ascending order. Layout, little-endian:

    magic  8 bytes
    blocks of up to BLOCK ids:
        least u32, count u32, width u8, exceptions u32
        (id - least) of every id, `width` bits each, most significant bit first; 0 for exceptions
        positions of the exceptions u16, then their ids u32
    doc table: start u64 and n_tokens u64 of each document, the start within this file
    index: the byte at which each block starts u64
    tail: docs u64, blocks u64, byte at which the doc table starts u64

The width holds PERCENTILE of a block's ids; the rest are exceptions. An id is found by
dividing its place by BLOCK and taking that block's start from the index.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.arrays import slices, tidy
from tidewatch.llm.pretokens import WordTable
from tidewatch.llm.shared import new_folder

MAGIC = b"TWPFOR01"
BLOCK, PERCENTILE = 8192, 99.0
HEAD, TAIL = struct.Struct("<IIBI"), struct.Struct("<QQQ")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    ids = ids.astype(np.uint32)
    least = ids.min()
    delta = ids - least
    width = max(1, int(np.partition(delta, k := min(len(delta) - 1, int(len(delta) * percentile / 100)))[k]).bit_length())
    out = np.flatnonzero(delta >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    values = ids[out]
    delta[out] = 0
    bits = np.unpackbits(delta.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return HEAD.pack(least, len(ids), width, len(out)) + np.packbits(bits).tobytes() + out.astype("<u2").tobytes() + values.astype("<u4").tobytes()


def unpack_block(raw: bytes, at: int = 0) -> np.ndarray:
    least, count, width, exceptions = HEAD.unpack_from(raw, at)
    at += HEAD.size
    size = (count * width + 7) // 8
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = np.frombuffer(raw, np.uint8, size, at)
    words = np.ndarray((size + 1,), ">u8", padded, strides=(1,))
    bit = np.arange(count, dtype=np.int64) * width
    ids = ((words[bit >> 3] >> (64 - width - (bit & 7)).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32) + np.uint32(least)
    at += size
    ids[np.frombuffer(raw, "<u2", exceptions, at)] = np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions)
    return ids


class Writer:
    """Streams documents' ids into one file; holds one block and 16 bytes a document."""

    def __init__(self, sink):
        self.sink, self.place = sink, len(MAGIC)
        sink.write(MAGIC)
        self.rest, self.total = [], 0
        self.waiting = 0
        self.counts: list[np.ndarray] = []
        self.blocks: list[int] = []

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.counts.append(counts.astype(np.int64))
        self.total += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, stop, BLOCK):
            raw = pack_block(ids[i : min(i + BLOCK, stop)])
            self.blocks.append(self.place)
            self.sink.write(raw)
            self.place += len(raw)
        self.rest = [ids[stop:]]
        self.waiting = len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        table = np.stack([np.cumsum(counts) - counts, counts], axis=1).astype("<u8")
        self.sink.write(table.tobytes() + np.array(self.blocks, "<u8").tobytes() + TAIL.pack(len(counts), len(self.blocks), self.place))


class Reader:
    """Ids of one file by place."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        docs, blocks, at = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        raw = source.read_at(16 * docs + 8 * blocks, at)
        self.table = np.frombuffer(raw, "<u8", 2 * docs).reshape(-1, 2).astype(np.int64)
        self.blocks = np.append(np.frombuffer(raw, "<u8", blocks, 16 * docs).astype(np.int64), at)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count - 1; reads the blocks that hold them in one piece."""
        if count == 0:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (start + count - 1) // BLOCK
        base = int(self.blocks[a])
        raw = self.source.read_at(int(self.blocks[b + 1]) - base, base)
        every = np.concatenate([unpack_block(raw, int(x) - base) for x in self.blocks[a : b + 1]])
        return every[start - a * BLOCK : start - a * BLOCK + count]

    def documents(self, group_ids: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of whole documents: starts, counts, ids."""
        starts, counts = self.table[:, 0], self.table[:, 1]
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts + counts, starts[i] + group_ids, side="right")))
            yield starts[i:j], counts[i:j], self.ids(int(starts[i]), int(counts[i:j].sum()))
            i = j


class Encoder:
    """The tokenizers library's ids; it encodes each distinct pre-token once, and as a whole each text that holds one of its added tokens."""

    def __init__(self, path: str, ordinary: bool = False):
        """`ordinary`: strings of added tokens are ordinary text, in place of the library's default."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.added = [] if ordinary else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(self.ids_of)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in each], np.int64)
        return np.fromiter((i for x in each for i in x), np.int32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and len + 1 offsets."""
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not special:
            return self.table.tokens(*self.table.rows(texts))
        plain = texts.copy()
        for i in special:
            plain[i] = ""
        ids, offsets = self.table.tokens(*self.table.rows(plain))
        more, counts = self.ids_of([texts[i] for i in special])
        out = np.insert(ids, np.repeat(offsets[special], counts), more)
        sizes = np.diff(offsets)
        sizes[special] = counts
        return out, np.append(0, np.cumsum(sizes))


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One worker process keeps the encoder of the last path from task to task."""
    if path not in _held:
        _held.clear()
        _held[path] = Encoder(path)
    return _held[path]


def file_system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2, files: int | None = None) -> list[tuple[int, str, int, int]]:
    """Encode all texts, append `end_id` to each, write them in ascending order of key (null first, ties by text).

    Returns (file, path, tokens, documents) of each file, as many as there are shuffle
    partitions. Null and empty texts are one `end_id`. Beside each file an Arrow file
    (`.keys`) has its documents' keys. Each attempt of a task writes under a name of its own, and
    only the names of those that ended are returned, so a lost or repeated attempt does no harm;
    what it left is deleted at the end.
    """
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(files, F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        file = f"tokens-{number:06d}-{attempt}.pfor"
        name = f"{base}/{file}"
        table = encoder(tokenizer_path)
        docs = 0
        keys = None
        with fs.open_output_stream(name) as sink, fs.open_output_stream(f"{name}.keys") as key_sink:
            writer = Writer(sink)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, offsets = table.encode([x or "" for x in part.column("text").to_pylist()])
                    docs += part.num_rows
                    writer.add(np.insert(ids, offsets[1:], end_id).astype(np.uint32), np.diff(offsets) + 1)
                    if keys is None:
                        keys = pa.ipc.new_file(key_sink, pa.schema([part.schema.field("key")]))
                    keys.write_batch(part.select(["key"]))
            writer.close()
            if keys is not None:
                keys.close()
        yield pa.RecordBatch.from_pydict({"file": [number], "path": [f"{folder}/{file}"], "tokens": [writer.total], "docs": [docs]}, schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("docs", pa.int64())]))

    out = rows.mapInArrow(tidy(run), "file int, path string, tokens long, docs long").collect()
    remove_others(folder, {r.path.rpartition("/")[2] for r in out})
    return sorted((r.file, r.path, r.tokens, r.docs) for r in out)


def remove_others(folder: str, names: set[str]) -> None:
    """Delete what attempts that didn't end left in the folder."""
    from pyarrow.fs import FileSelector

    fs, base = file_system(folder)
    for x in fs.get_file_info(FileSelector(base, allow_not_found=True)):
        if x.base_name.removesuffix(".keys") not in names:
            fs.delete_file(x.path)


def read_token_files(spark: SparkSession, files: list[tuple[int, str, int, int]], key_type: str = "long", key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all files before."""
    starts, rows = 0, []
    for _, path, tokens, docs in files:
        if docs:
            rows.append((path, starts))
        starts += tokens
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                fs, base = file_system(folder)
                with fs.open_input_file(f"{base}/{name}.keys") as f:
                    keys = pa.ipc.open_file(f).read_all().column("key").combine_chunks()
                with fs.open_input_file(f"{base}/{name}") as f:
                    done = 0
                    for doc_starts, counts, ids in Reader(f).documents():
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(counts)).tolist()
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([keys.slice(done, len(counts)), pa.array(doc_starts + before), pa.array(counts), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])
                        done += len(counts)

    return listed.mapInArrow(tidy(run), f"{key} {key_type}, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each row, from files written into a new folder of the shared one and read back.

    Null and empty texts have the end id only; repeated rows are written as often; ties of key go by text.
    """
    folder = new_folder(df.sparkSession, "token-files")
    files = write_token_files(df, tokenizer_path, folder, key, text, end_id)
    return read_token_files(df.sparkSession, files, dict(df.dtypes)[key], key)
