"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

A partition keeps the merge table in an in-memory DuckDB. The distinct pre-tokens of a
batch become rows (word, position, token); a recursive query joins neighbouring tokens to
the merge table, contracts each word's leftmost pair of least rank, and goes on until no
word has a pair left. An ordered aggregation turns ids back into bytes. Words of any length
are encoded: long ones are first cut where no token of the vocabulary can cross.

The ranks are also the ids, and two tokens merge whenever their bytes joined are a token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.arrays import RollingHash, U64, mix, slices, spread, tidy
from tidewatch.llm.pretokens import WordTable

#: Each round contracts the leftmost pair of least rank in every word. For pieces of up to CUT_BYTES, with word, place
#: and rank packed into one number each.
ENCODE = """
with recursive contracted(word, pos, tok, done) as (
  select word, pos, tok, false from words
  union all (
    with near as (
      select word, pos, tok,
        lead(word) over next as next_word, lead(pos) over next as next_pos, lead(tok) over next as next_tok
      from contracted where not done
      window next as (order by (word << 20) | pos)
    ), paired as (
      select n.word, n.pos, n.tok,
        case when n.next_word = n.word then (m.tok::bigint << 40) | (n.pos << 20) | n.next_pos end as pair
      from near n left join merges m on m.pair = (n.tok << 20) | n.next_tok
    ), least_pair as (
      select word, min(pair) as best from paired group by word
    )
    select word, pos, case when pos = (best >> 20) & 1048575 then best >> 40 else tok end, best is null
    from paired join least_pair using (word)
    where best is null or pos <> best & 1048575
  )
)
select word, pos, tok from contracted where done order by word, pos
"""
#: The same result in fewer rounds, for longer pieces: a round contracts the pair of least rank at all its places from the
#: left, where no contraction makes a pair of lower rank ("calm"), else at the leftmost. A pair is packed as rank, then place.
ENCODE_LONG = """
with recursive contracted(word, pos, tok, done) as (
  select word, pos, tok, false from words
  union all (
    with near as (
      select word, pos, tok, row_number() over next as place, lead(word) over next as next_word, lead(tok) over next as next_tok
      from contracted where not done
      window next as (order by word, pos)
    ), paired as (
      select n.word, n.pos, n.tok, n.place, m.calm, case when n.next_word = n.word then (m.tok::bigint << 40) | n.pos end as pair
      from near n left join merges m on m.pair = (n.tok::bigint << 20) | n.next_tok
    ), least_pair as (
      select word, min(pair) as best from paired group by word
    ), hits as (
      select word, pos, tok, place, best, calm, (pair = best) as leftmost, coalesce(pair >> 40 = best >> 40, false) as hit
      from paired join least_pair using (word)
    ), picked as (
      select word, pos, tok, place, best,
        hit and (leftmost or calm and (place - coalesce(max(case when not hit then place end) over (order by place rows unbounded preceding), 0)) % 2 = 1) as pick
      from hits
    ), marked as (
      select word, pos, tok, best, pick, lag(pick, 1, false) over (order by place) as gone from picked
    )
    select word, pos, case when pick then best >> 40 else tok end, best is null from marked where not gone
  )
)
select word, pos, tok from contracted where done order by word, pos
"""
DECODE = """
select chunk, string_agg(bytes, '' order by pos) as bytes
from ids join vocabulary using (tok) group by chunk order by chunk
"""
#: Ids that one ordered aggregate of the decoding query joins.
CHUNK_IDS = 4096
#: Rows of a recursive query's first step; a longer piece goes alone. Words of more bytes are cut where no token can cross.
QUERY_ROWS, CUT_BYTES = 1 << 18, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairDB:
    """The tables of one vocabulary, and both queries over them."""

    def __init__(self, ranks: dict[bytes, int], memory: str = "400MB"):
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory})
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.byte_strings = tokens
        self.byte_lengths = np.array([len(t) for t in tokens])
        self.opens = np.array([t[:1].isspace() for t in tokens])
        halves = [(ranks[a], ranks[b], r) for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks]
        left, right, tok = np.array(halves, np.int64).reshape(-1, 3).T
        calm = np.ones(max(ranks.values()) + 1, bool)  # tokens that are no half of a token of lower rank
        later = np.maximum(left, right)
        calm[later[later > tok]] = False
        self._table("merges", pa.table({"pair": left << 20 | right, "tok": tok.astype(np.int32), "calm": calm[tok]}))
        self.twos = np.zeros(1 << 16, bool)
        self.twos[[t[0] << 8 | t[1] for t in tokens if len(t) == 2]] = True
        self.threes = np.unique(np.array([t[i] << 16 | t[i + 1] << 8 | t[i + 2] for t in tokens for i in range(len(t) - 2)], np.int64))
        # One character per byte, as DuckDB's strings are UTF-8.
        self._table("vocabulary", pa.table({"tok": np.array([ranks[t] for t in tokens], np.int32), "bytes": [t.decode("latin-1") for t in tokens]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming").fetchall()
        self.db.unregister("incoming")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def cuts(self, word: np.ndarray) -> np.ndarray:
        """Places in a word's bytes that no token can cross: neither the two bytes there are one, nor do three there occur in one."""
        w = word.astype(np.int64)
        three = w[:-2] << 16 | w[1:-1] << 8 | w[2:]
        known = np.zeros(len(w) + 1, bool)  # at 1 + the place of the first byte
        if len(self.threes):
            known[1:-2] = self.threes[np.minimum(np.searchsorted(self.threes, three), len(self.threes) - 1)] == three
        at = np.arange(1, len(w))
        return at[~self.twos[w[:-1] << 8 | w[1:]] & ~known[at - 1] & ~known[at]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of each. A word that is a token is not contracted; a long one is cut exactly."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        pieces, owner = [], []
        for i, b in enumerate(raw):
            if len(b) <= CUT_BYTES:
                pieces.append(b)
                owner.append(i)
            else:
                edges = [0, *self.cuts(np.frombuffer(b, np.uint8)).tolist(), len(b)]
                pieces += [b[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                owner += [i] * (len(edges) - 1)
        ids, counts = self.encode_pieces(pieces)
        return ids, np.bincount(np.array(owner, np.int64), counts, minlength=len(raw)).astype(np.int64)

    def encode_pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of each, by the recursive query."""
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int64)
        counts, parts = np.ones(len(raw), np.int64), [whole]
        source = np.arange(len(raw))  # where each piece's ids start in the parts joined
        rest, total = np.flatnonzero(whole < 0), len(raw)
        lengths = np.array([len(raw[i]) for i in rest], np.int64)
        short = lengths <= CUT_BYTES
        rest, lengths, turn = np.concatenate([rest[short], rest[~short]]), np.concatenate([lengths[short], lengths[~short]]), int(short.sum())
        while len(rest):
            n = max(1, int(np.searchsorted(np.cumsum(lengths), QUERY_ROWS, side="right")))
            if turn > 0:
                n = min(n, turn)
            query, turn = ENCODE if turn > 0 else ENCODE_LONG, turn - n
            group, size, rest, lengths = rest[:n], lengths[:n], rest[n:], lengths[n:]
            got = self._query(
                query,
                "words",
                pa.table({"word": np.repeat(np.arange(n), size), "pos": spread(np.zeros(n, np.int64), size), "tok": self.byte_ids[np.frombuffer(b"".join(raw[i] for i in group), np.uint8)].astype(np.int64)}),
            )
            counts[group] = each = np.bincount(got.column("word").to_numpy(), minlength=n)
            source[group] = total + np.cumsum(each) - each
            total += int(each.sum())
            parts.append(got.column("tok").to_numpy())
        return np.concatenate(parts)[spread(source, counts)].astype(np.int32), counts

    def decode_pieces(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each piece, a run of ids."""
        at = np.arange(len(ids), dtype=np.int64)
        got = self._query(DECODE, "ids", pa.table({"chunk": at // CHUNK_IDS, "pos": at, "tok": ids.astype(np.int32)}))
        every = "".join(got.column("bytes").to_pylist()).encode("latin-1")
        ends = np.append(0, np.cumsum(self.byte_lengths[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return [every[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Decoder:
    """Bytes of id sequences. They are cut before each token that opens with white space; each distinct piece of a call is decoded once."""

    def __init__(self, db: BytePairDB):
        self.db = db
        self.symbols = mix(np.arange(1, len(db.opens) + 1, dtype=U64) * U64(0xA24BAED4963EE407))

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(ids):
            return [b""] * (len(offsets) - 1)
        cut = self.db.opens[ids]
        cut[offsets[:-1][offsets[:-1] < len(ids)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(ids))
        code, distinct = pd.factorize(RollingHash(self.symbols[ids]).of(starts, ends))
        sample = np.empty(len(distinct), np.int64)
        sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        counts = ends[sample] - starts[sample]
        known = np.empty(len(distinct), object)
        known[:] = self.db.decode_pieces(ids[spread(starts[sample], counts)], counts)
        pieces = known[code].tolist()
        first = np.searchsorted(starts, offsets).tolist()
        return [b"".join(pieces[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


#: One worker process keeps the tables of the last vocabulary from task to task.
_held: dict[str, tuple[BytePairDB, WordTable, Decoder]] = {}


def held(path: str) -> tuple[BytePairDB, WordTable, Decoder]:
    if path not in _held:
        _held.clear()
        db = BytePairDB(read_ranks(path))
        _held[path] = db, WordTable(db.encode_words), Decoder(db)
    return _held[path]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, ranks_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`df` with the token ids of each text as array<int>.

    Null and empty texts give an empty array; rows that repeat give equal ones; a column named
    `into` is replaced. Texts and words (matches of the pattern) may have any length.
    """
    keep = [c for c in df.columns if c != into]
    schema = df.select(*keep).schema.add(into, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _ = held(ranks_path)
        for batch in batches:
            for part in slices(batch, text):
                ids, offsets = table.tokens(*table.rows(strings(part.column(text))))
                array = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), array], [*keep, into])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with the bytes that each array of ids stands for. Null gives no bytes; an unknown id fails the task."""
    keep = [c for c in df.columns if c != into]
    schema = df.select(*keep).schema.add(into, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, decoder = held(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = pa.array([x or [] for x in part.column(ids).to_pylist()], pa.list_(pa.int32())) if part.column(ids).null_count else part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                offsets = np.append(0, np.cumsum(np.asarray(pc.list_value_length(column))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(decoder.texts(flat, offsets), pa.binary())], [*keep, into])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", into: str = "ids", same: str = "round_trip") -> DataFrame:
    """`df` with each text's ids, and whether they decode to it again: both in one worker, which holds the tables once.

    Null and empty texts give an empty array and true; columns named like the added ones are replaced.
    """
    keep = [c for c in df.columns if c not in (into, same)]
    schema = df.select(*keep).schema.add(into, T.ArrayType(T.IntegerType())).add(same, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, decoder = held(ranks_path)
        for batch in batches:
            for part in slices(batch, text):
                texts = strings(part.column(text))
                ids, offsets = table.tokens(*table.rows(texts))
                equal = [a == b.encode() for a, b in zip(decoder.texts(ids, offsets), texts, strict=True)]
                array = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), array, pa.array(equal, pa.bool_())], [*keep, into, same])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def digests(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested, within one pass."""
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, table, decoder = held(ranks_path)
        digits = np.array([str(i) for i in range(len(db.byte_strings))], object)
        for batch in batches:
            for part in slices(batch, text):
                ids, offsets = table.tokens(*table.rows(strings(part.column(text))))
                spelled, ends = digits[ids].tolist(), offsets.tolist()
                ids_sha = [hashlib.sha256(" ".join(spelled[a:b]).encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                decoded_sha = [hashlib.sha256(x).hexdigest() for x in decoder.texts(ids, offsets)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(tidy(run), schema)
