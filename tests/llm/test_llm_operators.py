"""Each operator against a brute-force version, on rows with every awkward case."""

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tidewatch.llm import bpe, chat, html, jaccard, mixing, neighbours, pretokens, quality, secrets, suffixes, token_files  # noqa: E402

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, node long, n int"


def rng_text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ther", "ing", "é", "中文", "x1", "Ab"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeats, near copies, ties, and columns that clash with those operators add."""
    rng = random.Random(3)
    base = [rng_text(rng, n) for n in (1, 3, 4, 5, 6, 40, 80, 120, 300)]
    passage = rng_text(rng, 60)
    texts = [None, "", " \n\t ", *base, base[5], base[5] + " more", base[6].upper(), base[7].replace("of", "or", 2), passage + " " + base[5], base[6] + " " + passage, "x" * 900, "line\nline\n\nline " * 30, "one two three four five " * 6, rng_text(rng, 4000)]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None, "clash", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base[6], None, "c", 1, 2), (None, None, "s0", None, None, None), (3, base[3] + " tie", "s1", "c", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1], r[2]) for r in rows]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1, 8: tokens

_db = None


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\t sdtrevmlLA19!<|>é中́"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=20))
def test_pretokens_equal_the_pattern(texts):
    import regex

    points, offsets = pretokens.code_points(texts)
    starts = pretokens.pretoken_starts(points, offsets)
    every = "".join(texts)
    assert [every[a:b] for a, b in zip(starts, np.append(starts[1:], len(points))[: len(starts)], strict=True)] == [w for t in texts for w in regex.findall(P.PATTERN, t)]


def test_bpe_equals_tiktoken(docs, empty):
    df, rows = docs
    enc = encoding()
    found = collected(bpe.digests(df, RANKS))
    expected = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    there = bpe.decode(bpe.encode(df, RANKS), RANKS).select("text", "ids", "decoded").collect()
    assert all(list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in there)
    assert bpe.digests(empty, RANKS).count() == 0


def test_bpe_of_long_and_random_words():
    enc, db = encoding(), bpe.BytePairDB(bpe.read_ranks(RANKS))
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    joined = "".join(rng.choice(["the", "of", "er", "ing", "ation", "re", "st"]) for _ in range(6000))
    words = ["a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(2000)), "é" * 500, "the", letters, joined, "ab" * 5000 + "aab" * 999, "é中" * 2000, "-=" * 3001 + "=" * 77, "中文字" * 70]
    ids, counts = db.encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(w) for w in words]
    assert b"".join(db.decode_pieces(ids, counts)) == "".join(words).encode()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abeinorstAB-=é", min_size=1, max_size=90), min_size=1, max_size=8))
def test_bpe_contracts_in_the_order_of_the_library(words):
    global _db
    enc = encoding() if _db is None else _db[0]
    _db = _db or (enc, bpe.BytePairDB(bpe.read_ranks(RANKS)))
    words = [w.strip() * 3 for w in words]
    ids, counts = _db[1].encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc._encode_single_piece(w.encode()) if w else [] for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=400))
def test_blocks_round_trip(ids):
    assert token_files.unpack_block(token_files.pack_block(np.array(ids, np.uint32))).tolist() == ids


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    df, rows = docs
    tokenizer = Tokenizer.from_file(TOKENIZER)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y " * 3, "<|endoftext|", "plain"]
    df = df.select("doc_id", "text").union(df.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(special)], "doc_id long, text string"))
    rows = [*rows, *((1000 + i, t, None) for i, t in enumerate(special))]
    found = token_files.token_files(df, TOKENIZER).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    digest = lambda t: (i := tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) and (len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, *digest(t)) for i, t, _ in rows)
    assert token_files.token_files(empty, TOKENIZER).count() == 0


# 2: secrets


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark, empty):
    rng = random.Random(7)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    planted = token(b64, 48)
    texts = [None, "", 'é TOKEN = "abcdefghijkl" password:short', "secret=token:abcdefghijklmnop", "AKIA" + "A" * 14 + "é AKIAAKIA", "deadbeef" * 3 + " " + planted, "abcdefghijklmnopqrstuvwxyz" * 2, "wordswordswordswordswords and more", " ".join(f"{i:032x}" for i in range(1200)), "api_key:'" + token("0123456789abcdef", 40) + "'"]
    texts += [" ".join(token("etaoinshr", rng.randrange(2, 9)) for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.secrets for r in secrets.scan(df).select("doc_id", "secrets").collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in found[i] if s.kind < 3] == base_spans(t or "")
    random_ones = {(i, texts[i][s.start : s.end]) for i, spans in found.items() for s in spans if s.kind == 3}
    assert (5, planted) in random_ones and not any(i in (6, 7) or i > 9 for i, _ in random_ones)
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] is None and clean[1] == "" and planted not in clean[5] and clean[7] == texts[7] and clean[3] == texts[3]
    assert secrets.digests(empty).count() == 0


def test_random_secrets_of_small_alphabets(spark):
    """Most random tokens in hexadecimal, base 32 and base 36 are found, as one in ten candidates, and no words, names or orderly runs."""
    rng = random.Random(11)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    alphabets = ("0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz")
    planted = [(n, token(a, n)) for a in alphabets for n in (20, 32, 40, 64) for _ in range(5)]
    parts = "time river house people water letter great small often never under after schrift frage maison lettre tiempo".split()
    word = lambda: rng.choice(("", "_", "-", "/")).join(rng.choices(parts, k=6))
    plain = [f(word()) for _ in range(180) for f in (str.lower, str.upper, str.title, lambda w: w + "/2024/05/12")] + ["deadbeef" * 3, "0" * 40, "0123456789ABCDEF" * 3, "ABAB1212" * 5]
    rows = [(f"{n}", f"see {t} and sig={t}.") for n, t in planted] + [("plain", f"see {t}.") for t in plain]
    found = Counter()
    for r in secrets.scan(spark.createDataFrame(rows, "kind string, text string")).collect():
        found[r.kind] += sum(s.kind == 3 for s in r.secrets)
    assert found["plain"] == 0
    assert found["20"] >= 32 and all(found[n] >= 36 for n in ("32", "40", "64"))  # of 40


# 3: quality


def counts_of(text):
    words = WORDS.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), repeats, len(covered)


def test_quality(spark, docs, empty):
    df, rows = docs
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.rate(df.select("doc_id", "text")).collect()), key=str)
    assert found == sorted(((i, *counts_of(t)) for i, t, _ in rows), key=str)
    rng = random.Random(1)
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(200))
    prose = " ".join(rng.choice("time river house people water letter great small often never under after".split()) + rng.choice(["", "s", "ed", "ly"]) for _ in range(900))
    unlike = " ".join(chr(rng.randrange(0x4E00, 0x9FFF)) + chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in quality.rate(spark.createDataFrame([(0, prose), (1, noise), (2, unlike), (3, None)], "doc_id int, text string")).collect()}
    assert verdicts[0] == (False, True) and verdicts[1] == (False, False) and verdicts[3] == (True, False)
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(df).columns == df.columns


def test_noise_of_every_length(spark):
    """Base 64 and printable noise of ten words or more fail at every length that is judged; prose in two scripts doesn't."""
    rng = random.Random(4)
    sizes = (210, 270, 350, 450, 600, 850, 1200, 1700, 2500, 3900, 6000, 20000)
    base = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    split = lambda t: " ".join(t[i : i + len(t) // 12 + 1] for i in range(0, len(t), len(t) // 12 + 1))
    ascii_noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    parts = "time river house people water letter great small often never under after begin along north table paper voice light story".split()
    prose = lambda n: " ".join(rng.choice(parts) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n // 5))[:n]
    han = lambda n: " ".join("".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 800) for _ in range(5)) for _ in range(n // 16))
    rows = [(kind, n, f(n)) for kind, f in (("noise", lambda n: split(base(n))), ("noise", lambda n: split(ascii_noise(n))), ("prose", prose), ("prose", han)) for n in sizes for _ in range(3)]
    found = quality.rate(spark.createDataFrame(rows, "kind string, size int, text string")).collect()
    assert not [(r.size, r.whole_ratio) for r in found if r.kind == "noise" and (r.kept or r.base_failed)]
    assert not [(r.size, r.whole_ratio) for r in found if r.kind == "prose" and not r.kept and not r.base_failed]


def test_both_sides_of_every_band():
    for at, (least, low, high, other) in enumerate(quality.BANDS):
        most = quality.BANDS[at + 1][0] - 1 if at + 1 < len(quality.BANDS) else 10**7
        for n in (least, most):
            assert not quality.outside(n, low) and quality.outside(n, low - 1e-6) and not quality.outside(n, high) and quality.outside(n, high + 1e-6)
            assert not quality.outside(n, other, True) and quality.outside(n, other + 1e-6, True)
    assert not quality.outside(quality.BANDS[0][0] - 1, 0.001) and not quality.outside(quality.BANDS[0][0] - 1, 5.0)


def test_templates_and_chunks(spark):
    """Lines of one template repeat no five words, but compress away; a text fails if most of its chunks do."""
    rng = random.Random(6)
    vocabulary = [a + b + c for a in "b d f g k l m n p r s t".split() for b in "aeiou" for c in ("n", "r", "st", "ck", "ll", "nd")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n // 4))[:n]
    template = lambda n: "".join(f"total net price amount {x} " for x in rng.sample(range(1000, 9999), n // 28 + 1))[:n]
    sizes = (450, 800, 1200, 1800, 3000, 6000, 30_000)
    rows = [("template", n, template(n)) for n in sizes] + [("prose", n, prose(n)) for n in (210, 300, *sizes)]
    half = "".join(prose(4096 - 1) + " " for _ in range(4))
    rows += [("most", 0, half[: 3 * 4096] + template(5 * 4096)), ("few", 0, half + template(2 * 4096))]
    found = quality.rate(spark.createDataFrame(rows, "kind string, size int, text string")).collect()
    assert [(r.kind, r.size, r.whole_ratio) for r in found if r.kind == "template" and (r.kept or r.base_failed)] == []
    assert [(r.kind, r.size, r.whole_ratio) for r in found if r.kind == "prose" and not r.kept] == []
    kept = {r.kind: (r.base_failed, r.kept, r.chunks_out) for r in found if not r.size}
    assert kept == {"most": (False, False, 5), "few": (False, True, 2)}


def test_quality_of_awkward_tables(spark, empty):
    assert quality.rate(empty).count() == 0
    clash = spark.createDataFrame([("a b " * 40_000, 1, "x"), ("a b " * 40_000, 1, "x"), (None, 2, "y")], "text string, kept int, n_words string")
    found = quality.rate(clash).collect()
    assert [(r.n_words, r.kept) for r in found] == [(80_000, False), (80_000, False), (0, False)] and quality.keep_good(clash).columns == clash.columns
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(300_000))
    r = quality.rate(spark.createDataFrame([(long,)], "text string")).first()
    assert (r.n_words, r.n_repeat_words) == counts_of(long)[0:5:4]


# 2 again: tables


def test_secrets_of_awkward_tables(spark):
    rows = [("token = abcdefghijkl0", 1, "x")] * 2 + [(None, None, None), ("x" * 300_000 + " secret:" + "Ab1" * 5, 2, "y")]
    df = spark.createDataFrame(rows, "text string, secrets int, __candidates string")
    found = secrets.scan(df).collect()
    assert sorted(len([s for s in r.secrets if s.kind < 3]) for r in found) == [0, 1, 1, 1]
    clean = secrets.redact(df)
    assert sorted(clean.columns) == sorted(df.columns) and clean.filter("text like '%[secret]%'").count() == 3 and [r.secrets for r in clean.filter("text is null").collect()] == [None]


# 4: chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>im_endsart\n ", max_size=30), st.text(alphabet="<|\\>n\nab", max_size=10))
def test_escapes_are_reversible(text, role):
    formatted, _ = chat.format_turn(role, text)
    assert chat.parse_turns(formatted * 2) == [(role, text)] * 2


def test_content_parts():
    parts = [{"type": "text", "text": "a <|im_end|>"}, {"type": "image", "ref": "i", "width": 56, "height": 30}, {"type": "audio", "ref": "s", "seconds": 2}, None, {"type": "document", "ref": "d", "pages": 3}, ["b", {"type": "video", "ref": "v"}]]
    formatted, attached = chat.format_turn("user", parts)
    assert [(a.kind, a.ref, a.tokens, a.place) for a in attached] == [("image", "i", 4, 0), ("audio", "s", 50, 1), ("document", "d", 1536, 2), ("video", "v", 1, 3)]
    assert [formatted.index(f"<|{a.kind}:{a.place}|>") for a in attached] == sorted(formatted.index(f"<|{a.kind}:{a.place}|>") for a in attached)


def test_typed_parts_of_a_table(spark):
    """Parts as JSON: references, placeholders and tokens per conversation; what is no JSON, and odd sizes, don't stop the task."""
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i", "width": 56, "height": 30}, {"type": "audio", "ref": "s", "seconds": 1.5}, [{"type": "document", "ref": "d", "pages": 2}], 7]
    deep = "[" * 900 + '"deep"' + "]" * 900
    rows = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", json.dumps("fine")), (2, 0, "user", "{broken"), (2, 1, "user", '[{"type": "image", "width": "wide", "height": -3}, {"type": 5}, {"text": [1]}, true]'), (3, 0, "user", None), (3, 1, "user", deep), (3, 2, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "mask", "conv", "attachments")})
    turns = chat.format_turns(df, parts=True)
    texts = {(r.conv, r.turn): r for r in turns.collect()}
    assert texts[1, 0].formatted == "<|im_start|>user\nsee <|image:0|><|audio:1|><|document:2|>7<|im_end|>\n" and [(a.kind, a.ref, a.tokens) for a in texts[1, 0].attachments] == [("image", "i", 4), ("audio", "s", 38), ("document", "d", 1024)]
    assert "{broken" in texts[2, 0].formatted and "<|image:0|><|5:1|>[1]true" in texts[2, 1].formatted and "deep" in texts[3, 1].formatted
    found = {r.conv_id: (r.n_turns, r.n_attachments, r.extra_tokens) for r in chat.digests(turns).collect()}
    assert found == {1: (2, 3, 4 + 38 + 1024), 2: (2, 2, 2), 3: (3, 0, 0)}


def test_very_long_turn(spark):
    said = "<|a<\\|" * 300_000
    row = chat.digests(chat.format_turns(spark.createDataFrame([(1, 0, "assistant", said)], "conv_id long, turn long, role string, text string"))).first()
    assert row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 2, "assistant", None), (1, 0, "system", "é\n"), (1, 1, "user", "x"), (None, 0, "assistant", "n"), (2, None, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, None, "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        groups[c].append((r or "", x or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# 5: suffix arrays


def test_suffix_family_against_a_set():
    rng = np.random.default_rng(1)
    family, keys = suffixes.SuffixFamily(), []
    for _ in range(9):
        batch = rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64)
        family.add(batch, np.arange(len(keys), len(keys) + len(batch)), np.zeros(len(batch), np.int64))
        keys.extend(batch.tolist())
    counts = Counter(keys)
    assert family.repeated()[0].tolist() == [i for i, k in enumerate(keys) if counts[k] > 1]
    assert len(family.levels) <= 5


def removed_of(texts, span):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if counts[b[k : k + span]] > 1:
                gone[k : k + span] = True
        edges = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("span, core", [(200, 48), (40, 12)])
def test_suffix_dedup(docs, empty, span, core):
    df, rows = docs
    found = suffixes.remove_repeats(df, span=span, core=core, kept=True)
    expected = [(i, *x) for (i, _, _), x in zip(rows, removed_of([t for _, t, _ in rows], span), strict=True)]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(expected, key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    # many small families, and other columns
    small = suffixes.remove_repeats(df.withColumns({"core": F.lit(1), "piece": F.lit("x"), "removed": F.lit(0)}), span=span, core=core, most=50)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in small.collect()), key=str) == sorted(expected, key=str)
    assert suffixes.remove_repeats(empty).count() == 0


# 6: Jaccard


def sets_of(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in texts:
        w = WORDS.findall((t or "").translate(lower))
        yield frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows, count=False):
    sets = list(sets_of(t for _, t, *_ in rows))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    if count:
        return len({top(i) for i in range(len(rows)) if sets[i]})
    least = {i: min((rows[j][0] for j in group if rows[j][0] is not None), default=None) for group in groups.values() for i in group}
    return sorted(((r[0], len(s), least[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard(spark, docs, empty):
    df, rows = docs
    assert collected(jaccard.join_result(df)) == components_of(rows)
    assert jaccard.join_result(empty).count() == 0
    one = jaccard.keep_one(df)
    assert one.columns == df.columns
    wordless = sum(not s for s in sets_of(t for _, t, _ in rows))
    assert one.count() == wordless + components_of(rows, count=True)


def test_jaccard_of_a_large_group(spark):
    """Near copies with many edits, so that components form over several rounds."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        mine = words[:]
        for _ in range(rng.randrange(4)):
            mine[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine + [f"t{i}"] * rng.randrange(3))))
    rows += [(200 + i, " ".join(words[:60] + [f"u{i}x{k}" for k in range(90)])) for i in range(40)]
    assert collected(jaccard.join_result(spark.createDataFrame(rows, "doc_id long, text string"))) == components_of(rows)


# 7: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((700, 12)) * rng.uniform(0.5, 2, (700, 1))).astype(np.float32)
    vectors[100:130] = vectors[100]
    bad = [(9000, None), (9001, [0.0] * 12), (9002, [float("nan")] * 12), (9003, [None] * 12), (9004, [float("inf")] + [1.0] * 11), (9005, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())] + bad, "vec_id long, embedding array<float>")
    found = defaultdict(dict)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, block_rows=200).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 700, 20))
    hits = 0
    for q, ranks in found.items():
        scores = vectors.astype(float) @ vectors[q].astype(float)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(700), -scores))[:20].tolist()
        got = [ranks[k] for k in range(1, 21)]
        assert q not in dict(got) and got == sorted(got, key=lambda x: (-x[1], x[0])) and all(abs(s - scores[i]) < 1e-9 for i, s in got)
        hits += len(set(best) & {i for i, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    few = neighbours.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3, 4]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_are_those_of_the_vectors_given(spark):
    """Double components keep their digits, and equal vectors tie exactly whatever their place."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 384))
    vectors[40:90] = vectors[40]
    vectors[0] = vectors[40] + 0.01 * vectors[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = sorted((r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0, block_rows=70).collect())
    assert [i for _, i, _ in found] == list(range(40, 60)) and len({s for _, _, s in found}) == 1
    assert found[0][2] == pytest.approx(float(vectors[0] @ vectors[40]), rel=1e-14)


# 9: HTML


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body><header><a href=/>Home</a></header>
    <nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar"><p>Side text here</p></div>
    <article><h1>Head &amp; line</h1><p>First   <b>bold</b><br>text of the article, which is long enough to count.<p>Second &eacute;&#x41; paragraph <a href=x>with a link</a>, longer than the menu.<form><input><button>Go</button></form><!-- no -->
    <ul><li>Point one</li><li>Point two</li></ul></article><section class="comments"><p>A reader's comment that goes on and on and on and on, for long.</p></section></div><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nFirst bold text of the article, which is long enough to count.\nSecond éA paragraph with a link, longer than the menu.\nPoint one\nPoint two"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<html></html>"), (5, "u", "plain words only"), (6, "u", "<div>" * 3000 + "<p>deep</p>"), (7, None, "<p>a<td>b</li></div>")]
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == found[3] == found[4] == ("", 0) and found[5] == ("plain words only", 16) and found[6] == ("deep", 4) and found[7][0].replace("\n", "") == "ab"


def test_html_by_names(spark):
    """The article's own header stays; reader comments go whatever else their name holds; names of sentences are no menus."""
    words = "".join(f"w{i:03d} " for i in range(60)).strip()
    page = f"""<body><header><h2>Site</h2></header><article><header><h1>Title</h1><p>By line</p></header><p class="social">One {words}</p><p>Two {words}</p><p class="notice">Cookies here.</p></article>
    <div class="post-comments"><p>First! {words}</p></div><section class="comment-content"><p>{words} Second!</p></section><div class="share content-tools"><p>x {words}</p></div></body>"""
    assert html.main_text(page).split("\n")[:4] == ["Title", "By line", f"One {words}", f"Two {words}"] and "First!" not in html.main_text(page) and "Second!" not in html.main_text(page) and "Cookies" not in html.main_text(page)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).columns == ["page_id", "url", "text", "n_chars"] and html.extract(empty).count() == 0
    clash = spark.createDataFrame([(1, "<p>a</p>", "old", 5, "k")] * 2, "page_id long, html string, text string, n_chars int, root string")
    assert [tuple(r) for r in html.extract(clash).select("page_id", "text", "n_chars", "root").collect()] == [(1, "a", 1, "k")] * 2


def test_html_of_any_depth():
    began = time.process_time()
    assert html.main_text("<b>x</i></u>" * 60_000).replace(" ", "") == "x" * 60_000
    assert html.main_text("<div><p>" * 60_000 + "deep") == "deep"
    assert time.process_time() - began < 20


@pytest.mark.parametrize("outer", ["<div id=content>{}</div>", "<main>{}</main>", "<div><div>{}</div></div>", "<main><div>{}</div></main>", "{}"])
def test_html_of_several_sections(outer):
    """Sections beside each other are main text, whatever holds them; lists of links beside them are not."""
    words = "".join(f"w{i:04d} " for i in range(50)).strip()
    section = lambda i: f"<div class=sec><h2>Part {i}</h2>" + "".join(f"<p>{i}{k} {words}</p>" for k in range(3)) + "</div>"
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Other page number {i}</a></li>" for i in range(12)) + "</ul></div>"
    body = f"<h1>Title</h1>{section(1)}{section(2)}<h2>Between</h2><p>Short.</p>{section(3)}{section(4)}"
    expected = ["Title"]
    for i in range(1, 5):
        expected += ["Between", "Short."] * (i == 3) + [f"Part {i}"] + [f"{i}{k} {words}" for k in range(3)]
    assert html.main_text(f"<html><body>{links}{outer.format(body)}{links}</body></html>").split("\n") == expected
    two = f"<h1>Title</h1>{section(1)}{links}{section(2)}{links}"
    assert html.main_text(f"<html><body>{outer.format(two)}</body></html>").split("\n") == expected[:9]
    assert html.main_text('<p>One <a href=/1>link</a> here.</p><p><a href=/2>A line of link only</a></p>Bare <a href=/3>text</a>.') == "One link here.\nA line of link only\nBare text."


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.text(alphabet="ab ", min_size=1, max_size=12), lambda x: st.tuples(st.sampled_from(["div", "p", "a", "b"]), st.lists(x, max_size=4)), max_leaves=14))
def test_density_against_its_formula(tree):
    """Every node's density and density sum, from counts made anew for each node."""
    root = html.Node("html")

    def build(node, x):
        if isinstance(x, str):
            node.children.append(x)
        else:
            child = html.Node(x[0])
            node.children.append(child)
            for y in x[1]:
                build(child, y)

    build(root, ("div", [tree]))
    inner = lambda n: [x for x in n.children if isinstance(x, html.Node)]
    below = lambda n: [y for x in inner(n) for y in (x, *below(x))]
    text = lambda n: "".join(x if isinstance(x, str) else text(x) for x in n.children)
    chars = lambda n: len(text(n).replace(" ", ""))
    links = lambda n: chars(n) if n.tag == "a" else sum(links(x) for x in inner(n))

    def density(n):
        c, lc, t, lt = chars(n), links(n), max(1, len(below(n))), max(1, sum(x.tag == "a" for x in below(n)))
        if not c or lc >= c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + links(root) / max(1, chars(root)) * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base

    for n in html.measure(root):
        own = sum(len(x.strip()) for x in n.children if isinstance(x, str)) if n.tag not in ("a", "p") else 0
        assert n.density == pytest.approx(density(n)) and n.density_sum == pytest.approx(sum(map(density, inner(n))) + own)


# 10: mix


def test_mix(docs, empty):
    df, rows = docs
    clashing = {c: F.lit("x") for c in ("size", "copies", "t_source", "__mix_source", "__mix_hash", "salt", "prefix", "whole", "source_size", "a.b")}
    found = mixing.mix_sources(df.withColumns(clashing))
    got = found.collect()
    assert found.columns[:8] == [*df.columns, "t_source", "__mix_source"] and {r.whole for r in got} == {"x"}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, left = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: left * weight[s] / total for s in free}
    largest = max(r["size"] for r in got)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest
    assert all(r.taken == r["size"] * r.copies and r.copies <= 3 for r in got) and len(got) == len(rows)
    assert collected(found) == collected(mixing.mix_sources(df.withColumns(clashing), broadcast_sources=0))
    assert mixing.mix_sources(empty).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfklm" for b in "aeiou" for c in ("n", "r", "st", "ck")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(60) for _ in range(40)] + [None, "", "too short", "again and again once more " * 20, prose(50) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(20)]
    texts += [texts[0], texts[1] + " end"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    kept = {r.doc_id for r in found}
    assert all(r.round_trip for r in found) and not kept & {40, 41, 42, 43, 45, 46}
    enc = encoding()
    for r in found:
        text = texts[r.doc_id]
        if r.doc_id == 44:
            text = re.sub(r'token = "\w+', "[secret]", text)
        assert list(r.ids) == enc.encode_ordinary(text)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))




SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_chat_format", "op5_suffix_dedup", "op6_ngram_jaccard"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__

    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'").fetchall()
    df = __spark_entry__.queries()[name](spark, SMALL)
    got = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert collected(df.select(*names)) == sorted(got.fetchall(), key=str)


def test_queries_run_on_whole_tables(spark):
    """Every other operator's query, on a test table, against the plain versions above."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    enc = encoding()
    found = {r.doc_id: r for r in queries["op1_byte_bpe"](spark, SMALL).collect()}
    assert len(found) == len(docs) and all(found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest() and found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in docs)
    found = {r.doc_id: r for r in queries["op2_secret_scan"](spark, SMALL).collect()}
    kinds = ("assign", "access", "hex")
    for i, t in docs:
        base = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(t or ""))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and ",".join(x for x in found[i].spans.split(",") if not x.startswith("random")) == base
    found = {r.doc_id: r for r in queries["op3_quality_rules"](spark, SMALL).collect()}
    for i, t in docs:
        n, chars, symbols, lines, repeats = counts_of(t)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, n < 10 or 100 * repeats > 20 * n) and not (r.kept and r.base_failed)
    rows = queries["op8_token_files"](spark, SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(i for i, _ in docs) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    pages = queries["op9_html_text"](spark, SMALL).collect()
    assert len(pages) == 50 and all(r.n_chars == len(r.text) > 0 and "<" not in r.text for r in pages)
    taken = queries["op10_mix_sources"](spark, SMALL).collect()
    assert len(taken) == len(docs) and all(r.taken <= 3 * r["size"] for r in taken)


def test_recall_of_the_query(spark):
    import __spark_entry__

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(set)
    for r in __spark_entry__.queries()["op7_hash_prefix_forest"](spark, SMALL).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        hits += len(found[ids[at]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()
