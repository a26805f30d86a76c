"""Functions and operators against the cases that their sources show."""

import datetime as dt
import difflib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text, times, vectors
from tidewatch.operators import ingest, insight, lists, outbox
from tidewatch.operators import similarity as sim
from tidewatch.plans.snapshots import Snapshots
from tidewatch.sources import exports, landing
from tidewatch.sources.lock import run_lock
from tidewatch.streaming.changes import age_stream, change_stream, enqueue, shop_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# texts


def test_chunks():
    assert text.chunks_of("x" * 1000 + "\n\n", 1000) == ["[1/1]\n" + "x" * 1000]
    assert text.chunks_of("a" * 600 + "\n" + "b" * 399 + "\n" + "c" * 10, 1000)[0] == "[1/2]\n" + "a" * 600
    assert text.chunks_of("a" * 999 + "\n" + "b", 1000) == ["[1/2]\n" + "a" * 999, "[2/2]\nb"]
    assert text.chunks_of("a" * 400 + "\n" + "b" * 900, 1000)[0] == "[1/2]\n" + "a" * 400 + "\n" + "b" * 599
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab\n") for _ in range(rng.randrange(1, 80)))
        pieces = text.chunks_of(t, 12)
        bodies = pieces if len(t) <= 12 else [p.split("\n", 1)[1] for p in pieces]
        assert all(len(b) <= 12 for b in bodies) and "".join(bodies).replace("\n", "") == t.replace("\n", "") and (len(t) <= 12 or all(p.startswith(f"[{i}/{len(pieces)}]\n") for i, p in enumerate(pieces, 1)))


@pytest.mark.parametrize(
    "url, expected",
    [("https://x/y", "https://x/y?hl=en"), ("https://x/y?a=1&a=2&b", "https://x/y?a=2&b=&hl=en"), ("https://x/?hl=de&q=a%20b+c%2F#f", "https://x/?hl=en&q=a+b+c%2F#f"), ("https://x?q=%zz&&e=é*~", "https://x?q=%25zz&e=%C3%A9%2A~&hl=en"), (None, None)],
)
def test_locale(spark, url, expected):
    assert value(spark, text.with_locale(F.lit(url).cast("string"), "en")) == expected


def test_labels_and_media(spark):
    assert value(spark, text.count_label(F.lit("1，123 reviews"), "reviews?")) == 1123
    assert value(spark, text.count_label(F.lit("reviews · 45 photos"), "reviews?")) is None
    assert value(spark, text.media_url(F.lit("a\\b c/é.jpg"))) == "/media/a/b%20c/%C3%A9.jpg"
    assert value(spark, text.redacted(F.lit("bot1234567:ABCDEFGHIJKLMNOPQRSTU ok"))) == "bot[REDACTED] ok"
    assert [value(spark, text.local_video(F.lit(x))) for x in ("a.mp4", "https://v")] == [True, False]
    assert value(spark, text.short_shop_name(F.lit("鬆肌LAY 運動筋膜放鬆 站前 (預約制)"))) == "站前"
    assert value(spark, text.star_marks(F.lit(4.5))) == "★★★★" and value(spark, text.star_marks(F.lit(None).cast("double"))) == "未提供星等"
    assert value(spark, text.without_phrases(F.lit("abcab"), ["ab", "c"])) == ""


def test_message(spark):
    review = {"shop_name": "店", "shop_url": "https://s", "author": "A", "stars": 5.0, "time_text": "2 週前", "text": "好", "profile": {"url": "https://p", "local_guide": True, "review_count": 3}, "photo_paths": [f"p{i}" for i in range(12)], "owner_reply": {"text": "謝謝", "time_text": "1 週前"}}
    df = spark.createDataFrame([(review,)], "review struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in spark.createDataFrame([], landing.REVIEW).schema) + ">")
    row = df.select(text.review_message(F.lit("review_new"), F.col("review"), F.lit("t"), F.lit("b")).alias("m"), F.col("review.photo_paths").alias("p"))
    found = row.select("m", text.message_parts(F.col("m"), F.col("p")).alias("parts")).first()
    assert found.m.split("\n") == ["🆕 新評論", "店家：店", "評論者：A", "星等：5 / 5", "Google 顯示時間：2 週前", "首次偵測：t", "回推發文時間：b", "", "評論內容：", "好", "", "店家回覆（1 週前）：", "謝謝", "", "評論者摘要：Local Guide、3 則評論", "評論者頁面：https://p", "店家連結：https://s", "照片：12 張"]
    assert [(p.kind, len(p.paths or [])) for p in found.parts] == [("text", 0), ("media", 10), ("media", 2)]
    with pytest.raises(Exception, match="no such event"):
        row.sparkSession.range(1).select(text.review_message(F.lit("x"), F.lit(None).cast(df.schema[0].dataType), F.lit("t"))).collect()


# times


def test_stored_times(spark):
    shown = lambda x: value(spark, times.local_text(F.lit(x).cast("string"), "Asia/Taipei"))
    assert [shown(x) for x in (None, "", "2026-07-19T06:40:35+00:00", "2026-07-19T06:40:35", "2026-07-19T08:40:35+02:00", "soon")] == ["—", "—", "2026-07-19 14:40:35", "2026-07-19 14:40:35", "2026-07-19 14:40:35", "soon"]
    assert value(spark, times.strict_instant(F.lit("2026-07-19T06:40:35Z"))) == dt.datetime(2026, 7, 19, 6, 40, 35)
    with pytest.raises(Exception, match="needs a zone"):
        value(spark, times.strict_instant(F.lit("2026-07-19T06:40:35")))
    assert value(spark, times.epoch_seconds(F.lit("1970-01-01"))) is None and value(spark, times.epoch_seconds(F.lit("1970-01-02"))) == 86400
    assert value(spark, times.posted(F.lit(""), F.lit("b"))) == "b" and value(spark, times.posted(F.lit("a"), F.lit("b"))) == "a"


# vectors


def test_pooling_and_packing(spark):
    states = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    assert vectors.masked_mean(states, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[1.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([([1.5, -2.25],), (None,), ([],)], "v array<float>")
    assert [r.x for r in df.select(vectors.unpacked(vectors.packed("v")).alias("x")).collect()] == [[1.5, -2.25], None, []]
    assert value(spark, vectors.unpacked(F.lit(b"[0.5,1]"))) == [0.5, 1.0]


# lists


def test_pages_and_guards(spark):
    df = spark.range(25)
    page = lists.page_of(df, [F.desc("id")], 2, 10).collect()
    assert [r.id for r in page] == list(range(14, 4, -1)) and all(r.has_next for r in page) and [r.row_no for r in page][:2] == [11, 12]
    assert not any(r.has_next for r in lists.page_of(df, [F.desc("id")], 3, 10).collect())
    for bad in (lambda: lists.page_of(df, ["id"], 0, 10), lambda: lists.viewed(df, "none"), lambda: lists.group_order("x"), lambda: lists.filtered_groups(df.withColumn("excluded_reason", F.lit(None)), "other")):
        with pytest.raises(ValueError):
            bad()
    assert value(spark, lists.clamped_page(F.lit(0), F.lit(7), 10)) == 0
    assert lists.boxed(df, 2).count("|") >= 3


def test_names(spark):
    rows = [(" Ann ", "a", "u"), ("ＡＮＮ", "b", " "), ("匿名評論者", "a", ""), ("匿名評論者", "b", ""), ("匿名", "a", "v"), ("匿名", "b", "v")]
    found = {r.name: r.identity_status for r in lists.same_names(spark.createDataFrame(rows, "author string, shop_key string, profile_url string")).collect()}
    assert found == {"ann": "insufficient", "匿名": "same_profile"}
    assert lists.matching(spark.createDataFrame([("ab", None), ("b", "Ａ")], "x string, y string"), ["x", "y"], "a b").count() == 2


# ingestion and sources


def test_point_lookup_and_states(spark):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    assert ingest.one_row(df, id=1).x == "a"
    with pytest.raises(LookupError):
        ingest.one_row(df, id=2)
    scans = spark.createDataFrame([("s", i, ok) for i, ok in enumerate((False, True, False, False, False, False, True))], "shop_key string, scan_no long, ok boolean")
    assert [(r.initialized, r.failures, r.alert_active) for r in ingest.scan_states(scans).orderBy("scan_no").collect()] == [(False, 1, False), (False, 0, False), (True, 1, False), (True, 2, False), (True, 3, True), (True, 4, True), (True, 0, False)]


def test_hashes(spark):
    h = lambda f, *x: value(spark, f(*(F.lit(v).cast("string") for v in x)))
    assert h(hashing.reply_hash, None) == "" and h(hashing.reply_hash, "a") != h(hashing.reply_hash, "b")
    assert h(hashing.fallback_id, "a", "b") != h(hashing.fallback_id, "ab", "") and h(hashing.fallback_id, "a", "b").startswith("fallback-")
    rows = [(g, f"n{i}") for g, n in ((1, 3), (2, 1), (3, 2000)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, n string")
    whole = {r.g: r.f for r in df.groupBy("g").agg(hashing.fingerprint(F.collect_list("n")).alias("f")).collect()}
    assert {r.g: r.fingerprint for r in hashing.fingerprints(df, "g", F.col("n")).collect()} == whole and hashing.fingerprints(df.limit(0), "g", F.col("n")).count() == 0


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with run_lock(path):
        with pytest.raises(RuntimeError), run_lock(path):
            pass
        with run_lock(path, stale_seconds=-1):
            pass
    assert not (tmp_path / "lock").exists()


def test_settings(tmp_path, monkeypatch):
    shop = '\n[[shops]]\nname = "a"\nurl = "https://www.google.com/maps/x"\n'
    monkeypatch.delenv("TELEGRAM_CHAT_ID", raising=False)
    (tmp_path / ".env").write_text("# c\nTELEGRAM_BOT_TOKEN='t'\nexport TELEGRAM_CHAT_ID=5\n")
    read = lambda s, **k: (tmp_path / "c.toml").write_text(s + shop) and landing.load_settings(str(tmp_path / "c.toml"), **k)
    found = read("scan_limit = 20\nshop_delay_min_seconds = 1", needs_token=True)
    assert (found.scan_limit, found.telegram_bot_token, found.telegram_chat_id, found.pauses[0]) == (20, "t", "5", ("shop_delay", 1.0, 45.0)) and found.data_dir == str(tmp_path / "data")
    for bad in ("scan_limit = 201", "known_streak_stop = 51", "scroll_delay_min_seconds = 9", "telegram_batch_limit = 0", "analysis_lexical_threshold = 1.5"):
        with pytest.raises(ValueError):
            read(bad)


def test_assets_and_rules(spark, tmp_path):
    asset = {"id": 1, "shop_key": "s", "published_at": "2026-01-01", "title": "t", "body": "b"}
    put = lambda x: (tmp_path / "x.json").write_text(json.dumps(x)) and str(tmp_path / "x.json")
    assert landing.load_assets(spark, put({"content": [asset]})).first().photos == [] and landing.load_assets(spark, str(tmp_path / "none.json")).count() == 0
    for bad in ([{"id": 1}], [asset | {"videos": [1]}], {"content": "x"}):
        with pytest.raises(ValueError):
            landing.load_assets(spark, put(bad))
    rules = landing.load_rules(spark, put({"common_phrases": [{"text": "服務 很好！", "reason": "r"}, {"text": " ", "reason": "r"}], "exclude_groups": [{"fingerprint": "f", "reason": "r"}]}))
    assert [r.text for r in rules["common_phrases"].collect()] == ["服務很好"] and rules["exclude_groups"].count() == 1 and rules["exclude_reviews"].count() == 0


def test_cards_json_and_csv(spark, tmp_path):
    cards = [("s", 0, "5", "a", ""), ("s", 1, "", "a", ""), ("s", 2, "4", "", ""), ("s", 3, "4", "", "u"), ("s", 4, "3", "b", "")]
    df = spark.createDataFrame(cards, "shop_key string, ord long, stars_label string, author string, profile_url string")
    assert [r.ord for r in landing.complete_cards(df, 2).orderBy("ord").collect()] == [0, 3]
    stored = spark.createDataFrame([('{"review_id":"1","stars":4.5,"photo_urls":["u"],"profile":{"url":"p"}}',), ("broken",)], "snapshot_json string")
    found = landing.decoded(stored).select("review.*").collect()
    assert found[0].stars == 4.5 and found[0].profile.url == "p" and found[1].review_id is None
    exports.write_csv(exports.flat(landing.decoded(stored).select("review.*")).repartition(2), f"file://{tmp_path}/csv")
    size = exports.with_bom(str(tmp_path / "csv"), str(tmp_path / "all.csv"))
    raw = (tmp_path / "all.csv").read_bytes()
    assert len(raw) == size and raw.startswith(exports.BOM + b"shop_name,") and raw.count(b"shop_name,") == 1 and b'["u"]'.replace(b'"', b'""') in raw
    parts = spark.createDataFrame([(1, 0, "x")], "event_id long, part_no int, part string")
    assert [tuple(r) for r in exports.FileSink(f"file://{tmp_path}/sent").send(parts).collect()] == [(1, 0)]
    assert outbox.after_delivery(parts.withColumn("status", F.lit("pending")), parts.select("event_id", "part_no")).first().status == "sent"


def test_run_states(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/runs")
    first = s.start()
    assert s.status().first().run_id == first
    s.log(first, "running", "compare", 140)
    assert s.status().first().percent == 100
    s.publish(first, {"x": spark.range(1)})
    assert (s.status().first().status, s.current()) == ("completed", first)
    assert insight.after_check(lambda: 1) == {"analysis_ok": 1, "analysis_failed": 0}
    said = []
    assert insight.after_check(lambda: 1 / 0, said.append)["analysis_failed"] == 1 and said


# the analysis


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def dice(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_common_length():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, d in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        assert sim.common_length(a, b) == table[-1][-1]
        if a and b:
            known = dice(a, b)
            assert sim.lexical_scores(a, b, known) == pytest.approx((max(known, ratio(a, b)), max(known, ratio(b, a))))


def test_lexical_pairs_find_what_only_the_ratio_admits(spark):
    rng = random.Random(3)
    base = "abcdefghijklmnopqrst"
    texts = [base, "abcdXfghijklmnYpqrst", base[::-1], "", "z", "zz"]
    for _ in range(40):
        t = list(rng.choice(texts[:3]))
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        texts.append("".join(t))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, normalized string")
    expected = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if a and b and max(dice(a, b), ratio(a, b), ratio(b, a)) >= 0.85:
                expected[(j, i)] = (max(dice(a, b), ratio(b, a)), max(dice(a, b), ratio(a, b)))
    found = {(r.left_id, r.right_id): (r.forward, r.backward) for r in sim.lexical_pairs(df, 0.85).collect()}
    assert (0, 1) in expected and dice(texts[0], texts[1]) < 0.85 and set(found) == set(expected)
    # a score may stay below what the ratio is where that doesn't reach the threshold
    for k, scores in expected.items():
        assert max(found[k]) == pytest.approx(max(scores)) and all(x == pytest.approx(y) or y < 0.85 for x, y in zip(found[k], scores, strict=True))


def brute(reviews, rules, lexical_at, least, copies):
    """The analysis as nested loops over rows (newest first), without embeddings."""
    rows = sorted(reviews, key=lambda r: -r["seq"])
    for r in rows:
        r["norm"] = "".join(c for c in r["text"].lower() if c.isalnum() or c == "_")
        for p in rules["phrases"]:
            r["norm"] = r["norm"].replace(p, "")
    counts = Counter(r["norm"] for r in rows)
    letters = lambda r: sum(c.isalpha() for c in r["norm"])
    able = [r for r in rows if r["id"] not in rules["reviews"] and r["norm"] and (letters(r) >= least or counts[r["norm"]] >= copies)]
    out = {}
    for scope in ("same", "cross"):
        local = Counter((r["shop"] if scope == "same" else "*", r["norm"]) for r in able)
        up, scores = {r["id"]: r["id"] for r in able}, defaultdict(float)

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(able):
            for b in able[i + 1 :]:
                if (a["shop"] == b["shop"]) != (scope == "same"):
                    continue
                score = max(dice(a["norm"], b["norm"]), ratio(a["norm"], b["norm"]))
                if letters(a) < least or letters(b) < least:
                    ok = a["norm"] == b["norm"] and local[(a["shop"] if scope == "same" else "*", a["norm"])] >= copies
                else:
                    ok = score >= lexical_at
                if ok:
                    up[top(a["id"])] = top(b["id"])
                    scores[a["id"]], scores[b["id"]] = max(scores[a["id"]], score), max(scores[b["id"]], score)
        groups = defaultdict(list)
        for r in able:
            groups[top(r["id"])].append(r)
        for g in groups.values():
            if len(g) > 1:
                ids = tuple(sorted(r["id"] for r in g))
                days = sorted(r["day"] for r in g if r["day"] is not None)
                urls = defaultdict(set)
                for r in g:
                    if r["url"]:
                        urls[r["url"]].add(r["shop"])
                why = [any(b - a <= 14 for a, b in zip(days, days[2:], strict=False)), any(len(s) > 1 for s in urls.values()), scope == "cross" and len(g) >= 3 and len({r["shop"] for r in g}) > 1]
                stars = [r["stars"] for r in g if r["stars"] is not None]
                turn = "positive" if stars and min(stars) >= 4 else "negative" if stars and max(stars) <= 2 else "mixed"
                out[(scope, ids)] = ("suspected" if any(why) else "highly_similar", turn, round(max(scores[i] for i in ids), 6), {i: round(scores[i], 6) for i in ids})
    return out


def test_whole_analysis_against_nested_loops(spark, tmp_path):
    rng = random.Random(5)
    words = "time river house people water letter great small often never under after".split()
    bases = [" ".join(rng.choices(words, k=8)) for _ in range(9)] + ["good!", "nice", "ok ok"]
    reviews = []
    for i in range(90):
        t = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 3)) if len(t) > 9 else 0):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        reviews.append({"id": i, "shop": f"s{rng.randrange(4)}", "text": "".join(t) + rng.choice(("", "", " Thanks")), "stars": rng.choice((None, 1.0, 2.0, 5.0)), "url": rng.choice(("", "u1", "u2", "u3")), "day": rng.choice((None, rng.randrange(300))), "seq": rng.randrange(10**6)})
    schema = "review_id long, shop_key string, text string, stars double, profile_url string, posted_day int, first_seen_seq long"
    df = spark.createDataFrame([(r["id"], r["shop"], r["text"], r["stars"], r["url"], r["day"], r["seq"]) for r in reviews], schema)
    excluded = [r for r in reviews if r["id"] % 11 == 3]
    rules = insight.Rules(reviews=spark.createDataFrame([(r["shop"], r["id"]) for r in excluded], "shop_key string, review_id long"), phrases=["thanks"])
    at = insight.Thresholds(lexical=0.85, counted=r"\p{L}")
    expected = brute(reviews, {"reviews": {r["id"] for r in excluded}, "phrases": ["thanks"]}, 0.85, 12, 3)
    found = insight.analyze(df, rules, at)
    members = defaultdict(dict)
    for r in found["members"].collect():
        members[r.group_id][r.review_id] = round(r.max_lexical, 6)
    got = {(r.scope, tuple(sorted(members[r.group_id]))): (r.label, r.direction, round(r.max_lexical, 6), members[r.group_id]) for r in found["groups"].collect()}
    assert got == expected and len(expected) > 6
    labels = {r.review_id: r.label for r in found["reviews"].collect()}
    assert len(labels) == 90
    for i, label in labels.items():
        mine = [g[0] for (_, ids), g in expected.items() if i in ids]
        assert label == ("suspected" if "suspected" in mine else "highly_similar" if mine else "")
    # an excluded group stays, with its reason, but counts nowhere
    one = found["groups"].orderBy("group_id").first()
    again = insight.analyze(df, insight.Rules(reviews=rules.reviews, phrases=["thanks"], groups=spark.createDataFrame([(one.fingerprint, "known")], "fingerprint string, reason string")), at)
    assert again["groups"].filter("excluded_reason = 'known'").count() == found["groups"].filter(F.col("fingerprint") == one.fingerprint).count()
    assert insight.statistics(again).first().groups == found["groups"].count() - again["groups"].filter("excluded_reason = 'known'").count()
    empty = insight.analyze(df.limit(0), at=at)
    assert [empty[x].count() for x in ("groups", "members", "reviews")] == [0, 0, 0]
    s = Snapshots(spark, f"file://{tmp_path}/runs")
    done = insight.run(s, df, rules=rules, at=at)
    assert done["reviews"] == 90 and s.read("groups").count() == done["groups"] and s.current() == done["run_id"]
    with pytest.raises(Exception):
        insight.run(s, df.drop("stars"), at=at)
    assert s.current() == done["run_id"] and s.status().first().status == "failed"


def test_semantic_pairs_admit_too(spark):
    class Letters:
        """Embeddings by letter counts; texts of like letters are alike."""

        version = "letters"

        def encode(self, texts):
            out = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float) + 1e-9
            return out / np.linalg.norm(out, axis=1, keepdims=True)

    rows = [(0, "a", "listen to the silent river"), (1, "a", "silent to the listen river"), (2, "b", "river the to silent listen"), (3, "b", "quite another matter altogether")]
    df = spark.createDataFrame([(i, s, t, 5.0, "", None, i) for i, s, t in rows], "review_id long, shop_key string, text string, stars double, profile_url string, posted_day int, first_seen_seq long")
    at = insight.Thresholds(lexical=0.99, semantic=0.97, counted=r"\p{L}")
    found = insight.analyze(df, at=at, provider=Letters())
    assert sorted((r.scope, r.review_count, round(r.max_semantic, 3)) for r in found["groups"].collect()) == [("cross", 3, 1.0), ("same", 2, 1.0)]
    same = found["groups"].filter("scope = 'same'").first()
    a, b = (r[2].replace(" ", "") for r in rows[:2])
    assert same.max_lexical == pytest.approx(max(dice(a, b), ratio(b, a)))


# streams


def test_streams_of_ages_and_shops(spark, tmp_path):
    at = dt.datetime(2026, 7, 20, 2)
    said = {"x": ["2 週前", "2 週前", "3 週前", "4 週前", "5 minutes ago"], "y": ["17 分鐘前", "2 週前", "3 週前"], "z": ["?", "?", "1 個月前", "2 個月前"]}
    rows = [(k, i, at + dt.timedelta(hours=i), t) for k, ts in said.items() for i, t in enumerate(ts)]
    schema = "review_key string, seq long, observed_at timestamp, time_text string"
    for part in (0, 1):  # two micro-batches
        spark.createDataFrame([r for r in rows if (r[1] > 1) == part], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ages")
    session = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ages")
        age_stream(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
        last = {r.review_key: r.x for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("review_key").agg(F.max_by(F.struct("run", "back_at", "estimated_date"), "seq").alias("x")).collect()}
        batch = spark.createDataFrame(rows, schema).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
        runs = ingest.observation_runs(batch, "review_key", "seq", "observed_at", "time_text")
        estimates = {r.review_key: r for r in ingest.transition_estimates(runs, "review_key").collect()}
        n_runs = {r.review_key: r.n for r in runs.groupBy("review_key").agg(F.max("run").alias("n")).collect()}
        for k, x in last.items():
            assert (x.run, x.back_at, x.estimated_date) == (n_runs[k], estimates[k].back_at, estimates[k].estimated_date), k
    finally:
        spark.conf.set("spark.sql.session.timeZone", session)
    scans = [("s", i, ok) for i, ok in enumerate((False, True, False, False, False, False, True, True))]
    for part in (0, 1):
        spark.createDataFrame([r for r in scans if (r[1] > 3) == part], "shop_key string, scan_no long, ok boolean").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/scans")
    source = spark.readStream.schema("shop_key string, scan_no long, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/scans")
    shop_stream(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/shops").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"file://{tmp_path}/shops").orderBy("scan_no").collect()
    assert [r.notify for r in found] == [False, False, True, True, True, True, True, True] and [r.signal for r in found] == [None, None, None, None, "alert", None, "recovered", None]


def test_first_scans_tell_nothing(spark, tmp_path):
    rows = [("r", 0, "a", "", False), ("r", 1, "b", "", True), ("n", 2, "a", "", True)]
    spark.createDataFrame(rows, "review_key string, seq long, content_hash string, reply_hash string, notify boolean").write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema("review_key string, seq long, content_hash string, reply_hash string, notify boolean").parquet(f"file://{tmp_path}/in")
    enqueue(change_stream(source), f"file://{tmp_path}/out", f"file://{tmp_path}/c", "notify").awaitTermination()
    assert {(r.review_key, r.event) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {("r", "review_updated"), ("n", "review_new")}
