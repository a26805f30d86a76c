import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ingest, lists, outbox
from tidewatch.operators import similarity as sim
from tidewatch.operators.components import connected_components
from tidewatch.plans.snapshots import Snapshots, still_valid
from tidewatch.sources import exports, landing
from tidewatch.streaming.changes import change_stream, enqueue


def test_components_in_many_tasks(spark):
    rows = [(i, i + 3) for i in range(1, 70)] + [(1000, 1001), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long"), task_links=30).collect()}
    assert {found[i] for i in range(1, 73)} == {1, 2, 3} and all(found[i] == (i - 1) % 3 + 1 for i in range(1, 73)) and found[1001] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dice_against_brute_force(spark):
    texts = ["abcdefgh", "abcdefgx", "abcdefgh", "zz", "z", "", "hgfedcba", "abcdefghabcdefgh"]
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "review_id long, shop_key string, normalized string")

    def dice(a, b):
        grams = [sorted(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in (a, b)]
        left = grams[1][:]
        shared = sum(1 for g in grams[0] if g in left and not left.remove(g))
        return 2 * shared / (len(grams[0]) + len(grams[1]))

    for scope in (None, "same", "cross"):
        expected = {(i, j) for i, s, a in rows for j, t, b in rows if i < j and a and b and dice(a, b) >= 0.5 and (scope is None or (s == t) == (scope == "same"))}
        assert {(r.left_id, r.right_id) for r in sim.dice_pairs(df, 0.5, scope).collect()} == expected


def test_short_texts_need_copies(spark):
    row = lambda *x: spark.range(1).select(sim.admitted(*map(F.lit, x)).alias("x")).first().x
    assert row(1.0, 1.0, True, True, 3) and not row(1.0, 1.0, True, True, 2) and not row(1.0, 1.0, True, False, 9)
    assert row(0.85, None, False, False, 0) and row(None, 0.92, False, False, 0) and not row(0.84, 0.91, False, False, 0)


def test_time_cluster(spark):
    rows = [("a", 1), ("a", 10), ("a", 15), ("b", 1), ("b", 10), ("b", 16), ("c", None)]
    found = {r.g: r.has_cluster for r in sim.time_cluster(spark.createDataFrame(rows, "g string, posted_day int"), "g").collect()}
    assert found == {"a": True, "b": False, "c": False}


def test_runs_and_estimates_against_a_fold(spark):
    at = dt.datetime(2026, 7, 20, 2)
    said = ["2 週前", "2 週前", "3 週前", "4 週前", "5 minutes ago"]
    rows = [("x", i, at + dt.timedelta(hours=i), t) for i, t in enumerate(said)] + [("y", 0, at, "17 分鐘前"), ("y", 1, at, "2 週前"), ("y", 2, at, "3 週前")]
    runs = ingest.observation_runs(spark.createDataFrame(rows, "k string, seq int, at timestamp_ntz, t string"), "k", "seq", "at", "t")
    assert {(r.k, r.run, r.observations) for r in runs.collect()} == {("x", 1, 2), ("x", 2, 1), ("x", 3, 1), ("x", 4, 1), ("y", 1, 1), ("y", 2, 1), ("y", 3, 1)}
    found = {r.k: (r.back_at, r.estimated_date) for r in ingest.transition_estimates(runs, "k").collect()}
    assert found["x"][1] == dt.date(2026, 6, 29) and found["y"] == (at - dt.timedelta(minutes=17), None)


def test_changes_and_versions(spark):
    rows = [("r", 0, "a", ""), ("r", 1, "a", "thanks"), ("r", 2, "b", "thanks!"), ("r", 3, "b", "")]
    df = spark.createDataFrame(rows, "k string, seq int, t string, reply string")
    events = ingest.change_events(df, ["k"], "seq", F.col("t"), F.col("reply")).orderBy("seq").collect()
    assert [r.event for r in events] == ["review_new", "none", "review_updated", "none"]
    assert [r.reply_event for r in events] == ["none", "owner_reply_added", "owner_reply_added", "owner_reply_removed"]
    old = df.select("k", F.col("t").alias("content_hash"), F.col("seq").alias("captured_at"))
    assert {tuple(r) for r in ingest.new_versions(old, old, ["k"]).collect()} == {("r", "a", 0), ("r", "b", 2)}


def test_alert_once(spark):
    rows = [("s", i, x) for i, x in enumerate("fffffsfffsf")]
    found = ingest.failure_alerts(spark.createDataFrame(rows, "k string, seq int, x string"), "k", "seq", F.col("x") == "f").orderBy("seq").collect()
    assert [(r.seq, r.signal) for r in found] == [(2, "alert"), (5, "recovered"), (8, "alert"), (9, "recovered")]


def test_fragments_without_id_stay_alone(spark):
    rows = [("a", 0, "", "r"), ("a", 1, "t", "s"), ("", 0, "u", ""), (None, 0, "v", "")]
    found = ingest.merged_fragments(spark.createDataFrame(rows, "id string, ord int, review_text string, reply_text string"))
    assert sorted((r.review_text, r.reply_text) for r in found.collect()) == [("t", "r"), ("u", ""), ("v", "")]


def test_queue(spark):
    events = spark.createDataFrame([("k", ["a", "b"]), ("k", ["a", "b"]), ("old", ["c"])], "event_key string, parts array<string>")
    fresh = outbox.fresh_events(events, spark.createDataFrame([("old",)], "event_key string"))
    parts = outbox.numbered_parts(fresh)
    assert sorted((r.part_no, r.part) for r in parts.collect()) == [(0, "a"), (1, "b")]


def test_names_and_pages(spark):
    rows = [("Ａnn  Lee", "s1", "https://p/1"), ("ann lee", "s2", "https://p/2"), ("Anonymous", "s1", ""), ("Anonymous", "s2", "")]
    found = lists.same_names(spark.createDataFrame(rows, "author string, shop_key string, profile_url string")).collect()
    assert [(r.shop_count, r.identity_status) for r in found] == [(2, "different_profiles")]
    with pytest.raises(ValueError):
        lists.pages(spark.range(1), ["id"], [F.col("id")], 0, 10)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/runs")
    with pytest.raises(LookupError):
        s.read("groups")
    first = s.start()
    s.publish(first, {"groups": spark.range(3)})
    second = s.start()
    assert s.read("groups").count() == 3
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        s.publish(second, {"groups": broken})
    assert s.current() == first and {r.run_id: r.status for r in s.runs().collect()} == {first: "completed", second: "failed"}
    s.publish(s.start(), {"groups": spark.range(5)})
    assert s.read("groups").count() == 5


def test_changed_member_drops_its_group(spark):
    groups = spark.createDataFrame([(1,), (2,)], "component int")
    members = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "component int, review_id int, t string").withColumn("text_hash", F.sha2("t", 256))
    now = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "c")], "review_id int, text string")
    assert [r.component for r in still_valid(groups, members, now).collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{i % 3}", i, "ab"[i % 4 // 2], "xy"[i % 2] if i % 5 else "") for i in range(24)]
    schema = "review_key string, seq long, content_hash string, reply_hash string"
    for at in (0, 12):  # two micro-batches
        spark.createDataFrame(rows[at : at + 12], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    enqueue(change_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    batch = ingest.change_events(spark.createDataFrame(rows, schema), ["review_key"], "seq", F.col("content_hash"), F.col("reply_hash"))
    expected = {(r.review_key, r.event) for r in batch.filter("event <> 'none'").collect()}
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.review_key, r.event) for r in found} == expected and len({r.event_key for r in found}) == len(found)


def test_sources_and_exports(spark, tmp_path):
    (tmp_path / "s.toml").write_text('scan_limit = 20\n[[shops]]\nname = "a"\nurl = "https://maps.google.com/x"\n[[shops]]\nname = "b"\nurl = "https://maps.google.com/y"\nenabled = false\n')
    assert [s.name for s in landing.load_settings(str(tmp_path / "s.toml")).shops] == ["a"]
    (tmp_path / "s.toml").write_text('[[shops]]\nname = "a"\nurl = "http://example.com/x"\n')
    with pytest.raises(ValueError):
        landing.load_settings(str(tmp_path / "s.toml"))
    asset = {"id": "1", "shop_key": "s", "published_at": "2026-01-01", "title": "t", "body": "b", "photos": ["p"]}
    (tmp_path / "a.json").write_text(json.dumps([asset, asset | {"id": "2", "published_at": "2026-02-01"}]))
    assert [r.id for r in landing.load_assets(spark, str(tmp_path / "a.json")).collect()] == ["2", "1"]
    (tmp_path / "r.json").write_text(json.dumps({"common_phrases": [{"phrase": "x"}]}))
    with pytest.raises(ValueError):
        landing.load_rules(spark, str(tmp_path / "r.json"))
    review = spark.createDataFrame([{"review_id": "1", "shop_key": "s", "photo_urls": ["u"], "profile": {"url": "p"}}], landing.REVIEW)
    exports.write_csv(exports.flat(review), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv").first().photo_urls == '["u"]'
    names = exports.backup(str(tmp_path / "csv"), str(tmp_path / "b.zip"))
    assert exports.restore(str(tmp_path / "b.zip"), str(tmp_path / "back")) == names
    with pytest.raises(FileExistsError):
        exports.restore(str(tmp_path / "b.zip"), str(tmp_path / "back"))


def test_alike_in_many_chunks(spark, monkeypatch):
    """Several chunks, more bigrams than columns, letters of four bytes, long runs of one letter; no row meets others in a shuffle of texts."""
    from tidewatch.operators import alike

    for name, value in {"CHUNK_ROWS": 30, "FILE_BYTES": 1500, "COLUMNS": 24, "SHARED": 8}.items():
        monkeypatch.setattr(alike, name, value)
    rng = random.Random(2)
    bases = ["".join(rng.choices("abcdefgh", k=40)), "".join(rng.choices("漢字語文章", k=30)), "\U00020000\U00020001￿" * 9, "a" * 70_000, "b"]
    texts = []
    for i in range(60):
        t = list(bases[i % 5])
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = rng.choice("xyz漢")
        texts.append("".join(t))
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "review_id long, shop_key string, normalized string")
    grams = [Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in texts]
    dice = {(i, j): 2 * (grams[i] & grams[j]).total() / (grams[i].total() + grams[j].total()) for j in range(60) for i in range(j)}
    for scope in (None, "same", "cross"):
        expected = {k: d for k, d in dice.items() if d >= 0.85 and (scope is None or (k[0] % 3 == k[1] % 3) == (scope == "same"))}
        found = sim.dice_pairs(df, 0.85, scope)
        assert {(r.left_id, r.right_id): r.dice for r in found.collect()} == pytest.approx(expected) and len(expected) > 20
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    root = list(range(60))
    for _ in range(60):
        for (i, j), d in dice.items():
            if d >= 0.85:
                root[i] = root[j] = min(root[i], root[j])
    linked = {i for k, d in dice.items() if d >= 0.85 for i in k}
    assert {r.review_id: r.component for r in sim.dice_members(df, 0.85).collect()} == {i: root[i] for i in linked}


def test_analysis_by_dice_deals_no_texts_to_blocks(spark, monkeypatch):
    from tidewatch.operators import insight

    monkeypatch.setattr(sim, "blocked_self_join", None)
    texts = ["a long enough review", "a long enough reviev", "a long enough review", "quite another text here", "ok", "ok", "ok"]
    rows = [(i, f"s{i % 2}", t, 5.0, "", i, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "review_id long, shop_key string, text string, stars double, profile_url string, posted_day int, first_seen_seq long")
    found = insight.analyze(df, at=insight.Thresholds(lexical=0.9, counted=r"\p{L}"), ratio=False)
    got = {(r.scope, r.review_id, round(r.max_lexical, 4)) for r in found["members"].collect()}
    near = round(2 * 15 / 32, 4)
    assert got == {("same", 0, 1.0), ("same", 2, 1.0), ("cross", 0, near), ("cross", 1, near), ("cross", 2, near), *(("cross", i, 1.0) for i in (4, 5, 6))}
    assert found["reviews"].count() == len(texts)


def test_hybrid_admission_joins_no_texts(spark, monkeypatch):
    from tidewatch.plans import analysis

    monkeypatch.setattr(sim, "eligible", None)
    assert analysis.hybrid_admission(spark, "/root/testdata/sf0.001").count() > 0
    assert "FlatMapGroups" not in sim.dice_pairs(spark.createDataFrame([(1, "s", "ab")], "review_id long, shop_key string, normalized string"), 0.9)._jdf.queryExecution().toString()
