import hashlib
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions import text as tx
from tidemark.operators import insights
from tidemark.plans import report as rp
from tidemark.schema import DAY_MS


@pytest.mark.parametrize("days,want", [(1, 1), (7, 7), (60, 31), (0, 0), (0.5, 1)])
def test_grid(days, want):
    assert rp.grid_size(0, int(days * DAY_MS)) == want


def test_depth(spark):
    quota = lambda counts, daily, weekly: [r.quota for r in rp.plan_depth(spark.createDataFrame(list(enumerate(counts)), "period long, n long"), daily, weekly).orderBy("period").collect()]
    assert quota([100, 10, 3], 40, 200) == [40, 10, 3]
    assert quota([100] * 90, 40, 200) == [3] * 90 and quota([50, 50], 2, 200) == [3, 3] and quota([100] * 10, 40, 200) == [20] * 10


def plain_fold(costs, budget):
    batch, spent, out = 0, 0, []
    for c in costs:
        if spent and spent + c > budget:
            batch, spent = batch + 1, 0
        spent += c
        out.append(batch)
    return out


def test_batches_and_packing(spark):
    rng = random.Random(3)
    rows = [(g, k, "x" * rng.randint(0, 300), "day 1") for g in range(6) for k in range(25)]
    df = spark.createDataFrame(rows, "g long, k long, text string, label string")
    got = {(r.g, r.k): (r.batch, r.label) for r in rp.batch_labels(rp.batches(df, 200, "g", ["k"]), "g").collect()}
    packed = {(r.g, r.k): r.cut for r in rp.pack_context(df, 400, "g", ["k"]).collect()}
    for g in range(6):
        own = [(k, rp.estimate(t) + 6) for q, k, t, _ in rows if q == g and t]
        want = plain_fold([c for _, c in own], 200)
        n = max(want) + 1
        assert [got[g, k] for k, _ in own] == [(b, f"day 1 (part {b + 1} of {n})" if n > 1 else "day 1") for b in want]
        spent, kept = 0, []
        for k, c in own:
            spent += c
            if spent > 400:
                break
            kept.append(k)
        assert sorted(k for q, k in packed if q == g) == kept
    one = spark.createDataFrame([(1, 1, "é" * 900), (1, 2, "b")], "g long, k long, text string")
    assert [(r.k, r.cut, r.text) for r in rp.pack_context(one, 100, "g", ["k"]).collect()] == [(1, True, "é" * 94)]


class Fake:
    context_tokens = 8192

    def __init__(self, words=5):
        self.calls, self.words = [], words

    def summarise(self, prompt, texts, reply_tokens):
        self.calls.append(texts)
        return "w " * self.words, [i for i, _ in texts]


def groups(periods, each, size=20):
    return [(f"day {p + 1}", [(p * each + k, "t" * size, 1000 - p * each - k) for k in range(each)]) for p in range(periods)]


def test_report_modes():
    fake = Fake()
    empty = rp.generate_report([], fake, 1)
    assert (empty.mode, fake.calls) == ("empty", [])
    small = rp.generate_report(groups(1, 5), fake, 1)
    assert (small.mode, small.passes, small.frames_summarized, small.frames_sampled) == ("single_pass", 1, 5, 5)
    assert [i for i, _ in fake.calls[0]] == [4, 3, 2, 1, 0]  # in order of time
    assert [i for i, _ in (rp.generate_report(groups(1, 5), fake, 1, by_time=False), fake.calls[-1])[1]] == [0, 1, 2, 3, 4]
    week = rp.generate_report(groups(7, 10), Fake(), 7)
    assert (week.mode, week.passes, week.periods_covered, week.truncated) == ("map_reduce", 8, 7, False)
    assert {0, 69} <= set(week.cited) and week.frames_summarized == 70
    long = rp.generate_report(groups(7, 10), Fake(words=2000), 7)
    assert long.passes >= 9 and {0, 69} <= set(long.cited)
    many = rp.generate_report(groups(100, 3), Fake(), 100)
    assert many.truncated and many.passes <= 65
    with pytest.raises(rp.Cancelled):
        rp.generate_report(groups(2, 20), Fake(), 2, cancelled=lambda: True)


def test_report_edges():
    blank = Fake(words=0)
    out = rp.generate_report(groups(3, 10), blank, 3)
    assert (out.mode, out.passes, out.cited, len(blank.calls)) == ("empty", 0, [], 3)
    fake = Fake()
    assert rp.generate_report([("day 1", [])], fake, 1).mode == "empty" and rp.generate_report([("day 1", [(1, " ", 0)])], fake, 1).mode == "empty" and not fake.calls
    short = Fake()
    short.context_tokens = 2000
    split = rp.generate_report(groups(1, 50, 2000), short, 1)
    assert (split.mode, split.periods_covered) == ("map_reduce", 1) and split.frames_summarized == 50
    assert all(sum(rp.estimate(t) + 6 for _, t in texts) <= 2000 for texts in short.calls)
    exact = rp.generate_report(groups(64, 3), Fake(), 64)
    assert exact.truncated and exact.passes == 65
    assert not rp.generate_report(groups(63, 3), Fake(), 63).truncated
    citing = Fake()
    citing.summarise = lambda prompt, texts, reply, base=citing.summarise: (base(prompt, texts, reply)[0] * 400, [i for i, _ in texts] or [7])
    deep = rp.generate_report([(label, [(i + 1, t, at) for i, t, at in chunks]) for label, chunks in groups(20, 3)], citing, 20)
    assert deep.passes > 21 and 0 not in deep.cited and deep.frames_summarized == 60
    many = rp.generate_report(groups(10, 60), Fake(), 10)
    assert len(many.cited) == 200 and many.frames_summarized == 600


def test_coverage_skips_blank_texts(spark):
    frames = spark.createDataFrame([(k, k * DAY_MS // 4) for k in range(12)], "frame_id long, captured_at long")
    texts = spark.createDataFrame([(k, " " if k == 5 else f"t{k}") for k in range(12)], "frame_id long, content_text string")
    got = rp.coverage_groups(frames, texts, 0, 3 * DAY_MS).collect()
    assert {r.label for r in got} == {"day 1", "day 2", "day 3"} and sorted(r.frame_id for r in got) == [k for k in range(12) if k != 5]
    assert rp.coverage_groups(frames, texts, 5, 5).count() == 0


def one(spark, make, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)).select(make(*map(F.col, columns)).alias("x")).first().x


def test_replies_and_streams(spark):
    parse = lambda text: tuple(one(spark, sc.reply_struct, r=text))
    assert parse('```json\n{"description": " a ", "activity_type": "Coding", "app_hint": "ed", "confidence": 0.5}\n```') == ("a", "coding", "ed", 0.5)
    assert parse('{"description": "a", "activity_type": "unknown", "app_hint": "null", "confidence": 7}') == ("a", None, None, -1.0)
    assert parse("just words") == ("just words", None, None, -1.0) and parse('{"description": " "}') == ('{"description": " "}', None, None, -1.0)
    sse = lambda text: one(spark, sc.sse_deltas, r=text)
    assert tuple(sse('data: {"choices": [{"delta": {"content": "hi"}}]}')) == (False, False, "hi")
    assert tuple(sse('data: {"choices": [{"delta": {"reasoning_content": "hm"}}]}')) == (False, True, "hm")
    assert sse("data: [DONE]").done and sse(": note") is None and sse("data: {bad") is None


@pytest.mark.parametrize("app,title,entries,want", [("Bank App", None, ["bank"], True), (None, "My BANK", [" bank "], True), ("x", "y", ["", "  "], False), (None, None, ["a"], False)])
def test_deny_list(spark, app, title, entries, want):
    assert one(spark, lambda a, t: sc.is_excluded(a, t, entries), a=app, t=title) is want


def test_paths_rectangles_and_settings(spark):
    assert one(spark, lambda t, i: sc.day_shard_path(t.cast("long"), i), t="-1", i="7") == "frames/-1/7.jpg"
    assert one(spark, sc.is_frame_path, p="frames/1/2.jpg") and not one(spark, sc.is_frame_path, p="frames/../x") and not one(spark, sc.is_frame_path, p="/etc/x")
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    assert tuple(one(spark, lambda _: sc.rect_in_monitor(box(-10, 0, 60, 50), box(0, 0, 100, 100)), a="")) == (0.0, 0.0, 0.5, 0.5)
    assert one(spark, lambda _: sc.rect_in_monitor(box(200, 0, 60, 50), box(0, 0, 100, 100)), a="") is None
    assert [sc.clamp_setting(*x) for x in (("capture_interval_ms", 1), ("change_threshold", float("nan")), ("max_width", 100000), ("worker_concurrency", 0), ("ctx_size", 0), ("ctx_size", 100), ("ctx_size", 999999))] == [250, 0.0, 7680, 1, 0, 512, 32768]
    assert (sc.parse_setting("Yes", False), sc.parse_setting("x", 5), sc.parse_setting("7", 5), sc.parse_setting(None, "a"), sc.format_setting(True)) == (True, 5, 7, "a", "true")
    said = lambda age: one(spark, lambda a: sc.relative_time(F.lit(1_700_000_000_000) - a.cast("long"), F.lit(1_700_000_000_000)), a=str(age * 1000))
    assert [said(x) for x in (-5, 10, 44, 45, 89, 90, 600, 3599, 3600, 7199, 7200, 86_399, 86_400, 172_799, 172_800, 604_799, 604_800)] == ["just now"] * 3 + ["1m ago"] * 2 + ["2m ago", "10m ago", "60m ago", "1h ago", "1h ago", "2h ago", "24h ago", "yesterday", "yesterday", "2d ago", "7d ago", "Nov 7, 2023"]


def test_scalars_of_charts_and_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-03-20', DATE'2023-11-05')) AS day")
    for zone in ("Europe/Berlin", "America/New_York", "UTC"):
        midnight = lambda d, z=ZoneInfo(zone): int(datetime(d.year, d.month, d.day, tzinfo=z).timestamp() * 1000)
        for r in days.select("day", sc.local_day_range(F.col("day"), zone).alias("r")).collect():
            assert (r.r.start, r.r.end) == (midnight(r.day), midnight(r.day + timedelta(days=1)))
    assert [sc.bucket_count(*x) for x in ((1000, 10, 24, 720), (90, 10, 24, 720), (99999, 10, 24, 720), (305, 10, 1, 99))] == [100, 24, 720, 31]
    assert sc.nearest_rank([5, 1, 4, 2, 3]) == 5 and sc.nearest_rank(list(range(20))) == 19 and sc.nearest_rank(list(range(100))) == 95 and sc.nearest_rank([]) is None
    assert [one(spark, lambda a: sc.worst_status(F.split(a, ",")), a=x) for x in ("ready,initializing,odd", "disabled,ready", "error,unavailable", "odd")] == ["initializing", "ready", "error", "unknown"]
    assert one(spark, sc.content_hash, a="é") == hashlib.sha256("é".encode()).hexdigest()
    values = spark.createDataFrame([(float(x),) for x in list(range(3000)) * 2], "v double")
    assert tuple(insights.latency_percentile(values, "v").first()) == (6000, float(sorted(list(range(3000)) * 2)[5700]))
    assert insights.latency_percentile(values.limit(0), "v").count() == 0
    cut = lambda text, n: spark.createDataFrame([(text,)], "t string").select(tx.truncate_bytes(F.col("t"), n).alias("x")).first().x
    for n in range(0, 14):
        assert cut("aé日😀b", n) == "aé日😀b".encode()[:n].decode("utf-8", "ignore")
