import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as cl
from tidemark.operators import timeseries as ts
from tidemark.schema import DAY_MS
from tidemark.sources.tables import Store
from tidemark.streaming import stateful as st


def solid(value, h=8, w=8):
    return np.full((h, w, 4), value, np.uint8)


def test_fingerprints():
    black, white = st.fingerprint(solid(0)), st.fingerprint(solid(255))
    assert st.difference(black, black) == 0 and st.difference(black, white) > 0.9 and st.difference(black, black, same_size=False) == 1.0
    nearly = solid(100)
    nearly[..., 0] += 1
    assert st.difference(st.fingerprint(solid(100)), st.fingerprint(nearly)) < st.THRESHOLD
    assert len(st.fingerprint(solid(9, 100, 200))) == st.GRID**2


def plain_gate(rows, threshold):
    last, kept = {}, []
    for monitor, t, luma in sorted(rows):
        if monitor not in last or st.difference(last[monitor], np.array(luma)) > threshold:
            last[monitor] = np.array(luma)
            kept.append((monitor, t))
    return kept


@pytest.fixture
def luma_rows():
    rng = np.random.default_rng(4)
    level, rows = [100, 50], []
    for t in range(120):
        for m in (0, 1):
            level[m] = int(np.clip(level[m] + rng.integers(-3, 4), 0, 255))
            rows.append((m, t, [level[m]] * 16))
    return rows


def test_gate_against_a_fold(spark, luma_rows):
    df = spark.createDataFrame(luma_rows, "monitor_index int, captured_at long, luma array<int>").repartition(5)
    got = sorted((r.monitor_index, r.captured_at) for r in st.change_gate(df, 0.02).collect())
    assert got == plain_gate(luma_rows, 0.02) and 2 < len(got) < 240
    assert st.change_gate(df.limit(0)).count() == 0


def test_gate_over_a_stream(spark, luma_rows, tmp_path):
    df = spark.createDataFrame(luma_rows, "monitor_index int, captured_at long, luma array<int>")
    for k in range(3):
        df.where(f"captured_at div 40 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = st.change_gate_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 0.02).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.monitor_index, r.captured_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_gate(luma_rows, 0.02)


@pytest.mark.parametrize("pieces", [["<think>a</think>b"], ["<thi", "nk>a</th", "ink>", "b"], ["plain"], ["a<", "b<think>c"], ["x<think>y<think>z</think>w</think>"]])
def test_splitter_doesn_t_depend_on_the_pieces(spark, pieces):
    def merged(segments):
        out = []
        for thinking, text in segments:
            if out and out[-1][0] == thinking:
                out[-1] = (thinking, out[-1][1] + text)
            else:
                out.append((thinking, text))
        return out

    s = st.Splitter()
    got = merged([x for k, p in enumerate(pieces) for x in s.push(p, last=k == len(pieces) - 1)])
    whole = st.Splitter().push("".join(pieces), last=True)
    assert got == merged(whole)
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(pieces)], "stream_id long, seq long, text string")
    assert merged((r.thinking, r.text) for r in st.split_think(df).orderBy("seq").collect()) == got


def test_splitter_over_a_stream(spark, tmp_path):
    schema = "stream_id long, seq long, text string"
    for k, piece in enumerate(["a<thi", "nk>b</think", ">c"]):
        spark.createDataFrame([(1, k, piece)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        st.split_think_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [(r.thinking, r.text) for r in got] == [(False, "a"), (True, "b"), (False, "c")]


def test_streamed_ingest(spark, tmp_path):
    frame = "frame_id long, seq long, captured_at long, monitor_index int, width int, height int, image_path string, content_hash string, app_hint string, window_title string, browser_url string, activity_type string, app string, title string, rect struct<x:float,y:float,w:float,h:float>, spans array<struct<span_index:int,text:string,normalized_text:string,source:string,x:float,y:float,w:float,h:float,line_index:int>>"
    rect = (0.1, 0.1, 0.8, 0.8)
    spans = [(0, "Menu", "menu", "ocr", 0.11, 0.11, 0.05, 0.02, 0), (1, "body", "body", "ocr", 0.5, 0.5, 0.05, 0.02, 1)]
    store = Store(spark, f"file://{tmp_path}/store")
    for k in range(3):
        row = (k, k, 100 * k, 0, 10, 10, f"frames/{k}.jpg", "h", "ed", None, None, None, "ed", None, rect, spans)
        spark.createDataFrame([row], frame).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame).parquet(f"{tmp_path}/in")
        st.ingest_stream(stream, store, lambda: 5, cl.Config(min_seen=2)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    texts = {r.frame_id: (r.content_text, r.raw_text) for r in store.read("frame_text").collect()}
    assert texts == {0: ("Menu\nbody", "Menu\nbody"), 1: ("body", "Menu\nbody"), 2: ("body", "Menu\nbody")}
    assert st.catalog(store, 2).first().seen_count == 3 and st.catalog(store, 2).count() == 1
    assert store.read("jobs").count() == 3 and store.read("frames").count() == 3
    assert store.versions("frames") == [] and len(store.batches("frames")) == 3  # appended, nothing is rewritten
    before = store.read("frames").inputFiles()
    again = spark.read.schema(frame).parquet(f"{tmp_path}/in")
    st.ingest_batch(store, again.drop("spans"), again.select("frame_id", F.explode("spans").alias("s")).select("frame_id", "s.*"), 6)
    assert store.read("frames").count() == store.read("jobs").count() == 3 and set(before) <= set(store.read("frames").inputFiles())  # frames that are stored aren't taken again
    store.compact("frames")
    assert store.versions("frames") == [1] and store.batches("frames") == [] and store.read("frames").count() == 3


FRAME = "frame_id long, seq long, captured_at long, monitor_index int, width int, height int, image_path string, content_hash string, app_hint string, window_title string, browser_url string, activity_type string, app string, title string, rect struct<x:float,y:float,w:float,h:float>"
SPAN = "frame_id long, span_index int, text string, normalized_text string, source string, x float, y float, w float, h float, line_index int"


def some_frames(spark, ids):
    rect = (0.1, 0.1, 0.8, 0.8)
    frames = [(k, k, DAY_MS * k, 0, 10, 10, f"frames/{k}.jpg", "h", "ed", None, None, None, "ed", None, rect) for k in ids]
    spans = [(k, n, t, t.lower(), "ocr", x, x, 0.05, 0.02, n) for k in ids for n, (t, x) in enumerate((("Menu", 0.11), ("body", 0.5)))]
    return spark.createDataFrame(frames, FRAME), spark.createDataFrame(spans, SPAN)


def contents(store):
    jobs = sorted((r.job_id, r.kind, r.frame_id, r.state) for r in store.read("jobs").collect())
    texts = sorted((r.frame_id, r.content_text, r.suppressed_count) for r in store.read("frame_text").collect())
    seen = sorted((r.signature, r.seen_count) for r in st.catalog(store, 2).collect())
    return jobs, texts, seen, store.read("text_spans").count(), sorted(r.frame_id for r in store.read("frames").collect())


def test_a_batch_that_failed_anywhere_can_run_again(spark, tmp_path):
    class Broken(Store):
        left = None

        def append(self, name, df, batch):
            if self.left is not None:
                if self.left == 0:
                    raise OSError("lost")
                self.left -= 1
            super().append(name, df, batch)

    config, wanted = cl.Config(min_seen=2), Store(spark, f"file://{tmp_path}/whole")
    st.ingest_batch(wanted, *some_frames(spark, [1, 2]), 5, config)
    for fails_at in range(5):
        shutil.copytree(f"{tmp_path}/whole", f"{tmp_path}/broken{fails_at}")
    st.ingest_batch(wanted, *some_frames(spark, [3, 4]), 5, config)
    for fails_at in range(5):  # between every two of the five tables
        store = Broken(spark, f"file://{tmp_path}/broken{fails_at}")
        store.left = fails_at
        with pytest.raises(OSError):
            st.ingest_batch(store, *some_frames(spark, [3, 4]), 5, config)
        store.left = None
        if fails_at == 4:  # a worker takes the job meanwhile
            store.write("jobs", store.read("jobs"))
        st.ingest_batch(store, *some_frames(spark, [3, 4]), 5, config)
        assert contents(store) == contents(wanted)


def test_days_are_pruned(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    st.ingest_batch(store, *some_frames(spark, [1, 2, 3, 4]), 5)
    frames = ts.within(store.read("frames"), 2 * DAY_MS, 3 * DAY_MS)
    assert [r.frame_id for r in frames.collect()] == [2]
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan
    store.compact("frames")
    assert [r.frame_id for r in ts.within(store.read("frames"), 2 * DAY_MS, 3 * DAY_MS).collect()] == [2]


def test_plain_ingest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    frames, texts = some_frames(spark, [1, 2])[0], spark.createDataFrame([(1, "raw words")], "frame_id long, raw_text string")
    for _ in range(2):
        st.ingest_plain(store, frames, texts, 5, "a")
    rows = sorted((r.frame_id, r.content_text, r.raw_text, r.filter_version, r.suppressed_count) for r in store.read("frame_text").collect())
    assert rows == [(1, "raw words", "raw words", 0, 0), (2, "", "", 0, 0)] and store.read("jobs").count() == 2
    assert store.read("text_spans").count() == 0 and st.catalog(store).count() == 0


def test_debounce(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime([0, 500, 1200, 5000], unit="ms")})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    assert sorted(r.n for r in st.debounce(spark.read.parquet(f"{tmp_path}/in")).collect()) == [1, 3]


def test_sse_cut_at_every_byte(spark):
    sent = 'data: {"choices": [{"delta": {"content": "h\u00e9 \U0001f600", "reasoning_content": "why"}}]}\r\n: note\n\ndata: oops\ndata:{"choices": []}\ndata: {"choices": [{"delta": {"content": ""}}]}\ndata:\n data: x\ndata: {"choices": [{"delta": {"content": "b"}}]}\n'.encode()
    end = b"data: [DONE]\ndata: {\"choices\": [{\"delta\": {\"content\": \"late\"}}]}\n"
    whole = sent + end
    rows = [(at, k, part) for at in range(len(whole) + 1) for k, part in enumerate((whole[:at], whole[at:]))]
    rows += [(1000, k, bytes([b])) for k, b in enumerate(whole)] + [(2000, 0, sent + b"data: {}"), (3000, 0, None), (3000, 1, b"data: [DO")]
    got = {}
    for r in sorted(st.sse_pieces(spark.createDataFrame(rows, "stream_id long, seq int, data binary").repartition(3)).collect(), key=lambda r: (r.stream_id, r.seq, r.part)):
        got.setdefault(r.stream_id, []).append((r.kind, r.text))
    want = [("reasoning", "why"), ("content", "h\u00e9 \U0001f600"), ("content", "b"), ("done", None)]
    assert all(got[at] == want for at in (*range(len(whole) + 1), 1000, 2000)) and got[3000] == [("done", None)]


def test_lines_after_the_end_are_left_out(spark):
    lines = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 5, False), (2, 7, None)], "s int, k int, done boolean")
    assert sorted((r.s, r.k) for r in st.until_done(lines, "s", "k").collect()) == [(1, 0), (1, 1), (2, 5), (2, 7)]
