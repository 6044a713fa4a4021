import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as cl

SPANS = "frame_id long, span_index int, text string, line_index int, x float, y float, w float, h float"
CONTEXT = "frame_id long, seq long, app string, title string, rect struct<x:float,y:float,w:float,h:float>"
RECT = (0.1, 0.1, 0.6, 0.7)
LINES = [("Save File", 0.11, 0.11), ("a long body line of words within the window that is protected by length", 0.2, 0.4), ("short body", 0.35, 0.45), ("other window text", 0.8, 0.3), ("12:30 PM", 0.9, 0.96)]


def screen(frame, lines=LINES):
    out, n = [], 0
    for k, (text, x, y) in enumerate(lines):
        for j, word in enumerate(text.split()):
            out.append((frame, n, word, k, x + 0.01 * j, y, 0.01, 0.02))
            n += 1
    return out


def run(spark, frames, lines=LINES, rect=RECT, title=None, config=cl.Config(min_seen=3), app="ed", catalog=None):
    spans = spark.createDataFrame([s for k in range(frames) for s in screen(k, lines)], SPANS)
    context = spark.createDataFrame([(k, k, app, title, rect) for k in range(frames)], CONTEXT)
    return spans, context, cl.line_roles(spans, context, config, catalog)


def roles(lines, frame=0):
    return [r.role for r in lines.where(F.col("frame_id") == frame).orderBy("line_index").collect()]


def test_roles_of_a_screen(spark):
    spans, _, lines = run(spark, 1)
    assert roles(lines) == ["content", "content", "content", "background", "system"]
    done = cl.classify_spans(spans, lines)
    assert cl.suppressed_counts(done).first().suppressed_count == 5
    assert cl.content_texts(lines).first().content_text.split("\n") == [t for t, *_ in LINES[:3]]


def test_repetition_suppresses_from_the_threshold_on(spark):
    _, _, lines = run(spark, 4)
    assert [roles(lines, k)[0] for k in range(4)] == ["content", "content", "chrome", "chrome"]
    assert all(roles(lines, k)[2] == "content" for k in range(4))  # interior lines are never counted
    (row,) = cl.observations(lines, 9).collect()
    assert (row.seen_count, row.app_hint, row.normalized_text) == (4, "ed", "save file")
    _, _, warm = run(spark, 1, catalog=cl.observations(lines, 9))
    assert roles(warm)[0] == "chrome"


def test_slices_don_t_change_counts(spark, monkeypatch):
    want = [roles(run(spark, 6)[2], k)[0] for k in range(6)]
    monkeypatch.setattr(cl, "SLICE", 2)
    assert [roles(run(spark, 6)[2], k)[0] for k in range(6)] == want


def test_without_a_window_only_the_title_goes(spark):
    _, _, lines = run(spark, 5, rect=None, title="  SAVE  file ")
    assert roles(lines, 4) == ["chrome", "unknown", "unknown", "unknown", "unknown"]
    assert cl.observations(lines, 0).count() == 0


def test_reconcile_demotes_once(spark):
    spans, context, lines = run(spark, 4)
    done, apps, catalog = cl.classify_spans(spans, lines), context.select("frame_id", "app"), cl.observations(lines, 0)
    once = cl.reconcile(done, apps, catalog, cl.Config(min_seen=3))
    assert {r.suppressed_count for r in cl.suppressed_counts(once).collect()} == {7}
    twice = cl.reconcile(once, apps, catalog, cl.Config(min_seen=3))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    cold = cl.reconcile(done, apps, catalog, cl.Config(min_seen=99))
    assert sorted(map(str, cold.select(*sorted(cold.columns)).collect())) == sorted(map(str, done.select(*sorted(done.columns)).collect()))


def test_merge_catalog(spark):
    _, _, lines = run(spark, 2)
    one = cl.observations(lines, 5)
    (row,) = cl.merge_catalog(one, cl.observations(lines, 8), 4).collect()
    assert (row.seen_count, row.first_seen_at, row.last_seen_at, row.suppressed) == (4, 5, 8, True)


def test_backfill(spark):
    spans, context, lines = run(spark, 4)
    done = cl.classify_spans(spans, lines)
    texts = cl.content_texts(lines).join(cl.suppressed_counts(done), "frame_id").select("frame_id", F.lit("raw").alias("raw_text"), "content_text", F.lit("ocr").alias("primary_source"), F.lit(1).alias("filter_version"), F.col("suppressed_count").cast("int").alias("suppressed_count"), F.lit(None).cast("string").alias("target_title"), F.lit("ed").alias("target_app"))
    vectors = spark.createDataFrame([(k, 0, "ocr") for k in range(4)], "frame_id long, chunk_index int, source string")
    state = cl.backfill(texts, done, vectors, cl.observations(lines, 0), cl.Config(min_seen=3))
    assert sorted(r.frame_id for r in state["changed"].collect()) == [0, 1]
    assert sorted(r.frame_id for r in state["embeddings"].collect()) == [2, 3]
    assert {r.filter_version for r in state["frame_text"].collect()} == {2}
    again = cl.backfill(state["frame_text"], state["spans"], state["embeddings"], cl.observations(lines, 0), cl.Config(min_seen=3))
    assert again["changed"].count() == 0


@pytest.mark.parametrize("box,want", [((0.0, 0.0, 0.2, 0.2), 0.25), ((0.2, 0.2, 0.2, 0.2), 1.0), ((0.5, 0.5, 0.0, 0.0), 1.0), ((0.05, 0.5, 0.0, 0.0), 0.0)])
def test_inside_fraction(spark, box, want):
    x, y, w, h = box
    df = spark.createDataFrame([(x, y, x + w, y + h, RECT)], "x float, y float, right float, bottom float, rect struct<x:float,y:float,w:float,h:float>")
    assert abs(df.select(cl.inside_fraction(F.col("rect"))).first()[0] - want) < 1e-4
