import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as cl
from tidemark.sources import images
from tidemark.sources.tables import Store
from tidemark.streaming import capture
from tidemark.streaming import stateful as st


def test_images_round_trip_and_scale(tmp_path):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (30, 50, 3)).astype(np.uint8)
    assert (images.decode(images.encode(pixels)) == pixels).all()
    assert (images.decode(b"P6 # by hand\n2 1\n255\n" + bytes(range(6))) == np.arange(6).reshape(1, 2, 3)).all()
    for bad in (None, b"", b"P5 1 1 255 a", images.encode(pixels)[:-1], b"P6 0 0 255 "):
        with pytest.raises(ValueError):
            images.decode(bad)
    assert images.scaled(pixels, 50) is pixels and images.scaled(pixels, 0) is pixels
    assert images.scaled(pixels, 20).shape == (12, 20, 3) and images.scaled(pixels, 1).shape == (1, 1, 3)
    flat = np.full((40, 80, 3), 77, np.uint8)
    assert (images.scaled(flat, 13) == 77).all()
    # Every new pixel against a plain weighted mean.
    small, ratio = images.scaled(pixels, 20), 50 / 20
    across = [max(0, 1 - abs(x + 0.5 - 3.5 * ratio) / ratio) for x in range(50)]
    down = [max(0, 1 - abs(y + 0.5 - 5.5 * ratio) / ratio) for y in range(30)]
    mean = sum(across[x] * down[y] * pixels[y, x].astype(float) for x in range(50) for y in range(30)) / (sum(across) * sum(down))
    assert np.abs(small[5, 3] - mean).max() <= 0.51


def test_folders_keep_names_inside(tmp_path):
    folder, remover = images.Folder(f"file://{tmp_path}/a"), images.Remover(f"file://{tmp_path}/a")
    folder.write("frames/day-1/x.ppm", b"one")
    folder.write("frames/day-1/x.ppm", b"two")
    assert (tmp_path / "a/frames/day-1/x.ppm").read_bytes() == b"two" and len(list((tmp_path / "a/frames/day-1").iterdir())) == 1
    (tmp_path / "b").write_text("stays")
    for name in ("../b", "/b", "frames//x", "", None, "c:\\b"):
        assert remover([name]) == [True]
        with pytest.raises(ValueError):
            folder.write(name, b"")
    (tmp_path / "a/full/of").mkdir(parents=True)
    assert remover(["frames/day-1/x.ppm", "frames/day-1/x.ppm", "full"]) == [True, True, False] and (tmp_path / "b").exists()


def drop(root, monitor, at, level, **about):
    folder = root / f"monitor-{monitor}"
    folder.mkdir(parents=True, exist_ok=True)
    if about:
        (folder / f"{at}.json").write_text(json.dumps(about))
    (folder / f"{at}.ppm").write_bytes(images.encode(np.full((20, 40, 3), level, np.uint8)) if level is not None else b"broken")


def read_text(pixels):
    level = int(pixels[0, 0, 0])
    if level == 66:
        raise RuntimeError("no text engine")
    return [{"span_index": 0, "text": f"level {level}", "normalized_text": f"level {level}", "source": "ocr", "x": 0.5, "y": 0.5, "w": 0.1, "h": 0.02, "line_index": 0}]


def test_captures_from_start_to_end_with_restarts(spark, tmp_path):
    root, store, folder = tmp_path / "in", Store(spark, f"file://{tmp_path}/store"), images.Folder(f"file://{tmp_path}/data")
    root.mkdir()

    def start(fails=None):
        frames = capture.changed_frames(capture.captures(spark, f"file://{root}", 2), ["bank"])
        clock = (lambda: 5) if fails is None else (lambda: 1 / 0)
        return capture.ingest_captures(frames, store, read_text, folder, clock, cl.Config(), 10).option("checkpointLocation", f"{tmp_path}/cp").start()

    drop(root, 0, 1000, 10, app="ed", title="a", rect={"x": 0, "y": 0, "w": 1, "h": 1})
    drop(root, 0, 2000, 10, app="ed")  # unchanged
    drop(root, 0, 3000, None, app="ed")  # can't be read
    drop(root, 0, 4000, 10, app="ed")  # unchanged still, whatever came between
    drop(root, 0, 5000, 90, app="My Bank")
    drop(root, 1, 1000, 90, app="ed", locked=True)
    drop(root, 1, 2000, 66, app="ed")  # recognition fails
    drop(root, 1, 3000, 200)
    query = start()
    query.processAllAvailable()
    query.stop()
    ids = lambda *places: sorted(t * capture.MONITORS + m for m, t in places)
    stored = lambda: sorted(r.frame_id for r in store.read("frames").collect())
    assert stored() == ids((0, 1000), (1, 3000))

    drop(root, 0, 6000, 200, app="ed", own_window=True)
    drop(root, 0, 7000, 150, app="ed")
    query = start(fails=True)  # lost after its images and errors, before its rows
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    assert stored() == ids((0, 1000), (1, 3000))
    drop(root, 1, 8000, 20)
    (root / "END").write_text("")
    query = start()
    capture.run_to_the_end(query, f"file://{root}")
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3  # the lost batch and what came since, nothing older

    assert stored() == ids((0, 1000), (1, 3000), (0, 7000), (1, 8000))
    assert {r.frame_id: r.content_text for r in store.read("frame_text").collect()} == {ids((m, t))[0]: f"level {v}" for m, t, v in ((0, 1000, 10), (1, 3000, 200), (0, 7000, 150), (1, 8000, 20))}
    assert sorted((r.monitor_index, r.captured_at, r.error) for r in capture.set_aside(store).collect()) == [(0, 3000, "image: no image"), (1, 2000, "recognise: no text engine")]
    jobs = store.read("jobs").collect()
    assert sorted(j.frame_id for j in jobs) == stored() and len({j.job_id for j in jobs}) == 4
    frames = {r.frame_id: r for r in store.read("frames").collect()}
    first = frames[ids((0, 1000))[0]]
    assert (first.app_hint, first.window_title, first.width, first.height, first.image_path) == ("ed", "a", 40, 20, "frames/day-0/1000-0.ppm")
    assert images.decode((tmp_path / "data" / first.image_path).read_bytes()).shape == (5, 10, 3)
    assert len(list((tmp_path / "data/frames/day-0").iterdir())) == 4


def test_a_batch_reads_again_what_it_read(tmp_path):
    for t in range(5):
        drop(tmp_path, 3, t, 1)
    reader = capture.CaptureReader({"root": f"file://{tmp_path}", "perBatch": "2"})
    offsets = [reader.initialOffset()] + [reader.latestOffset() for _ in range(4)]
    assert offsets == [{}, {"3": 1}, {"3": 3}, {"3": 4}, {"3": 4}]
    again = capture.CaptureReader({"root": f"file://{tmp_path}"})
    assert [[t for f in again.partitions(a, b) for t in f.times] for a, b in zip(offsets, offsets[1:])] == [[0, 1], [2, 3], [4], []]
    rows = list(again.read(capture.Files(3, [0, 99])))
    assert rows[0][:2] == (3, 0) and rows[0][3:] == (None, None, False, False, None) and rows[1][2] is None
    assert capture.CaptureReader({"root": f"file://{tmp_path}/none"}).latestOffset() == {} and not capture.ended(f"file://{tmp_path}")


def test_luma_of_a_column(spark):
    rng = np.random.default_rng(2)
    pixels = [rng.integers(0, 256, (40, 60, 3)).astype(np.uint8) for _ in range(6)]
    df = spark.createDataFrame([(k, images.encode(p)) for k, p in enumerate(pixels)] + [(9, None)], "k int, content binary")
    got = {r.k: r for r in images.with_luma(df).collect()}
    assert all(got[k].luma == st.fingerprint(p).tolist() and (got[k].width, got[k].height, got[k].error) == (60, 40, None) for k, p in enumerate(pixels))
    assert got[9].luma is None and got[9].error == "image: no image"
    gated = st.change_gate(images.with_luma(df.where("k < 9")).select(F.lit(0).alias("monitor_index"), F.col("k").cast("long").alias("captured_at"), "luma"))
    assert gated.count() == 6
