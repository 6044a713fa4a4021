import numpy as np
import pytest

from tidemark.operators import cells as ce
from tidemark.operators import retrieval as rt

SCHEMA = "frame_id long, chunk_index int, embedding array<float>"


def vectors_of(kind, n=600, size=12, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centers = rng.normal(size=(15, size))
        v = centers[rng.integers(0, 15, n)] + 0.05 * rng.normal(size=(n, size))
    elif kind == "hot":
        v = np.where(rng.random(n)[:, None] < 0.5, np.ones(size), rng.normal(size=(n, size)))  # half of all are equal
    else:
        v = rng.normal(size=(n, size))
    v[::97] = 0
    v[1::50] = v[0 if kind == "hot" else 3]
    return [(k // 2, k % 2, [float(x) for x in row]) for k, row in enumerate(v.astype(np.float32))]


def stored(spark, rows, path, **layout):
    ce.write_cells(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{path}/index", ce.Layout(**layout))
    return ce.read_cells(spark, f"file://{path}/index")


def same(got, want):
    key = lambda r: (r.query_id, r.frame_id, r.chunk_index, round(r.distance, 9), r["rank"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("kind", ["clusters", "hot", "spread"])
def test_the_nearest_are_those_of_comparing_everything(spark, tmp_path, kind):
    rows = vectors_of(kind)
    df, index = spark.createDataFrame(rows, SCHEMA), stored(spark, rows, tmp_path, cells=20, file_rows=10)
    asked = [(k, rows[k][2]) for k in range(0, 600, 40)] + [(900, [0.0] * 12), (901, [-x for x in rows[5][2]])]
    for k in (1, 7, 250):
        same(index.batch(asked, k), rt.knn_batch(df, asked, k))
    same(index.batch(asked[:2], 5000), rt.knn_batch(df, asked[:2], 5000))
    assert index.batch([], 5).count() == 0


def test_cells_are_skipped(spark, tmp_path):
    rows = vectors_of("clusters")
    index = stored(spark, rows, tmp_path, cells=30)
    asked = np.array([rows[k][2] for k in (5, 77, 300)])
    seen = index.visits(np.arange(3), asked, 5).collect()
    assert all(r.rows_read + r.rows_skipped == 600 and r.rows_skipped > 350 for r in seen)
    files = index.vectors.where("cell = 3").inputFiles()
    assert index.vectors.where(index.vectors.cell.isin([3])).select("frame_id").count() == int(index.n[index.cell == 3].sum()) and files


def test_windows_and_frames(spark, tmp_path):
    rows = vectors_of("clusters", seed=4)
    df, index = spark.createDataFrame(rows, SCHEMA), stored(spark, rows, tmp_path)
    frames = spark.createDataFrame([(k, k * 10) for k in range(250)], "frame_id long, captured_at long")
    for options in ({}, {"start": 500, "end": 900}, {"start": 500, "end": 900, "prefilter": True}, {"start": 5, "end": 5, "prefilter": True}):
        got, want = index.knn(frames, rows[9][2], 20, **options).collect(), rt.knn(df, frames, rows[9][2], 20, **options).collect()
        assert [(r.frame_id, round(r.distance, 9), r["rank"]) for r in got] == [(r.frame_id, round(r.distance, 9), r["rank"]) for r in want]


def test_segments_and_other_sizes(spark, tmp_path):
    rows, path = vectors_of("clusters"), f"file://{tmp_path}/index"
    parts = rows[:200], rows[200:]
    for k, part in enumerate(parts):
        ce.write_cells(spark.createDataFrame(part, SCHEMA), path, ce.Layout(cells=8), f"b{k}")
    asked = [(1, rows[8][2]), (2, rows[501][2])]
    same(ce.read_cells(spark, path).batch(asked, 9), rt.knn_batch(spark.createDataFrame(rows, SCHEMA), asked, 9))
    ce.write_cells(spark.createDataFrame(parts[1], SCHEMA), path, segment="b1")  # again: replaced, not added
    same(ce.read_cells(spark, path).batch(asked, 9), rt.knn_batch(spark.createDataFrame(rows, SCHEMA), asked, 9))
    with pytest.raises(ValueError):
        ce.read_cells(spark, path).batch([(1, [1.0, 2.0])], 3)
    none = stored(spark, [], tmp_path / "none")
    assert none.batch([], 3).count() == 0 and none.chunks([1.0] * 12, 3).count() == 0


def test_hybrid_takes_the_index(spark, tmp_path):
    rows = vectors_of("clusters")
    frames = spark.createDataFrame([(k, k * 10) for k in range(300)], "frame_id long, captured_at long")
    texts = spark.createDataFrame([(k, f"word{k % 9} common") for k in range(300)], "frame_id long, content_text string")
    plain = rt.Corpus(frames, texts, spark.createDataFrame(rows, SCHEMA))
    by_cells = rt.Corpus(frames, texts, cells=stored(spark, rows, tmp_path))
    assert rt.hybrid_ids(plain, "word3", 20, rows[7][2]).collect() == rt.hybrid_ids(by_cells, "word3", 20, rows[7][2]).collect()
