import random

import pandas as pd
import pytest

from tidemark.plans import report as rp
from tidemark.plans.folds import Fold, fold_slices
from tidemark.streaming import stateful as st


def plain_batches(costs, budget):
    out, spent, batch = [], 0, 0
    for cost in costs:
        if spent and spent + cost > budget:
            spent, batch = 0, batch + 1
        spent += cost
        out.append(batch)
    return out


@pytest.mark.parametrize("groups", [1, 3])
def test_batches_of_one_hot_group(spark, groups):
    rng = random.Random(2)
    rows = [(k % groups if k % 10 else None, k, "x" * rng.randint(0, 90)) for k in range(1500)]
    got = rp.batches(spark.createDataFrame(rows, "g int, k long, text string").repartition(5), 300, "g", ["k"]).collect()
    want = {}
    for g in {g for g, *_ in rows}:
        own = [(k, text) for h, k, text in rows if h == g and text]
        want |= dict(zip((k for k, _ in own), plain_batches([len(t) // 2 + 1 + rp.CHUNK_TOKENS for _, t in own], 300)))
    assert {r.k: r.batch for r in got} == want
    assert len({r.batch for r in got}) > 40


def test_gate_of_one_monitor(spark):
    rng = random.Random(3)
    level, rows = 0, []
    for k in range(900):
        level = max(0, min(255, level + rng.randint(-9, 9)))
        rows.append((0 if k < 800 else 1, k, [level] * 16))
    df = spark.createDataFrame(rows, "monitor_index int, captured_at long, luma array<int>").repartition(4)
    last, want = {}, set()
    for monitor, at, luma in rows:
        if monitor not in last or abs(luma[0] - last[monitor]) / 255 > 0.1:
            last[monitor] = luma[0]
            want.add(at)
    assert {r.captured_at for r in st.change_gate(df, 0.1).collect()} == want


def test_think_tags_across_slices(spark):
    rng = random.Random(4)
    parts = ["<think>", "</think>", "<thi", "nk>", "</", "think>", "a", "b ", "<", ">", "", None, "x" * 30]
    rows = [(s, k, rng.choice(parts)) for s in range(6) for k in range(1 if s == 5 else 400 if s == 0 else 60)] + [(9, 0, "no tag"), (9, 1, " at all <thin"), (8, 0, ""), (7, 0, "<think>")]
    want = set()
    for s in {s for s, *_ in rows}:
        text, tags, thinking = "".join(t or "" for h, _, t in rows if h == s), 0, False
        while text:
            said, tag, after = text.partition("</think>" if thinking else "<think>")
            if said:
                want.add((s, tags, thinking, said))
            thinking, tags, text = not thinking, tags + 1, after if tag else ""
    got = st.split_think(spark.createDataFrame(rows, "stream_id long, seq int, text string").repartition(5)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_a_fold_that_never_forgets(spark, slices):
    """A running sum depends on every row before it, so states pass through all slices in turn."""

    def step(state, number, rows):
        total = rows["v"].cumsum() + state
        return rows.assign(total=total), int(total.iloc[-1]), number + len(rows)

    def finish(state, number, group):
        return pd.DataFrame([(group, -number, 0, state)], columns=["g", "k", "v", "total"]).astype({"g": object})

    rows = [("a" if k < 150 else "b" if k < 160 else None, k, k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(3)
    got = {(r.g, r.k): r.total for r in fold_slices(df, "g", ["k"], Fold(step, 0, finish), "g string, k long, v long, total long", slices).collect()}
    want = {}
    for g in ("a", "b", None):
        total, own = 0, [(k, v) for h, k, v in rows if h == g]
        for k, v in own:
            total += v
            want[g, k] = total
        want[g, -len(own)] = total
    assert got == want
    assert fold_slices(df.limit(0), "g", ["k"], Fold(step, 0), "g string, k long, v long, total long", slices).count() == 0
