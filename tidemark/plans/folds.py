"""Folds in order over groups of any size.

A fold needs the state that the row before has left, so a group would be one task. Here rows are cut into
slices of order instead, whatever their group, and every slice is run at the same time from a guess: that its
first group begins with it. A slice that holds one group alone passes a state on that depends on the state
it gets; it is run again if that differs from the guess, and so on until no state changes. Most folds forget
(a batch is full, a frame is kept, a tag is closed), so few slices run twice; in the worst case a state
passes through all slices in turn, which is the work of one task. Then one pass gives out the rows.

Only what a slice leaves behind comes to the driver: a state and a count for each slice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder


@dataclass(frozen=True)
class Fold:
    """``step(state, number, rows)`` takes the rows of one group that follow each other and returns what they give,
    the state and the number after them. States are what JSON can hold; a number only counts on, so that
    what follows doesn't depend on it. ``finish(state, number, group)`` gives what a group's end gives, if anything.
    """

    step: Callable[[Any, int, pd.DataFrame], tuple[pd.DataFrame, Any, int]]
    initial: Any = None
    finish: Callable[[Any, int, Any], pd.DataFrame | None] = lambda state, number, group: None


def fold_slices(df: DataFrame, by: str, order: list[str], fold: Fold, schema, slices: int | None = None) -> DataFrame:
    """What the fold gives for the rows of ``df`` in ``order`` within each group ``by``; columns as ``schema`` says.

    Rows of equal keys stand in one slice. The number of slices is that of the shuffle partitions if left
    out. No rows give none; a null group is a group.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_folder(spark)
    dealt = df.repartitionByRange(slices, by, *order).sortWithinPartitions(by, *order).withColumn("__slice", F.spark_partition_id())
    # Stored: the bounds of slices are drawn from a sample and must not change between the passes.
    dealt = dealt.checkpoint(eager=True)
    kind = df.schema[by].dataType.simpleString()

    def runs(frames: Iterator[pd.DataFrame], known: dict) -> Iterator[tuple]:
        """``slice, group, first, rows given, state, number`` after each run of rows of a group."""
        at, first, state, number = None, True, fold.initial, 0
        for pdf in frames:
            for (part, group), rows in pdf.groupby(["__slice", by], sort=False, dropna=False):
                group = None if pd.isna(group) else group
                if at is None or at[0] != part:
                    state, number = known.get(part, (fold.initial, 0))
                    first = True
                elif at[1] != group:
                    state, number, first = fold.initial, 0, False
                at = (part, group)
                given, state, number = fold.step(state, number, rows.drop(columns="__slice"))
                yield part, group, first, given, state, number

    def left_by(rows: DataFrame, known: dict) -> list:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict = {}
            for part, group, first, _, state, number in runs(frames, known):
                begun = seen[part][1] if part in seen else group
                seen[part] = (part, begun, group, first, state, number)
            rows = [(p, a, b, one, json.dumps(state), number) for p, a, b, one, state, number in seen.values()]
            yield pd.DataFrame(rows, columns=["part", "begun", "ended", "one", "state", "number"], dtype=object)

        return rows.mapInPandas(run, f"part int, begun {kind}, ended {kind}, one boolean, state string, number long").collect()

    left, used = {r.part: r for r in left_by(dealt, {})}, {}
    parts = sorted(left)
    while True:
        begin, changed = _beginnings(left, parts, fold.initial), []
        for part in parts:
            if left[part].one and begin[part][0] != used.get(part, fold.initial):
                used[part] = begin[part][0]
                changed.append(part)
        if not changed:
            break
        states = {p: (used[p], 0) for p in changed}
        left |= {r.part: r for r in left_by(dealt.where(F.col("__slice").isin(changed)), states)}
    ends = {p for p, after in zip(parts, [*parts[1:], None]) if after is None or left[after].begun != left[p].ended}

    def given(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for part, group, _, rows, state, number in runs(frames, begin):
            ended = before and (before[0] in ends if before[0] != part else before[1] != group)
            if ended and (more := fold.finish(before[2], before[3], before[1])) is not None:
                yield more
            before = (part, group, state, number)
            yield rows
        if before and before[0] in ends and (more := fold.finish(before[2], before[3], before[1])) is not None:
            yield more

    return dealt.mapInPandas(given, schema)


def _beginnings(left: dict, parts: list[int], initial: Any) -> dict:
    """The state and number that each slice's first group begins with, from what the slices before have left."""
    begin, before = {}, None
    for part in parts:
        if before is not None and left[before].ended == left[part].begun:
            own = left[before]
            begin[part] = (json.loads(own.state), own.number + (begin[before][1] if own.one else 0))
        else:
            begin[part] = (initial, 0)
        before = part
    return begin
