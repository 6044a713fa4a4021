"""Steps that bring stored tables up to this build's schema, one version after the other.

Each step writes the next versions of the tables it changes, and its marker comes last. A step that was
lost halfway runs again over what it wrote, so each gives the same rows when it is applied twice. Older
versions of the tables stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema


def _as_it_is(store) -> dict[str, DataFrame]:
    """Nothing stored changes: an index of the queue, which scans of Parquet don't have."""
    return {}


def _two_layers(store) -> dict[str, DataFrame]:
    """Recognised texts become both layers of the frames' texts, of filter version 0, so that a backfill cleans them."""
    old = store.versions("ocr_text")
    if not old:
        return {}
    have = store.read("frame_text")
    text = F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    found = store.spark.read.parquet(f"{store.root}/ocr_text/v{old[-1]}").groupBy("frame_id").agg(F.max("text").alias("text"))
    new = found.join(have.select("frame_id"), "frame_id", "left_anti").select("frame_id", text.alias("raw_text"), text.alias("content_text"), F.lit("ocr").alias("primary_source"), F.lit(0).alias("filter_version"), F.lit(0).alias("suppressed_count"), none.alias("target_title"), none.alias("target_app"))
    return {"frame_text": have.unionByName(new, allowMissingColumns=True)}


def _line_numbers(store) -> dict[str, DataFrame]:
    """Spans get the number of their line, 0 where it wasn't kept."""
    if not (store.versions("text_spans") or store.batches("text_spans")):
        return {}
    return {"text_spans": store.read("text_spans").withColumn("line_index", F.coalesce("line_index", F.lit(0)))}


STEPS: list[tuple[int, Callable]] = [(2, _as_it_is), (3, _two_layers), (4, _line_numbers)]


def bring_up(store, found: int) -> list[int]:
    """Apply the steps after a stored version, in order; the versions reached."""
    done = []
    for version, step in STEPS:
        if found < version <= schema.SCHEMA_VERSION:
            for name, rows in step(store).items():
                store.write(name, rows)
            store.mark_schema(version)
            done.append(version)
    return done
