"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table below ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    Where the session names none, a folder of this machine is set in local mode, as in tests; on a cluster
    that is an error, since other machines would not see its files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpointed``, and the number of rows, which are counted as they are written."""
    seen = Observation()
    df = checkpointed(df.observe(seen, F.count("*").alias("n")))
    return df, seen.get.get("n") or 0


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder.

    A checkpoint keeps what the planner knows of its columns, which piles up in a loop; a table doesn't.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of ids that is broadcast (16 MB of longs); larger ones are joined by shuffle.
MOST_BROADCAST = 2_000_000


def keep_rows(df: DataFrame, keys: DataFrame, on: str | Column, how: str) -> DataFrame:
    """A semi or anti join of wide rows with distinct keys, which are counted first: few are broadcast, so that the rows stay where they are."""
    keys = checkpointed(keys)
    return df.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, on, how)


def few(df: DataFrame, count: int) -> DataFrame:
    """The table of ``count`` rows of plain numbers, to be broadcast where it has no more values than ids may have."""
    return F.broadcast(df) if count * len(df.columns) <= MOST_BROADCAST else df


#: Rows that a function of columns gets at once; a worker holds the values of no more than these.
ROWS_AT_ONCE = 512


def map_batches(df: DataFrame, fn: Callable[[list, ...], dict[str, list]], schema: str, *args) -> DataFrame:
    """Apply ``fn(*columns, *args)`` to slices of Arrow batches, which Spark bounds in rows and in bytes.

    A worker stays for later stages, so after each batch Arrow's free memory goes back to the system.
    """
    out_schema = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                got = fn(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns), *args)
                yield pa.RecordBatch.from_pydict(got, schema=out_schema)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def to_arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain column types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([(name, kind(of)) for name, of in (field.split() for field in schema.split(","))])


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit("")).alias(col)


#: Keys with more than this part of all rows are joined by broadcast; so there are fewer than this.
HOT_KEYS = 200


def join_hot(rows: DataFrame, of_key: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of rows with a table of one row per key that counts the rows of its key in ``n``.

    A key may hold many of the rows. Those with more than a 200th of all are fewer than 200, so they are
    broadcast and their rows stay where they are; the others' rows are joined by shuffle.
    """
    most = (of_key.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS
    hot, others = F.broadcast(of_key.where(F.col(n) > most)), of_key.where(F.col(n) <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key))
