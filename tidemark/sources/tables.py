"""Tables: the observation model over the given Parquet tables, and versioned Parquet stores.

The given tables play the model's parts: ``events`` are frames, ``documents`` their texts, ``embeddings``
their vectors, ``orders`` the job queue, ``labels`` tags. The SQL of the same mapping is kept beside each
for the oracles.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark import schema
from tidemark.sources import migrations

#: A line that every raw text ends with: what a window shows around its content.
CHROME_LINE = "File Edit View Window Help"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds since 1970 of a timestamp without time zone, rounded down; no session setting matters."""
    return F.expr(f"CAST(floor(CAST(CAST({col} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000) AS BIGINT)")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    labels = F.array(*map(F.lit, schema.ACTIVITIES))
    return e.select(
        F.col("event_id").alias("frame_id"),
        epoch_ms("ts").alias("captured_at"),
        (F.col("user_id") % 3).cast("int").alias("monitor_index"),
        F.format_string("frames/%d.jpg", "event_id").alias("image_path"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("app_hint"),
        F.when(F.col("event_id") % 11 < 8, F.get(labels, F.col("event_id") % 11)).alias("activity_type"),
    )


FRAMES_SQL = f"""SELECT event_id AS frame_id, epoch_us(ts) // 1000 AS captured_at, CAST(user_id % 3 AS INTEGER) AS monitor_index, 'frames/' || event_id || '.jpg' AS image_path,
  CASE WHEN event_id % 17 <> 0 THEN event_type END AS app_hint, CASE WHEN event_id % 11 < 8 THEN {list(schema.ACTIVITIES)}[event_id % 11 + 1] END AS activity_type FROM events"""


def frame_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers of text; the documents of even source count as recognised, the others as read from the window."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("frame_id"),
        F.concat("text", F.lit("\n" + CHROME_LINE)).alias("raw_text"),
        F.col("text").alias("content_text"),
        F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("uia").alias("primary_source"),
        (F.col("doc_id") % 3).cast("int").alias("filter_version"),
        F.col("source").alias("target_app"),
    )


FRAME_TEXT_SQL = f"SELECT doc_id AS frame_id, text || chr(10) || '{CHROME_LINE}' AS raw_text, text AS content_text, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'uia' END AS primary_source, CAST(doc_id % 3 AS INTEGER) AS filter_version, source AS target_app FROM documents"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 2").alias("frame_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"), "embedding")


VECTORS_SQL = "SELECT vec_id // 2 AS frame_id, CAST(vec_id % 2 AS INTEGER) AS chunk_index, embedding FROM embeddings"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, schema.JOB_KINDS))
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.get(kinds, F.col("o_custkey") % 3).alias("kind"),
        F.when(F.col("o_orderkey") % 5 != 0, F.expr("o_orderkey div 2")).alias("frame_id"),
        F.when(F.col("o_orderkey") % 13 == 0, "dead").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("state"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", 10).otherwise(0).cast("long").alias("priority"),
        (F.col("o_orderkey") % 4).alias("attempts"),
        F.lit(3).cast("long").alias("max_attempts"),
        epoch_ms("o_orderdate").alias("not_before"),
        F.lit(None).cast("string").alias("last_error"),
        (epoch_ms("o_orderdate") + F.col("o_orderkey") % 1000).alias("updated_at"),
    )


JOBS_SQL = f"""SELECT o_orderkey AS job_id, {list(schema.JOB_KINDS)}[o_custkey % 3 + 1] AS kind, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 2 END AS frame_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'dead' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS state,
  CAST(CASE WHEN o_orderpriority[1] = '1' THEN 10 ELSE 0 END AS BIGINT) AS priority, o_orderkey % 4 AS attempts, CAST(3 AS BIGINT) AS max_attempts, epoch_us(o_orderdate) // 1000 AS not_before,
  CAST(NULL AS VARCHAR) AS last_error, epoch_us(o_orderdate) // 1000 + o_orderkey % 1000 AS updated_at FROM orders"""


def frame_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, name``: good or poor, and toxic."""
    names = F.explode(F.filter(F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"), names.alias("name"))


FRAME_TAGS_SQL = "SELECT doc_id AS frame_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS name FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1"

WITH = f"frames AS ({FRAMES_SQL}), frame_text AS ({FRAME_TEXT_SQL}), vectors AS ({VECTORS_SQL}), jobs AS ({JOBS_SQL}), frame_tags AS ({FRAME_TAGS_SQL})"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one that ``spark.checkpoint.dir`` names.

    Where the session names none, a folder of this machine does in local mode, as in tests; on a cluster
    that is an error, since other machines would not see its files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    return named


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that all that reads them makes them once."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A name for the files that a DataFrame reads, by their paths, sizes and times."""
    conf, path_of = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    seen = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = path_of(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:24]


def cover(n: int, sums: set[tuple[int, int]], without: int | None = None) -> list[tuple[int, int]]:
    """The fewest sums and single numbers that hold 1 to n, but for one number, in order."""
    widest = {}
    for first, last in sums:
        if last <= n and not (without is not None and first <= without <= last):
            widest[first] = max(last, widest.get(first, 0))
    out, at = [], 1
    while at <= n:
        last = widest.get(at, at)
        if at != without:
            out.append((at, last))
        at = last + 1
    return out


class Store:
    """A directory of Parquet tables: whole versions, batches appended to the newest one, changed rows and deletions.

    There is one writer at a time. A version or batch is visible once its marker is written, so a lost job
    leaves what was before in place. A batch has a name, and writing it again replaces it, so a batch that
    failed halfway can be run again. Tables of ``schema.BY_DAY`` are partitioned by day where rows have one.

    Changes of keyed tables and deletions of frames write what they change, not the table: reading puts the
    changed rows in place of those with their keys and leaves deleted frames out of every table. A deleted
    frame stays deleted, even if its batch is run again. ``compact`` and ``forget_deleted`` fold them in.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        found = schema.check_version(self.schema_version())
        if found < schema.SCHEMA_VERSION:
            migrations.bring_up(self, found)

    def _listed(self, path: str, prefix: str) -> list[str]:
        """Names of complete directories below a path, without the prefix they begin with."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at)]
        return [p.getName()[len(prefix) :] for p in found if p.getName().startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def schema_version(self) -> int:
        """The version that the data was written with: the largest marker, or this build's where there is none."""
        return max(map(int, self._listed(f"{self.root}/_schema", "v")), default=schema.SCHEMA_VERSION)

    def versions(self, name: str) -> list[int]:
        return sorted(map(int, self._listed(f"{self.root}/{name}", "v")))

    def batches(self, name: str) -> list[str]:
        """Names of the batches appended to the newest version."""
        return sorted(self._listed(self._added(name), "batch="))

    def _added(self, name: str) -> str:
        return f"{self.root}/{name}/added-to-{(self.versions(name) or [0])[-1]}"

    def read(self, name: str, without: str | None = None) -> DataFrame:
        """A table as it is now, if asked for without one of its batches."""
        return self.living(name, self._changed(name, self.stored(name, without)))

    def stored(self, name: str, without: str | None = None) -> DataFrame:
        """The newest version and its batches."""
        kind, versions = schema.TABLES[name], self.versions(name)
        added = self._added(name)
        paths = [f"{added}/batch={b}" for b in self.batches(name) if b != without]
        day = StructType([*kind.fields, StructField("day", IntegerType())]) if name in schema.BY_DAY else kind
        reader = self.spark.read.schema(day)
        out = reader.parquet(f"{self.root}/{name}/v{versions[-1]}") if versions else None
        if paths:
            more = reader.option("basePath", added).parquet(*paths).drop("batch")
            out = more if out is None else out.unionByName(more)
        return self.spark.createDataFrame([], day) if out is None else out

    def batch(self, name: str, batch: str) -> DataFrame:
        return self.spark.read.schema(schema.TABLES[name]).parquet(f"{self._added(name)}/batch={batch}")

    def write(self, name: str, df: DataFrame) -> int:
        """The next version of a table, in place of the one before and its batches."""
        version = (self.versions(name) or [0])[-1] + 1
        self._save(name, df, f"{self.root}/{name}/v{version}")
        return version

    def append(self, name: str, df: DataFrame, batch: str) -> None:
        """Add a batch; it replaces the one of its name, and the sums that hold that one go first."""
        number = self._order(name).get(batch)
        for first, last in self._sums(name) if number else []:
            if first <= number <= last:
                self._remove(f"{self._added(name)}/sum={first}-{last}")
        self._save(name, df, f"{self._added(name)}/batch={batch}")

    def _sums(self, name: str) -> list[tuple[int, int]]:
        return [tuple(map(int, s.split("-"))) for s in self._listed(self._added(name), "sum=")]

    def _order(self, name: str) -> dict[str, int]:
        """The numbers of batches that were summed, from 1 in the order of summing; files without rows hold them."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._added(name)}/_order")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName().partition("-") for s in fs.listStatus(at)] if fs.exists(at) else []
        return {batch: int(number) for number, _, batch in found}

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def sum_up(self, name: str, batch: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Add a finished batch to the sums: of every 2, 4, 8, ... batches in order that end with it or lack one.

        ``merge`` adds rows up and may be applied to its own results. Each row is summed once for each width.
        """
        order = self._order(name)
        number = order.get(batch)
        if number is None:
            number = len(order) + 1
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._added(name)}/_order/{number}-{batch}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)
        names, width = {n: b for b, n in order.items()} | {number: batch}, 2
        while width <= len(names):
            first = (number - 1) // width * width + 1
            last = first + width - 1
            if last <= len(names) and (first, last) not in self._sums(name):
                inside = {(a, b) for a, b in self._sums(name) if first <= a and b <= last}
                parts = [self._piece(name, names, a, b) for a, b in cover(last, inside) if a >= first]  # two, unless a sum was lost
                self._save(name, merge(self.spark.read.schema(schema.TABLES[name]).parquet(*parts)), f"{self._added(name)}/sum={first}-{last}")
            width *= 2

    def _piece(self, name: str, names: dict[int, str], first: int, last: int) -> str:
        return f"{self._added(name)}/" + (f"batch={names[first]}" if first == last else f"sum={first}-{last}")

    def partly_summed(self, name: str, without: str | None = None) -> DataFrame:
        """Rows that add up to those of ``read``: of n summed batches about 2 log2(n) files at most are opened."""
        order = self._order(name)
        names = {n: b for b, n in order.items()}
        pieces = [self._piece(name, names, *p) for p in cover(len(names), set(self._sums(name)), order.get(without))]
        pieces += [f"{self._added(name)}/batch={b}" for b in self.batches(name) if b not in order and b != without]
        if self.versions(name):
            pieces.append(f"{self.root}/{name}/v{self.versions(name)[-1]}")
        reader = self.spark.read.schema(schema.TABLES[name])
        return reader.parquet(*pieces) if pieces else self.spark.createDataFrame([], schema.TABLES[name])

    def compact(self, name: str) -> int:
        """Fold batches, changes and deletions into the next version. Call it between batches, when none has to be run again."""
        return self.write(name, self.read(name))

    def changes(self, name: str) -> list[tuple[int, int]]:
        """The fewest change files that hold all changes since the newest version, as their first and last numbers."""
        spans = [tuple(map(int, s.split("-"))) for s in self._listed(self._added(name), "change=")]
        cover, at = [], 1
        while widest := max((last for first, last in spans if first == at), default=0):
            cover.append((at, widest))
            at = widest + 1
        return cover

    def change(self, name: str, rows: DataFrame) -> None:
        """Put rows in place of those with the keys of ``schema.KEYS``; new keys are added.

        The rows alone are written. Two files of equally many changes become one, as in counting by twos, so
        after n changes a read opens about log2(n) files, and a changed row is written that often.
        """
        done = self.changes(name)
        number = done[-1][1] + 1 if done else 1
        names = schema.TABLES[name].names
        self._save(name, rows.select(*names).withColumn("change", F.lit(number)), f"{self._added(name)}/change={number}-{number}")
        while len(done := self.changes(name)) > 1 and done[-2][1] - done[-2][0] == done[-1][1] - done[-1][0]:
            first, last = done[-2][0], done[-1][1]
            self._save(name, self._latest(name, done[-2:]), f"{self._added(name)}/change={first}-{last}")

    def _latest(self, name: str, spans: list[tuple[int, int]]) -> DataFrame:
        """The last change of each key, with its number."""
        kind, added = schema.TABLES[name], self._added(name)
        reader = self.spark.read.schema(StructType([*kind.fields, StructField("change", IntegerType())]))
        found = reader.parquet(*(f"{added}/change={first}-{last}" for first, last in spans))
        return found.groupBy(*schema.KEYS[name]).agg(F.max_by(F.struct(*kind.names, "change"), "change").alias("r")).select("r.*")

    def _changed(self, name: str, df: DataFrame) -> DataFrame:
        spans = self.changes(name) if name in schema.KEYS else []
        if not spans:
            return df
        keys, latest = schema.KEYS[name], self._latest(name, spans).drop("change")
        return df.join(latest.select(*keys), keys, "left_anti").select(*df.columns).unionByName(latest)

    def deletions(self) -> list[int]:
        return sorted(map(int, self._listed(f"{self.root}/_deleted", "part=")))

    def deleted(self, parts: list[int] | None = None) -> DataFrame | None:
        """``frame_id, day`` of deleted frames, of all deletions or of some; None where there are none."""
        parts = self.deletions() if parts is None else parts
        reader = self.spark.read.schema("frame_id long, day int")
        return reader.parquet(*(f"{self.root}/_deleted/part={n}" for n in parts)) if parts else None

    def delete(self, frames: DataFrame) -> int:
        """Delete frames and all that hangs off them, by a file of ``frame_id`` and the day of ``captured_at``; its number.

        The frames are evaluated once, by the write. Equal rows of many tasks come together by day, so a
        deletion of a few thousand frames is one small file, sorted by day.
        """
        number = (self.deletions() or [0])[-1] + 1
        day = F.floor(F.col("captured_at") / schema.DAY_MS).cast("int").alias("day")
        rows = frames.select("frame_id", day).repartition("day").sortWithinPartitions("day", "frame_id")
        self._save("_deleted", rows, f"{self.root}/_deleted/part={number}")
        return number

    def living(self, name: str, df: DataFrame) -> DataFrame:
        """Rows of a table of frames, or of one that hangs off them, without those of deleted frames.

        Frames are compared within their day, so a window of time reads the deletions of its days alone.
        The side of the ids is broadcast while its files are small enough for Spark's own limit.
        """
        gone = self.deleted() if name == "frames" or name in schema.SATELLITES else None
        if gone is None:
            return df
        on = ["day", "frame_id"] if name == "frames" and "day" in df.columns else ["frame_id"]
        return df.join(gone.select(*on), on, "left_anti").select(*df.columns)

    def forget_deleted(self) -> None:
        """Fold deletions into new versions of all tables they touch, the frames last, and drop them then.

        Call it between batches, as ``compact``; a lost job leaves the deletions, and can run again.
        """
        for name in (*schema.SATELLITES, "frames"):
            if self.versions(name) or self.batches(name) or self.changes(name):
                self.compact(name)
        self._remove(f"{self.root}/_deleted")

    def mark_schema(self, version: int) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/_schema/v{version}")

    def _save(self, name: str, df: DataFrame, path: str) -> None:
        if not self._listed(f"{self.root}/_schema", "v"):
            self.mark_schema(schema.SCHEMA_VERSION)
        if name == "frames":
            df = df.withColumn("day", F.floor(F.col("captured_at") / schema.DAY_MS).cast("int"))
        by = ["day"] if name in schema.BY_DAY and "day" in df.columns else None
        df.write.mode("overwrite").parquet(path, partitionBy=by)


def storage_classes(spark: SparkSession, classes: dict[str, str]) -> DataFrame:
    """``class, n_files, n_bytes`` of directories, from file metadata alone."""
    out = None
    for name, path in classes.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("class"), "length")
        out = files if out is None else out.unionByName(files)
    return out.groupBy("class").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
