"""Retrieval: postings, BM25 with phrases, cosine neighbours, reciprocal rank fusion, hydration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.timeseries import clamp, within
from tidemark.schema import MAX_MS, MIN_MS

RRF_K = 60

#: How many pools an interactive text arm takes before the window is tried.
OVER_FETCH = 4
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def normalized_limit(limit: int) -> int:
    return clamp(limit, 1, 2000)


def candidate_pool(limit: int) -> int:
    return clamp(5 * limit, 50, 2000)


#: Parts of an index by term, and bytes of text that a task indexes and that a file of a part comes from, about.
BUCKETS, TASK_BYTES, FILE_BYTES = 32, 4 << 20, 16 << 20
#: Tokens that a task groups at once.
TOKENS_AT_ONCE = 2_000_000
#: Terms up to which an index is asked by name; above, all of it is read and joined.
NAMED_TERMS = 1_000


@dataclass
class Index:
    """``postings``: buckets, bucket, term, frame_id, size, positions; ``layer``: rows of texts, tokens, to be added up.

    ``size`` is the number of tokens of the frame's text. Terms lie in the bucket of their hash, so a stored
    index is read only where the terms of a query are. Segments may differ in their number of buckets;
    ``parts`` lists these numbers. Texts without tokens count in ``layer``.
    """

    postings: DataFrame
    layer: DataFrame
    parts: tuple[int, ...] = (BUCKETS,)

    @property
    def buckets(self) -> int:
        return max(self.parts)

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of a few terms; the buckets are constants that prune a stored index."""
        if len(terms) > NAMED_TERMS:
            return self.postings
        if not terms:
            return self.postings.where("false")
        places = " OR ".join(f"(buckets = {n} AND bucket IN ({', '.join(f'pmod(hash({quoted(t)}), {n})' for t in terms)}))" for n in self.parts)
        return self.postings.where(f"({places}) AND term IN ({', '.join(map(quoted, terms))})")

    def totals(self) -> DataFrame:
        """One row: ``total`` texts and their ``mean`` number of tokens."""
        return self.layer.selectExpr("sum(texts) AS total", "sum(tokens) / sum(texts) AS mean")


def blocks(texts: DataFrame, column: str, stemmed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, term, found``: the postings of some texts of one task, a row for each term; a term has several rows.

    A text's postings are made where it is read, so no row of a single token is shuffled or held.
    """
    one = "struct<frame_id: bigint, size: int, positions: array<int>>"
    made = texts.select(F.col("frame_id").cast("long"), tx.tokens(F.col(column)).alias("tokens")).mapInArrow(_post(stemmed), f"term string, found array<{one}>")
    return made.select(F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"), "term", "found")


def _post(stemmed: bool):
    def some(ids: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
        sizes, words = pc.list_value_length(tokens).to_numpy(), tokens.flatten()
        if stemmed:
            codes, terms = tx.stems_of(words)
        else:
            coded = words.dictionary_encode()
            codes, terms = coded.indices.to_numpy(), coded.dictionary
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        position = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        order = np.argsort(codes, kind="stable")  # texts and places stay in order within a term
        codes, row, position = codes[order], row[order], position[order]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])
        held, owner = codes[starts], row[starts]
        firsts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(position))
        found = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.array(sizes[owner], pa.int32()), places], ["frame_id", "size", "positions"])
        found = pa.ListArray.from_arrays(pa.array(np.r_[firsts, len(held)], pa.int32()), found)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(held[firsts])), found], ["term", "found"])

    def run(batches):
        for batch in batches:
            ids, tokens = batch.column("frame_id"), batch.column("tokens")
            upto, at = np.cumsum(pc.list_value_length(tokens).to_numpy()), 0
            while at < len(upto):
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + TOKENS_AT_ONCE, "right")))
                if upto[end - 1] > before:
                    yield some(ids.slice(at, end - at), tokens.slice(at, end - at))
                at = end

    return run


def postings_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("buckets", "bucket", "term", F.inline("found"))


def layer_of(texts: DataFrame, column: str) -> DataFrame:
    """``texts, tokens``; a stem is a token as its word is."""
    return texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size(tx.tokens(F.col(column)))), F.lit(0)).alias("tokens"))


def build_index(texts: DataFrame, column: str, stemmed: bool = False, buckets: int = BUCKETS) -> Index:
    """The index of one text layer of ``frame_id, <column>``, for use as it is."""
    return Index(postings_of(blocks(texts, column, stemmed, buckets).withColumn("buckets", F.lit(buckets))), layer_of(texts, column), (buckets,))


def write_index(texts: DataFrame, column: str, path: str, stemmed: bool = False, buckets: int = BUCKETS, segment: str = "all") -> None:
    """Store the index of some texts as one segment; the segment is replaced if it is there.

    Tasks and files follow the bytes of the texts. A part of many bytes is dealt to several tasks by frame,
    so a frequent term is shared; files are sorted by term, so that row groups without a query's terms are skipped.
    """
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    shares = max(1, -(-size // (buckets * FILE_BYTES)))
    tasks = clamp(-(-size // TASK_BYTES), 1, buckets * shares)
    share = F.pmod(F.xxhash64(F.get("found", F.lit(0))["frame_id"]), F.lit(shares))
    dealt = blocks(texts, column, stemmed, buckets).repartitionById(tasks, F.pmod(F.col("bucket") * shares + share, F.lit(tasks)).cast("int"))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}/buckets={buckets}")
    for other in (n for n in stored_buckets(texts.sparkSession, f"{path}/postings/segment={segment}") if n != buckets):
        at = texts.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/segment={segment}/buckets={other}")
        at.getFileSystem(texts.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    # Written last: a segment without its totals isn't there yet.
    layer_of(texts, column).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/layer/segment={segment}")


def stored_buckets(spark: SparkSession, path: str) -> list[int]:
    """The numbers of buckets below a segment's folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("buckets="))


def read_index(spark: SparkSession, path: str) -> Index:
    """All segments of a stored index, whatever their numbers of buckets."""
    layer = spark.read.parquet(f"{path}/layer")
    counts = tuple(sorted(r.buckets for r in layer.select("buckets").distinct().collect()))  # a few numbers
    return Index(postings_of(spark.read.parquet(f"{path}/postings")), layer, counts)


def segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete segments of a stored index."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layer")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(p.getName().partition("=")[2] for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_removal(texts: DataFrame, column: str, path: str, segment: str, stemmed: bool = False) -> None:
    """A segment that takes texts off the totals of an index; their postings are left out by ``without``."""
    minus = layer_of(texts, column).select(*((-F.col(c)).alias(c) for c in ("texts", "tokens")))
    minus.withColumn("buckets", F.lit(BUCKETS)).coalesce(1).write.mode("overwrite").parquet(f"{path}/layer/segment={segment}")


def without(index: Index, gone: DataFrame) -> Index:
    """An index without the postings of some frames, whose texts its totals leave out already."""
    return replace(index, postings=index.postings.join(gone.select("frame_id"), "frame_id", "left_anti").select(*index.postings.columns))


def score_phrases(index: Index, queries: list[list[list[str]]]) -> DataFrame:
    """``query, frame_id, score`` (lower is better) of frames with all phrases of a query, for a few queries at once.

    Document counts and the mean length are those of the whole layer, whatever is asked for later. Only
    the postings of the queries' terms are read and shuffled, by frame.
    """
    phrases = sorted({tuple(p) for q in queries for p in q})
    terms = sorted({t for p in phrases for t in p})
    alone = {p[0] for p in phrases if len(p) == 1}
    together = {t for p in phrases if len(p) > 1 for t in p}
    # Expressions are written as text: an interactive search spends more on building columns one by one than on running them.
    of = lambda t, what: f"max(IF(term = {quoted(t)}, {what}, NULL)) AS {'n' if t in alone and what != 'positions' else 'p'}{terms.index(t)}"
    found = [*(of(t, "size(positions)") for t in terms if t in alone), *(of(t, "positions") for t in terms if t in together)]

    def frequency(phrase: tuple[str, ...]) -> str:
        if len(phrase) == 1:
            return f"coalesce(n{terms.index(phrase[0])}, 0)"
        both = f"p{terms.index(phrase[0])}"
        for k, t in enumerate(phrase[1:], 1):
            both = f"array_intersect({both}, transform(p{terms.index(t)}, x -> x - {k}))"
        return f"coalesce(size({both}), 0)"

    docs = index.of(terms).groupBy("frame_id", "size").agg(*map(F.expr, found)).selectExpr("frame_id", "size", *(f"{frequency(p)} AS tf{k}" for k, p in enumerate(phrases)))
    holding = docs.selectExpr(*(f"count_if(tf{k} > 0) AS n{k}" for k in range(len(phrases))))
    rows = docs.join(F.broadcast(holding)).join(F.broadcast(index.totals()))  # one row each
    each = []
    for n, query in enumerate(queries):
        places = [phrases.index(tuple(p)) for p in query]
        score = " + ".join(["0.0D", *(bm25(f"tf{k}", f"n{k}") for k in places)])
        each.append(f"IF({' AND '.join(f'tf{k} > 0' for k in places) or 'true'}, struct({n} AS query, -({score}) AS score), NULL)")
    if len(each) == 1:
        return rows.selectExpr("frame_id", f"{each[0]} AS found").where("found IS NOT NULL").selectExpr("found.query", "frame_id", "found.score")
    return rows.selectExpr("frame_id", f"explode(filter(array({', '.join(each)}), x -> x IS NOT NULL)) AS found").selectExpr("found.query", "frame_id", "found.score")


def quoted(text: str) -> str:
    """A text as a constant of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bm25(tf: str, holding: str) -> str:
    """A phrase's part of a score, beside the columns ``total, mean, size``."""
    return f"greatest(ln((total - {holding} + 0.5D) / ({holding} + 0.5D)), {LEAST_IDF!r}D) * ({tf} * {K1 + 1}D) / ({tf} + {K1}D * (1 - {B}D + {B}D * size / mean))"


def text_arm(index: Index, frames: DataFrame, text: str, pool: int, start: int = MIN_MS, end: int = MAX_MS, stemmed: bool = False) -> DataFrame:
    """``frame_id, score, rank``: the best ``pool`` frames of a window; a query without tokens finds nothing."""
    phrases = tx.query_phrases(text, stemmed)
    scored = score_phrases(index, [phrases or [["\0"]]]).select("frame_id", "score")
    inside = scored.join(within(frames, start, end).select("frame_id"), "frame_id", "left_semi")
    return with_rank(inside, ["score", "frame_id"], pool)


def with_rank(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank from 1; the limit is taken before the one-task window."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def _first(k: int, query: np.ndarray, distance: np.ndarray, frame: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest rows of each query, sorted; ties go by frame and chunk."""
    order = np.lexsort((chunk, frame, distance, query))
    of = query[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
    return tuple(x[order[place < k]] for x in (query, distance, frame, chunk))


def _nearest(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, block: int = 1024) -> DataFrame:
    """``query_id, frame_id, chunk_index, distance`` (1 - cosine, in doubles): the best ``k`` per task and query.

    A task holds its best ``k`` so far and emits them once, so ``MOST_RESULTS`` bounds what it holds and
    what is shuffled grows with the tasks, not with the vectors. Vectors of another length than the
    queries' raise.
    """
    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
    size = q.shape[1] if len(q) else 0
    schema = pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("chunk_index", pa.int32()), ("distance", pa.float64())])

    def best(batches):
        kth, held, waiting = np.full(len(q), np.inf), None, 0
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            frame, chunk, column = (batch.column(c) for c in ("frame_id", "chunk_index", "embedding"))
            if (np.diff(column.offsets.to_numpy()) != size).any():
                raise ValueError(f"a vector doesn't have {size} dimensions")
            v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            frame, chunk, parts = frame.to_numpy(), chunk.to_numpy(), [held] if held else []
            for at in range(0, len(q), block):
                d = 1 - q[at : at + block] @ v.T
                # Ties at the k-th place go by id, so all rows as near as it stay in the race.
                if d.shape[1] >= k:
                    kth[at : at + block] = np.minimum(kth[at : at + block], np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(d <= kth[at : at + block, None])
                parts.append((r + at, d[r, c], frame[c], chunk[c]))
            held = tuple(map(np.concatenate, zip(*parts)))
            if len(held[0]) > waiting:
                held = _first(k, *held)
                waiting = 2 * len(held[0]) + 10_000
        if held:
            query, distance, frame, chunk = _first(k, *held)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(frame), pa.array(chunk, pa.int32()), pa.array(distance)], schema=schema)

    return vectors.select("frame_id", "chunk_index", "embedding").mapInArrow(best, "query_id long, frame_id long, chunk_index int, distance double")


def knn_chunks(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` nearest chunks: ``frame_id, chunk_index, distance``."""
    near = _nearest(vectors, np.zeros(1, np.int64), np.array([query], np.float64), k)
    return near.select("frame_id", "chunk_index", "distance").orderBy("distance", "frame_id", "chunk_index").limit(k)


def knn(vectors: DataFrame, frames: DataFrame, query: list[float], k: int, start: int = MIN_MS, end: int = MAX_MS, prefilter: bool = False) -> DataFrame:
    """``frame_id, distance, rank`` of frames by their nearest chunk.

    As a rule the nearest ``k`` chunks of all are taken first and the window second, so a narrow window
    may find few; ``prefilter`` looks within the window only.
    """
    inside = within(frames, start, end).select("frame_id")
    if prefilter:
        near = knn_chunks(vectors.join(inside, "frame_id", "left_semi"), query, k)
    else:
        near = knn_chunks(vectors, query, k).join(inside, "frame_id", "left_semi")
    first = near.groupBy("frame_id").agg(F.min("distance").alias("distance"))
    return with_rank(first, ["distance", "frame_id"], k)


#: Vectors of one batch of searches, and neighbours that a task may hold for them.
MOST_QUERIES, MOST_RESULTS = 100_000, 10_000_000


def asked_for(queries: DataFrame, *columns: str) -> list:
    """The rows of a query set, whose size is checked."""
    rows = queries.select(*columns).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"a query set holds at most {MOST_QUERIES} rows; give more in several calls")
    return rows


def knn_batch(vectors: DataFrame, queries: DataFrame | list, k: int) -> DataFrame:
    """``query_id, frame_id, chunk_index, distance, rank`` of the ``k`` nearest chunks for each of a stated set of queries.

    Vectors are compared with blocks of queries; every task keeps its best ``k`` for each query, so what
    is shuffled is bounded by tasks x queries x k. The query set is a parameter: its size is checked.
    """
    rows = queries if isinstance(queries, list) else [tuple(r) for r in asked_for(queries, "query_id", "embedding")]
    if len(rows) > MOST_QUERIES or len(rows) * k > MOST_RESULTS:
        raise ValueError(f"a query set holds at most {MOST_QUERIES} vectors and asks for at most {MOST_RESULTS} neighbours")
    part = _nearest(vectors, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0), k)
    w = W.partitionBy("query_id").orderBy("distance", "frame_id", "chunk_index")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(arms: list[DataFrame], limit: int) -> DataFrame:
    """``frame_id, score``: sums of 1 / (60 + rank) over the arms in their order; ties go to the larger id."""
    joined = None
    for k, arm in enumerate(arms):
        own = arm.select("frame_id", F.col("rank").alias(f"r{k}"))
        joined = own if joined is None else joined.join(own, "frame_id", "full")
    score = F.lit(0.0)
    for k in range(len(arms)):
        score = score + F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(f"r{k}")), F.lit(0.0))
    return joined.select("frame_id", score.alias("score")).orderBy(F.desc("score"), F.desc("frame_id")).limit(limit)


def hydrate(fused: DataFrame, frames: DataFrame, texts: DataFrame, phrases: list[list[str]], include_chrome: bool = False, stemmed: bool = False) -> DataFrame:
    """Hits with their frame and snippet: of the content, else of the raw text, else the beginning of the content."""
    rows = F.broadcast(fused).join(frames.select("frame_id", "captured_at", "image_path", "app_hint"), "frame_id").join(texts.select("frame_id", "content_text", "raw_text"), "frame_id", "left")
    snip = lambda c: tx.snippet(F.col(c), phrases, stemmed)
    said = F.coalesce(snip("content_text"), *([snip("raw_text")] if include_chrome else []), tx.fallback_snippet(F.col("content_text")), F.lit(""))
    return rows.select("frame_id", "captured_at", said.alias("snippet"), F.col("score").cast("float").alias("score"), "image_path", "app_hint").orderBy(F.desc("score"), F.desc("frame_id"))


@dataclass
class Corpus:
    """What a search works on."""

    frames: DataFrame
    texts: DataFrame
    vectors: DataFrame | None = None
    stemmed: bool = False
    indexes: dict[str, Index] = field(default_factory=dict)
    #: A cell index of the vectors (``cells.Cells``), which is searched in their place.
    cells: Any = None

    def near(self, query: list[float], k: int, start: int, end: int) -> DataFrame:
        """``frame_id, distance, rank`` of the nearest frames."""
        return self.cells.knn(self.frames, query, k, start, end) if self.cells else knn(self.vectors, self.frames, query, k, start, end)

    def index(self, layer: str) -> Index:
        """The stored index of a text layer, or one made for this search alone."""
        return self.indexes.get(layer) or build_index(self.texts, layer, self.stemmed)


def hybrid_ids(corpus: Corpus, text: str, limit: int, query_vector: list[float] | None = None, start: int = MIN_MS, end: int = MAX_MS, include_chrome: bool = False) -> DataFrame:
    """``frame_id, score`` of a search over text layers and vectors; a blank text finds nothing."""
    limit, blank = normalized_limit(limit), not text.strip()
    pool = candidate_pool(limit)
    layers = ["content_text", *(["raw_text"] if include_chrome else [])]
    arms = [text_arm(corpus.index(c), corpus.frames, text, pool, start, end, corpus.stemmed) for c in layers]
    if query_vector is not None and (corpus.cells or corpus.vectors) is not None and not blank:
        arms.append(corpus.near(query_vector, pool, start, end))
    fused = rrf(arms, limit)
    return fused.limit(0) if blank else fused


def hybrid_search(corpus: Corpus, text: str, limit: int = 20, query_vector: list[float] | None = None, start: int = MIN_MS, end: int = MAX_MS, include_chrome: bool = False) -> DataFrame:
    """Hits: ``frame_id, captured_at, snippet, score, image_path, app_hint``, best first."""
    fused = hybrid_ids(corpus, text, limit, query_vector, start, end, include_chrome)
    return hydrate(fused, corpus.frames, corpus.texts, tx.query_phrases(text, corpus.stemmed), include_chrome, corpus.stemmed)


HITS = "frame_id long, captured_at long, snippet string, score float, image_path string, app_hint string"


def search_hits(corpus: Corpus, text: str, limit: int = 20, query_vector: list[float] | None = None, start: int = MIN_MS, end: int = MAX_MS, include_chrome: bool = False) -> list[tuple]:
    """The hits of ``hybrid_search`` as rows, for one interactive search.

    The arms run at the same time, and what they find, at most 8,000 rows each, is fused and cut to snippets
    here. The window is tried on the frames of these rows; if it leaves too few of a text arm that had more, that
    arm is asked again within the window. Texts are read for the hits alone.
    """
    limit = normalized_limit(limit)
    if not text.strip():
        return []
    pool, phrases = candidate_pool(limit), tx.query_phrases(text, corpus.stemmed)
    layers = ["content_text", *(["raw_text"] if include_chrome else [])] if phrases else []
    inside = within(corpus.frames, start, end).select("frame_id")

    def ranked_ids(layer: str, most: int, join: bool = False) -> list[int]:
        scored = score_phrases(corpus.index(layer), [phrases])
        scored = scored.join(inside, "frame_id", "left_semi") if join else scored
        return [r.frame_id for r in scored.orderBy("score", "frame_id").limit(most).select("frame_id").collect()]

    def near_chunks() -> list[tuple[int, float]]:
        return [(r.frame_id, r.distance) for r in (corpus.cells.chunks(query_vector, pool) if corpus.cells else knn_chunks(corpus.vectors, query_vector, pool)).collect()]

    def rows_of(df: DataFrame, ids: Iterable[int], *columns: str) -> dict[int, Row]:
        among = f"frame_id IN ({', '.join(map(str, ids)) or 'NULL'})"
        return {r.frame_id: r for r in df.where(among).select("frame_id", *columns).collect()}

    meta = within(corpus.frames, start, end)
    with ThreadPoolExecutor(len(layers) + 2) as threads:
        found = [threads.submit(ranked_ids, layer, OVER_FETCH * pool) for layer in layers]
        near = threads.submit(near_chunks) if query_vector is not None and (corpus.cells or corpus.vectors) is not None else None
        arms, nearest = [f.result() for f in found], {}
        for frame, distance in near.result() if near else []:
            nearest[frame] = min(distance, nearest.get(frame, distance))
        known = rows_of(meta, sorted({*nearest, *(i for arm in arms for i in arm)}), "captured_at", "image_path", "app_hint")
        for k, arm in enumerate(arms):
            left = [i for i in arm if i in known]
            if len(left) < pool and len(arm) == OVER_FETCH * pool:  # the window may hold more of them further down
                left = ranked_ids(layers[k], pool, join=True)
                known |= rows_of(meta, left, "captured_at", "image_path", "app_hint")
            arms[k] = left[:pool]
    if near:
        arms.append([i for i, _ in sorted(nearest.items(), key=lambda x: (x[1], x[0])) if i in known])
    scores: dict[int, float] = {}
    for arm in arms:
        for rank, i in enumerate(arm, 1):
            scores[i] = scores.get(i, 0.0) + 1.0 / (RRF_K + rank)
    best = sorted(scores, key=lambda i: (-scores[i], -i))[:limit]

    def said(content: str | None, raw: str | None) -> str:
        hit = next((x for t in (content, raw if include_chrome else None) if t is not None and (x := tx.snippet_python(t, phrases, corpus.stemmed)) is not None), None)
        return hit if hit is not None else tx.fallback_snippet_python(content or "")

    texts = rows_of(corpus.texts, best, "content_text", "raw_text") if best else {}
    shown = {i: said(texts[i].content_text, texts[i].raw_text) if i in texts else "" for i in best}
    return [(i, known[i].captured_at, shown[i], scores[i], known[i].image_path, known[i].app_hint) for i in best]


def rag_context(corpus: Corpus, text: str, k: int = 8, query_vector: list[float] | None = None, drop_blank: bool = False) -> DataFrame:
    """``frame_id, text, score, captured_at`` for an answer: whole texts, the snippet where there is none."""
    return with_texts(hybrid_search(corpus, text, k, query_vector), corpus.texts, drop_blank)


def with_texts(hits: DataFrame, texts: DataFrame, drop_blank: bool = False) -> DataFrame:
    """``frame_id, text, score, captured_at`` of hits, best first; ``drop_blank`` leaves out hits without words."""
    own = texts.select("frame_id", F.when(F.col("content_text") != "", F.col("content_text")).alias("content"))
    out = hits.join(own, "frame_id", "left").select("frame_id", F.coalesce("content", "snippet").alias("text"), "score", "captured_at")
    return (out.where(F.trim("text") != "") if drop_blank else out).orderBy(F.desc("score"), F.desc("frame_id"))


# Many searches in one plan. The queries are a table: what is shuffled grows with the matches.


#: Cells of phrases and frames, and of queries and frames, that a task of a batch holds at once.
CELLS = 2_000_000
#: Tokens of the searches that are matched in one pass over the index; more take several passes.
PASS_TOKENS = 200_000


def passes(terms: Iterable[tuple[int, int, int, str]]) -> Iterator[list[tuple[int, int, int, str]]]:
    """Tokens of whole queries, ``PASS_TOKENS`` at most unless one query alone has more."""
    held: list[tuple[int, int, int, str]] = []
    for _, own in groupby(terms, lambda t: t[0]):
        own = list(own)
        if held and len(held) + len(own) > PASS_TOKENS:
            yield held
            held = []
        held += own
    if held:
        yield held


def bm25_batch(index: Index, terms: Iterable[tuple[int, int, int, str]], spark: SparkSession, times: DataFrame | None = None, windows: dict[int, tuple[int, int]] | None = None, most: int | None = None) -> DataFrame:
    """``query, frame_id, score`` of frames with all phrases of a query.

    ``terms``: ``(query, phrase, place, term)``, one for each token, those of a query together; any number of them,
    which are taken in passes of ``PASS_TOKENS``. Phrases of a pass are looked up once, whatever queries ask for them,
    and dealt by frame; a task finds the queries of its frames. So what is shuffled are the phrases' frames, not the
    results. With ``times`` (``frame_id, captured_at``) only these frames count, within the queries' ``windows``;
    ``most`` leaves each task its best rows of a query.
    """
    found = [_one_pass(index, some, spark, times, windows, most) for some in passes(terms)]
    return reduce(DataFrame.unionByName, found) if found else _one_pass(index, [], spark, times, windows, most)


def _one_pass(index: Index, terms: list[tuple[int, int, int, str]], spark: SparkSession, times: DataFrame | None, windows: dict[int, tuple[int, int]] | None, most: int | None) -> DataFrame:
    asked: dict[tuple[int, int], dict[int, str]] = {}
    for query, phrase, place, term in terms:
        asked.setdefault((query, phrase), {})[place] = term
    number: dict[tuple[str, ...], int] = {}
    queries: dict[int, list[int]] = {}
    for (query, _), at in sorted(asked.items()):
        queries.setdefault(query, []).append(number.setdefault(tuple(at[k] for k in sorted(at)), len(number)))
    tf = phrase_frequencies(index, number, spark)
    holding = tf.groupBy("phrase").agg(F.count("*").alias("n_p"))  # as many rows as phrases at most
    rows = (tf.join(times, "frame_id") if times is not None else tf.withColumn("captured_at", F.lit(0).cast("long"))).repartition("frame_id")
    rows = rows.join(F.broadcast(holding), "phrase").join(F.broadcast(index.totals()))
    parts = rows.select("frame_id", "captured_at", "phrase", F.expr(bm25("tf", "n_p")).alias("part")).sortWithinPartitions("frame_id")
    return parts.mapInArrow(_matches(len(number), queries, windows or {}, most), "query long, frame_id long, score double")


def phrase_frequencies(index: Index, number: dict[tuple[str, ...], int], spark: SparkSession) -> DataFrame:
    """``phrase, frame_id, size, tf`` of numbered phrases."""
    postings = index.of(sorted({t for p in number for t in p}))
    words = spark.createDataFrame([(p[0], n) for p, n in number.items() if len(p) == 1], "term string, phrase int")
    tf = postings.join(F.broadcast(words), "term").select("phrase", "frame_id", "size", F.size("positions").alias("tf"))
    several = [(t, n, k, len(p)) for p, n in number.items() if len(p) > 1 for k, t in enumerate(p)]
    if not several:
        return tf
    places = spark.createDataFrame(several, "term string, phrase int, place int, length int")
    hits = postings.join(F.broadcast(places), "term").select("phrase", "length", "frame_id", "size", F.explode("positions").alias("position"), "place")
    starts = hits.groupBy("phrase", "length", "frame_id", "size", (F.col("position") - F.col("place")).alias("start")).agg(F.count("*").alias("n"))
    return tf.unionByName(starts.where("n = length").groupBy("phrase", "frame_id", "size").agg(F.count("*").cast("int").alias("tf")))


def _matches(n_phrases: int, queries: dict[int, list[int]], windows: dict[int, tuple[int, int]], most: int | None):
    """Rows of frames' phrases, in order of frames, to the queries all of whose phrases a frame has."""
    lengths: dict[int, list[int]] = {}
    for q, phrases in queries.items():
        lengths.setdefault(len(phrases), []).append(q)
    groups = [(np.array(qs), np.array([queries[q] for q in qs])) for _, qs in sorted(lengths.items())]
    spans = [(np.array([windows.get(q, (MIN_MS, MAX_MS)) for q in qs], np.int64) if windows else None) for qs, _ in groups]
    width = max(1, min(4096, CELLS // max(1, n_phrases)))
    places = np.full(n_phrases, -1)  # of the phrases of some frames; -1 in between
    schema = pa.schema([("query", pa.int64()), ("frame_id", pa.int64()), ("score", pa.float64())])

    def found(frame: np.ndarray, time: np.ndarray, place: np.ndarray, phrase: np.ndarray, part: np.ndarray):
        """Queries, frames and negative scores; ``place`` is each row's frame.

        Whether a frame has a phrase is a bit, so queries are matched by the eight frames of a byte.
        """
        own, row = np.unique(phrase, return_inverse=True)
        table, held = np.zeros((len(own), len(frame))), np.zeros((len(own), len(frame)), bool)
        table[row, place], held[row, place] = part, True
        bits = np.packbits(held, axis=1)
        places[own] = np.arange(len(own))
        for (ids, wanted), span in zip(groups, spans):
            rows = places[wanted]
            asked = np.flatnonzero((rows >= 0).all(1))
            for at in range(0, len(asked), step := max(1, CELLS // len(frame))):
                some = asked[at : at + step]
                mine = rows[some]
                both = bits[mine[:, 0]]
                for k in range(1, mine.shape[1]):
                    both &= bits[mine[:, k]]
                hit = np.unpackbits(both, axis=1, count=len(frame)).view(bool)
                if span is not None:
                    hit &= (time >= span[some, :1]) & (time < span[some, 1:])
                r, c = np.divmod(np.flatnonzero(hit), len(frame))
                if len(r):
                    total = table[mine[r, 0], c]
                    for k in range(1, mine.shape[1]):
                        total += table[mine[r, k], c]
                    yield ids[some[r]], -total, frame[c]
        places[own] = -1

    def blocks_of(batches):
        """Whole frames, up to ``width`` of them."""
        held, frames = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            frames += 1 + np.count_nonzero(np.diff(held[-1][0]))
            if frames <= width:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            while len(starts) > width:  # the last frame may go on
                yield [x[: starts[width]] for x in rows]
                rows, starts = [x[starts[width] :] for x in rows], starts[width:] - starts[width]
            held, frames = [rows], len(starts)
        if held and len((rows := [np.concatenate(x) for x in zip(*held)])[0]):
            yield rows

    def run(batches):
        best, waiting = None, 0
        for frame, time, phrase, part in blocks_of(batches):
            starts = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
            place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(frame)]))
            for query, score, own in found(frame[starts], time[starts], place, phrase, part):
                if most is None:
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(own), pa.array(score)], schema=schema)
                    continue
                new = (query, score, own, own)
                best = new if best is None else tuple(map(np.concatenate, zip(best, new)))
                if len(best[0]) > waiting:
                    best = _first(most, *best)
                    waiting = 2 * len(best[0]) + 1_000_000
        if best is not None:
            query, score, own, _ = _first(most, *best)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(own), pa.array(score)], schema=schema)

    return run


def hybrid_batch(corpus: Corpus, queries: DataFrame, limit: int = 20, index: Index | None = None) -> DataFrame:
    """``query, frame_id, score, rank`` for a table ``query, text, embedding, start, end`` of searches.

    The same results as ``hybrid_ids`` for each row; ``start`` and ``end`` may be null.
    """
    spark, pool = queries.sparkSession, candidate_pool(normalized_limit(limit))
    asked = asked_for(queries, "query", "text", "embedding", "start", "end")
    # A phrase given twice counts twice, as it does in a single search.
    terms = [(q.query, n, k, t) for q in asked for n, p in enumerate(tx.query_phrases(q.text, corpus.stemmed)) for k, t in enumerate(p)]
    times = corpus.frames.select("frame_id", "captured_at")
    windows = {q.query: (MIN_MS if q.start is None else q.start, MAX_MS if q.end is None else q.end) for q in asked}
    window = F.broadcast(spark.createDataFrame([(q, *w) for q, w in windows.items()], "query long, low long, high long"))
    inside = lambda df: df.join(times, "frame_id").join(window, "query").where("captured_at >= low AND captured_at < high")
    top = lambda df, order: df.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= pool)
    scored = bm25_batch(index or corpus.index("content_text"), terms, spark, times, windows, pool)
    text = top(scored, ["score", "frame_id"]).select("query", "frame_id", F.col("rank").alias("r0"))
    near = knn_batch(corpus.vectors, [(q.query, q.embedding) for q in asked if q.text.strip()], pool).withColumnRenamed("query_id", "query").drop("rank")
    first = inside(near).groupBy("query", "frame_id").agg(F.min("distance").alias("distance"))
    vector = top(first, ["distance", "frame_id"]).select("query", "frame_id", F.col("rank").alias("r1"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    fused = text.join(vector, ["query", "frame_id"], "full").select("query", "frame_id", (F.lit(0.0) + part("r0") + part("r1")).alias("score"))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.desc("frame_id")))
    return fused.withColumn("rank", best).where(F.col("rank") <= normalized_limit(limit))
