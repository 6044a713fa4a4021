"""Best-fit packing of token sequences by exact-complement hashing.

The plan depends only on how many pieces there are of each length, at most one count per length up to
the capacity. So Spark counts the lengths, the driver plans on that bounded histogram, and Spark deals
the pieces to the planned slots by their rank within their length. The plan is a list of patterns
(lengths that share a sequence) with a multiplicity each, so its size doesn't grow with the table.

Planning takes lengths from the longest down. The gap beside a length is looked up as a single length,
then as a sum of two, then of three, among the lengths that are still available; a combination found is
consumed as often as its counts allow. Pairs are indexed by their sum once, and a triple is a length beside
an indexed pair. Where no sum fits exactly, the longest available length that
fits goes in (best fit) and the rest of the gap is looked up again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import DEFAULT_TOKENIZER, encoder
from tidemark.llm.common import checkpointed, map_batches, text_or_empty, to_arrow

#: Rows of a length that are ranked together, about; a length with more is split into buckets.
RANKED_ROWS = 1_000

PIECES = "doc_id long,piece int,start long,length long,ids_crc32 long,copy long"


class Sums:
    """The available lengths, and an index of their pairs by sum; a triple is a length beside an indexed pair.

    ``counts[n]`` says how many pieces of length n are available. Counts only fall, so pairs that have
    become impossible leave the index for good when they are met.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        have = [n for n, count in enumerate(self.counts) if n and count]
        self.pairs: list[list[int]] = [[] for _ in self.counts]
        for a in have:  # the longer one of each pair, in rising order
            for b in have:
                if b > a or a + b >= len(self.counts):
                    break
                self.pairs[a + b].append(a)

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...]:
        """The pair with the longest length whose sum is ``total``, available together with ``beside``."""
        listed = self.pairs[total]
        for k in range(len(listed) - 1, -1, -1):
            found = (listed[k], total - listed[k])
            if not self.enough(found):
                del listed[k]
            elif self.enough((*beside, *found)):
                return found
        return ()

    def longest(self, gap: int) -> int:
        """The longest available length of at most ``gap``, or 0."""
        return next((n for n in range(gap, 0, -1) if self.counts[n]), 0)

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths whose sum is ``gap``; empty if there are none."""
        if self.counts[gap]:
            return (gap,)
        found = self.pair(gap)
        first = gap
        while not found and (first := self.longest(first - 1)):
            if pair := self.pair(gap - first, (first,)):
                found = (first, *pair)
        return found

    def take(self, lengths: tuple[int, ...], times: int = 1) -> None:
        for x in lengths:
            self.counts[x] -= times


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, times)`` patterns that use every piece once; each pattern's sum is at most ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, patterns = Sums(counts), []
    longest = capacity
    while longest := left.longest(longest):
        left.take((longest,))
        pattern, gap = (longest,), capacity - longest
        while gap:
            more = left.exact(gap) or ((best,) if (best := left.longest(gap)) else ())
            if not more:
                break
            left.take(more)
            pattern += more
            gap -= sum(more)
        again = min(left.counts[x] // k for x, k in Counter(pattern).items())
        left.take(pattern, again)
        patterns.append((pattern, again + 1))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """``length, low, high, sequence, offset``: pieces of a length with ranks low..high-1 go, one each, to
    the sequences from ``sequence`` on, at ``offset``."""
    used, rows, sequence = Counter(), [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "offset"]).sort_values(["length", "low"], ignore_index=True)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Tokens of each document and an end id, cut where they exceed ``capacity``; the first piece takes what is left over."""

    def run(doc_ids, texts, copies, name, capacity, end_id):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "copy")}
        end, enc = np.array([end_id], "<u4").tobytes(), encoder(name, "library")
        for doc_id, text, copy in zip(doc_ids, texts, copies):
            ids = enc.encode(text) + end
            size = len(ids) // 4
            first = (size - 1) % capacity + 1
            cuts = [0, *range(first, size + 1, capacity)]
            pieces = len(cuts) - 1
            out["doc_id"] += [doc_id] * pieces
            out["copy"] += [copy] * pieces
            out["piece"] += range(pieces)
            out["start"] += cuts[:-1]
            out["length"] += [first, *[capacity] * (pieces - 1)]
            out["ids_crc32"] += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
        return out

    rows = docs.select("doc_id", text_or_empty(), F.monotonically_increasing_id().alias("copy"))
    return map_batches(rows, run, PIECES, tokenizer, capacity, end_id)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of ``PIECES``).

    Repeated documents are packed like any others; a null doc_id is kept; no pieces give no rows.
    """
    cut = checkpointed(cut)  # read three times: to count, to rank and to place
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # A full piece is a sequence by itself; those sequences have numbers below zero.
    full = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cut = cut.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    # A length may hold many of the rows, so ranks are counted within (length, bucket) and shifted by the
    # counts of the buckets before. A length of n rows has the root of n buckets of as many rows, so neither
    # one bucket nor the table of one length's buckets is large; the table of numbers of buckets has a row
    # for each length, fewer than ``capacity``.
    numbers = [(k, -(-n // max(RANKED_ROWS, isqrt(n)))) for k, n in histogram.items()]
    buckets = cut.sparkSession.createDataFrame(numbers, "length long,buckets long")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("copy", "piece"), F.col("buckets")))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "copy", "piece")) - 1
    ranked = dealt.withColumn("in_bucket", rank).join(shift, ["length", "bucket"]).withColumn("rank", F.col("in_bucket") + F.col("shift"))

    out = "doc_id long,piece int,start long,length long,ids_crc32 long,sequence_id long,offset long"
    out_schema = to_arrow(out)

    def place(batches):
        keys = table["length"].to_numpy(np.int64) << 40 | table["low"].to_numpy(np.int64)
        low, sequence, offset = (table[c].to_numpy(np.int64) for c in ("low", "sequence", "offset"))
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(sequence[at] + rank - low[at]), pa.array(offset[at])], schema=out_schema)

    placed = ranked.select(*columns, "rank").mapInArrow(place, out)
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens, one row per piece.

    A null or empty text is its end id alone; a very long text gives many pieces, all but the first
    full; ties in length go by doc_id; other columns are not read.
    """
    return pack(pieces(docs, capacity, end_id, tokenizer), capacity)
