"""Importance resampling towards a target distribution, over hashed word features.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes. CRCs are taken many at a
time: distinct features are grouped by equal length into matrices of bytes, one row a feature, all rows'
CRCs are updated column by column, and the buckets are scattered back to the features' places. Features
longer than ``WIDTH`` are cut into rows of that width, whose CRCs are joined (a CRC is linear), so one
long word doesn't make a matrix of as many columns.

The job reads the texts twice: once for the counts of each bucket, which each task adds up before they are
shuffled, and once for the documents' weights. The draw needs no order of all documents: scores are whole
numbers in a narrow range, so the documents above a score are counted, and ranks are taken within a score.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, to_arrow

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: Columns of the widest matrix; bytes of text whose words are held at once.
WIDTH, BLOCK = 64, 1 << 22

#: Scores of a block that is numbered by itself.
SCORES = 256

#: Bytes of words as they are, A-Z in lower case, all other bytes as blanks.
FOLD = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


@dataclass(frozen=True)
class Draw:
    """Words of the longest feature; buckets; share of the documents drawn, in percent, among those with
    ``least_words``; name that the noise of a document is drawn by."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(POLYNOMIAL)
    return table


TABLE = _table()


def by_columns(matrix: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The CRC registers of all rows of a byte matrix, updated one column after the other."""
    for column in np.ascontiguousarray(matrix.T):
        register = TABLE[(register ^ column) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


def _past_a_row() -> list[list[int]]:
    """What a register becomes after ``WIDTH`` zero bytes, by each of its four bytes."""
    zeros = np.zeros((256, WIDTH), np.uint8)
    return [by_columns(zeros, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).tolist() for k in range(4)]


PAST = _past_a_row()


def _crcs_of_long(features: list[bytes]) -> list[int]:
    """CRCs of features of more than ``WIDTH`` bytes. Zeros before the first byte don't change a register
    of zero, so rows are filled up from the left and the start value goes into the first four bytes."""
    rows = []
    for x in features:
        rows.append(bytes(-len(x) % WIDTH) + bytes(b ^ 0xFF for b in x[:4]) + x[4:])
    matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH)
    registers, at, out = by_columns(matrix, np.zeros(len(matrix), np.uint32)).tolist(), 0, []
    for row in rows:
        register = 0
        for r in registers[at : at + len(row) // WIDTH]:
            register = PAST[0][register & 255] ^ PAST[1][register >> 8 & 255] ^ PAST[2][register >> 16 & 255] ^ PAST[3][register >> 24] ^ r
        at += len(row) // WIDTH
        out.append(register ^ 0xFFFFFFFF)
    return out


def crcs(features: list[bytes]) -> np.ndarray:
    """The unsigned CRC-32 of each feature."""
    out = np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    for size, start, end in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(features)]):
        places = order[start:end]
        if size > WIDTH:
            places = order[start:]
            out[places] = _crcs_of_long([features[k] for k in places])
            break
        matrix = np.frombuffer(b"".join([features[k] for k in places]), np.uint8).reshape(len(places), size)
        out[places] = by_columns(matrix, np.full(len(places), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    return out


def features(text: bytes, longest: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """The number of words and the features of a text, in blocks of some ``BLOCK`` bytes; runs cross blocks."""
    plain, at, before = text.translate(FOLD), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK) if len(plain) - at > BLOCK else -1
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        found, both = list(words), before + words
        for n in range(2, longest + 1):
            found += [b" ".join(both[k : k + n]) for k in range(max(0, len(before) - n + 1), len(both) - n + 1)]
        yield len(words), found
        before, at = both[max(0, len(both) - longest + 1) :] if longest > 1 else [], end


def _slices(texts: Iterator[bytes | None], longest: int) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """Places of documents, words and features of some ``BLOCK`` bytes of text at a time."""
    places, words, found, held = [], [], [], 0
    for place, text in enumerate(texts):
        for n, some in features(text or b"", longest):
            places.append(place)
            words.append(n)
            found.append(some)
            held += min(len(text), BLOCK)
            if held >= BLOCK:
                yield places, words, found
                places, words, found, held = [], [], [], 0
    if places:
        yield places, words, found


def _buckets(found: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of a slice, and how many each document's part has."""
    numbers = defaultdict(count().__next__)
    each = np.concatenate([np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)) for some in found])
    return (crcs(list(numbers)) % np.uint32(buckets)).astype(np.int64)[each], np.array([len(some) for some in found], np.int64)


def _binary(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(texts: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket, repeats included; only buckets with some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for _, _, found in _slices((x.as_py() for x in batch.column(0)), draw.longest):
                total += np.bincount(_buckets(found, draw.buckets)[0], minlength=draw.buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": have, "n": total[have]}, schema=to_arrow("bucket long,n long"))

    return _binary(texts).mapInArrow(run, "bucket long,n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, draw: Draw = Draw()) -> np.ndarray:
    """Each bucket's gain in thousandths, from the ``bucket_counts`` of both sides; there are ``draw.buckets`` rows at most."""
    sides = []
    for counted in (source, target):
        n = np.zeros(draw.buckets, np.int64)
        for row in counted.collect():
            n[row["bucket"]] = row["n"]
        sides.append(n.tolist())
    s, t = sides
    of_s, of_t = sum(s) + draw.buckets, sum(t) + draw.buckets
    return np.array([math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, gained: np.ndarray, draw: Draw = Draw()) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of a document's features, rounded down; 0 without features."""
    schema = "doc_id long,n_words long,n_features long,weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for places, words, found in _slices((x.as_py() for x in batch.column(1)), draw.longest):
                buckets, sizes = _buckets(found, draw.buckets)
                below = np.concatenate([[0], np.cumsum(gained[buckets])])
                ends = np.cumsum(sizes)
                for out, more in ((n_words, words), (n_features, sizes), (total, below[ends] - below[ends - sizes])):
                    np.add.at(out, places, more)
            mean = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, mean))], schema=to_arrow(schema))

    return _binary(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, schema)


def ranked(scored: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Add ``rank`` to rows with ``doc_id, n_words, weight, score``: 1, 2, 3... among the drawn, else null.

    Scores are whole numbers between two bounds (gains of counts in 64 bits, noise of 32 bits), some 110,000
    at most, so the table of scores is broadcast. A score's noise is drawn by doc_id: no score holds more
    than one in 2,700 of the documents.
    """
    can = F.col("score").isNotNull() & (F.col("n_words") >= draw.least_words)
    held = scored.where(can).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / SCORES))
    held = checkpointed(held)
    blocks = held.groupBy("block").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1))  # some 430 rows at most
    blocks = blocks.select("block", F.coalesce(above, F.lit(0)).alias("above"))
    within = F.sum("n").over(W.partitionBy("block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    before = held.join(F.broadcast(blocks), "block").select("score", (F.col("above") + F.coalesce(within, F.lit(0))).alias("before"))
    n = held.agg(F.sum("n")).first()[0] or 0
    most = draw.percent * n // 100
    placed = scored.join(F.broadcast(before), "score", "left").withColumn("can", F.coalesce(can & (F.col("before") < most), F.lit(False)))
    order = W.partitionBy("score").orderBy("doc_id", "weight", "n_features", "n_words")
    drawn = placed.where("can").withColumn("rank", F.col("before") + F.row_number().over(order))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    others = placed.where("NOT can").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: one row per row of ``docs``; ``target`` has ``text``.

    A null, empty or wordless text has no features and the weight 0. Rows repeat as they do in ``docs``, and
    repeated rows are ranked one after the other; ties in score go to the smaller doc_id. A row without a
    doc_id has no noise, so no score, and isn't drawn or counted. Very long texts are read in blocks. Other
    columns are not read. An empty table gives no rows; without a target, gains follow from its zero counts.
    """
    gained = gains(bucket_counts(docs, draw), bucket_counts(target, draw), draw)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = checkpointed(weights(docs, gained, draw).withColumn("score", F.col("weight") + noise))
    return ranked(scored, draw).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(draw: Draw = Draw()) -> str:
    """``resample`` of ``documents`` towards ``benchmark`` in DuckDB's SQL, for features of one word."""
    words = lambda table, columns: f"SELECT {columns}unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {table}"
    step = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}::BIGINT) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bits(byte, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT byte, {step}, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_words AS (SELECT r, word, count(*) AS n FROM ({words("docs", "r, ")}) GROUP BY ALL),
goal_words AS (SELECT word, count(*) AS n FROM ({words("benchmark", "")}) GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM doc_words UNION SELECT word FROM goal_words)),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % {draw.buckets} AS bucket
  FROM hexed, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM goal_words JOIN hashed USING (word) GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {draw.buckets}) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {draw.buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM doc_words JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{draw.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT *, n_features >= {draw.least_words} AND score IS NOT NULL AS can, row_number() OVER (PARTITION BY n_features >= {draw.least_words} AND score IS NOT NULL ORDER BY score DESC, doc_id, weight, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= (SELECT {draw.percent} * count_if(can) // 100 FROM placed) THEN place END AS rank FROM placed"""
