"""How filters interact: what each removes at each place of every order of them.

Each document is read once and becomes a mask of the filters that it fails. Documents are then counted by
part and mask, so all orders are worked out on at most 32 cells a part. The orders come from a recursive
query: it extends prefixes of filters by the letters that they lack, carries the bits of the filters
applied so far beside each mask, and each level says which masks that step keeps and removes. Its size
depends on the number of filters alone (10,400 rows for five); joined to the cells, it gives the counts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, map_batches

#: The filters in the order of their bits; the last compares documents, the others read one text.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")

#: Bytes that aren't letters A-Z, bytes that go on a code point, and bytes that filter D looks for.
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUED = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"


def failed(text: bytes) -> int:
    """Bits of the filters of one text that it fails: few words, few different words, many capitals, a mark."""
    words = text.split()  # bytes: ASCII white space only
    points = len(text.translate(None, CONTINUED))
    short = len(words) < 50
    same = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * len(text.translate(None, NOT_CAPITALS)) > 5 * points
    return short | same << 1 | loud << 2 | (len(text) != len(text.translate(None, MARKS))) << 3


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask``: what each row of ``docs`` fails by itself."""

    def run(doc_ids, parts, texts):
        return {"doc_id": doc_ids, "part": parts, "digest": [hashlib.sha256(t).digest() for t in texts], "mask": [failed(t) for t in texts]}

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return map_batches(rows, run, "doc_id long,part string,digest binary,mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and those labelled good and toxic, by part and by all they fail."""
    rows = checkpointed(masks(docs))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c) for c in ("quality", "toxic")))
    key = ["digest", "mask", "part", "quality", "toxic"]
    known = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "mask", "part").agg(F.count("*").alias("n"))
    known = known.join(marked, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    # Copies by the thousand are a few rows from here on: of each kind their number, and how many rows have its smallest doc_id.
    kinds = known.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    first = F.col("first.doc_id") == F.min("first.doc_id").over(W.partitionBy("digest"))
    kinds = kinds.withColumn("once", F.when(first, F.col("first.n")).otherwise(0))
    once = kinds.select(*key[1:], F.col("once").alias("n"))
    again = kinds.select(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), *key[2:], (F.col("n") - F.col("once")).alias("n"))
    nameless = rows.where("doc_id IS NULL").groupBy("mask", "part").agg(F.count("*").alias("n")).withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    each = once.unionByName(again).unionByName(nameless.select(*once.columns)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


WALK = """
WITH RECURSIVE walk(prefix, step, applied, mask, bit, kept, removed, redundant, alone) AS (
  SELECT CAST('' AS STRING), 0, 0, mask, 0, 1, 0, 0, 0 FROM {of_masks}
  UNION ALL
  SELECT concat(prefix, letter.name), step + 1, applied | letter.bit, mask, letter.bit,
    IF(mask & (applied | letter.bit) = 0, 1, 0), IF(mask & letter.bit <> 0 AND mask & applied = 0, 1, 0),
    IF(mask & letter.bit <> 0 AND mask & applied <> 0, 1, 0), IF(mask = letter.bit, 1, 0)
  FROM (SELECT *, explode(filter(letters(), x -> applied & x.bit = 0)) AS letter FROM walk))
SELECT * FROM walk WHERE step > 0"""


def walk(of_masks: DataFrame) -> DataFrame:
    """Every prefix of every order beside every mask of ``of_masks``: whether its last step keeps or removes it."""
    letters = ", ".join(f"named_struct('name', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))
    return of_masks.sparkSession.sql(WALK.replace("letters()", f"array({letters})"), of_masks=of_masks)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part, filter_order, step`` with counts of documents, for each value of ``source`` in ``docs``.

    A null text counts as empty, a null source as ''. Repeated rows count each; of the rows of one text all
    but those with the smallest doc_id are copies. Rows without a doc_id have no labels, aren't copies and
    make none. A doc_id with several labels has a mark that any of them gives. Very long texts are read
    whole; other columns are not read; an empty table gives no rows.
    """
    counted = checkpointed(cells(docs, labels))
    spread = checkpointed(walk(counted.select("mask").distinct()))
    n = F.col("n")
    sums = {x: F.sum(n * F.col(x)) for x in ("kept", "removed", "redundant")} | {"unique_fails": F.sum(n * F.col("alone")), "good_lost": F.sum(F.col("good") * F.col("removed")), "toxic_lost": F.sum(F.col("toxic") * F.col("removed"))}
    steps = counted.join(F.broadcast(spread), "mask").groupBy("part", "prefix", "step").agg(*(c.alias(x) for x, c in sums.items()))
    # A prefix of k letters is what step k of each order that begins with it has applied.
    orders = spread.where(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.col("step"))).alias("k")).distinct()
    orders = orders.select("filter_order", F.substring("filter_order", F.lit(1), F.col("k")).alias("prefix"))
    removed = F.sum("removed").over(W.partitionBy("part", F.substring("prefix", -1, 1)))
    return steps.join(F.broadcast(orders), "prefix").withColumn("shapley", removed).select("part", "filter_order", "step", *sums, "shapley")


def oracle() -> str:
    """``audit`` of ``documents`` and ``labels`` in DuckDB's SQL; each order's steps are counted from the documents."""
    return """
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM base LEFT JOIN marked USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM masked GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS earlier FROM orders, generate_series(1, 5) AS s(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted"""
