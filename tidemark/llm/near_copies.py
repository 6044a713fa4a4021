"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity two SimHashes differ in some ten of 64 bits, too many for a join key of any length. So
candidates come from two places: equal bands of MinHashes (a pair at 0.8 shares one of 24 bands of six with
probability 0.9993), and SimHash links through the pivot tables, of all texts of a fingerprint. Every candidate is
compared by its whole shingle sets unless it is connected already, so no link is made up, and no candidate is left
out. Texts of the same words count once.

A band's key and the texts that hold it are a bucket, and so are the texts of fingerprints that SimHash links connect
within a key of theirs. Buckets of the same texts, as near copies have many, are one. A task gets the sets of a
bucket and compares each text with all before it (of a SimHash bucket, those that a link leads to) by counting the
shingles they share, but gives out no more links than connect what it has found, so pairs never become rows. Large
buckets are cut into parts, and each two parts are compared by a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import checkpointed, counted, few, join_hot, keep_rows, map_batches, text_or_empty, to_arrow
from tidemark.llm.components import stars

SHINGLE, BANDS, ROWS = 5, 24, 6

#: A bucket's part has about so many texts, and about so many shingles in all, at most.
PART_TEXTS, PART_SHINGLES = 256, 1 << 18


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only


def node(text: str) -> int:
    """Signed 64-bit name of a text's words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(_words(text)), 5)).view(np.int64))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles; fewer words make one shingle of all, no words one of none."""
    words = _words(text)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 7) for k in range(n)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of MinHashes; bands don't share keys."""
    rng = np.random.default_rng(17)
    mix, odd = rng.integers(0, 2**64, BANDS * ROWS, np.uint64), rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        low = np.minimum(low, ((hashes[k : k + 512, None] ^ mix) * odd).min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n`` (distinct shingles), ``bands`` and ``print`` (SimHash), one row per row of ``docs``."""

    def run(doc_ids, texts):
        out = {"doc_id": doc_ids, "node": [], "n": [], "bands": [], "print": np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)}
        for t in texts:
            own = shingles(t)
            for key, value in zip(("node", "n", "bands"), (node(t), len(own), bands(own))):
                out[key].append(value)
        return out

    return map_batches(docs.select("doc_id", text_or_empty()), run, "doc_id long,node long,n long,bands array<long>,print long")


def buckets(nodes: DataFrame) -> DataFrame:
    """``node, bucket, parts``: the bands that several nodes hold; bands held by the same nodes are one bucket."""
    return _buckets(nodes.select("node", "n", F.explode("bands").alias("key")))


def _buckets(each: DataFrame) -> DataFrame:
    """``node, bucket, parts``, and further columns, from ``node, n, key`` and these."""
    held = each.groupBy("key").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("n").alias("shingles")).where("held > 1")
    held, count = counted(_parted(held.groupBy("held", "x", "y", "shingles").agg(F.min("key").alias("key"))))
    return each.join(few(held, count), "key").drop("n").withColumnRenamed("key", "bucket")


def _parted(held: DataFrame) -> DataFrame:
    """``key, parts``: the parts of a bucket that ``held`` nodes with so many ``shingles`` hold."""
    parts = F.greatest(F.ceil(F.col("held") / PART_TEXTS), F.ceil(F.col("shingles") / PART_SHINGLES))
    return held.select("key", F.least(parts, F.col("held")).cast("int").alias("parts"))


def spanning_links(names: list[int], sets: list[np.ndarray], prints: list[int] | None = None, within: int = 4, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of sets with a Jaccard similarity of 0.8 or more, as many as connect what all such links would.

    Every two sets are compared: one set's shingles are marked, and each earlier set counts its marks. With
    ``prints`` only sets whose fingerprints differ in no more than ``within`` bits are compared, and none that are
    connected by then; those of one of the ``classes`` are from the start.
    """
    bits = None if prints is None else np.array(prints, np.int64).view(np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found, places = np.unique(np.concatenate(sets), return_inverse=True)
    marks, links = np.zeros(len(found), np.int32), []
    group = np.arange(len(sets)) if classes is None else np.unique(np.array(classes), return_inverse=True)[1]
    for k in range(1, len(sets)):
        own, some, at = places[starts[k] : starts[k + 1]], np.arange(k), slice(starts[k])
        if bits is not None:
            some = np.flatnonzero((group[:k] != group[k]) & (np.bitwise_count(bits[:k] ^ bits[k]) <= within))
            if not len(some):
                continue
            at = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in some])
        marks[own] = 1
        common = np.add.reduceat(marks[places[at]], np.cumsum(sizes[some]) - sizes[some])
        marks[own] = 0
        near = some[5 * common >= 4 * (sizes[some] + sizes[k] - common)]
        groups, first = np.unique(group[near], return_index=True)
        links += [(names[near[f]], names[k]) for f in first]
        if len(groups):
            group[np.isin(group, groups)] = group[k]
    return links


def links_within(members: DataFrame, docs: DataFrame, nodes: DataFrame, by_print: bool = False) -> DataFrame:
    """Links ``a, b`` of nodes that share a bucket, from ``node, bucket, parts``; they connect all similar ones.

    If ``by_print``, ``members`` also have ``print`` and ``class``, and nodes of different classes that a SimHash
    link leads from one to the other are compared.
    """

    def read(texts):
        return {"node": [node(t) for t in texts], "set": [shingles(t).view(np.int64) for t in texts]}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets, prints, classes = None, [], [], [], []

        def done() -> pa.RecordBatch:
            known = {"prints": prints, "classes": classes} if by_print else {}
            got = spanning_links(names, sets, **known) if len(sets) > 1 else []
            return pa.RecordBatch.from_pydict({"a": [a for a, _ in got], "b": [b for _, b in got]}, schema=to_arrow("a long,b long"))

        for batch in batches:
            keys, held = zip(*(c.to_pylist() for c in batch.columns[:3])), batch.column("set")
            for key, name, values, print_, class_ in zip(keys, batch.column("node").to_pylist(), held, *(batch.column(c).to_pylist() for c in ("print", "class"))):
                if key != at:
                    yield done()
                    at, names, sets, prints, classes = key, [], [], [], []
                names.append(name)
                sets.append(values.values.to_numpy())
                prints.append(print_)
                classes.append(class_)
        yield done()

    # Of a bucket's parts every two meet, the rows of a part thus go to as many tasks as there are parts.
    part = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")
    met = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    known = [F.col(c) if by_print else F.lit(0).cast("long").alias(c) for c in ("print", "class")]
    met = met.select("node", *known, F.struct("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).alias("task"))
    tasks, count = counted(met.groupBy("node").agg(F.collect_list("task").alias("tasks"), *(F.first(c).alias(c) for c in ("print", "class"))))
    ids = nodes.join(few(tasks.select("node"), count), "node", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    own = keep_rows(docs.select("doc_id", text_or_empty()), ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = map_batches(own.select("text"), read, "node long,set array<long>").dropDuplicates(["node"])
    rows = sets.join(tasks, "node").select("node", "set", "print", "class", F.explode("tasks").alias("task")).select("task.*", "node", "set", "print", "class")
    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(compare, "a long,b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id``: one row per row of ``docs``, the component being the smallest doc_id that links lead to.

    Null, empty and blank texts are copies of each other, and fewer than five words make one shingle. Rows
    repeat as they do in ``docs``; rows without a doc_id are compared like others and count as no smallest one, so
    components of such rows alone are null; a table without rows gives none; other columns are not read. Very long
    texts are compared by all their shingles.
    """
    return _compared(docs).select("doc_id", "component_id")


def _compared(docs: DataFrame) -> DataFrame:
    """``doc_id, node, low, component_id``: rows with their node and the smallest node of their component."""
    rows = checkpointed(signatures(docs))
    nodes = checkpointed(rows.groupBy("node").agg(F.count("*").alias("held"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("print").alias("print")))
    linked, count = stars(links_within(buckets(nodes), docs, nodes))
    of = few(linked.select(F.col("a").alias("node"), F.col("b").alias("class")), count)
    each = _simhash_groups(nodes.select("node", "n", "print").join(of, "node", "left").withColumn("class", F.coalesce("class", "node")))
    more, new = counted(links_within(_buckets(each), docs, nodes, by_print=True))
    if new:
        linked, count = stars(linked.unionByName(more))
    of = few(linked.select(F.col("a").alias("node"), F.col("b").alias("low")), count)
    named = checkpointed(nodes.select("node", "held", "doc_id").join(of, "node", "left").withColumn("low", F.coalesce("low", "node")))
    classes = named.groupBy("low").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    copies = join_hot(named.select("node", "held", "low"), checkpointed(classes), "low")
    return join_hot(rows.select("doc_id", "node"), checkpointed(copies), "node", "held").select("doc_id", "node", "low", "component_id")


def _simhash_groups(nodes: DataFrame) -> DataFrame:
    """``node, n, print, class, key``: all texts of the fingerprints that SimHash links connect within a key, from
    ``node, n, print, class``; only links of different classes count. A fingerprint of several classes is linked
    whatever the class of the other, and its texts are a group by themselves too."""
    nodes = checkpointed(nodes)
    several = F.min("class") != F.max("class")
    table = checkpointed(nodes.groupBy("print").agg(F.min("class").alias("class"), several.alias("several"), F.count("*").alias("texts")))
    alone = F.xxhash64("print", F.lit("several"))  # a class that no other fingerprint has
    linked = simhash.groups(table.select("print", F.when(F.col("several"), alone).otherwise(F.col("class")).alias("class")))
    keys = linked.select(F.xxhash64("key", "a").alias("key"), F.col("b").alias("print")).unionByName(table.where("several").select(alone.alias("key"), "print"))
    of_print = checkpointed(keys.groupBy("print").agg(F.collect_set("key").alias("keys")).join(table.select("print", "texts"), "print"))
    return checkpointed(join_hot(nodes, of_print, "print", "texts").select("node", "n", "print", "class", F.explode("keys").alias("key")))


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller doc_id among their near copies; columns as they were.

    Of repeated rows of one doc_id all stay. A row without a doc_id goes if a near copy has one; of near copies that
    all lack it one row stays. Null, empty and blank texts are copies of each other, so one of them stays; a table
    without rows gives none.
    """
    found = checkpointed(_compared(docs))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = keep_rows(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    nameless = found.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    first = checkpointed(nameless.where("component_id IS NULL").groupBy("low").agg(F.min("node").alias("node")))
    own = docs.where("doc_id IS NULL").select(F.struct("*").alias("row"), text_or_empty())
    own = own.withColumn("node", F.udf(node, "long", useArrow=True)("text")).join(first, "node", "left_semi")
    return kept.where("doc_id IS NOT NULL").unionByName(own.groupBy("node").agg(F.min_by("row", "text").alias("row")).select("row.*"))
