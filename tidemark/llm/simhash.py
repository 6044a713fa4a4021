"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to fixed reference fingerprints. Distances
obey the triangle inequality, so two fingerprints whose distances to some reference differ by more than
the threshold can't be a pair. References alone prune random 64-bit values poorly (one reference keeps
57 % of all pairs at threshold 4) and give no join key, so distances are also taken within bands: the 64
bits are cut into more bands than the threshold, and a pair within it has at least ``bands - threshold``
equal bands, in which all its distances are equal. More bands give longer keys in more combinations; how
many follows from the number of distinct fingerprints, and the result is the same with any. The job is then

1. an equi-join on the reference distances of each ``bands - threshold`` bands,
2. the discard of pairs whose largest coordinate difference over all references exceeds the threshold,
3. the comparison of the fingerprints themselves for those that are left.

Equal fingerprints count once in all of this. The links are exact: none is lost, and none is made up.

The number of links grows with the square of a group of near fingerprints, so components aren't made from all
of them. The fingerprints of a key are compared within a task, which gives out a row for each that has a link.
Keys of many fingerprints are cut into parts, and each two parts are compared by a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, keep_rows, map_batches, text_or_empty, to_arrow
from tidemark.llm.components import components

#: References within bands (a distance takes 4 bits) and over all 64 bits (a distance takes 8 bits).
BAND_REFERENCES, WHOLE_REFERENCES = 16, 8

#: Prints with more than this part of all documents are joined by broadcast; so there are fewer than this.
HOT_PRINTS = 200

#: A key's part has about so many fingerprints at most. Keys are counted in slots, which have so many rows on average
#: at most, or so many slots in all if that is more.
PART_PRINTS, SLOT_ROWS, SLOTS = 2048, 256, 1 << 16

#: Shingles whose bits are summed at once.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : min(n, k + BLOCK)], last[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def references(n: int) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(b"reference %d" % k, 0) for k in range(n)], np.uint64)


def band_masks(bands: int) -> list[int]:
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def distance_table(prints: np.ndarray, bands: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Packed distances of fingerprints to the references: one 64-bit word per band, and one over all bits."""
    refs = references(BAND_REFERENCES)
    apart = prints[:, None] ^ refs[None, :]
    shifts = np.arange(BAND_REFERENCES, dtype=np.uint64) * np.uint64(4)
    packed = [(np.bitwise_count(apart & np.uint64(m)).astype(np.uint64) << shifts).sum(1, dtype=np.uint64) for m in band_masks(bands)]
    whole = np.bitwise_count(apart[:, :WHOLE_REFERENCES]).astype(np.uint64) << (np.arange(WHOLE_REFERENCES, dtype=np.uint64) * np.uint64(8))
    return [p.view(np.int64) for p in packed], whole.sum(1, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, print`` (signed 64-bit), one row per row of ``docs``."""

    def run(doc_ids, texts, shingle):
        return {"doc_id": doc_ids, "print": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_batches(docs.select("doc_id", text_or_empty()), run, "doc_id long,print long", shingle)


def bands_for(prints: int, threshold: int = 4) -> int:
    """The number of bands with the fewest rows and expected random candidates, for so many distinct fingerprints."""

    def work(bands: int) -> float:
        return comb(bands, threshold) * (prints + prints**2 / 2 / 2 ** (64 * (bands - threshold) / bands))

    return min(range(max(threshold + 1, -(-64 // 15)), threshold + 8), key=work)


def distances(prints: DataFrame, bands: int) -> DataFrame:
    """``print, class, whole, band0, band1, ...``: the packed distance table of distinct fingerprints.

    The class is that of ``prints``, or the fingerprint itself where it has none.
    """

    def run(prints, classes, bands):
        packed, whole = distance_table(np.array(prints, np.int64).view(np.uint64), bands)
        return {"print": prints, "class": classes, "whole": whole} | {f"band{k}": p for k, p in enumerate(packed)}

    own = "class" if "class" in prints.columns else "print"
    return map_batches(prints.select("print", F.col(own).alias("class")), run, "print long,class long,whole long," + ",".join(f"band{k} long" for k in range(bands)), bands)


def _keyed(prints: DataFrame, threshold: int, bands: int) -> tuple[DataFrame, list[str]]:
    """``print, class, whole`` and the columns of a key, which are named: a row for each ``bands - threshold`` bands."""
    if bands <= threshold or -(-64 // bands) > 15:
        raise ValueError("bands must exceed the threshold, and be 5 at least")
    keys = [F.struct(F.lit(k).alias("of"), *(F.col(f"band{b}").alias(f"k{i}") for i, b in enumerate(some))) for k, some in enumerate(combinations(range(bands), bands - threshold))]
    names = ["of", *(f"k{i}" for i in range(bands - threshold))]
    return distances(prints, bands).select("print", "class", "whole", F.explode(F.array(*keys)).alias("key")).select("print", "class", "whole", "key.*"), names


def links(prints: DataFrame, threshold: int = 4, bands: int | None = None) -> DataFrame:
    """``a, b`` pairs of fingerprints at most ``threshold`` bits apart, from distinct ones (column ``print``).

    ``bands`` must exceed ``threshold``; left out, it follows from the number of fingerprints. There are as many
    rows as pairs; ``groups`` has what connects them.
    """
    spread, names = _keyed(prints, threshold, bands or bands_for(prints.count(), threshold))
    left = spread.select(*names, F.col("print").alias("a"), F.col("whole").alias("wa"))
    right = spread.select(*names, F.col("print").alias("b"), F.col("whole").alias("wb"))
    differ = [F.abs(F.shiftright("wa", 8 * k).bitwiseAND(F.lit(255)) - F.shiftright("wb", 8 * k).bitwiseAND(F.lit(255))) for k in range(WHOLE_REFERENCES)]
    pairs = left.hint("merge").join(right, names).where("a < b").where(F.greatest(*differ) <= threshold)
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold).select("a", "b").distinct()


def _connect(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of each ``a`` and ``b``; a group is named by its smallest place."""
    while len(a):
        x, y = group[a], group[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(group, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := group[group]) != group).any():
            group[:] = up


def grouped(keys: np.ndarray, prints: np.ndarray, classes: np.ndarray, whole: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """``key, a, b`` of rows in order of ``keys, whole``: each fingerprint ``b`` that links of fingerprints of one key
    and two classes connect with others, and the smallest of them, ``a``.

    Each row is compared with the next, then the second next and so on, as long as a row with the same key has a
    distance to the last reference that is near enough. Those that are connected by then aren't compared.
    """
    bits, first, pivots = prints.view(np.uint64), whole >> 56, np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 8).astype(np.int16)
    group, at, step = np.arange(len(keys)), np.arange(len(keys)), 1
    while len(at := at[: np.searchsorted(at, len(keys) - step)]):
        at = at[(keys[at] == keys[at + step]) & (first[at + step] - first[at] <= threshold)]
        near = at[(group[at] != group[at + step]) & (classes[at] != classes[at + step])]
        near = near[np.abs(pivots[near] - pivots[near + step]).max(1, initial=0) <= threshold]
        near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= threshold]
        _connect(group, near, near + step)
        step += 1
    linked = np.flatnonzero(np.bincount(group, minlength=len(group))[group] > 1)
    low = prints.copy()
    np.minimum.at(low, group[linked], prints[linked])
    return keys[linked], low[group[linked]], prints[linked]


def groups(prints: DataFrame, threshold: int = 4, bands: int | None = None) -> DataFrame:
    """``key, a, b``: as links ``a, b`` these connect what all ``links`` would, with no more than a row (and one for
    each part) for each key of a fingerprint.

    The rows of one ``key`` and ``a`` are the fingerprints that links within the key connect, ``a`` being the
    smallest. Where ``prints`` has a ``class``, only links of different classes count. A link is between two rows
    of at least one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in grouped(*rows, threshold)], schema=to_arrow("key long,a long,b long"))

        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            rows = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(held, batch.columns)]
            open_at = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0  # the last key may go on in the next batch
            yield done([c[:open_at] for c in rows])
            held = [c[open_at:] for c in rows]
        yield done(held)

    count = prints.count()
    bands = bands or bands_for(count, threshold)
    spread, names = _keyed(prints, threshold, bands)
    # Keys are cut by what their slot has: no less than they have, so no key is left whole that has too many.
    slots = max(SLOTS, comb(bands, threshold) * count // SLOT_ROWS)
    rows = spread.select(F.xxhash64(*names).alias("key"), "print", "class", "whole").withColumn("slot", F.pmod("key", F.lit(slots)))
    full = rows.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > PART_PRINTS).select("slot", F.ceil(F.col("n") / PART_PRINTS).alias("parts"))
    rows = rows.join(F.broadcast(full), "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("print", "key"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    dealt = rows.select(met.alias("key"), "print", "class", "whole").repartition("key").sortWithinPartitions("key", "whole")
    return dealt.mapInArrow(run, "key long,a long,b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4, bands: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document, the component being the smallest
    doc_id that links lead to.

    Null, empty and blank texts all have fingerprint zero and link like others. Fewer words than a
    shingle make one shingle of all words. Repeated rows stay; rows of one doc_id with different texts
    are kept apart, but each counts with its doc_id; a null doc_id stays null and counts as no smallest
    one. Other columns are not read. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    table = checkpointed(prints.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("smallest")))
    linked = components(groups(table, threshold, bands).select("a", "b")).withColumnRenamed("node", "print")
    named = table.select("print", "smallest").join(linked, "print")
    low = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_print = named.join(low, "component").select("print", "component_id")
    classes = table.select("print", "n", "smallest").join(of_print, "print", "left").select("print", "n", F.coalesce("component_id", "smallest").alias("component_id"))
    # A print may hold many of the documents. Those with more than a 200th of all are fewer than 200, so
    # their classes are broadcast; the others' documents are joined by shuffle.
    most = (table.agg(F.sum("n")).first()[0] or 0) // HOT_PRINTS
    hot = F.broadcast(classes.where(F.col("n") > most).select("print", "component_id"))
    rows = prints.select("doc_id", "print")
    joined = rows.join(hot, "print").unionByName(rows.join(hot.select("print"), "print", "left_anti").join(classes.where(F.col("n") <= most).select("print", "component_id"), "print"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 4, threshold: int = 4, bands: int | None = None) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component; columns as they were.

    Rows without a doc_id stay. Of repeated rows of one doc_id all stay. Null, empty and blank texts are
    copies of each other, so one of them stays; a table without rows gives none.
    """
    gone = near_duplicates(docs, shingle, threshold, bands).where("doc_id <> component_id").select("doc_id").distinct()
    return keep_rows(docs, gone, "doc_id", "left_anti").select(*docs.columns)
