"""License scans by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a text are joined, by hash, to the places of the same k-grams in license
templates. A match votes for a diagonal: the word place in the text minus the place in the template.
Neighbouring diagonals of a template merge, so that a word put in or left out doesn't split a passage.
A merged span is verified by the share of the template's k-grams found in it and by its length.

The templates are few and fixed, so their side of the join is broadcast; only matches are shuffled.
Short phrases that name a license count wherever they stand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrases that name a license, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)

K = 3
#: Diagonals this far apart merge; the least share of a template's k-grams, and the longest span, in template lengths.
NEAR, LEAST_SHARE, LONGEST = 3, 0.6, 1.5

NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case. Beside A-Z, only the Kelvin sign has an ASCII letter as its lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORDS), "")


def template_grams(templates=TEMPLATES, k: int = K) -> list[tuple]:
    """``(template, label, grams, words, place, w0, w1, ...)`` for each k-gram of each template."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        n = len(words) - k + 1
        rows += [(t, label, n, len(words), p, *words[p : p + k]) for p in range(n)]
    return rows


def _phrase_starts(words: Column) -> Column:
    """``array<struct<start, label>>`` of places where a phrase's words stand."""
    tests = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        tests.append((lambda i, parts=parts: [F.get(words, i + k) == w for k, w in enumerate(parts)], label))

    def label_at(i: Column) -> Column:
        out = None
        for test, label in tests:
            first, *rest = test(i)
            for x in rest:
                first = first & x
            out = F.when(first, label) if out is None else out.when(first, label)
        return out

    places = F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.struct(i.cast("long").alias("start"), label_at(i).alias("label")))
    return F.filter(places, lambda x: x["label"].isNotNull())


def _may_hold_phrases(text: Column) -> Column:
    """Whether a text holds a word of each phrase, taken so that few words do for all; others needn't be searched."""
    words = [phrase.split() for phrase, _ in PHRASES]
    needed = sorted({max(own, key=lambda w: (sum(w in other for other in words), len(w), w)) for own in words})
    may = F.lit(False)
    for word in needed:
        may = may | F.contains(F.lower(text), F.lit(word))
    return may


#: Rows of the table of template grams that is broadcast (some 100 bytes each); larger ones are joined by shuffle.
MOST_GRAMS = 200_000


def scan(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per row of ``docs``.

    ``score``: the largest share of a template found, at least 0.5 where a phrase stands, else 0. Null and
    empty texts have no words and no labels. Rows repeat as they do in ``docs``; labels are distinct and
    sorted, so ties don't matter; other columns are not read; an empty table gives no rows.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"w{i}" for i in range(k)]
    grams = spark.createDataFrame(template_grams(templates, k), "template int, label string, grams int, length int, place int, " + ", ".join(f"{w} string" for w in names))
    grams = grams.withColumn("hash", F.xxhash64(*names))

    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(text).alias("words"), _may_hold_phrases(text).alias("may"))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = base.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.when(F.col("may"), _phrase_starts(F.col("words"))).otherwise(none).alias("base"))

    # One row for each word place; the outer form also keeps texts without words.
    places = base.select("*", F.posexplode_outer("words").alias("pos", "word"))
    at = lambda i: F.get("words", F.col("pos") + i) if i else F.col("word")
    full = F.col("pos") + k <= F.col("n_words")
    places = places.withColumn("hash", F.when(full, F.xxhash64(*map(at, range(k)))))
    same = places["hash"] == grams["hash"]
    for i, w in enumerate(names):
        same = same & (at(i) == grams[w])
    few = grams.count() <= MOST_GRAMS
    joined = places.join(F.broadcast(grams) if few else grams, same, "left").where("coalesce(pos, 0) = 0 OR template IS NOT NULL")
    head = F.coalesce("pos", F.lit(0)) == 0
    hits = joined.select(
        "row", "template", "label", "grams", "length", "place", "pos", (F.col("pos") - F.col("place")).alias("diagonal"),
        F.when(head, F.struct("doc_id", "n_words", "base")).alias("doc"),
    )
    votes = hits.groupBy("row", "template", "label", "grams", "length", "diagonal").agg(F.max("doc").alias("doc"), F.collect_set("place").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"))

    of = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(of) > NEAR).cast("int"), F.lit(0))
    merged = votes.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(of.rowsBetween(W.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "template", "label", "grams", "length", "passage").agg(F.max("doc").alias("doc"), (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.col("grams")).alias("share"), (F.max("high") + k - F.min("low")).alias("span"))
    good = (F.col("share") >= LEAST_SHARE) & (F.col("span") <= F.col("length") * LONGEST)
    per = spans.groupBy("row").agg(F.max("doc").alias("doc"), F.collect_set(F.when(good, F.col("label"))).alias("found"), F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("share"))

    starts = F.transform("doc.base", lambda x: x["start"])
    own = F.transform("doc.base", lambda x: x["label"])
    join = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return per.select(
        "doc.doc_id", "doc.n_words", F.size("doc.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(own).alias("base_labels"), join(F.concat(own, F.col("found"))).alias("labels"),
        F.greatest(F.col("share"), F.when(F.size("doc.base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, k: int = K) -> str:
    """``scan`` over the table ``documents`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = ", ".join(f"({t}, '{label}', {n}, {size}, {p}, " + ", ".join(f"'{w}'" for w in words) + ")" for t, label, n, size, p, *words in template_grams(templates, k))
    names = [f"w{i}" for i in range(k)]
    phrase = " ".join(f"WHEN {' AND '.join(f'words[i + {j}] = {w!r}' for j, w in enumerate(p.split()))} THEN '{label}'" for p, label in PHRASES)
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
places AS (SELECT r, unnest(generate_series(1, len(words))) AS i, words FROM base),
named AS (SELECT r, i - 1 AS start, CASE {phrase} END AS label FROM places),
own AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named WHERE label IS NOT NULL GROUP BY r),
grams(template, label, grams, length, place, {", ".join(names)}) AS (VALUES {rows}),
texts AS (SELECT r, i - 1 AS pos, {", ".join(f"words[i + {j}] AS {w}" for j, w in enumerate(names))} FROM places),
hits AS (SELECT r, template, label, grams, length, place, pos, pos - place AS diagonal FROM texts JOIN grams USING ({", ".join(names)})),
diagonals AS (SELECT DISTINCT r, template, diagonal FROM hits),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {NEAR} THEN 1 ELSE 0 END AS a FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
passages AS (SELECT *, sum(a) OVER (PARTITION BY r, template ORDER BY diagonal) AS passage FROM apart),
spans AS (SELECT r, template, label, passage, count(DISTINCT place)::DOUBLE / grams AS share, max(pos) + {k} - min(pos) AS span, length FROM hits JOIN passages USING (r, template, diagonal) GROUP BY r, template, label, passage, grams, length),
good AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM spans WHERE share >= {LEAST_SHARE} AND span <= length * {LONGEST} GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(own.labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN own.labels IS NULL THEN []::VARCHAR[] ELSE string_split(own.labels, ',') END, coalesce(good.labels, []::VARCHAR[])))), ',') AS labels,
  greatest(coalesce(good.share, 0.0::DOUBLE), CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM base LEFT JOIN own ON base.r = own.r LEFT JOIN good ON base.r = good.r"""
