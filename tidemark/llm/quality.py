"""Quality rules with thresholds that follow the data, by DataFrame functions only.

Each document gets counts and, from them, rates in whole numbers. For each language and source a
mergeable quantile sketch is kept per rate: a histogram over buckets whose width grows with the value
(values keep their six leading binary digits, so a quantile is at most 1/32 off). Sketches merge by
adding counts, so Spark aggregates them partially before any shuffle, and a group with few documents
uses the merged sketch of its language, or of all. Sketches hold the documents that pass the base rules.

A document is rejected if a rate lies far above its group's quartiles. Most rates are zero in most documents,
so quartiles alone would forbid a single mark. A rate moves in steps of one occurrence, though, and the
step is the larger the shorter a document is: the quartile range counts as one occurrence in a document
of the group's 0.05 quantile of length at least, which is read from a sketch of the lengths. A group whose own fence lies far above that of its language, as where a quarter of a
source is junk, gets the fence of the language, and so does a language from all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, written

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Bits of a sorted word window that hold its position; longer texts take the general way.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are fixed; a fence is the upper quartile + spread x quartile range.

    Ranges count as one occurrence in a short document at least; a fence of more than ``far`` times the
    wider group's gives way to that.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_group: int = 50
    spread: int = 6
    far: int = 2


#: Each rate: what is counted, the length that it is divided by, the factor, and what one occurrence counts
#: (a window found twice covers six words).
RATES = {"symbols": ("n_symbols", "n_words", 1000, 1), "shouts": ("n_shouts", "n_words", 1000, 1), "dup_lines": ("n_dup_lines", "n_lines", 1000, 1), "repeats": ("n_repeat_words", "n_words", 1000, 6), "word_length": ("word_chars", "n_words", 100, 1)}
LENGTHS = ("n_words", "n_lines")

#: Rows of the table of fences that are broadcast; with more groups the join is salted.
MOST_GROUPS, SALTS = 200_000, 16


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at sorted positions."""
    steps = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1), p + 3) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _same_words(words: Column, a: Column, b: Column) -> Column:
    same = F.get(words, a) == F.get(words, b)
    for k in (1, 2):
        same = same & (F.get(words, a + k) == F.get(words, b + k))
    return same


def _repeat_words(df: DataFrame) -> DataFrame:
    """Replace ``words`` by ``n_repeat_words``, the words in three-word windows that occur twice or more.

    Windows are sorted by hash and position in one array of longs, so equal ones are neighbours. If
    neighbours agree in the hash bits but not in their words, or positions don't fit, the windows
    themselves are sorted instead, so the count is exact in any case.
    """
    words, low = F.col("words"), (1 << POSITION_BITS) - 1
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    df = df.withColumn("order", F.sort_array(packed))
    order = F.col("order")
    head = lambda v: F.shiftright(v, POSITION_BITS)
    at = lambda v: v.bitwiseAND(F.lit(low)).cast("int")
    clash = F.exists(F.transform(order, lambda v, k: (head(v) == head(F.get(order, k + 1))) & ~_same_words(words, at(v), at(F.get(order, k + 1)))), lambda x: F.coalesce(x, F.lit(False)))
    twice = F.filter(order, lambda v, k: F.coalesce(head(v) == head(F.get(order, k + 1)), F.lit(False)) | F.coalesce(head(v) == head(F.get(order, k - 1)), F.lit(False)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.slice(words, i + 1, 3).alias("w"), i.alias("i"))))
    exact = F.filter(windows, lambda v, k: F.coalesce(v["w"] == F.get(windows, k + 1)["w"], F.lit(False)) | F.coalesce(v["w"] == F.get(windows, k - 1)["w"], F.lit(False)))
    found = F.when((F.size(words) >= low) | clash, F.transform(exact, lambda v: v["i"])).otherwise(F.transform(twice, at))
    return df.withColumn("found", F.sort_array(found)).withColumn("n_repeat_words", _covered(F.col("found"))).drop("words", "order", "found")


def counts(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id, lang, source``, the counts of each document, and columns of other names as they are; null texts have no words, null groups count as ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    df = docs.select("doc_id", *carried, *group, text.alias("text"))
    df = df.select("doc_id", *carried, "lang", "source", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    df = df.select(
        "doc_id",
        *carried,
        "lang",
        "source",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeat_words(df)


def _rates() -> dict[str, Column]:
    return {x: F.expr(f"CASE WHEN {of} = 0 THEN 0 ELSE {n} * {by} DIV {of} END") for x, (n, of, by, _) in RATES.items()}


def bucket(value: Column) -> Column:
    """The upper end of a value's bucket, whose values share their six leading binary digits."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(value)) - 6))
    return value - F.pmod(value, width) + width - 1


def sketches(rates: DataFrame, names: list[str]) -> DataFrame:
    """``lang, source, rate, bucket, n``; merging two sketches is adding n."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("rate"), bucket(F.col(x)).alias("bucket")) for x in names))).alias("each")
    return rates.select("lang", "source", each).groupBy("lang", "source", "each.rate", "each.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The quartiles ``q1, q3``, the 0.05 quantile ``low`` and the number of documents, for each group ``by`` and rate."""
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "rate")
    ranked = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy(*by, "rate").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("below") * n >= F.col("total") * k, F.col("bucket"))).alias(x) for x, k, n in (("q1", 1, 4), ("q3", 3, 4), ("low", 1, 20))))


def _fences_of(sketch: DataFrame, by: list[str], rules: Rules) -> DataFrame:
    """The groups ``by``, their number of documents as ``total``, and the upper fence of each rate."""
    q = lambda x, k: F.max(F.when(F.col("rate") == x, F.col(k)))
    one = lambda of, by, n: F.floor(F.lit(by * n) / F.greatest(q(of, "low"), F.lit(1)))
    fence = {x: q(x, "q3") + rules.spread * F.greatest(q(x, "q3") - q(x, "q1"), one(*RATES[x][1:])) for x in RATES}
    return quartiles(sketch, by).groupBy(*by).agg(F.max("total").alias("total"), *(c.alias(x) for x, c in fence.items()))


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row per language and source with a sketch: the upper fence of each rate."""
    named = lambda df, by, name: df.select(*by, F.struct(*df.columns).alias(name))
    own, lang, every = (named(_fences_of(sketch, by, rules), by, name) for by, name in ((["lang", "source"], "own"), (["lang"], "of_lang"), ([], "of_all")))
    levels = own.join(lang, "lang").crossJoin(F.broadcast(every))  # one row of all

    def picked(x: str) -> Column:
        wide = F.col(f"of_all.{x}")
        for name in ("of_lang", "own"):
            near = (F.col(f"{name}.total") >= rules.min_group) & (F.col(f"{name}.{x}") <= wide * rules.far)
            wide = F.when(near, F.col(f"{name}.{x}")).otherwise(wide)
        return wide.alias(f"{x}_fence")

    return levels.select("lang", "source", *map(picked, RATES))


def _judged(docs: DataFrame, rules: Rules, cut: Callable[[DataFrame], DataFrame], *carried: str) -> DataFrame:
    """The counts of each row, ``base_failed``, ``kept`` and the columns carried along; ``cut`` stores the counts once."""
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    measured = cut(counts(docs, *carried).select("*", *(c.alias(x) for x, c in _rates().items()), failed.alias("base_failed")))
    limits = checkpointed(fences(sketches(measured.where("NOT base_failed"), [*RATES, *LENGTHS]), rules))
    passes = ~F.col("base_failed")
    for x in RATES:
        passes = passes & (F.col(x) <= F.col(f"{x}_fence"))
    # A source may hold many of the rows, so they aren't dealt by it.
    if limits.count() <= MOST_GROUPS:
        joined = measured.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        spread = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(spread, ["lang", "source", "salt"], "left")
    return joined.withColumn("kept", passes)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, one row per row of ``docs``.

    Null, empty and blank texts have no words and fail the base rules. Rows repeat as they do in
    ``docs``; rates equal to a fence pass; other columns are not read; an empty table gives no rows.
    """
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(docs, rules, checkpointed).select(*columns)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns as they were; each row is judged by itself, whatever its doc_id.

    Null, empty and blank texts fail the base rules and go; repeated rows go or stay together; a table
    without rows gives none.
    The rows are stored beside their counts and filtered there, so that no text is shuffled.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return _judged(docs.select("doc_id", "text", "lang", "source", row), rules, written, "row").where("kept").select("row.*")


def oracle(rules: Rules = Rules()) -> str:
    """``judge`` over the table ``documents`` in DuckDB's SQL."""
    space = "[\\x20\\x09-\\x0D]+"
    names, values = list(RATES), [*RATES, *LENGTHS]
    rates = {x: f"{n} * {by} // {of}" for x, (n, of, by, _) in RATES.items()}
    quart = lambda by: f"SELECT {by}rate, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS q1, min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS q3, min(CASE WHEN below * 20 >= total THEN bucket END) AS low FROM (SELECT {by}rate, bucket, sum(sum(n)) OVER (PARTITION BY {by}rate ORDER BY bucket) AS below, sum(sum(n)) OVER (PARTITION BY {by}rate) AS total FROM sketch GROUP BY {by}rate, bucket) GROUP BY {by}rate"
    fence = lambda of: f"{of}.q3 + greatest({of}.q3 - {of}.q1, one // greatest({of}_len.low, 1)) * {rules.spread}"
    steps = ", ".join(f"('{x}', '{of}', {by * n})" for x, (_, of, by, n) in RATES.items())
    kept = " AND ".join(f"{x} <= {x}_fence" for x in names)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM base)),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM hits, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
counted AS (
  SELECT base.r, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_shouts,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered ON base.r = covered.r),
measured AS (SELECT *, {", ".join(f"coalesce({e}, 0) AS {x}" for x, e in rates.items())}, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed FROM counted),
each AS (UNPIVOT (SELECT lang, source, {", ".join(f"{x}::BIGINT AS {x}" for x in values)} FROM measured WHERE NOT base_failed) ON {", ".join(values)} INTO NAME rate VALUE v),
sketch AS (SELECT lang, source, rate, v - v % width + width - 1 AS bucket, count(*) AS n FROM (SELECT *, 1::BIGINT << greatest(0, length(bin(v)) - 6) AS width FROM each) GROUP BY ALL),
own AS ({quart("lang, source, ")}), by_lang AS ({quart("lang, ")}), whole AS ({quart("")}),
steps(rate, length, one) AS (VALUES {steps}),
levels AS (
  SELECT own.lang, own.source, own.rate, CASE WHEN own.total >= {rules.min_group} THEN {fence("own")} END AS own_fence,
    CASE WHEN by_lang.total >= {rules.min_group} THEN {fence("by_lang")} END AS lang_fence, {fence("whole")} AS all_fence
  FROM own JOIN by_lang ON own.lang = by_lang.lang AND own.rate = by_lang.rate JOIN whole ON own.rate = whole.rate JOIN steps ON own.rate = steps.rate
  JOIN own AS own_len ON own_len.lang = own.lang AND own_len.source = own.source AND own_len.rate = length
  JOIN by_lang AS by_lang_len ON by_lang_len.lang = own.lang AND by_lang_len.rate = length JOIN whole AS whole_len ON whole_len.rate = length),
wider AS (SELECT *, CASE WHEN lang_fence <= all_fence * {rules.far} THEN lang_fence ELSE all_fence END AS wide_fence FROM levels),
picked AS (SELECT lang, source, rate, CASE WHEN own_fence <= wide_fence * {rules.far} THEN own_fence ELSE wide_fence END AS fence FROM wider),
fences AS (SELECT lang, source, {", ".join(f"max(CASE WHEN rate = '{x}' THEN fence END) AS {x}_fence" for x in names)} FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept
FROM measured LEFT JOIN fences USING (lang, source)"""
