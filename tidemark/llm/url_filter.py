"""URL filters: rules by host and path, and a tree of path templates for all other URLs.

The rules decide the URLs that they fit, the tree all others. Its evidence are labels: what the rules say,
and words that name an unwanted kind of host; they decide no URL by themselves. Per host it grows level by level: digits and long hex runs are
wildcards, and so is a segment that takes many values below the same parent. Then siblings whose labelled
shares don't differ statistically merge into one branch, below which the tree goes on. A template's
share of bad labels is smoothed towards that of the branch above it; it is rejected if that share is high. One
bad label and no good one are enough for the template that holds it. Templates without labels of their own
are allowed: what the rules say of one part of a host says nothing of the others.

The tree grows only where a branch is not decided yet, as deep as its paths go, and skips segments that all
URLs of a branch share: a branch without bad labels is allowed, one whose URLs all have bad labels, at a high
share, is rejected as it stands. Everything works on counts per host and path shape, and
joins are salted, so a host with many of the URLs is dealt to several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The rules, as verdict, host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Words that name an unwanted kind of host when they are a part of its name.
BAD_WORDS = ("adult", "ads", "bet", "bets", "casino", "pills", "porn", "spam", "track", "xxx")


@dataclass(frozen=True)
class Tree:
    """Values below a parent that make a wildcard (many and mostly different, or very many); weight of the
    prior; shares from which on a template is rejected; normal score up to which branches merge; tasks
    over which a host's rows are dealt in joins."""

    many: int = 20
    different: float = 0.5
    very_many: int = 200
    weight: float = 1.0
    reject: float = 0.6
    merge_z: float = 1.96
    salts: int = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case and path; both empty for null or where there is no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, begins in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):  # the last one that fits stands outermost
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(begins))
        text, verdict = F.when(fits, of + begins).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def shape_of(path: Column) -> Column:
    """A path with its digits and long hex runs as wildcards and without a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{16,}", "*"), "[0-9]+", "*"), "/$", "")


def labelled(pages: DataFrame, rules=RULES, bad_words=BAD_WORDS) -> DataFrame:
    """``page_id, host, path, rule, shape, label``; the label is the rule's, else block by a word of the host, else null."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    bad = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, bad_words))) if bad_words else F.lit(False)
    return df.select("*", rule.alias("rule"), shape_of(F.col("path")).alias("shape"), F.coalesce(said, F.when(bad, "block")).alias("label"))


def join_salted(rows: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table with one row per key, each key dealt to ``salts`` tasks by the path shape."""
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("shape"), F.lit(salts)).cast("int")).join(spread, [*on, "salt"], how).drop("salt")


def merged_branches(children: DataFrame, tree: Tree) -> DataFrame:
    """``host, node, segment, branch, above, b, m`` for the labelled segments below each node.

    ``children`` has ``host, node, above, segment, b, m`` (bad and all labels), at most ``very_many`` and
    two rows a node. Sorted by share, neighbours merge if a two-sample test doesn't tell them apart.
    """
    order = W.partitionBy("host", "node").orderBy(F.col("b") / F.col("m"), "segment")
    b0, m0 = F.lag("b").over(order), F.lag("m").over(order)
    pooled = (F.col("b") + b0 + 1) / (F.col("m") + m0 + 2)
    z = F.abs(F.col("b") / F.col("m") - b0 / m0) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("m") + 1 / m0))
    apart = F.coalesce(z > tree.merge_z, F.lit(True)).cast("int")
    grouped = children.where("m > 0").withColumn("apart", apart).withColumn("group", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    over = W.partitionBy("host", "node", "group")
    return grouped.select("host", "node", "segment", "above", F.min("segment").over(over).alias("branch"), F.sum("b").over(over).alias("b"), F.sum("m").over(over).alias("m"))


def rejected_shapes(urls: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """Distinct ``host, shape`` of the templates that are rejected, from ``host, shape, label``."""
    count = lambda label: F.count_if(F.col("label") == label)
    rows = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), count("block").alias("b"), (count("block") + count("allow")).alias("m"))
    parts = F.split("shape", "/")
    rows = written(rows.withColumn("rest", F.slice(parts, 2, F.size(parts))).withColumn("node", F.lit("")).withColumn("above", F.lit(None).cast("double")))
    found = urls.select("host", "shape").limit(0)
    while not rows.isEmpty():
        nodes = rows.groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum("b").alias("bad"), F.sum("m").alias("known"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # The segments that all URLs of a branch share are skipped.
        first = F.array_position(F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        root = (F.col("bad") + 0.5 * tree.weight) / (F.col("known") + tree.weight)
        nodes = nodes.where("bad > 0").select("host", "node", root.alias("root"), (F.col("bad") == F.col("all")).alias("pure"), F.when(first > 0, first - 1).otherwise(F.size("low")).cast("int").alias("shared"))
        rows = written(join_salted(rows, nodes, ["host", "node"], tree.salts).withColumn("above", F.coalesce("above", F.round("root", 9))))
        whole = F.col("pure") & (F.col("above") >= tree.reject)
        found = found.unionByName(rows.where(whole).select("host", "shape"))
        rows = rows.where(~whole)
        rest = F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest") - F.col("shared"), F.lit(0)))
        rows = rows.withColumn("rest", rest).withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))).select("host", "shape", "node", "above", "rest", "segment", "n", "b", "m")

        values = rows.groupBy("host", "node", "segment").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(F.count("*").alias("values"), F.sum("n").alias("all"))
        wild = (F.col("values") > tree.very_many) | ((F.col("values") > tree.many) & (F.col("values") > F.col("all") * tree.different))
        rows = join_salted(rows, values.select("host", "node", wild.alias("wild")), ["host", "node"], tree.salts).withColumn("segment", F.when(F.col("wild") & (F.col("segment") != ""), F.lit("*")).otherwise(F.col("segment"))).drop("wild")

        children = rows.groupBy("host", "node", "above", "segment").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
        branches = merged_branches(children, tree)
        smoothed = F.round((F.col("b") + F.col("above") * tree.weight) / (F.col("m") + tree.weight), 9)
        branches = branches.select("host", "node", "segment", F.concat("node", F.lit("/"), "branch").alias("below"), smoothed.alias("share"))
        rows = join_salted(rows.drop("above"), branches, ["host", "node", "segment"], tree.salts)  # the segments with labels
        rest = F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))
        rows = rows.select("host", "shape", F.col("below").alias("node"), F.col("share").alias("above"), rest.alias("rest"), (F.size("rest") == 0).alias("done"), "n", "b", "m")
        rows = written(rows)
        found = found.unionByName(rows.where(F.col("done") & (F.col("above") >= tree.reject)).select("host", "shape"))
        rows = rows.where(~F.col("done")).drop("done")
    return found


def judge(pages: DataFrame, rules=RULES, tree: Tree = Tree(), bad_words=BAD_WORDS) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    A null URL or one without ``://`` has an empty host and path; those are one host with one template and
    are allowed. Rows repeat as they do in ``pages``; of rules of equal length the later host name wins;
    other columns are not read; an empty table gives no rows.
    """
    df = labelled(pages, rules, bad_words)
    rejected = rejected_shapes(df.select("host", "shape", "label"), tree).withColumn("rejected", F.lit(True))
    joined = join_salted(df, rejected, ["host", "shape"], tree.salts, "left")
    return joined.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("label")).when(F.col("rejected"), "block").otherwise("allow").alias("verdict"))
