"""Filter interaction audit: what each filter removes, in every order of the filters.

Five filters say which documents fail: A few words, B repeated words, C many capitals,
D symbols, E a text that a smaller doc_id has too (table-wide, removed or not).  A
document is then one of 32 sets of failed filters, and an order of the filters is a path
through the lattice of the sets of filters already applied.

1. Each document gets its set of failed filters.  E needs the smallest doc_id of a text:
   documents are counted by (content, part, labels) with partial sums before the shuffle,
   so a text that stands in a third of all rows is a few rows when its smallest id is
   looked up.
2. Documents are counted by part and failed set; each of these sums contributes to the 80
   edges (filters applied, next filter) of the lattice.
3. The edges are joined to the 600 steps of the 120 orders.

Cases: a null text is the empty text (it fails A, and copies of it fail E); a null lang
is the part ''; a null doc_id is larger than no other and smaller than none, so it passes
E, and has no labels; repeated rows of the smallest doc_id all pass E; several labels of a
doc_id count where one of them is 1; very long texts are read whole; a part without a
document doesn't exist, so an empty table gives an empty table; columns that the operator
doesn't name are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
_SPACES = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_by_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by part, bits of failed filters and labels."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("content"), failed_by_text(text).alias("failed"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = each.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    key = ["content", "part", "failed", "good", "toxic"]
    rows = each.groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    groups = rows.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("first"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("of_first"),
    )
    least = F.min("first").over(Window.partitionBy("content"))
    passed = F.col("unnamed") + F.when(F.col("first") == least, F.col("of_first")).otherwise(0)
    groups = groups.withColumn("passed", passed).groupBy("part", "failed", "good", "toxic").agg(F.sum("passed").alias("passed"), F.sum(F.col("n") - F.col("passed")).alias("copies"))
    both = F.array(F.struct(F.col("failed"), F.col("passed").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), F.col("copies").alias("n")))
    return groups.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.failed", "good", "toxic", "x.n").where("n > 0 OR failed = 0")


def edges(failed: DataFrame) -> DataFrame:
    """(part, applied, next, counts): the 80 edges of the lattice for each part."""
    all_edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s in range(32) for f in (1, 2, 4, 8, 16) if not s & f))
    each = failed.withColumn("edge", F.explode(all_edges)).select("*", "edge.*")
    fails, earlier = F.col("failed").bitwiseAND(F.col("next")) > 0, F.col("failed").bitwiseAND(F.col("applied")) > 0
    when = {
        "kept": ~fails & ~earlier,
        "removed": fails & ~earlier,
        "redundant": fails & earlier,
        "unique_fails": F.col("failed") == F.col("next"),
        "good_lost": fails & ~earlier & F.col("good"),
        "toxic_lost": fails & ~earlier & F.col("toxic"),
    }
    return each.groupBy("part", "applied", "next").agg(*(F.sum(F.when(x, F.col("n")).otherwise(0)).alias(k) for k, x in when.items()))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, next): the 600 steps of the 120 orders."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [("".join(p), k + 1, sum(bit[f] for f in p[:k]), bit[p[k]]) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts of the step, and shapley: one row per part, order and step."""
    found = edges(failures(docs, labels)).join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"])
    found = found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "next")))
    return found.select("part", "filter_order", "step", *_COUNTS, "shapley")
