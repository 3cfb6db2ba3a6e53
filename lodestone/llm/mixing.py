"""Mixing sources to target weights: whole epochs, then a weighted sample without replacement up to each target.

Each document draws an exponential key divided by its quality weight (Efraimidis and Spirakis); within a source the keys
in rising order are a weighted sample, and a prefix sum of sizes cuts it at what the target leaves after whole epochs.
No source is ordered in one task: keys fall into 2^20 ranges whose sums locate the cut coarsely, then finely, and only
the range that holds the cut is ordered row by row.  Keys hash the id and the text, so reruns agree.
Null texts have size 0 and are never taken; null sources come last and form one source; ties in the key fall to the
smaller size, then the id; rows equal in all of these are interchangeable.  An empty table gives no rows.  Texts
of any length are measured whole; only the id, text and source columns are read, so others may have any name.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2
COARSE, FINE = 1 << 10, 1 << 10


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters that are not symbols, bars or exclamation marks, squared."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    odd = n - F.length(F.regexp_replace(t, r"[#*$%&|<>!]+", ""))
    return F.greatest(F.lit(0.05), F.pow(1 - odd / F.greatest(n, F.lit(1)), 2))


def draw(id_col: Column, text: Column, weight: Column, seed: int = 7) -> Column:
    """The exponential key: small keys are taken first."""
    u = (F.pmod(F.xxhash64(id_col, text, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """__source, __source_size -> with __target.

    Sources are ranked by range partitions (a rank within a partition plus the counts before it); shares of the sources
    that would exceed `epochs` times their size are given to the others by weight, round by round, until none does.
    """
    last = F.col("__source").isNull()
    parts = saved(sizes.repartitionByRange(last, F.col("__source")).withColumn("__part", F.spark_partition_id()), "sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(last, "__source")) - 1 + F.col("__before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(parts.join(F.broadcast(offsets), "__part").select("__source", "__source_size", weight.alias("__w"), (F.lit(epochs) * F.col("__source_size")).cast("double").alias("__cap")), "ranked")
    total = share * (ranked.agg(F.sum("__source_size")).first()[0] or 0)
    level, held = None, -1
    while True:  # what one unit of weight is worth; rises until no source is above its cap
        capped = F.lit(False) if level is None else F.col("__cap") <= F.lit(level) * F.col("__w")
        row = ranked.agg(F.sum(F.when(capped, F.col("__cap"))).alias("c"), F.sum(F.when(~capped, F.col("__w"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()
        if row.n == held or not row.w:
            break
        level, held = (total - (row.c or 0.0)) / row.w, row.n
    return ranked.select("__source", "__source_size", F.least(F.col("__cap"), F.lit(level or 0.0) * F.col("__w")).alias("__target"))


def with_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """__id, __source, __size, __source_size, __target, __taken for every row of docs."""
    base = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), count_words(F.col(text_col)).alias("__size"), draw(F.col(id_col), F.col(text_col), quality_weight(F.col(text_col))).alias("__key")
    )
    # keys have about unit exponential size, so this is about even, and it never falls as the key grows
    even = F.least(F.lit(COARSE * FINE - 1), F.floor((1 - F.exp(-F.col("__key"))) * (COARSE * FINE))).cast("int")
    rows = saved(base.withColumn("__range", even), "mix")
    by_range = saved(rows.groupBy("__source", (F.col("__range") / FINE).cast("int").alias("__coarse")).agg(F.sum("__size").alias("__sum")), "ranges")
    sizes = by_range.groupBy("__source").agg(F.sum("__sum").alias("__source_size"))
    goal = F.col("__target") - F.floor(F.col("__target") / F.greatest("__source_size", F.lit(1))) * F.col("__source_size")
    sources = saved(source_targets(sizes).withColumn("__epochs", F.floor(F.col("__target") / F.greatest("__source_size", F.lit(1))).cast("long")).withColumn("__rest", F.greatest(goal, F.lit(0.0))), "targets")

    def cut(sums: DataFrame, column: str, start: Column) -> DataFrame:
        """The range of each source in which its prefix sum reaches the rest, and the sum before it."""
        ahead = F.coalesce(F.sum("__sum").over(Window.partitionBy("__source").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start
        return sums.withColumn("__ahead", ahead).filter("__ahead < __rest and __ahead + __sum >= __rest").select("__source", column, "__ahead")

    def of_source(left: DataFrame, right: DataFrame) -> DataFrame:
        kept = right.withColumnRenamed("__source", "__s")
        return left.join(kept, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")

    coarse = cut(of_source(by_range, sources.select("__source", "__rest")), "__coarse", F.lit(0)).withColumnsRenamed({"__coarse": "__at", "__ahead": "__start"})
    near = of_source(rows, coarse).filter(F.col("__at") == (F.col("__range") / FINE).cast("int"))
    fine_sums = of_source(near.groupBy("__source", "__range", "__start").agg(F.sum("__size").alias("__sum")), sources.select("__source", "__rest"))
    fine = saved(cut(fine_sums, "__range", F.col("__start")).withColumnsRenamed({"__range": "__cut", "__ahead": "__start"}), "cuts")
    whole = of_source(of_source(rows, sources), fine)
    ordered = whole.filter(F.col("__range") == F.col("__cut"))
    w = Window.partitionBy("__source").orderBy("__key", "__size", "__id").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("__size").over(w), F.lit(0)) + F.col("__start") + F.col("__size") / 2
    names = ["__id", "__source", "__size", "__source_size", "__target", "__epochs", "__in"]
    at_cut = ordered.withColumn("__in", middle <= F.col("__rest")).select(names)
    # without a cut nothing is left to sample
    rest = whole.filter(F.col("__cut").isNull() | (F.col("__range") != F.col("__cut"))).withColumn("__in", F.coalesce(F.col("__range") < F.col("__cut"), F.lit(False))).select(names)
    return rest.unionByName(at_cut).withColumn("__taken", F.col("__size") * (F.col("__epochs") + F.col("__in").cast("long"))).drop("__epochs", "__in")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return with_taken(docs, id_col, text_col, source_col).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken")
    )
