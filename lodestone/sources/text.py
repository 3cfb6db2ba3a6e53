"""Graphs as text: directories of adjacency lists, one-file adjacency, edge lists, vertex-to-graph files.

All reading and writing goes through Spark, so any file system that it knows will do.  Line numbers, which are ids here,
count files by part number and lines by their place in the file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, parse, text_of, vertex_patterns
from ..operators.graph import Graph, from_edges, ranked



def numbered_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """line (from 0) and value of a text file or a directory of part files in numeric order; None if there is none.

    Files are read in splits, by many tasks.  Rows of a split have consecutive ids in their order, so a line's number is its
    distance from the first of its split, plus the lines of all splits before; only a row for each split is sent around.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    part = F.coalesce(F.nullif(F.regexp_extract("__file", r"part-(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    rows = raw.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = rows.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).withColumn("__part", part)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part", "__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("__file", "__start", (before - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(begins), ["__file", "__start"]).select((F.col("__id") + F.col("__shift")).alias("line"), "value")


def ints(value: Column, separator: str) -> Column:
    """The integers of a line; none for a blank one."""
    return F.transform(F.array_remove(F.split(F.trim(value), separator), ""), lambda x: x.cast("int"))


def read_graph(spark: SparkSession, path: str, labeling: str = "ve", **options) -> Graph:
    """A graph directory: metadata, adjlists, and vlabels and elabels if they are there."""
    n, m = map(int, spark.read.text(f"{path}/metadata").first().value.split()[:2])
    rows = numbered_lines(spark, f"{path}/adjlists")
    items = rows.select(F.col("line").alias("src"), F.explode(F.array_remove(F.split(F.trim("value"), r"\s+"), "")).alias("item"))
    pair = F.split("item", ",")
    edges = items.select("src", pair[0].cast("long").alias("dst"), pair[1].cast("long").alias("id")).filter("src < dst")
    vlabels, elabels = numbered_lines(spark, f"{path}/vlabels"), numbered_lines(spark, f"{path}/elabels")
    vertices = spark.range(n)
    if vlabels is not None and "v" in labeling:
        vertices = vertices.join(vlabels.select(F.col("line").alias("id"), ints(F.col("value"), r"\s+").alias("labels")), "id", "left")
        if bad := vlabels.count() - n:
            raise ValueError(f"{path}: vlabels has {bad:+d} lines")
    else:
        vertices = vertices.withColumn("labels", F.array(F.lit(1)))
    if elabels is not None and "e" in labeling:
        edges = edges.join(elabels.select(F.col("line").alias("id"), ints(F.col("value"), r"[,\s]+").alias("labels")), "id", "left")
    else:
        edges = edges.withColumn("labels", F.array().cast("array<int>"))
    if (there := edges.count()) != m:
        raise ValueError(f"{path}: {m} edges are announced, {there} are there")
    return Graph(vertices.select("id", "labels"), edges.select("id", "src", "dst", "labels"), labeling, **options)


def unlabelled(spark: SparkSession, path: str, **options) -> Graph:
    return read_graph(spark, path, "n", **options)


def vertex_labelled(spark: SparkSession, path: str, **options) -> Graph:
    return read_graph(spark, path, "v", **options)


def fully_labelled(spark: SparkSession, path: str, **options) -> Graph:
    return read_graph(spark, path, "ve", **options)


def write_graph(graph: Graph, path: str) -> None:
    """A graph directory, for dense ids; each logical file is a directory of parts in order."""
    spark = graph.spark
    spark.createDataFrame([(f"{graph.num_vertices} {graph.num_edges}",)], "value string").coalesce(1).write.text(f"{path}/metadata")
    lists = graph.arcs.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("nb", "eid"))).alias("all"))
    line = F.array_join(F.transform("all", lambda x: F.concat_ws(",", x["nb"].cast("string"), x["eid"].cast("string"))), " ")
    adj = graph.vertices.join(lists.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce(line, F.lit("")).alias("value"))
    adj.repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(f"{path}/adjlists")
    texts = lambda c, sep: F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
    graph.vertices.repartitionByRange("id").sortWithinPartitions("id").select(texts("labels", " ").alias("value")).write.text(f"{path}/vlabels")
    graph.edges.repartitionByRange("id").sortWithinPartitions("id").select(texts("labels", ",").alias("value")).write.text(f"{path}/elabels")


def read_single_file(spark: SparkSession, path: str, **options) -> Graph:
    """The one-file form: on line u its labels, then `nbr,eid[,edge labels]` items; the labels of a vertex are joined by commas."""
    rows = numbered_lines(spark, path)
    parts = F.array_remove(F.split(F.trim("value"), r"\s+"), "")
    vertices = rows.select(F.col("line").alias("id"), ints(F.get(parts, F.lit(0)), ",").alias("labels"))
    items = rows.select(F.col("line").alias("src"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("item")).select("src", F.split("item", ",").alias("f"))
    edges = items.select("src", F.col("f")[0].cast("long").alias("dst"), F.col("f")[1].cast("long").alias("id"), F.transform(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))), lambda x: x.cast("int")).alias("labels")).filter("src < dst")
    return Graph(vertices, edges.select("id", "src", "dst", "labels"), **options)


def write_single_file(graph: Graph, path: str) -> None:
    item = lambda x: F.concat_ws(",", x["nb"].cast("string"), x["eid"].cast("string"), F.nullif(F.array_join(x["marks"].cast("array<string>"), ","), F.lit("")))
    lists = graph.arcs.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("nb", "eid", "marks"))).alias("all"))
    rows = graph.vertices.join(lists.withColumnRenamed("v", "id"), "id", "left")
    own = F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")
    value = F.concat_ws(" ", own, F.array_join(F.transform(F.coalesce("all", F.expr("array()")), item), " "))
    rows.select("id", F.rtrim(value).alias("value")).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_edge_list(spark: SparkSession, path: str, labeling: str = "n", **options) -> Graph:
    """Lines `u v`, in any order and either direction; keys become dense ids in their order."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"[\s,]+")
    pairs = raw.select(part[0].cast("long").alias("u"), part[1].cast("long").alias("v"))
    ids = ranked(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "key").select("key", F.col("__rank").alias("id"))
    side = lambda c: ids.select(F.col("key").alias(c), F.col("id").alias(f"__{c}"))
    dense = pairs.join(side("u"), "u").join(side("v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    return from_edges(dense, ids.select("id"), labeling, **options)


def edge_list(graph: Graph) -> DataFrame:
    """Each edge once, as (u, v)."""
    return graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()


def read_graph_index(spark: SparkSession, path: str) -> DataFrame:
    """vertex, graph_id: one integer on each line."""
    return numbered_lines(spark, path).select(F.col("line").alias("vertex"), F.trim("value").cast("int").alias("graph_id"))


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_lines(spark: SparkSession, path: str) -> list[str] | None:
    """A small text, in order."""
    rows = numbered_lines(spark, path)
    return None if rows is None else [r.value for r in rows.orderBy("line").collect()]


def write_pattern(spark: SparkSession, p: Pattern, folder: str) -> None:
    """A pattern directory on any file system that Spark knows: metadata, edges, vlabels, elabels."""
    parts = {"metadata": [f"{p.n} {p.m}"], "edges": [f"{i} {j}" for i, j, _ in p.edges]}
    if p.labels is not None:
        parts["vlabels"] = [str(x) for x in p.labels]
    if p.edge_labeled:
        parts["elabels"] = [str(x) for _, _, x in p.edges]
    for name, lines in parts.items():
        _write_lines(spark, lines, f"{folder}/{name}")


def read_pattern(spark: SparkSession, folder: str, labeling: str = "ve") -> Pattern:
    """A pattern directory; labels count as far as the labelling (n, v, e, ve) honours them."""
    get = lambda name: [x for x in _read_lines(spark, f"{folder}/{name}") or [] if x.strip()]
    n, m = map(int, get("metadata")[0].split()[:2])
    edges = [tuple(map(int, x.split()[:2])) for x in get("edges")]
    if len(edges) != m:
        raise ValueError(f"{folder}: {m} edges are announced, {len(edges)} are there")
    labels = get("vlabels") if "v" in labeling else []
    marks = get("elabels") if "e" in labeling else []
    if marks:
        edges = [(*e, int(x)) for e, x in zip(edges, marks, strict=True)]
    return Pattern.of(n, edges, map(int, labels) if labels else None, edge_labeled=bool(marks))


def pattern_set(spark: SparkSession, k: int, folder: str) -> DataFrame:
    """pattern: canonical keys of all connected patterns of k vertices, from the folder if they are there; else made and written."""
    path = f"{folder}/vpatterns-{k}"
    found = _read_lines(spark, path)
    if found is None:
        found = [text_of(p) for p in vertex_patterns(k)]
        _write_lines(spark, found, path)
    return spark.createDataFrame([(text_of(parse(x)),) for x in found], "pattern string")
