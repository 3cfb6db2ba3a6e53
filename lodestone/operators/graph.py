"""The graph: two DataFrames, what is derived from them, and filters that act before anything is mined."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import kept

VERTICES = "id long, labels array<int>"
EDGES = "id long, src long, dst long, labels array<int>"


#: A graph whose vertices have no more neighbours than this may carry their lists in the rows of a frontier.
LIST_DEGREE = 2_000
#: Ranges of ids serve as blocks of vertices if none has so many times its share.
UNEVEN = 4


@dataclass(frozen=True)
class Graph:
    """vertices (id, labels), edges (id, src, dst, labels) with src < dst.

    labeling says which labels count: v, e, ve or n; a label that does not count is 1 for vertices and 0 for edges.
    broadcast_edges bounds the adjacency that is sent to every executor; a larger one is joined by shuffle.
    list_degree bounds the neighbour lists that rows of a frontier may carry; a graph with a larger degree is mined by joins.
    simple says that no two edges join the same vertices, as from_edges() makes them.
    Derived tables are kept when first used: every level of a mining query joins one of them again.
    """

    vertices: DataFrame
    edges: DataFrame
    labeling: str = "ve"
    broadcast_edges: int = 1_000_000
    list_degree: int = LIST_DEGREE
    simple: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def vertex_label(self) -> DataFrame:
        """v, label: the first label."""
        label = F.coalesce(F.get("labels", F.lit(0)), F.lit(1)) if "v" in self.labeling else F.lit(1)
        return kept(self.vertices.select(F.col("id").alias("v"), label.cast("int").alias("label")))

    @cached_property
    def edge_label(self) -> DataFrame:
        label = F.coalesce(F.get("labels", F.lit(0)), F.lit(0)) if "e" in self.labeling else F.lit(0)
        return self.edges.select("id", "src", "dst", label.cast("int").alias("label"))

    @cached_property
    def num_edges(self) -> int:
        return self.edges.count()

    @cached_property
    def num_vertices(self) -> int:
        return self.vertices.count()

    @cached_property
    def fits(self) -> bool:
        return self.num_edges <= self.broadcast_edges

    @cached_property
    def max_degree(self) -> int:
        return self.degrees.agg(F.max("degree")).first()[0] or 0

    @cached_property
    def lists(self) -> bool:
        """Whether rows of a frontier carry neighbour lists: no list is long."""
        return self.max_degree <= self.list_degree

    @cached_property
    def wide(self) -> bool:
        """Whether lists are joined by shuffle: rows then fetch a list only when it is first read, and labels come with lists."""
        return self.lists and not self.fits

    def sized(self, df: DataFrame) -> DataFrame:
        """df, with a broadcast hint where the graph is small enough; df must be no larger than its adjacency."""
        return F.broadcast(df) if self.fits else df

    @cached_property
    def arcs(self) -> DataFrame:
        """Both directions of every edge: v, nb, eid, marks (all edge labels)."""
        marks = F.coalesce("labels", F.array().cast("array<int>"))
        e = self.edges.select("id", "src", "dst", marks.alias("marks"))
        return e.select(F.col("src").alias("v"), F.col("dst").alias("nb"), F.col("id").alias("eid"), "marks").union(e.select("dst", "src", "id", "marks"))

    @cached_property
    def adjacency(self) -> DataFrame:
        """v, label, nb: neighbours in rising order; isolated vertices have none."""
        # dealt by v first: partial lists would be as many as arcs, and larger
        near = self.pairs.repartition("v").groupBy("v").agg(F.array_sort(F.collect_list("nb")).alias("nb"))
        return kept(self.vertex_label.join(near, "v", "left").withColumn("nb", F.coalesce("nb", F.array().cast("array<bigint>"))))

    @cached_property
    def beside(self) -> DataFrame:
        """v, label, nb, nl: the same with the labels of the neighbours."""
        far = self.vertex_label.select(F.col("v").alias("nb"), F.col("label").alias("nl"))
        arcs = self.pairs.join(self.sized(far), "nb") if "v" in self.labeling else self.pairs.withColumn("nl", F.lit(1))
        near = arcs.repartition("v").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("nb", "nl"))).alias("__n")).select("v", F.col("__n.nb").alias("nb"), F.col("__n.nl").alias("nl"))
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        return kept(self.vertex_label.join(near, "v", "left").select("v", "label", none("nb", "array<bigint>"), none("nl", "array<int>")))

    @cached_property
    def pairs(self) -> DataFrame:
        """v, nb: every vertex with each of its neighbours, once."""
        both = self.arcs.select("v", "nb")
        return both if self.simple else kept(both.distinct())

    @cached_property
    def incident(self) -> DataFrame:
        """v, nb, eid, far, mark: every vertex with each edge at it, the label of its other end and the edge's first label."""
        far = self.vertex_label.select(F.col("v").alias("nb"), F.col("label").alias("far"))
        e = self.edge_label
        arcs = e.select(F.col("src").alias("v"), F.col("dst").alias("nb"), F.col("id").alias("eid"), F.col("label").alias("mark"))
        arcs = arcs.union(e.select("dst", "src", "id", "label"))
        return kept(arcs.join(self.sized(far), "nb").select("v", "nb", "eid", "far", "mark"))

    @cached_property
    def degrees(self) -> DataFrame:
        return kept(self.vertex_label.join(self.pairs.groupBy("v").agg(F.count("*").alias("d")), "v", "left").select("v", "label", F.coalesce("d", F.lit(0)).cast("long").alias("degree")))

    @cached_property
    def upward(self) -> DataFrame:
        """v, up: neighbours that come later by (degree, id).  Each clique appears once, and no list exceeds sqrt(2 m)."""
        d = lambda v, n: self.sized(self.degrees.select(F.col("v").alias(v), F.col("degree").alias(n)))
        once = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if self.simple else self.pairs.filter("v < nb").select(F.col("v").alias("a"), F.col("nb").alias("b"))
        rises = F.struct("da", "a") < F.struct("db", "b")
        arcs = once.join(d("a", "da"), "a").join(d("b", "db"), "b").select(F.when(rises, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(rises, F.col("b")).otherwise(F.col("a")).alias("nb"))
        lists = arcs.repartition("v").groupBy("v").agg(F.array_sort(F.collect_list("nb")).alias("up"))
        return kept(self.vertex_label.join(lists, "v", "left").select("v", "label", F.coalesce("up", F.array().cast("array<bigint>")).alias("up")))

    def label_frequencies(self) -> DataFrame:
        return self.vertex_label.groupBy("label").agg(F.count("*").alias("n"))

    def frequency(self) -> dict[int, int]:
        """The commonest 10,000 labels; plan ordering treats any other as rare."""
        return {r.label: r.n for r in self.label_frequencies().orderBy(F.desc("n"), "label").limit(10_000).collect()}

    # filters: lazily composed, as predicates before any derived table

    def filter_vertices(self, keep: Callable[[Column, Column], Column] | Column) -> Graph:
        """keep(id, labels); edges that lose an end go too."""
        cond = keep(F.col("id"), F.col("labels")) if callable(keep) else keep
        kept = self.vertices.filter(cond)
        ids = kept.select(F.col("id").alias("__v"))
        edges = self.edges.join(ids.withColumnRenamed("__v", "src"), "src", "left_semi").join(ids.withColumnRenamed("__v", "dst"), "dst", "left_semi")
        return replace(self, vertices=kept, edges=edges.select("id", "src", "dst", "labels"))

    def filter_edges(self, keep: Callable[..., Column]) -> Graph:
        """keep(src, src labels, dst, dst labels, id, labels); vertices stay, even isolated."""
        ends = self.vertices.select(F.col("id").alias("src"), F.col("labels").alias("__s")), self.vertices.select(F.col("id").alias("dst"), F.col("labels").alias("__d"))
        df = self.edges.join(ends[0], "src").join(ends[1], "dst")
        cond = keep(F.col("src"), F.col("__s"), F.col("dst"), F.col("__d"), F.col("id"), F.col("labels"))
        return replace(self, edges=df.filter(cond).select("id", "src", "dst", "labels"))

    def filter_vertices_given_graph(self, keep: Callable[[DataFrame], Column]) -> Graph:
        """keep sees v, label, nb and degree."""
        seen = self.adjacency.withColumn("degree", F.size("nb").cast("long"))
        ids = seen.filter(keep(seen)).select(F.col("v").alias("id"))
        kept = self.vertices.join(ids, "id", "left_semi")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, vertices=kept, edges=edges.select("id", "src", "dst", "labels"))

    def filter_edges_given_graph(self, keep: Callable[[DataFrame], Column]) -> Graph:
        """keep sees the edge with nb_src, nb_dst, label_src, label_dst of its ends."""
        side = lambda end: self.adjacency.select(F.col("v").alias(end), F.col("nb").alias(f"nb_{end}"), F.col("label").alias(f"label_{end}"))
        df = self.edges.join(side("src"), "src").join(side("dst"), "dst")
        return replace(self, edges=df.filter(keep(df)).select("id", "src", "dst", "labels"))

    # accessors

    def neighbours(self, v: int) -> DataFrame:
        return self.arcs.filter(F.col("v") == v).select("nb").distinct()

    def edges_between(self, u: int, v: int) -> DataFrame:
        return self.edges.filter((F.col("src") == min(u, v)) & (F.col("dst") == max(u, v)))

    def degree(self, v: int) -> int:
        """Neighbours of a vertex; 0 for one that is not there."""
        row = self.degrees.filter(F.col("v") == v).first()
        return row.degree if row else 0

    def common_edge_labels(self, pairs: DataFrame) -> DataFrame:
        """pairs (group, u, v) of joined vertices -> group, labels: the sorted labels that all edges of a group have.

        Parallel edges count as one with the labels of all; a group with a pair that is not joined has none.
        """
        marks = self.edges.groupBy("src", "dst").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("labels", F.array().cast("array<int>"))))).alias("labels"))
        ends = pairs.select("group", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
        all_ = ends.groupBy("group").agg(F.count("*").alias("n"))
        each = ends.join(marks, ["src", "dst"]).select("group", F.explode("labels").alias("label")).groupBy("group", "label").agg(F.count("*").alias("n"))
        found = each.join(all_, ["group", "n"]).groupBy("group").agg(F.array_sort(F.collect_list("label")).alias("labels"))
        return all_.select("group").join(found, "group", "left").select("group", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))

    def kept(self) -> Graph:
        """The same graph with both tables computed once."""
        return replace(self, vertices=kept(self.vertices), edges=kept(self.edges))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with __rank from 0 in the order of columns that are distinct together.

    Range partitions are ranked apart and shifted by the counts before them, so no task sees all rows.
    """
    # kept, since both uses below must see one and the same choice of ranges
    parts = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def from_edges(edges: DataFrame, vertices: DataFrame | None = None, labeling: str = "ve", packed: bool = False, **options) -> Graph:
    """A graph of any edges (u, v[, labels]) and vertices (id[, labels or label]); ids of edges are ranks by (src, dst).

    Self loops go; edges given twice count once, their labels united.  packed, for vertex ids below 2^31, makes ids of the
    two ends instead: the same order, without a sort of all edges.
    """
    none = F.array().cast("array<int>")
    ends = F.least("u", "v").cast("long").alias("src"), F.greatest("u", "v").cast("long").alias("dst")
    if "labels" in edges.columns:
        pairs = edges.filter("u <> v").select(*ends, F.coalesce("labels", none).alias("labels"))
        single = pairs.groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    else:
        single = edges.filter("u <> v").select(*ends).distinct()
    if packed:  # ids and empty labels are made when read
        made = kept(single)
        numbered = made.select((F.shiftleft("src", 32) + F.col("dst")).alias("id"), "src", "dst", "labels" if "labels" in made.columns else none.alias("labels"))
    else:
        single = single if "labels" in single.columns else single.withColumn("labels", none)
        numbered = kept(ranked(single, "src", "dst").select(F.col("__rank").alias("id"), "src", "dst", "labels"))
    if vertices is None:
        ids = numbered.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(ids.withColumn("labels", F.array(F.lit(1))), numbered, labeling, simple=True, **options)
    labels = F.col("labels") if "labels" in vertices.columns else F.array(F.col("label").cast("int")) if "label" in vertices.columns else F.array(F.lit(1))
    return Graph(vertices.select(F.col("id").cast("long").alias("id"), labels.alias("labels")), numbered, labeling, simple=True, **options)


def reordered(graph: Graph, permutation: DataFrame) -> Graph:
    """permutation (old, new): vertices renumbered, edges numbered anew by (src, dst)."""
    side = lambda c: permutation.select(F.col("old").alias(c), F.col("new").alias(f"__{c}"))
    edges = graph.edges.join(side("src"), "src").join(side("dst"), "dst").select(F.least("__src", "__dst").alias("src"), F.greatest("__src", "__dst").alias("dst"), "labels")
    vertices = graph.vertices.join(side("id"), "id").select(F.col("__id").alias("id"), "labels")
    return replace(graph, vertices=vertices, edges=ranked(edges, "src", "dst").select(F.col("__rank").alias("id"), "src", "dst", "labels"))


def by_degree(graph: Graph) -> Graph:
    """Vertices renumbered by falling degree."""
    order = ranked(graph.degrees.withColumn("__low", -F.col("degree")), "__low", "v").select(F.col("v").alias("old"), F.col("__rank").alias("new"))
    return reordered(graph, order)


def _triangles_by_block(graph: Graph, up: DataFrame) -> DataFrame:
    """The same beyond the broadcast: a list travels once to each block of vertices that has some of its members, not to each member.

    Blocks are ranges of ids, since ids that are near are often joined; of hashes, where ids are spread unevenly.
    """
    spark = graph.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high, n = up.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return up.select("v", F.lit(0).cast("long").alias("triangles"))
    width = (high - low) // parts + 1
    block = lambda x: F.floor((x - F.lit(low)) / F.lit(width)).cast("long")
    if up.groupBy(block(F.col("v")).alias("block")).count().agg(F.max("count")).first()[0] > UNEVEN * (n // parts + 1):
        block = lambda x: F.pmod(F.xxhash64(x), F.lit(parts))
    sent = up.withColumn("block", F.explode_outer(F.array_distinct(F.transform("up", lambda x: block(x))))).filter("block is not null").repartition(parts, "block")
    pairs = sent.select("block", "v", F.col("up").alias("mine"), F.explode_outer(F.filter("up", lambda x: block(x) == F.col("block"))).alias("w"))
    theirs = up.select(block(F.col("v")).alias("block"), F.col("v").alias("w"), F.col("up").alias("theirs")).repartition(parts, "block")
    setting = "spark.sql.requireAllClusterKeysForCoPartition"  # both sides lie by block, which is one of two keys
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        found = pairs.join(theirs.hint("merge"), ["block", "w"]).select("v", "w", F.explode_outer(F.array_intersect("mine", "theirs")).alias("x")).filter("x is not null")
        return kept(found.select(F.explode(F.array("v", "w", "x")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles")))
    finally:
        spark.conf.set(setting, was)


def triangle_count(graph: Graph) -> DataFrame:
    """Triangles at each vertex (v, triangles), and so three times their number in sum."""
    up = graph.upward.select("v", "up")
    if not graph.fits:
        return _triangles_by_block(graph, up)
    pairs = up.select("v", F.col("up").alias("mine"), F.explode("up").alias("w")).join(graph.sized(up.select(F.col("v").alias("w"), F.col("up").alias("theirs"))), "w")
    found = pairs.select("v", "w", F.explode(F.array_intersect("mine", "theirs")).alias("x"))
    return found.select(F.explode(F.array("v", "w", "x")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
