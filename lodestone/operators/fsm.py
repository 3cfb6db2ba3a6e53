"""Frequent subgraph mining: level by level, only what is frequent is grown, and the frontier is kept between levels."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, canonical_order, extend_by_edge, parse
from .frontier import MOST_COUNTED, MOST_VERTICES, Frontier, canonical_positions, match
from .graph import Graph
from .store import bounded, dropped, kept

RESULT = "pattern string, support long, n long"
BROADCAST_PATTERNS, MOST_LABEL_PAIRS = 100_000, 2_000
#: More patterns of one shape than this are matched as the shape, without labels.
FEW_OF_A_SHAPE = 8


def _placed(f: Frontier, labelled: bool) -> DataFrame:
    """The frontier's rows with __m, __l (quick pattern), pattern and the orbit of each vertex.

    Only distinct quick patterns are canonised; they are few next to the rows, so the join back is a broadcast if small.
    """
    mask, labels = f.quick()
    rows = f.df.withColumn("__m", mask).withColumn("__l", labels if labelled else F.array().cast("array<int>")).withColumn("__v", f.vertex_list())
    quick = rows.groupBy("__m", "__l").agg(F.count("*").alias("__n"))
    named = quick.select("__m", "__l", canonical_positions(F.col("__m"), F.col("__l"), f.k, "edge").alias("p")).select("__m", "__l", "p.pattern", "p.orbit")
    return rows.join(named, ["__m", "__l"])


def mni(placed: DataFrame) -> DataFrame:
    """pattern, support, n: the least number of distinct vertices at any orbit, and the number of embeddings."""
    images = placed.select("pattern", F.posexplode("__v").alias("at", "v"), "orbit").select("pattern", F.get("orbit", F.col("at")).alias("orbit"), "v").distinct()
    support = images.groupBy("pattern", "orbit").agg(F.count("*").alias("images")).groupBy("pattern").agg(F.min("images").alias("support"))
    return support.join(placed.groupBy("pattern").agg(F.count("*").alias("n")), "pattern")


def frequent_subgraphs(graph: Graph, min_support: int, max_edges: int = 10, strategy: str = "po", labelled: bool | None = None) -> DataFrame:
    """pattern, support (exact minimum image), n: connected patterns of at most max_edges edges that are frequent.

    po grows edge subgraphs and keeps those of frequent patterns; pa matches candidate patterns, which are the growths
    of frequent ones none of whose parts is infrequent; mcvc does so with covers first; papo finds frequent single edges
    by matching and grows only those.  Without labels po matches too, up to four edges.  Edge labels do not count.
    """
    labelled = "v" in graph.labeling if labelled is None else labelled
    if strategy == "po" and not labelled and max_edges < MOST_COUNTED:
        strategy = "pa"  # a handful of patterns in all, whose matches need not be listed
    if strategy in ("pa", "mcvc"):
        return _by_patterns(graph, min_support, max_edges, strategy, labelled)
    found: list[DataFrame] = []
    f = Frontier.edges(graph).extend(1)
    for level in range(1, max_edges + 1):
        placed = kept(_placed(f, labelled))
        support = pattern_support(graph, _edge_patterns(graph, labelled)) if strategy == "papo" and level == 1 else mni(placed)
        good = kept(support.filter(F.col("support") >= min_support))
        if not good.limit(1).count():
            break
        found.append(good)
        if level < max_edges:
            rows = kept(placed.join(bounded(good.select("pattern"), BROADCAST_PATTERNS), "pattern", "left_semi").select(*f.df.columns))
            f = Frontier(graph, rows, "edge", level).extend(1)
        dropped(placed)
    return reduce(DataFrame.unionByName, found) if found else graph.spark.createDataFrame([], RESULT)


def pattern_support(graph: Graph, patterns: Iterable[Pattern], strategy: str = "pa") -> DataFrame:
    """pattern, support, n of given patterns by matching; one job for all.

    Patterns of one shape that differ in labels are matched together, if they are more than FEW_OF_A_SHAPE.
    """
    strategy = "mcvc" if strategy == "mcvc" else "pa"
    ps, shapes = list(patterns), {}
    for at, p in enumerate(ps):
        shapes.setdefault(p.unlabelled().key(), []).append(at)
    parts = []
    for shape, group in shapes.items():
        if ps[group[0]].labels is not None and len(group) > FEW_OF_A_SHAPE:
            parts.append(_images_of_shape(graph, parse(shape), {at: ps[at] for at in group}, strategy))
        else:
            parts += [_images(graph, ps[at], at, strategy) for at in group]
    # a place is a pattern's number and an orbit; a match counts once for each of its vertices
    seen = reduce(DataFrame.unionAll, parts).groupBy("place", "v").agg(F.sum("times").alias("times"))
    places = seen.groupBy("place").agg(F.count("*").alias("images"), F.sum("times").alias("times"))
    names = graph.spark.createDataFrame([(at, p.key(), p.n) for at, p in enumerate(ps)], "at int, pattern string, size int")
    each = places.groupBy((F.col("place") / MOST_VERTICES).cast("int").alias("at")).agg(F.min("images").alias("support"), F.sum("times").alias("times"))
    return each.join(F.broadcast(names), "at").select("pattern", "support", (F.col("times") / F.col("size")).cast("long").alias("n"))


def _images(graph: Graph, p: Pattern, at: int, strategy: str) -> DataFrame:
    """place, v, times: for each match of a pattern, or for all that differ in the last vertex, the vertex at each position."""
    f = Frontier.pattern(graph, p, strategy).extend(p.n - 1)
    orbits = p.orbits()
    place = lambda i: F.lit(at * MOST_VERTICES + orbits[f.plan.order[i]])
    entry = lambda i, v, times: F.struct(place(i).alias("place"), v.alias("v"), times.cast("long").alias("times"))
    last, own = f"c{p.n - 1}", range(p.n - 1)
    if last in f.df.columns:
        rows = f.df.filter(F.size(last) > 0)
        each = F.concat(F.array(*[entry(i, F.col(f"v{i}"), F.size(last)) for i in own]), F.transform(last, lambda x: entry(p.n - 1, x, F.lit(1))))
    else:
        rows = f.extend(1).df
        each = F.array(*[entry(i, F.col(f"v{i}"), F.lit(1)) for i in range(p.n)])
    return rows.select(F.explode_outer(each).alias("x")).select("x.place", "x.v", "x.times")


def _images_of_shape(graph: Graph, shape: Pattern, labelled: dict[int, Pattern], strategy: str) -> DataFrame:
    """The same for all these patterns, which become one shape without labels: it is matched once, and labels tell them apart."""
    f = match(graph, shape, strategy).with_labels()
    rows: dict[tuple[int, ...], tuple[int, list[int]]] = {}
    for at, p in labelled.items():
        order, orbits = canonical_order(p.unlabelled()), p.orbits()  # position i of the shape is p's vertex order[i]
        for turn in shape.automorphisms():
            mine = [order[turn[i]] for i in f.plan.order]
            rows[tuple(p.labels[v] for v in mine)] = at, [at * MOST_VERTICES + orbits[v] for v in mine]
    known = graph.spark.createDataFrame([(list(x), places) for x, (_, places) in rows.items()], "__l array<int>, places array<int>")
    named = f.df.select(f.words().alias("words"), f.labels().alias("__l")).join(bounded(known, BROADCAST_PATTERNS), "__l")
    return named.select(F.explode_outer(F.arrays_zip("places", "words")).alias("x")).select(F.col("x.places").alias("place"), F.col("x.words").alias("v"), F.lit(1).cast("long").alias("times"))


def _of_pairs(graph: Graph, good: list[Pattern]) -> Graph:
    """The graph with only the edges whose pair of labels is one of these single-edge patterns."""
    side = lambda c, a: graph.vertex_label.select(F.col("v").alias(c), F.col("label").alias(a))
    pairs = graph.spark.createDataFrame([(min(p.labels), max(p.labels)) for p in good], "x int, y int")
    ends = graph.edges.join(graph.sized(side("src", "p")), "src").join(graph.sized(side("dst", "q")), "dst").withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q"))
    return replace(graph, edges=kept(ends.join(F.broadcast(pairs), ["x", "y"], "left_semi").select("id", "src", "dst", "labels")))


def _edge_patterns(graph: Graph, labelled: bool) -> list[Pattern]:
    """The single-edge patterns of a graph.  Patterns are planned on the driver, so MOST_LABEL_PAIRS bounds how many there may be."""
    if not labelled:
        return [Pattern.of(2, [(0, 1)])]
    side = lambda c, a: graph.vertex_label.select(F.col("v").alias(c), F.col("label").alias(a))
    pairs = graph.edges.join(graph.sized(side("src", "x")), "src").join(graph.sized(side("dst", "y")), "dst").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    rows = pairs.limit(MOST_LABEL_PAIRS + 1).collect()
    if len(rows) > MOST_LABEL_PAIRS:
        raise ValueError(f"more than {MOST_LABEL_PAIRS} pairs of labels: mine by growing subgraphs (po)")
    return [Pattern.of(2, [(0, 1)], (r.x, r.y)) for r in rows]


def _by_patterns(graph: Graph, min_support: int, max_edges: int, strategy: str, labelled: bool) -> DataFrame:
    level = _edge_patterns(graph, labelled)
    found: list[DataFrame] = []
    infrequent: set[str] = set()
    labels: set[int | None] = {None}
    for m in range(1, max_edges + 1):
        if not level:
            break
        all_ = kept(pattern_support(graph, level, strategy).filter(F.col("support") >= min_support))
        keys = {r.pattern for r in all_.select("pattern").collect()}
        infrequent |= {p.key() for p in level} - keys
        if not keys:
            break
        found.append(all_)
        good = [parse(k) for k in sorted(keys)]
        if m == 1 and labelled:
            labels = {x for p in good for x in p.labels}
            if infrequent and m < max_edges:
                graph = _of_pairs(graph, good)  # no frequent pattern has another edge
        grown = {q for p in good for q in extend_by_edge(p, labels)}
        level = sorted((q for q in grown if not any(r.key() in infrequent for r in _parts(q))), key=lambda q: q.key())
    return reduce(DataFrame.unionByName, found) if found else graph.spark.createDataFrame([], RESULT)


def _parts(p: Pattern) -> Iterable[Pattern]:
    from .apps import _less_one_edge

    return _less_one_edge(p)


def database_frequent(graph: Graph, index: DataFrame, min_ratio: float, max_edges: int = 3, labelled: bool | None = None) -> DataFrame:
    """pattern, graphs, ratio: patterns that occur in at least min_ratio of the component graphs; index (vertex, graph_id)."""
    labelled = "v" in graph.labeling if labelled is None else labelled
    total = index.select("graph_id").distinct().count()
    ids = index.select(F.col("vertex").alias("a0"), "graph_id")
    found: list[DataFrame] = []
    f = Frontier.edges(graph).extend(1)
    for level in range(1, max_edges + 1):
        placed = kept(_placed(f, labelled))
        seen = placed.select("pattern", "a0").join(ids, "a0").select("pattern", "graph_id").distinct()
        good = kept(seen.groupBy("pattern").agg(F.count("*").alias("graphs")).withColumn("ratio", F.col("graphs") / F.lit(total)).filter(F.col("ratio") >= min_ratio))
        if not good.limit(1).count():
            break
        found.append(good)
        if level < max_edges:
            rows = kept(placed.join(bounded(good.select("pattern"), BROADCAST_PATTERNS), "pattern", "left_semi").select(*f.df.columns))
            f = Frontier(graph, rows, "edge", level).extend(1)
        dropped(placed)
    return reduce(DataFrame.unionByName, found) if found else graph.spark.createDataFrame([], "pattern string, graphs long, ratio double")
