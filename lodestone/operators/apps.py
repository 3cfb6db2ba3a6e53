"""Built-in mining operators.  Where several strategies give one answer, a parameter picks the strategy."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import cache, reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, add_vertex, edge_patterns, parse, vertex_patterns
from .frontier import MOST_COUNTED, Frontier, Keep, canonical_key, match, roll
from .graph import Graph, ranked
from .store import dropped, kept

Sample = tuple[float, int] | None
#: Distinct scores that one task puts in order.
BLOCK_OF_RANKS = 100_000


def level_rate(fraction: float, depth: int) -> float:
    """Chance to keep an extension so that a share `fraction` of the subgraphs of `depth` words is expected to stay."""
    return fraction if depth < 2 else fraction ** (1 / (depth - 1))


def _rate(sample: Sample, depth: int) -> Sample:
    return None if sample is None else (level_rate(sample[0], depth), sample[1])


# listings and motifs


def induced_subgraphs(graph: Graph, k: int, sample: Sample = None) -> Frontier:
    """Connected induced subgraphs of k vertices."""
    return Frontier.vertices(graph).extend(k, _rate(sample, k))


def induced_by_pattern(graph: Graph, k: int, strategy: str = "pa", sample: Sample = None) -> Iterable[tuple[Pattern, Frontier]]:
    """The same, pattern by pattern."""
    for p in vertex_patterns(k):
        q = Pattern.of(p.n, p.edges, None, induced=True)
        yield q, match(graph, q, strategy, _rate(sample, k))


def edge_subgraphs(graph: Graph, m: int, sample: Sample = None) -> Frontier:
    """Connected subgraphs of m edges."""
    return Frontier.edges(graph).extend(m, _rate(sample, m))


def edge_subgraphs_by_pattern(graph: Graph, m: int, strategy: str = "pa") -> Iterable[tuple[Pattern, Frontier]]:
    for p in edge_patterns(m):
        yield p, match(graph, p, strategy)


def subgraphs_by_pattern(graph: Graph, k: int, strategy: str = "pa") -> Iterable[tuple[Pattern, Frontier]]:
    """Non-induced matches of every connected pattern of k vertices."""
    for p in vertex_patterns(k):
        yield p, match(graph, p, strategy)


def counts(graph: Graph, parts: Iterable[tuple[Pattern, Frontier]]) -> DataFrame:
    """pattern, n for each part, in one job."""
    rows = [_number(f).select(F.lit(p.key()).alias("pattern"), "n") for p, f in parts]
    return reduce(DataFrame.unionAll, rows)


def _number(f: Frontier) -> DataFrame:
    """How many matches a pattern frontier has: one column, n.  In a graph beyond the broadcast the last position is counted, not listed."""
    p, graph = f.plan.pattern, f.graph
    if f.whole and f.k == p.n > 1 and not graph.fits and p.labels is None and not p.edge_labeled:
        if p.m == p.n * (p.n - 1) // 2:
            return cliques(graph, p.n).agg(F.count("*").alias("n"))
        if graph.wide:
            last = Frontier(graph, None, "pattern", 0, plan=f.plan).extend(p.n - 1).df.select(F.size(f"c{p.n - 1}").cast("long").alias("n"))
            return last.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))
    return f.df.agg(F.count("*").alias("n"))


@cache
def spanning(k: int) -> dict[tuple[str, str], int]:
    """For connected patterns p and q of k vertices: by how much matches of p, signed, count induced ones of q.

    A set of vertices whose pattern is q holds as many matches of p as q has spanning copies of it.  These numbers make a
    triangular matrix with ones, in order of edges; what is returned is its inverse.
    """
    ps = sorted(vertex_patterns(k), key=lambda p: p.m)
    keys, copies = [p.key() for p in ps], {}
    for q in ps:
        for m in range(k - 1, q.m + 1):
            for some in combinations(q.edges, m):
                r = Pattern.of(k, [(i, j) for i, j, _ in some])
                if r.connected():
                    copies[r.key(), q.key()] = copies.get((r.key(), q.key()), 0) + 1
    out: dict[tuple[str, str], int] = {}
    for i in reversed(range(len(keys))):  # induced(i) = matches(i) - sum of copies(i, j) induced(j) with more edges
        out[keys[i], keys[i]] = 1
        for j in range(i + 1, len(keys)):
            if times := copies.get((keys[i], keys[j])):
                for x in keys[j:]:
                    if y := out.get((x, keys[j])):
                        out[x, keys[i]] = out.get((x, keys[i]), 0) - times * y
    return out


def whole_counts(graph: Graph, k: int, kind: str, strategy: str = "pa") -> DataFrame:
    """pattern, n: all subgraphs of k words, of which there are some, by matches of each pattern."""
    if kind == "edge":
        return counts(graph, edge_subgraphs_by_pattern(graph, k, strategy)).filter("n > 0")
    matched = counts(graph, subgraphs_by_pattern(graph, k, strategy))
    signs = graph.spark.createDataFrame([(x, y, c) for (x, y), c in spanning(k).items()], "pattern string, induced string, c long")
    both = matched.join(F.broadcast(signs), "pattern").groupBy(F.col("induced").alias("pattern")).agg(F.sum(F.col("c") * F.col("n")).alias("n"))
    return both.filter("n > 0")


def motifs(graph: Graph, k: int, strategy: str = "po", labelled: bool | None = None, sample: Sample = None) -> DataFrame:
    """pattern, n: induced subgraphs of k vertices by canonical pattern.

    po grows subgraphs and names them afterwards; pa and mcvc match each pattern (labelled ones are told apart by key).
    Beyond the broadcast unlabelled ones of up to MOST_COUNTED vertices are counted from matches that need not be induced.
    A sample scales nothing: divide by its fraction to estimate.
    """
    labelled = "v" in graph.labeling if labelled is None else labelled
    if strategy == "po":
        return induced_subgraphs(graph, k, sample).by_pattern(labelled)
    if not labelled:
        if sample is None and not graph.fits and 2 < k <= MOST_COUNTED:
            return whole_counts(graph, k, "vertex", strategy)
        return counts(graph, induced_by_pattern(graph, k, strategy, sample)).filter("n > 0")
    out = [as_vertices(p, f).select(*[F.col(f"{c}{i}") for i in range(k) for c in ("v", "l")], *[F.col(f"b{i}") for i in range(1, k)]) for p, f in induced_by_pattern(graph, k, strategy, sample)]
    return Frontier(graph, reduce(DataFrame.unionAll, out), "vertex", k).by_pattern(True)


def as_vertices(p: Pattern, f: Frontier) -> DataFrame:
    """Rows of induced matches of p with the labels and adjacency columns of a vertex frontier, in the order of the plan."""
    at = {v: i for i, v in enumerate(f.plan.order)}
    bits = [0] * p.n
    for i, j, _ in p.edges:
        bits[max(at[i], at[j])] |= 1 << min(at[i], at[j])
    return f.with_labels().df.select("*", *[F.lit(bits[i]).cast("long").alias(f"b{i}") for i in range(1, p.n)])


# cliques


def cliques(graph: Graph, k: int, strategy: str = "kclist") -> DataFrame:
    """v0..v{k-1}, rising: every clique of k vertices once.

    kclist walks the graph oriented by (degree, id), carrying the vertices that may still join; po filters induced
    subgraphs for completeness at each level; pa matches the complete pattern.
    """
    if strategy == "po":
        full = lambda f: F.col(f"b{f.k - 1}") == (1 << (f.k - 1)) - 1 if f.k > 1 else F.lit(True)
        f = Frontier.vertices(graph).extend(1).filter(full).explore(k - 1)
        return _rising(f.df, k)
    if strategy in ("pa", "mcvc"):
        p = Pattern.of(k, [(i, j) for j in range(k) for i in range(j)])
        return _rising(match(graph, p, strategy).df, k)
    up = graph.upward
    df = up.select(F.col("v").alias("v0"), F.col("up").alias("may"))
    for i in range(1, k):
        last = i == k - 1
        df = df.withColumn(f"v{i}", F.explode_outer("may"))
        if last:
            df = df.filter(F.col(f"v{i}").isNotNull())
        else:
            df = df.join(graph.sized(up.select(F.col("v").alias(f"v{i}"), F.col("up").alias("__up"))), f"v{i}").withColumn("may", F.array_intersect("may", "__up")).drop("__up")
    return _rising(df, k)


def _rising(df: DataFrame, k: int) -> DataFrame:
    s = df.select(F.array_sort(F.array(*[F.col(f"v{i}") for i in range(k)])).alias("s"))
    return s.select(*[F.col("s")[i].alias(f"v{i}") for i in range(k)])


def maximal_cliques(graph: Graph, k: int, strategy: str = "custom") -> DataFrame:
    """Cliques of exactly k vertices that no other vertex could join.

    custom lists the vertices that each clique has in common: where the graph has lists, by carrying them along the
    oriented walk; otherwise by joins, from the arcs of a clique's first vertex in degree order.  po and pa intersect the
    lists of finished cliques, or do the same by joins.
    """
    if not graph.lists:
        return _maximal_by_joins(graph, cliques(graph, k, "kclist" if strategy == "custom" else strategy), k)
    if strategy == "custom":
        up = graph.upward.select("v", "up").join(graph.sized(graph.adjacency.select("v", "nb")), "v")
        df = up.select(F.col("v").alias("v0"), F.col("up").alias("may"), F.col("nb").alias("common"))
        for i in range(1, k):
            side = up.select(F.col("v").alias(f"v{i}"), F.col("up").alias("__up"), F.col("nb").alias("__nb"))
            df = df.withColumn(f"v{i}", F.explode_outer("may")).join(graph.sized(side), f"v{i}")
            df = df.withColumn("may", F.array_intersect("may", "__up")).withColumn("common", F.array_intersect("common", "__nb")).drop("__up", "__nb")
        return _rising(df.filter(F.size("common") == 0), k)
    df = cliques(graph, k, strategy)
    for i in range(k):
        df = df.join(graph.sized(graph.adjacency.select(F.col("v").alias(f"v{i}"), F.col("nb").alias(f"n{i}"))), f"v{i}")
    common = reduce(F.array_intersect, [F.col(f"n{i}") for i in range(k)])
    return df.filter(F.size(common) == 0).select(*[f"v{i}" for i in range(k)])


def _maximal_by_joins(graph: Graph, found: DataFrame, k: int) -> DataFrame:
    names = [f"v{i}" for i in range(k)]
    found = kept(found)
    degree = graph.degrees.select("v", "degree")
    least = found.select(*names, F.explode(F.array(*names)).alias("v")).join(graph.sized(degree), "v").groupBy(*names).agg(F.min(F.struct("degree", "v"))["v"].alias("v"))
    open_ = least.join(graph.sized(graph.pairs), "v").filter(~F.array_contains(F.array(*names), F.col("nb"))).select(*names, "nb")
    for c in names:
        side = graph.pairs.select(F.col("v").alias("__v"), F.col("nb").alias("__nb"))
        open_ = open_.join(graph.sized(side), (F.col(c) == F.col("__v")) & (F.col("nb") == F.col("__nb")), "left_semi")
    return found.join(open_.select(*names).distinct(), names, "left_anti")


def least_degree(density: float, k: int) -> int:
    return math.ceil(density * (k - 1))


def quasi_cliques(graph: Graph, k: int, density: float, strategy: str = "po") -> DataFrame:
    """v0..v{k-1}, rising: connected induced subgraphs of k vertices, each of degree at least ceil(density (k - 1)) inside."""
    target = least_degree(density, k)
    if strategy == "po" and not graph.fits and k <= MOST_COUNTED:
        strategy = "pa"  # few patterns are dense, and to match them moves less than every subgraph of k - 1 vertices
    if strategy == "po":
        can = lambda f: reduce(lambda a, b: a & b, [f.degree(i) + (k - f.k) >= target for i in range(f.k)])
        return _rising(Frontier.vertices(graph).extend(1).filter(can).explore(k - 1).df, k)
    parts = []
    for p, f in induced_by_pattern(graph, k, "mcvc" if strategy == "papo" else "pa"):
        if all(len(near) >= target for near in p.adjacent()):
            parts.append(_rising(f.df, k))
    if not parts:
        return graph.spark.createDataFrame([], ", ".join(f"v{i} long" for i in range(k)))
    return reduce(DataFrame.unionAll, parts)


# queries


def query(graph: Graph, p: Pattern, strategy: str = "pa", sample: Sample = None) -> Frontier:
    """Matches of a pattern, each class of automorphic ones once; induced if the pattern says so.  Labels always count."""
    return match(graph, p, strategy, _rate(sample, p.n))


def query_by_edges(graph: Graph, p: Pattern) -> Frontier:
    """Pattern-oblivious: grow edge subgraphs, keep those whose pattern occurs in p at every level.  Labels of both kinds count."""
    wanted: list[set[str]] = []
    level = {p.canonical()}
    for _ in range(p.m):
        wanted.insert(0, {q.key() for q in level})
        level = {r.canonical() for q in level for r in _less_one_edge(q)}
    f = Frontier.edges(graph)
    for keys in wanted:
        f = f.extend(1)
        mask, labels = f.quick(p.edge_labeled)
        labels = labels if p.labels is not None else F.array().cast("array<int>")
        tagged = kept(f.df.withColumn("__m", mask).withColumn("__l", labels))
        good = tagged.select("__m", "__l").distinct().filter(canonical_key(F.col("__m"), F.col("__l"), f.k, "edge").isin(*keys))
        f = Frontier(graph, kept(tagged.join(good, ["__m", "__l"], "left_semi").drop("__m", "__l")), "edge", f.k)
        dropped(tagged)
    return f


def query_from_cover(graph: Graph, p: Pattern, keep: Keep | None = None) -> Frontier:
    """Matches of a pattern from those of its connected cover, completed with a predicate that is asked at every step."""
    return Frontier.pattern(graph, p, "mcvc").matches(keep)


def _less_one_edge(p: Pattern) -> Iterable[Pattern]:
    """Connected patterns that p has with one edge less (and without a vertex that this leaves alone)."""
    for e in p.edges:
        rest = [x for x in p.edges if x != e]
        used = sorted({v for i, j, _ in rest for v in (i, j)})
        if not rest:
            continue
        at = {v: k for k, v in enumerate(used)}
        q = Pattern.of(len(used), [(at[i], at[j], x) for i, j, x in rest], None if p.labels is None else [p.labels[v] for v in used], p.induced, p.edge_labeled)
        if q.connected():
            yield q


# periodic subgraphs


def has_progression(times: Column, length: int) -> Column:
    """Whether a sorted array of integers holds an arithmetic progression of `length` terms."""
    if length <= 2:
        return F.size(times) >= length

    def from_pair(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.array_contains(times, (a + (b - a) * m).cast("int")) for m in range(2, length)])

    return F.exists(times, lambda a: F.exists(times, lambda b: (b > a) & from_pair(a, b)))


def periodic_subgraphs(graph: Graph, k: int, length: int, strategy: str = "po") -> DataFrame:
    """v0..v{k-1}, common: induced subgraphs whose edges have labels (times) in common that hold a progression of `length`."""
    if strategy != "po":
        return _periodic_by_pattern(graph, k, length, strategy)
    times = graph.edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.array_sort("labels").alias("__t"))
    f = Frontier.vertices(graph).extend(1)
    f = replace(f, df=f.df.withColumn("common", F.lit(None).cast("array<int>")))
    for i in range(1, k):
        f = f.extend(1)
        df = f.df
        for j in range(i):
            ends = (F.least(f"v{i}", f"v{j}") == F.col("__s")) & (F.greatest(f"v{i}", f"v{j}") == F.col("__d"))
            df = df.join(graph.sized(times), ends, "left")
            both = F.when(F.col("common").isNull(), F.col("__t")).otherwise(F.array_intersect("common", "__t"))
            df = df.withColumn("common", F.when(F.col("__s").isNull(), F.col("common")).otherwise(both)).drop("__s", "__d", "__t")
        f = replace(f, df=df.filter(has_progression(F.col("common"), length)))
    return f.df.select(*[f"v{i}" for i in range(k)], "common")


def _periodic_by_pattern(graph: Graph, k: int, length: int, strategy: str) -> DataFrame:
    times = graph.edges.select("src", "dst", F.array_sort("labels").alias("t"))
    parts = []
    for p, f in induced_by_pattern(graph, k, strategy):
        df = f.in_pattern_order().withColumn("common", F.lit(None).cast("array<int>"))
        for i, j, _ in p.edges:
            own = times.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("t").alias("__t"))
            df = df.join(graph.sized(own), (F.least(f"p{i}", f"p{j}") == F.col("__s")) & (F.greatest(f"p{i}", f"p{j}") == F.col("__d")))
            df = df.withColumn("common", F.when(F.col("common").isNull(), F.col("__t")).otherwise(F.array_intersect("common", "__t"))).drop("__s", "__d", "__t")
        parts.append(df.filter(has_progression(F.col("common"), length)).select(*[F.col(f"p{i}").alias(f"v{i}") for i in range(k)], "common"))
    return reduce(DataFrame.unionAll, parts)


# searches by label


def label_search(graph: Graph, k: int, labels: Iterable[int], strategy: str = "po", filter_graph: bool = True) -> Frontier | list[Frontier]:
    """Induced subgraphs of k vertices whose labels are all among `labels`."""
    some = sorted(set(labels))
    inside = lambda _, own: F.coalesce(F.get(own, F.lit(0)), F.lit(1)).isin(*some)
    if strategy == "po" and not filter_graph:
        return Frontier.vertices(graph).extend(1).filter(lambda f: f.label(f.k - 1).isin(*some)).explore(k - 1)
    small = graph.filter_vertices(inside)
    if strategy == "po":
        return induced_subgraphs(small, k)
    return [f for _, f in induced_by_pattern(small, k, strategy)]


def with_articulation(f: Frontier) -> DataFrame:
    """The rows of a vertex frontier with cut: bit i is set where vertex i is an articulation point.  Only distinct adjacencies are looked at."""
    from .frontier import pattern_of

    k = f.k

    @F.pandas_udf("long")
    def points(masks: pd.Series) -> pd.Series:
        return pd.Series([sum(1 << v for v in pattern_of(m, (), k, "vertex").articulation()) for m in masks], dtype="int64")

    rows = f.df.withColumn("__m", f.quick()[0].cast("string"))
    return rows.join(rows.select("__m").distinct().select("__m", points("__m").alias("cut")), "__m").drop("__m")


def minimal_keyword_search(graph: Graph, k: int, keywords: Iterable[int], strategy: str = "po", filter_graph: bool = False) -> Frontier:
    """Induced subgraphs of k vertices with each keyword label exactly once, in which every other vertex is an articulation point.

    po grows subgraphs; pa matches the patterns that have few enough vertices which are no articulation points.
    """
    words = sorted(set(keywords))
    if filter_graph:
        graph = graph.filter_edges(lambda u, lu, v, lv, e, le: (lu[0] != lv[0]) | lu[0].isin(*words))
    once = lambda f: reduce(lambda a, b: a & b, [F.size(F.filter(f.labels(), _is(w))) <= 1 for w in words])
    every = lambda f: reduce(lambda a, b: a & b, [F.array_contains(f.labels(), F.lit(w)) for w in words])
    if strategy != "po":
        parts = []
        for p, f in induced_by_pattern(graph, k, strategy):
            cut = p.articulation()
            if k - len(cut) > len(words):
                continue
            rows = Frontier(graph, as_vertices(p, f), "vertex", k)
            needed = reduce(lambda a, b: a & b, [rows.label(f.plan.order.index(v)).isin(*words) for v in range(k) if v not in cut])
            names = [f"{c}{i}" for i in range(k) for c in ("v", "l")] + [f"b{i}" for i in range(1, k)]
            parts.append(rows.filter(once(rows) & every(rows) & needed).df.select(*names))
        if not parts:
            return Frontier(graph, Frontier.vertices(graph).extend(k).df.limit(0), "vertex", k)
        return Frontier(graph, reduce(DataFrame.unionAll, parts), "vertex", k)
    f = Frontier.vertices(graph).extend(1).filter(once).explore(k - 1)
    f = f.filter(every(f))
    needed = reduce(lambda a, b: a & b, [f.label(i).isin(*words) | (F.col("cut").bitwiseAND(F.lit(1 << i)) != 0) for i in range(k)])
    return Frontier(graph, with_articulation(f).filter(needed).drop("cut"), "vertex", k)


def _is(w: int) -> Callable[[Column], Column]:
    return lambda x: x == w


def keyword_search(graph: Graph, m: int, keywords: Iterable[int], filter_graph: bool = False) -> Frontier:
    """Subgraphs of m edges in which each edge, in canonical order, adds a keyword and leaves another to the rest; all covered."""
    words = sorted(set(keywords))
    if filter_graph:
        graph = graph.filter_edges(lambda u, lu, v, lv, e, le: lu[0].isin(*words) | lv[0].isin(*words))
    only = lambda labels: F.array_intersect(labels, F.array(*map(F.lit, words)))
    f = Frontier.edges(graph)
    covered = F.array().cast("array<int>")
    for i in range(m):
        f = f.extend(1)
        fresh = lambda s, i=i: F.when(reduce(lambda a, b: a & b, [F.col(f"{s}{i}") != F.col(f"{t}{j}") for j in range(i) for t in "ab"], F.lit(True)), F.array(F.col(f"l{s}{i}")))
        none = F.array().cast("array<int>")
        last = only(F.concat(F.coalesce(fresh("a"), none), F.coalesce(fresh("b"), none)))
        df = f.df.withColumn("__last", last).withColumn("__seen", covered if i == 0 else F.col("covered"))
        adds = F.size("__last") > 0
        if i:
            adds = adds & (F.size(F.array_except("__last", "__seen")) > 0) & (F.size(F.array_except("__seen", "__last")) > 0)
        df = df.filter(adds).withColumn("covered", F.array_union("__seen", "__last")).drop("__last", "__seen")
        f = Frontier(graph, df, "edge", i + 1)
    return Frontier(graph, f.df.filter(F.size("covered") == len(words)).drop("covered"), "edge", m)


def query_specialization(graph: Graph, p: Pattern, strategy: str = "papo") -> DataFrame:
    """One column, edges (sorted ids): instances of every pattern that is the labelled query with one more edge."""
    ids = graph.edges.select("id", "src", "dst")
    if strategy == "papo":  # match the query, add each incident edge, and keep each edge set once
        f = query(graph, p)
        rows = f.df.select(*[f"v{i}" for i in range(p.n)])
        pos = {v: i for i, v in enumerate(f.plan.order)}
        f = Frontier(graph, rows, "vertex", p.n)
        df = f.all_incident_edges()
        for n, (i, j, _) in enumerate(p.edges):
            a, b = F.col(f"v{pos[i]}"), F.col(f"v{pos[j]}")
            side = ids.select(F.col("id").alias(f"q{n}"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
            df = df.join(graph.sized(side), (F.least(a, b) == F.col("__s")) & (F.greatest(a, b) == F.col("__d"))).drop("__s", "__d")
        own = F.array(*[F.col(f"q{n}") for n in range(p.m)])
        return df.filter(~F.array_contains(own, F.col("eid"))).select(F.array_sort(F.concat(own, F.array("eid"))).alias("edges")).distinct()
    from ..functions.pattern import extend_by_edge

    labels = [r.label for r in graph.label_frequencies().select("label").collect()]
    parts = []
    for q in extend_by_edge(p, labels):
        if strategy == "po":
            parts.append(query_by_edges(graph, q).df.select(F.array_sort(F.array(*[F.col(f"e{i}") for i in range(q.m)])).alias("edges")))
        else:
            df = query(graph, q).in_pattern_order()
            for n, (i, j, _) in enumerate(q.edges):
                side = ids.select(F.col("id").alias(f"q{n}"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
                df = df.join(graph.sized(side), (F.least(f"p{i}", f"p{j}") == F.col("__s")) & (F.greatest(f"p{i}", f"p{j}") == F.col("__d"))).drop("__s", "__d")
            parts.append(df.select(F.array_sort(F.array(*[F.col(f"q{n}") for n in range(q.m)])).alias("edges")))
    return reduce(DataFrame.unionAll, parts).distinct()


# sampling and generators


def random_walks(graph: Graph, k: int, seeds: int, seed: int = 1) -> Frontier:
    """About `seeds` induced subgraphs of k vertices: random first vertices, each grown by its least candidate."""
    share = min(1.0, seeds / max(1, graph.num_vertices))
    f = Frontier.vertices(graph).extend(1)
    f = f.filter(roll([F.col("v0")], seed) < share)
    for _ in range(k - 1):
        f = f.extend_least()
    return f


def around_word(graph: Graph, k: int, start: int) -> Frontier:
    """Induced subgraphs of k vertices whose least vertex is `start` or above."""
    return Frontier.vertices(graph).extend(1).filter(F.col("v0") >= start).extend(k - 1)


def patterns_from_samples(graph: Graph, k: int, seeds: int, seed: int = 1) -> DataFrame:
    return random_walks(graph, k, seeds, seed).by_pattern().select("pattern")


def pattern_query_generator(graph: Graph, k: int, fraction: float, seed: int, topk: int = 10) -> dict[str, str]:
    """Up to four labelled patterns: {least, most} dense by {least, most} frequent, drawn from the topk of each.

    Least dense leaves out cliques (k = 4), or cliques and trees (k >= 5).
    """
    found = kept(Frontier.vertices(graph).extend(k, (level_rate(fraction, k), seed)).by_pattern(True))  # read four times below
    edges = F.size(F.split(F.split("pattern", ";")[2], ","))
    rows = found.withColumn("m", edges)
    full = k * (k - 1) // 2
    sparse = rows.filter(F.col("m") < full) if k == 4 else rows.filter((F.col("m") < full) & (F.col("m") > k - 1)) if k >= 5 else rows
    out = {}
    for density, pool, first in (("least_dense", sparse, F.asc("m")), ("most_dense", rows, F.desc("m"))):
        for often, second in (("least_frequent", F.asc("n")), ("most_frequent", F.desc("n"))):
            top = pool.orderBy(first, second, "pattern").limit(topk)
            pick = top.orderBy(roll([F.col("pattern")], seed), "pattern").limit(1).collect()
            if pick:
                out[f"{density}_{often}"] = pick[0].pattern
    return out


def label_query_generator(graph: Graph, k: int, fraction: float, seed: int, topk: int = 10) -> DataFrame:
    """labels, n, place: label sets of sampled subgraphs with all labels different: the least, the middle and the most frequent."""
    f = Frontier.vertices(graph).extend(k, (level_rate(fraction, k), seed))
    sets = f.df.select(F.array_sort(f.labels()).alias("labels")).filter(F.size(F.array_distinct("labels")) == k)
    counted = kept(sets.groupBy("labels").agg(F.count("*").alias("n")))  # read four times below
    low = counted.orderBy("n", "labels").limit(topk).withColumn("place", F.lit("least"))
    high = counted.orderBy(F.desc("n"), "labels").limit(topk).withColumn("place", F.lit("most"))
    mid = counted.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("mid")).first().mid
    middle = counted.orderBy(F.abs(F.col("n") - F.lit(mid or 0)), "labels").limit(topk).withColumn("place", F.lit("middle"))
    return low.unionByName(middle).unionByName(high)


def throughput(graph: Graph, count: Callable[[Graph], int], budget: float, seed: int = 1, share: float = 0.01) -> float:
    """Subgraphs a millisecond: counts from growing shares of seed vertices until the budget of seconds is spent."""
    spent = found = 0.0
    while spent < budget and share <= 1:
        some = graph.filter_vertices(lambda v, _, s=share: F.pmod(F.xxhash64(v, F.lit(seed)), F.lit(10_000)) < int(10_000 * s))
        began = time.monotonic()
        found += count(some)
        spent += time.monotonic() - began
        share *= 2
    return found / max(1e-9, spent * 1000)


def graphlet_features(graph: Graph, k: int, index: DataFrame) -> DataFrame:
    """graph_id, pattern, share: motif counts of each component graph, normalised; index (vertex, graph_id)."""
    f = induced_subgraphs(graph, k)
    rows = f.df.withColumn("__m", f.quick()[0].cast("string")).join(index.select(F.col("vertex").alias("v0"), "graph_id"), "v0")
    mask = rows.groupBy("graph_id", "__m").agg(F.count("*").alias("n"))
    named = mask.select("graph_id", canonical_key(F.col("__m"), F.array().cast("array<int>"), k, "vertex").alias("pattern"), "n").groupBy("graph_id", "pattern").agg(F.sum("n").alias("n"))
    total = named.groupBy("graph_id").agg(F.sum("n").alias("all"))
    return named.join(total, "graph_id").select("graph_id", "pattern", (F.col("n") / F.col("all")).alias("share"))


def graphlet_kernel_auc(graph: Graph, k: int, index: DataFrame, classes: DataFrame, train_share: float = 0.6, seed: int = 1) -> float:
    """Area under the ROC curve, on the graphs left out, of a linear support vector machine over graphlet shares.

    classes (graph_id, label 0 or 1).  A graph is trained on by a hash of its id; patterns are at most the connected ones of k vertices.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = {p.key(): f"p{i}" for i, p in enumerate(vertex_patterns(k))}
    wide = graphlet_features(graph, k, index).groupBy("graph_id").agg(*[F.coalesce(F.sum(F.when(F.col("pattern") == key, F.col("share"))), F.lit(0.0)).alias(c) for key, c in names.items()])
    rows = VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(classes.join(wide, "graph_id").withColumn("label", F.col("label").cast("double")))
    rows = kept(rows.select("features", "label", (roll([F.col("graph_id")], seed) < train_share).alias("train")))
    model = LinearSVC(maxIter=50, regParam=0.01).fit(rows.filter("train"))
    weights, bias = model.coefficients.toArray().tolist(), model.intercept
    values = vector_to_array("features")
    score = reduce(lambda a, b: a + b, [values[i] * w for i, w in enumerate(weights)], F.lit(bias))
    return area_under_roc(rows.filter("not train").select(score.alias("score"), "label"))


def area_under_roc(scored: DataFrame) -> float:
    """The chance that a row of label 1 scores above one of label 0, ties counting half; 0.5 without either.  scored: score, label."""
    by_score = scored.groupBy("score").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    order = ranked(by_score, "score").select("__rank", "ones", "zeros")  # distinct scores in ranges, so no task orders all
    parts = kept(order.withColumn("__block", (F.col("__rank") / BLOCK_OF_RANKS).cast("long")))
    sums = parts.groupBy("__block").agg(F.sum("zeros").alias("own"))
    before = sums.withColumn("below", F.coalesce(F.sum("own").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("__block", "below")
    within = F.coalesce(F.sum("zeros").over(Window.partitionBy("__block").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = parts.withColumn("within", within).join(F.broadcast(before), "__block")
    total = rows.agg(F.sum(F.col("ones") * (F.col("below") + F.col("within") + F.col("zeros") / 2)).alias("won"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).first()
    return total.won / (total.ones * total.zeros) if total.ones and total.zeros else 0.5


def grown_by_label(graph: Graph, p: Pattern, label: int, strategy: str = "pa") -> DataFrame:
    """One column, n: pairs of an induced match of p and a further vertex with a label that is joined to it.

    pa counts the induced matches of every pattern that p becomes by such a vertex, each as often as it holds p that way;
    papo matches p and takes every vertex beside each match.
    """
    q = Pattern.of(p.n, p.edges, p.labels, induced=True)
    if strategy == "papo":
        f = query(graph, q)
        names = [f"{c}{i}" for i in range(p.n) for c in ("vn" if graph.lists else "v")]
        rows = f.df.select(*[f"v{i}" for i in range(p.n)])
        if graph.lists:
            for i in range(p.n):
                rows = rows.join(graph.sized(graph.adjacency.select(F.col("v").alias(f"v{i}"), F.col("nb").alias(f"n{i}"))), f"v{i}")
        near = Frontier(graph, rows.select(*names), "vertex", p.n).touching().select(F.col("x").alias("v"))
        return near.join(graph.sized(graph.vertex_label.filter(F.col("label") == label)), "v").agg(F.count("*").alias("n"))
    labels = p.labels if p.labels is not None else None
    if labels is None:
        raise ValueError("a pattern with labels is needed")
    found: dict[str, int] = {}
    for mask in range(1, 1 << p.n):
        grown = add_vertex(q, [v for v in range(p.n) if mask >> v & 1], label)
        found[grown.key()] = _ways(grown, q, label)
    parts = [query(graph, _induced(parse(key))).df.agg((F.count("*") * ways).alias("n")) for key, ways in sorted(found.items())]
    return reduce(DataFrame.unionAll, parts).agg(F.sum("n").alias("n"))


def _induced(p: Pattern) -> Pattern:
    return Pattern.of(p.n, p.edges, p.labels, True, p.edge_labeled)


def _ways(grown: Pattern, p: Pattern, label: int) -> int:
    """Vertices with the label without which grown is p."""
    out = 0
    for v in range(grown.n):
        rest = [u for u in range(grown.n) if u != v]
        at = {u: i for i, u in enumerate(rest)}
        left = Pattern.of(p.n, [(at[i], at[j], x) for i, j, x in grown.edges if v not in (i, j)], [grown.labels[u] for u in rest])
        out += grown.labels[v] == label and left.connected() and left.key() == p.key()
    return out
