"""Enumeration: extend, filter, explore and aggregate over frontiers of subgraphs.

A frontier is a DataFrame with a row per subgraph and scalar columns: v0..v{k-1} for vertices (l* labels, b* adjacency to
earlier ones as bits), e0..e{k-1} for edges (a*, b* ends, la*, lb* their labels, x* the edge's label).  Every connected
subgraph appears once: in the order of its words in which each next one is above the first word and above all words after
its first neighbour.

Three physical forms give the same rows.  Where no vertex has many neighbours (Graph.lists), rows carry neighbour lists
(n*), and a level is an expression that lists the valid extensions, and one explode.  If the graph is small, lists are joined
from a broadcast; if it is not (Graph.wide), lists carry the labels of neighbours along (m*), and the list of the last word
is joined by shuffle only when another level reads it: the last level moves nothing.  Where there are hubs, rows carry words
alone, extensions come from joins with the arcs, and what an extension touches is gathered by one aggregation: no row ever
holds the list of a hub.  Explodes are outer and their nulls dropped later, since inner ones make the optimizer compute the
list twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, canonical_order, from_mask, parse, text_of
from ..plans.order import STRATEGIES, Plan, heuristic
from .graph import Graph

Keep = Callable[["Frontier"], Column]
#: Subgraphs of so many vertices have their adjacency in one long; those of more in a text.
ONE_MASK, MOST_VERTICES = 11, 63
#: All subgraphs of so many vertices are counted by matching their few patterns where the graph is not broadcast.
MOST_COUNTED = 5
#: How partial results by raw pattern are made, and how they are merged by canonical pattern.
MERGES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "bit_or": (F.bit_or, F.bit_or),
    "bool_or": (F.bool_or, F.bool_or),
    "bool_and": (F.bool_and, F.bool_and),
    "avg": (lambda x: F.struct(F.sum(x).alias("s"), F.count(x).alias("n")), lambda x: F.sum(x["s"]) / F.sum(x["n"])),
    "collect_set": (F.collect_set, lambda x: F.array_distinct(F.flatten(F.collect_list(x)))),
    "collect_list": (F.collect_list, lambda x: F.flatten(F.collect_list(x))),
}
Merge = str | tuple[Callable[[Column], Column], Callable[[Column], Column]]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def roll(words: list[Column], seed: int) -> Column:
    """A number from 0 to 1 that depends on words and seed alone, so that samples can be repeated anywhere."""
    text = F.concat_ws(",", *[w.cast("string") for w in words], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


@dataclass(frozen=True)
class Frontier:
    """Subgraphs of k words.  steps: what led here, for explore()."""

    graph: Graph
    df: DataFrame | None
    kind: str
    k: int
    plan: Plan | None = None
    steps: tuple[tuple[str, object], ...] = ()
    #: df, if its rows are all subgraphs of k words: nothing was filtered, sampled or replaced.
    unfiltered: DataFrame | None = None

    @property
    def whole(self) -> bool:
        return self.unfiltered is self.df

    # roots

    @staticmethod
    def vertices(graph: Graph) -> Frontier:
        return Frontier(graph, None, "vertex", 0)

    @staticmethod
    def edges(graph: Graph) -> Frontier:
        return Frontier(graph, None, "edge", 0)

    @staticmethod
    def pattern(graph: Graph, p: Pattern, strategy: str = "pa", plan: Plan | None = None) -> Frontier:
        if plan is None:
            frequency = graph.frequency() if strategy == "pa" and p.labels is not None else None
            plan = STRATEGIES[strategy](p, frequency)
        return Frontier(graph, None, "pattern", 0, plan=plan)

    # columns of a row

    def word(self, i: int) -> Column:
        return F.col(f"e{i}" if self.kind == "edge" else f"v{i}")

    def label(self, i: int) -> Column:
        return F.col(f"l{i}")

    def words(self) -> Column:
        return F.array(*[self.word(i) for i in range(self.k)])

    def labels(self) -> Column:
        """First labels of the vertices, in order."""
        if self.kind == "edge":
            return F.transform(self._ends(), lambda x: x["l"])
        return F.array(*[self.label(i) for i in range(self.k)])

    def _ends(self) -> Column:
        """Vertices of an edge subgraph with their labels, in the order in which its edges name them."""
        return F.array_distinct(F.array(*[F.struct(F.col(f"{s}{i}").alias("v"), F.col(f"l{s}{i}").alias("l")) for i in range(self.k) for s in "ab"]))

    def vertex_list(self) -> Column:
        if self.kind == "edge":
            return F.array_distinct(F.array(*[F.col(f"{s}{i}") for i in range(self.k) for s in "ab"]))
        return self.words()

    def joined(self, i: int, j: int) -> Column:
        """Whether vertices i and j are adjacent (vertex kind)."""
        i, j = min(i, j), max(i, j)
        return F.col(f"b{j}").bitwiseAND(F.lit(1 << i)) != 0

    def degree(self, i: int) -> Column:
        """Degree of vertex i inside the subgraph (vertex kind)."""
        later = [F.when(self.joined(i, j), 1).otherwise(0) for j in range(i + 1, self.k)]
        return reduce(lambda a, b: a + b, later, F.bit_count(f"b{i}") if i else F.lit(0))

    def complete(self) -> Column:
        """Whether all vertices are adjacent (vertex kind)."""
        return _all([F.col(f"b{i}") == (1 << i) - 1 for i in range(1, self.k)])

    def num_edges(self) -> Column:
        return reduce(lambda a, b: a + b, [F.bit_count(f"b{i}") for i in range(1, self.k)], F.lit(0))

    # extension

    def _extended(self, df: DataFrame | None) -> Frontier:
        return replace(self, df=df, k=self.k + 1)

    def _sampled(self, out: Frontier, sample: tuple[float, int] | None) -> Frontier:
        if sample is None or self.k == 0:
            return out
        return replace(out, df=out.df.filter(roll([out.word(i) for i in range(out.k)], sample[1]) <= sample[0]))

    def extend(self, n: int = 1, sample: tuple[float, int] | None = None, using: Callable[[Frontier], Column] | None = None) -> Frontier:
        """n more words.  sample (probability, seed) keeps extensions after the first by chance.

        using is an enumerator of one's own: for vertices it lists candidates as an array and needs a graph with lists, for
        edges it is a condition in place of canonicity.
        """
        out = self
        for _ in range(n):
            step = getattr(out, f"_extend_{out.kind}")(using)
            step = replace(out._sampled(step, sample), steps=(*out.steps, ("extend", (sample, using))))
            out = replace(step, unfiltered=step.df if out.whole and sample is None and using is None else None)
        return out

    def filter(self, keep: Keep | Column) -> Frontier:
        cond = keep(self) if callable(keep) else keep
        return replace(self, df=self.df.filter(cond), steps=(*self.steps, ("filter", keep)))

    def explore(self, n: int) -> Frontier:
        """n more rounds of the whole chain so far."""
        out, chain = self, self.steps
        for _ in range(n):
            for name, what in chain:
                out = out.extend(1, *what) if name == "extend" else out.filter(what)
        return out

    def process(self, each_partition: Callable[[Iterator], None]) -> None:
        self.df.foreachPartition(each_partition)

    def observed(self, name: str) -> tuple[Frontier, Observation]:
        """The same frontier, and an observation whose get["n"] is its number of rows once an action has run."""
        watch = Observation(name)
        return replace(self, df=self.df.observe(watch, F.count(F.lit(1)).alias("n"))), watch

    # vertices

    def _side(self, k: int) -> DataFrame:
        """What the graph says of word k: v*, l*, n* and m* as its form has them."""
        graph = self.graph
        with_far = self.needs_label if self.kind == "pattern" else graph.wide
        side = graph.vertex_label if not graph.lists else graph.beside if with_far else graph.adjacency
        names = {"v": f"v{k}", "label": f"l{k}", "nb": f"n{k}", "nl": f"m{k}"}
        return side.select(*[F.col(c).alias(names[c]) for c in side.columns])

    def with_lists(self) -> Frontier:
        """The rows with the lists of all words (graph with lists); in a wide graph they are fetched here."""
        df = self.df
        for i in range(self.k if self.graph.wide else 0):
            if f"n{i}" not in df.columns:
                df = df.join(self._side(i).drop(f"l{i}"), f"v{i}")
        return replace(self, df=df)

    def _label_beside(self, x: Column, places: Iterable[int]) -> Column:
        """The label of a vertex x that is in the list of a word at one of these places (wide graph)."""
        return F.coalesce(*[F.get(f"m{i}", F.array_position(f"n{i}", x).cast("int") - 1) for i in places])

    def candidates(self) -> Column:
        """Valid next vertices, each once (vertex kind, graph with lists)."""
        parts = []
        for i in range(self.k):
            floor, earlier = self._floor(i), list(range(i))

            def test(x: Column, floor: Column = floor, earlier: list[int] = earlier) -> Column:
                return _all([x > floor, *[~F.array_contains(F.col(f"n{j}"), x) for j in earlier], *[x != F.col(f"v{j}") for j in earlier[1:]]])

            parts.append(F.filter(f"n{i}", _one(test)))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def _floor(self, first: int) -> Column:
        """What a next vertex whose first neighbour is word `first` has to exceed."""
        later = [F.col(f"v{j}") for j in range(first + 1, self.k)]
        return F.greatest(F.col("v0"), *later) if later else F.col("v0")

    def touching(self) -> DataFrame:
        """Rows with x, a vertex beside theirs, and bits, bit i for each vertex i next to it; each pair of a row and an x once."""
        if self.graph.lists:
            self = self.with_lists()
            near = F.array_except(F.array_distinct(F.flatten(F.array(*[F.col(f"n{i}") for i in range(self.k)]))), self.words())
            met = self.df.withColumn("x", F.explode_outer(near)).filter("x is not null")
            return met.withColumn("bits", reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(f"n{i}", F.col("x")), F.lit(1 << i)).otherwise(0).cast("long") for i in range(self.k)]))
        names = self.df.columns
        at = self.df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1)))).withColumn("__at", F.get(self.words(), F.col("__i")))
        pairs = self.graph.pairs.select(F.col("v").alias("__at"), F.col("nb").alias("x"))
        met = at.join(self.graph.sized(pairs), "__at").filter(~F.array_contains(self.words(), F.col("x")))
        return met.groupBy(*names, "x").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__i"))).alias("bits"))

    def _valid(self) -> Column:
        out = F.lit(False)
        for i in reversed(range(self.k)):
            out = F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("x") > self._floor(i)).otherwise(out)
        return out

    def _with_vertex(self, rows: DataFrame) -> Frontier:
        """The frontier of rows with x and bits."""
        k = self.k
        grown = rows.withColumnsRenamed({"x": f"v{k}", "bits": f"b{k}"})
        if self.graph.wide:
            return self._extended(grown.withColumn(f"l{k}", self._label_beside(F.col(f"v{k}"), range(k))))
        return self._extended(grown.join(self.graph.sized(self._side(k)), f"v{k}"))

    def _root(self) -> DataFrame:
        return self._side(0)

    def _extend_vertex(self, using) -> Frontier:
        k = self.k
        if k == 0:
            return self._extended(self._root())
        if k >= MOST_VERTICES:
            raise ValueError(f"a subgraph has {MOST_VERTICES} vertices at most")
        if not self.graph.lists:
            if using:
                raise ValueError("an enumerator of one's own needs a graph with lists (Graph.lists)")
            return self._with_vertex(self.touching().filter(self._valid()))
        self, x = self.with_lists(), F.col(f"v{k}")
        grown = self.df.withColumn(f"v{k}", F.explode_outer(using(self) if using else self.candidates()))
        if not self.graph.wide:
            grown = grown.join(self.graph.sized(self._side(k)), f"v{k}")
        elif using:  # which may list anything
            grown = grown.join(self.graph.vertex_label.select(F.col("v").alias(f"v{k}"), F.col("label").alias(f"l{k}")), f"v{k}")
        else:
            grown = grown.filter(x.isNotNull()).withColumn(f"l{k}", self._label_beside(x, range(k)))
        bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(f"n{i}", F.col(f"v{k}")), F.lit(1 << i)).otherwise(0).cast("long") for i in range(k)])
        return self._extended(grown.withColumn(f"b{k}", bits))

    def extend_all(self) -> Frontier:
        """Every vertex beside the subgraph, whatever the order: sets of vertices appear once for each way to reach them."""
        return self._with_vertex(self.touching())

    def extend_least(self) -> Frontier:
        """Each subgraph with the least of its valid next vertices; those without any go."""
        if self.graph.lists:
            return self._extend_vertex(lambda f: F.slice(F.array_sort(f.candidates()), 1, 1))
        least = self.touching().filter(self._valid()).groupBy(*self.df.columns).agg(F.min(F.struct("x", "bits")).alias("__least"))
        return self._with_vertex(least.select(*self.df.columns, "__least.x", "__least.bits"))

    def count_next(self) -> DataFrame:
        """How many subgraphs one more vertex makes, without making them (vertex kind): one column, n."""
        if not self.graph.lists:
            return self.touching().filter(self._valid()).agg(F.count(F.lit(1)).alias("n"))
        self = self.with_lists()
        return self.df.select(F.size(self.candidates()).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))

    # edges

    def _extend_edge(self, using) -> Frontier:
        if self.k == 0:
            ends = self.graph.vertex_label
            side = lambda c: ends.select(F.col("v").alias(c), F.col("label").alias(f"l{c}"))
            e = self.graph.edge_label.select(F.col("id").alias("e0"), F.col("src").alias("a0"), F.col("dst").alias("b0"), F.col("label").alias("x0"))
            return self._extended(e.join(self.graph.sized(side("a0")), "a0").join(self.graph.sized(side("b0")), "b0"))
        k = self.k
        df = self._incident()
        low = F.col("at") < F.col("nb")
        df = df.select(
            *self.df.columns, F.col("eid").alias(f"e{k}"), F.least("at", "nb").alias(f"a{k}"), F.greatest("at", "nb").alias(f"b{k}"),
            F.when(low, F.col("near")).otherwise(F.col("far")).alias(f"la{k}"), F.when(low, F.col("far")).otherwise(F.col("near")).alias(f"lb{k}"), F.col("mark").alias(f"x{k}"),
        )
        e, valid = F.col(f"e{k}"), F.lit(False)
        for i in reversed(range(k)):  # the first word that shares an end with the new edge decides
            touch = _any([F.col(f"{s}{i}") == F.col(f"{t}{k}") for s in "ab" for t in "ab"])
            above = _all([e > F.col("e0"), *[e > F.col(f"e{j}") for j in range(i + 1, k)], *[e != F.col(f"e{j}") for j in range(1, i + 1)]])
            valid = F.when(touch, above).otherwise(valid)
        return self._extended(df.filter(valid if using is None else using(self)))

    def _incident(self) -> DataFrame:
        """Rows with an edge at one of their vertices: at and its label near, nb and far, eid, mark; edges between two of them once."""
        ends = self._ends() if self.kind == "edge" else F.transform(self.words(), lambda v: F.struct(v.alias("v"), F.lit(None).cast("int").alias("l")))
        df = self.df.withColumn("__end", F.explode(ends)).select(*self.df.columns, F.col("__end.v").alias("at"), F.col("__end.l").alias("near"))
        df = df.join(self.graph.sized(self.graph.incident.withColumnRenamed("v", "at")), "at")
        return df.filter(~F.array_contains(self.vertex_list(), F.col("nb")) | (F.col("at") < F.col("nb")))

    def all_incident_edges(self) -> DataFrame:
        """Every (row, edge) with an end in the row's vertices: the row's columns, eid, x, y; edges between two of them once."""
        return self._incident().select(*self.df.columns, "eid", F.least("at", "nb").alias("x"), F.greatest("at", "nb").alias("y"))

    # patterns

    def _extend_pattern(self, using) -> Frontier:
        k, step = self.k, self.plan.steps[self.k]
        by_lists = self.graph.lists and not self.plan.pattern.edge_labeled
        if k == 0:
            root = self._rooted() if by_lists else self.graph.degrees.select(F.col("v").alias("v0"), F.col("label").alias("l0"), F.col("degree").alias("g0"))
            return self._extended(root if step.label is None else root.filter(F.col("l0") == step.label))
        if by_lists and f"c{k}" in self.df.columns:
            return self._extended(self._matched_candidates())
        return self._extended(self._matched_lists(step) if by_lists else self._matched_joins(step))

    # with lists, rows carry c*, the candidates of each later position that is joined to a matched one, in place of lists

    def _rooted(self) -> DataFrame:
        root, label = self._root(), self.plan.steps[0].label
        return self._narrowed(root if label is None else root.filter(F.col("l0") == label), 0)

    def _matched_candidates(self) -> DataFrame:
        """The next vertex from its candidates; its list is fetched if a later position reads it, and narrows their candidates."""
        k, steps, induced = self.k, self.plan.steps, self.plan.pattern.induced
        drawn = self.df.withColumn(f"v{k}", F.explode_outer(f"c{k}")).drop(f"c{k}").filter(F.col(f"v{k}").isNotNull())
        if steps[k].label is not None:
            drawn = drawn.withColumn(f"l{k}", F.lit(steps[k].label))
        if any(k in s.joined or induced and k in s.apart for s in steps[k + 1 :]):
            drawn = drawn.join(self.graph.sized(self._side(k).drop(f"l{k}")), f"v{k}")
        return self._narrowed(drawn, k)

    def _narrowed(self, df: DataFrame, k: int) -> DataFrame:
        """Rows whose word k is matched, with the candidates of later positions by what it says of them."""
        steps, induced = self.plan.steps, self.plan.pattern.induced

        def says(p: int, j: int, x: Column) -> list[Column]:
            """What word j asks of the vertex at position p, beyond an edge."""
            s, v = steps[p], F.col(f"v{j}")
            out = [x > v] if j in s.above else [x < v] if j in s.below else [x != v] if j in s.apart else []
            return out + ([~F.array_contains(f"n{j}", x)] if induced and j in s.apart else [])

        def asked(p: int) -> tuple:
            s = steps[p]
            return (s.label, *[(j in s.joined, j in s.apart, j in s.above, j in s.below) for j in range(k)])

        made, waiting = {}, []
        for p in range(k + 1, len(steps)):
            s, c = steps[p], f"c{p}"
            if s.joined[0] < k:  # it has candidates
                if k in s.above and k in s.apart and not induced and asked(p) == asked(k):
                    # the same rising list that word k was drawn from
                    made[c] = F.slice(c, F.array_position(c, F.col(f"v{k}")).cast("int") + 1, F.size(c))
                elif k in s.joined or k in s.apart:
                    made[c] = F.filter(c, _one(lambda x, p=p, s=s: _all(says(p, k, x) + ([F.array_contains(f"n{k}", x)] if k in s.joined else []))))
            elif s.joined[0] == k:
                near = F.col(f"n{k}")
                if s.label is not None:
                    near = F.transform(F.filter(F.arrays_zip(f"n{k}", f"m{k}"), _one(lambda z, s=s: z[f"m{k}"] == s.label)), lambda z: z[f"n{k}"])
                asks = lambda x, p=p: [c for j in range(k + 1) for c in says(p, j, x)]
                made[c] = F.filter(near, _one(lambda x, asks=asks: _all(asks(x)))) if s.above or s.below or s.apart else near
            else:
                waiting.append(s)
        lists = {f"n{j}" for j in range(k + 1) if induced and any(j in s.apart for s in waiting)}
        df = df.withColumns(made) if made else df
        return df.drop(*[c for c in df.columns if c[0] in "nm" and c not in lists])

    def _ordered_by(self, x: Column, step) -> list[Column]:
        out = [x > F.col(f"v{j}") for j in step.above] + [x < F.col(f"v{j}") for j in step.below]
        return out + [x != F.col(f"v{j}") for j in step.apart if j not in step.above and j not in step.below]

    def _matched_lists(self, step) -> DataFrame:
        k = self.k
        first, *rest = step.joined

        def test(x: Column) -> Column:
            out = [F.array_contains(F.col(f"n{j}"), x) for j in rest] + self._ordered_by(x, step)
            return _all(out + ([~F.array_contains(F.col(f"n{j}"), x) for j in step.apart] if self.plan.pattern.induced else []))

        grown = self.df.withColumn(f"v{k}", F.explode_outer(F.filter(f"n{first}", _one(test))))
        later = self.plan.steps[k + 1 :]
        used = any(k in s.joined or self.plan.pattern.induced and k in s.apart for s in later)
        if step.label is None and not used and (later or not self.needs_label):
            return grown.filter(F.col(f"v{k}").isNotNull())
        if self.graph.wide:
            grown = grown.filter(F.col(f"v{k}").isNotNull())
            if self.needs_label:
                grown = grown.withColumn(f"l{k}", self._label_beside(F.col(f"v{k}"), [first]))
                grown = grown if step.label is None else grown.filter(F.col(f"l{k}") == step.label)
            return grown.join(self._side(k).drop(f"l{k}"), f"v{k}") if used else grown
        side = self._side(k)
        return grown.join(self.graph.sized(side if step.label is None else side.filter(F.col(f"l{k}") == step.label)), f"v{k}")

    def _matched_joins(self, step) -> DataFrame:
        """The next vertex by joins with the arcs alone.

        Each row takes the neighbours of the one of its vertices, among those the new vertex is joined to, that has fewest
        (g* are degrees), so a hub is only spread out where the pattern leaves no other way; semi joins check the other edges
        of the pattern, anti joins what must lie apart.
        """
        k, graph = self.k, self.graph
        marks = dict(step.edge_labels)
        x = F.col(f"v{k}")
        pairs = graph.pairs.select(F.col("v").alias("__v"), F.col("nb").alias("__x"))
        least = F.least(*[F.struct(F.col(f"g{j}").alias("g"), F.col(f"v{j}").alias("v")) for j in step.joined]) if len(step.joined) > 1 else F.struct(F.col(f"v{step.joined[0]}").alias("v"))
        at = "__at" if len(step.joined) > 1 else f"v{step.joined[0]}"  # of one vertex, the shuffle of the step before may serve again
        df = (self.df.withColumn("__at", least["v"]) if at == "__at" else self.df).join(graph.sized(pairs), F.col(at) == F.col("__v")).withColumnRenamed("__x", f"v{k}").drop("__v", "__at").filter(_all(self._ordered_by(x, step)))
        if len(step.joined) == 2 and not marks:  # the other of the two is all that is left to check
            ends = [F.struct(F.col(f"g{j}").alias("g"), F.col(f"v{j}").alias("v")) for j in step.joined]
            df = df.withColumn("__far", F.greatest(*ends)["v"]).join(graph.sized(pairs), (F.col("__far") == F.col("__v")) & (x == F.col("__x")), "left_semi").drop("__far")
        elif len(step.joined) > 1 or marks:
            for j in step.joined:
                there = pairs if not marks else graph.incident.filter(F.col("mark") == marks[j]).select(F.col("v").alias("__v"), F.col("nb").alias("__x"))
                df = df.join(graph.sized(there), (F.col(f"v{j}") == F.col("__v")) & (x == F.col("__x")), "left_semi")
        if self.plan.pattern.induced:
            for j in step.apart:
                df = df.join(graph.sized(pairs), (F.col(f"v{j}") == F.col("__v")) & (x == F.col("__x")), "left_anti")
        if step.label is None and not self.needs_label and not any(k in s.joined for s in self.plan.steps[k + 1 :]):
            return df  # nothing reads its degree
        side = graph.degrees.select(F.col("v").alias(f"v{k}"), F.col("label").alias(f"l{k}"), F.col("degree").alias(f"g{k}"))
        return df.join(graph.sized(side if step.label is None else side.filter(F.col(f"l{k}") == step.label)), f"v{k}")

    @property
    def needs_label(self) -> bool:
        return self.plan.pattern.labels is not None

    def matches(self, keep: Keep | None = None) -> Frontier:
        """All positions of the pattern (pattern kind); keep is asked at every further step."""
        out = self
        for _ in range(self.plan.pattern.n - self.k):
            out = out.extend(1)
            out = out.filter(keep) if keep is not None else out
        return out

    def in_pattern_order(self) -> DataFrame:
        """p0..p{n-1}: the vertex at each position of the pattern as given."""
        return self.df.select(*[F.col(f"v{self.plan.order.index(p)}").alias(f"p{p}") for p in range(self.k)])

    def with_labels(self) -> Frontier:
        """The rows with the graph's labels l* of all vertices (vertex and pattern kinds), whatever the pattern asks for."""
        df = self.df.drop(*[f"l{i}" for i in range(self.k)])
        for i in range(self.k):
            df = df.join(self.graph.sized(self.graph.vertex_label.select(F.col("v").alias(f"v{i}"), F.col("label").alias(f"l{i}"))), f"v{i}")
        return replace(self, df=df)

    # other kinds

    def to_vertices(self, size: int | None = None) -> Frontier:
        """Vertex-induced subgraphs of the same vertices, one for each row, in canonical order: the least vertex, then each time the least neighbour of those before.

        Edge subgraphs of one frontier may have different numbers of vertices; size names one of them.
        """
        if self.kind != "edge":
            return _in_vertex_order(self.graph, self.df.select(F.array_sort(self.words()).alias("all")), self.k)
        if size is None and self.k > 1:
            raise ValueError("edge subgraphs may have different numbers of vertices: name one, or use to_vertices_by_size()")
        size = size or 2
        if self.whole and not self.graph.fits and size <= MOST_COUNTED:
            return _spanned(Frontier.vertices(self.graph).extend(size), self.k)
        sets = self.df.select(F.array_sort(self.vertex_list()).alias("all"))
        return _in_vertex_order(self.graph, sets.filter(F.size("all") == size), size)

    def to_vertices_by_size(self) -> dict[int, Frontier]:
        """to_vertices() for each number of vertices that k edges may have."""
        least = next(n for n in range(2, self.k + 2) if n * (n - 1) // 2 >= self.k)
        return {n: self.to_vertices(n) for n in range(least, self.k + 2)}

    def to_edges(self) -> Frontier:
        """Edge-induced subgraphs of the pattern's edges (pattern kind), words in canonical order."""
        p = self.plan.pattern
        ids = self.graph.edge_label.select("id", "src", "dst", "label")
        df = self.in_pattern_order().withColumn("__row", F.array(*[F.col(f"p{i}") for i in range(p.n)]))
        pairs = F.array(*[F.struct(F.least(f"p{i}", f"p{j}").alias("src"), F.greatest(f"p{i}", f"p{j}").alias("dst")) for i, j, _ in p.edges])
        each = df.select("__row", F.explode(pairs).alias("e")).select("__row", "e.src", "e.dst").join(self.graph.sized(ids), ["src", "dst"])
        rows = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("id", "src", "dst", "label"))).alias("left"))
        return _in_edge_order(self.graph, rows, p.m)

    def to_pattern(self, plan: Plan) -> Frontier:
        """Matches of a pattern that begin with each row's words in every order that fits (vertex kind)."""
        k, out = self.k, []
        for order in permutations(range(k)):
            conds = []
            for pos in range(k):
                s = plan.steps[pos]
                v = F.col(f"v{order[pos]}")
                conds += [self.joined(order[j], order[pos]) for j in s.joined] + ([~self.joined(order[j], order[pos]) for j in s.apart] if plan.pattern.induced else [])
                conds += [v > F.col(f"v{order[j]}") for j in s.above] + [v < F.col(f"v{order[j]}") for j in s.below]
                if s.label is not None:
                    conds.append(F.col(f"l{order[pos]}") == s.label)
            parts = "vlnm" if self.graph.wide else "vln" if self.graph.lists else "vl"
            out.append(self.with_lists().df.filter(_all(conds)).select(*[F.col(f"{c}{order[pos]}").alias(f"{c}{pos}") for pos in range(k) for c in parts]))
        df = reduce(DataFrame.unionAll, out)
        if not self.graph.lists or plan.pattern.edge_labeled:
            for i in range(k):
                df = df.join(self.graph.sized(self.graph.degrees.select(F.col("v").alias(f"v{i}"), F.col("degree").alias(f"g{i}"))), f"v{i}")
        return Frontier(self.graph, df, "pattern", k, plan=plan)

    # aggregation

    def through(self, each: Callable[[Frontier], DataFrame]) -> Frontier:
        """The frontier with what a callback makes of it in place of its rows: any number of rows for each, any columns."""
        return replace(self, df=each(self))

    def count(self) -> int:
        return self.df.count()

    def counted(self, name: str = "n") -> DataFrame:
        return self.df.agg(F.count("*").alias(name))

    def agg(self, value: Column, how: str | Callable[[Column], Column] = "sum", name: str = "value") -> DataFrame:
        return self.df.agg((how if callable(how) else getattr(F, how))(value).alias(name))

    def by_key(self, keys: dict[str, Column], value: Column | None = None, how: str | Callable[[Column], Column] = "count", name: str = "n") -> DataFrame:
        """keys by name; how is any aggregate function of one column (sum, min, max, collect_set, ...)."""
        made = (how if callable(how) else getattr(F, how))(value if value is not None else F.lit(1)).alias(name)
        return self.df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(made)

    def reduced(self, keys: dict[str, Column], value: Column, zero: Column, merge: Callable[[Column, Column], Column], name: str = "value", spread: int = 64) -> DataFrame:
        """Values of each key joined by a merge of one's own, which is associative and commutative and has zero as its neutral value.

        Keys are spread over so many parts first, so no task gathers all values of a frequent key.
        """
        names = list(keys)
        rows = self.df.select(*[c.alias(k) for k, c in keys.items()], value.alias("__x"))
        for part in (F.pmod(F.xxhash64("__x"), F.lit(spread)), F.lit(0)):
            rows = rows.groupBy(*names, part.alias("__part")).agg(F.aggregate(F.collect_list("__x"), zero, merge).alias("__x"))
        return rows.select(*names, F.col("__x").alias(name))

    def quick(self, edge_labels: bool = False) -> list[Column]:
        """Columns that stand for the pattern in the order of discovery: adjacency, or edges by position, and labels."""
        if self.kind == "vertex":
            bits = [F.col(f"b{j}") for j in range(1, self.k)]
            if self.k <= ONE_MASK:
                mask = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(b, j * (j + 1) // 2) for j, b in enumerate(bits)], F.lit(0).cast("long"))
            else:
                mask = F.concat_ws(",", *[b.cast("string") for b in bits])
            return [mask.alias("mask"), self.labels().alias("labels")]
        all_ = self.vertex_list()
        at = lambda c: (F.array_position(all_, F.col(c)) - 1).cast("string")
        edges = [F.concat_ws("-", at(f"a{i}"), at(f"b{i}"), *([F.col(f"x{i}").cast("string")] if edge_labels else [])) for i in range(self.k)]
        return [F.concat_ws(",", *edges).alias("mask"), self.labels().alias("labels")]

    def by_pattern(self, labelled: bool = True, value: Column | None = None, how: Merge = "sum", name: str = "n", edge_labels: bool = False) -> DataFrame:
        """pattern (its canonical key) and a count, or an aggregate of value.

        Rows are aggregated by the quick pattern first, so only distinct quick patterns are canonised, in parallel; how
        names a pair of MERGES, or is one: what makes a partial result and what merges them.
        """
        if self.whole and not self.graph.fits and not labelled and value is None and how in ("sum", "count") and 2 < self.k <= MOST_COUNTED - (self.kind == "edge") and self.kind != "pattern" and not edge_labels:
            from .apps import whole_counts

            return whole_counts(self.graph, self.k, self.kind).withColumnRenamed("n", name)
        partial, final = MERGES[how] if isinstance(how, str) else how
        mask, labels = self.quick(edge_labels)
        quick = [mask, labels if labelled else F.array().cast("array<int>").alias("labels")]
        rows = self.df.select(*quick, (value if value is not None else F.lit(1).cast("long")).alias("__x"))
        rows = rows.distinct() if how == "collect_set" else rows  # so that no set takes each row
        rows = rows.groupBy("mask", "labels").agg(partial(F.col("__x")).alias("__x"))
        named = rows.select(canonical_key(F.col("mask").cast("string"), F.col("labels"), self.k, self.kind).alias("pattern"), "__x")
        return named.groupBy("pattern").agg(final(F.col("__x")).alias(name))


def _one(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """test as a function of exactly one argument."""
    return lambda x: test(x)


def pattern_of(mask: str, labels: tuple[int, ...], k: int, kind: str) -> Pattern:
    if kind == "vertex":
        if k <= ONE_MASK:
            return from_mask(k, int(mask), labels or None)
        return from_mask(k, sum(int(b) << (j * (j + 1) // 2) for j, b in enumerate(mask.split(","))), labels or None)
    edges = [tuple(map(int, e.split("-"))) for e in mask.split(",")]
    return Pattern.of(max(max(e[:2]) for e in edges) + 1, edges, labels or None, edge_labeled=len(edges[0]) > 2)


def canonical_key(mask: Column, labels: Column, k: int, kind: str) -> Column:
    @F.pandas_udf("string")
    def key(masks: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([pattern_of(m, tuple(x), k, kind).key() for m, x in zip(masks, labels, strict=True)], dtype=object)

    return key(mask, labels)


def canonical_positions(mask: Column, labels: Column, k: int, kind: str) -> Column:
    """Struct: the canonical key, and for each vertex in discovery order the orbit of its canonical position."""

    @F.pandas_udf("struct<pattern:string,orbit:array<int>>")
    def place(masks: pd.Series, labels: pd.Series) -> pd.DataFrame:
        rows = []
        for m, x in zip(masks, labels, strict=True):
            p = pattern_of(m, tuple(x), k, kind)
            order = canonical_order(p)
            q = p.relabel(order)
            orbits = q.orbits()
            at = {v: c for c, v in enumerate(order)}
            rows.append((text_of(q), [orbits[at[v]] for v in range(p.n)]))
        return pd.DataFrame(rows, columns=["pattern", "orbit"])

    return place(mask, labels)


def _bit(rows: str, q: Column, j: Column) -> Column:
    """Whether vertices at places q and j of a sorted set are adjacent, as 0 or 1."""
    return F.call_function("shiftright", F.get(rows, q)["bits"], j).bitwiseAND(F.lit(1).cast("long"))


def _in_vertex_order(graph: Graph, sets: DataFrame, k: int) -> Frontier:
    """all (sorted vertices, rows may repeat) -> a vertex frontier in canonical order."""
    times = sets.groupBy("all").agg(F.count(F.lit(1)).alias("times"))
    at = times.select("all", "times", F.posexplode("all").alias("i", "v")).join(graph.sized(graph.pairs), "v").filter(F.array_contains("all", F.col("nb")))
    place = (F.array_position("all", F.col("nb")) - 1).cast("int")
    own = at.groupBy("all", "times", "i").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    df = own.groupBy("all", "times").agg(F.array_sort(F.collect_list(F.struct("i", "bits"))).alias("rows")) if k > 1 else times.withColumn("rows", F.array().cast("array<struct<i:int,bits:bigint>>"))
    df = df.filter(F.size("rows") == k) if k > 1 else df
    df = df.withColumn("q0", F.lit(0)).withColumn("c0", F.lit(1).cast("long"))
    for i in range(1, k):
        free = lambda q, i=i: (F.call_function("shiftright", F.col(f"c{i - 1}"), q).bitwiseAND(F.lit(1).cast("long")) == 0) & (F.get("rows", q)["bits"].bitwiseAND(F.col(f"c{i - 1}")) != 0)
        df = df.withColumn(f"q{i}", F.array_min(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), _one(free)))).filter(F.col(f"q{i}").isNotNull())
        df = df.withColumn(f"c{i}", F.col(f"c{i - 1}").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"q{i}"))))
    bits = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_bit("rows", F.col(f"q{i}"), F.col(f"q{j}")), j) for j in range(i)])
    df = df.select(F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("__time"), *[F.get("all", F.col(f"q{i}")).alias(f"v{i}") for i in range(k)], *[bits(i).alias(f"b{i}") for i in range(1, k)]).drop("__time")
    f = Frontier(graph, df, "vertex", k)
    for i in range(k):
        df = df.join(graph.sized(f._side(i) if not graph.wide else f._side(i).select(f"v{i}", f"l{i}")), f"v{i}")
    return replace(f, df=df)


def _spanned(f: Frontier, m: int) -> Frontier:
    """Each row of a vertex frontier once for every connected subgraph of m edges on all its vertices."""
    k, pairs = f.k, [(i, j) for j in range(f.k) for i in range(j)]
    ways: dict[int, int] = {}
    for some in combinations(pairs, m):
        if Pattern.of(k, some).connected():
            ways[sum(1 << (j * (j - 1) // 2 + i) for i, j in some)] = 1
    bit = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f"b{j}", j * (j - 1) // 2) for j in range(1, k)])
    times = reduce(lambda a, b: a + b, [F.when(bit.bitwiseAND(F.lit(w)) == w, 1).otherwise(0) for w in ways], F.lit(0))
    rows = f.df.withColumn("__time", F.explode_outer(F.when(times > 0, F.sequence(F.lit(1), times)))).filter("__time is not null").drop("__time")
    return replace(f, df=rows)


def _in_edge_order(graph: Graph, rows: DataFrame, m: int) -> Frontier:
    """left (sorted structs id, src, dst, label) -> an edge frontier: the least edge, then each time the least that touches those before."""
    df = rows.select(F.col("left"), F.col("left")[0].alias("y0"))
    for k in range(1, m):
        touches = lambda x, k=k: _any([(x[s] == F.col(f"y{j}")[t]) for j in range(k) for s in ("src", "dst") for t in ("src", "dst")]) & _all([x["id"] != F.col(f"y{j}")["id"] for j in range(k)])
        df = df.withColumn(f"y{k}", F.get(F.filter("left", _one(touches)), F.lit(0)))
    df = df.select(*[F.col(f"y{i}")[a].alias(f"{b}{i}") for i in range(m) for a, b in (("id", "e"), ("src", "a"), ("dst", "b"), ("label", "x"))])
    for i in range(m):
        for s in "ab":
            df = df.join(graph.sized(graph.vertex_label.select(F.col("v").alias(f"{s}{i}"), F.col("label").alias(f"l{s}{i}"))), f"{s}{i}")
    return Frontier(graph, df, "edge", m)


def match(graph: Graph, p: Pattern, strategy: str = "pa", sample: tuple[float, int] | None = None) -> Frontier:
    """All matches of a pattern, each class of automorphic ones once."""
    return Frontier.pattern(graph, p, strategy).extend(p.n, sample)


def explain_plan(p: Pattern, frequency: dict[int, int] | None = None) -> str:
    return heuristic(p, frequency).text()


__all__ = ["Frontier", "MERGES", "canonical_key", "canonical_positions", "explain_plan", "match", "parse", "pattern_of", "roll"]
