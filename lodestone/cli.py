"""Command line: `python -m lodestone.cli LABELING GRAPH APP STEPS [ARG ...] [key:value ...]`.

LABELING is n, v, e or ve; STEPS is the size less one (vertices, or edges where the app grows edges).  Each app prints
its rows, then `numSubgraphs elapsedMs throughput`.  Names ending in po, pa, pa_mcvc, pa_po are strategies of one operator.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pattern import parse, text_of, vertex_patterns
from .operators import apps, fsm
from .operators.frontier import Frontier, explain_plan
from .operators.graph import Graph
from .sources.text import read_graph, read_pattern, write_pattern


@dataclass
class Call:
    graph: Graph
    size: int
    args: list[str]
    conf: dict[str, str] = field(default_factory=dict)

    def ints(self, i: int) -> list[int]:
        return [int(x) for x in self.args[i].split(",")]

    def flag(self, i: int) -> bool:
        return len(self.args) > i and self.args[i].lower() == "true"

    def pattern(self, i: int = 0, induced: bool = False):
        labeling = self.args[i + 1] if len(self.args) > i + 1 and set(self.args[i + 1]) <= set("nve") else "v"
        p = read_pattern(self.graph.spark, self.args[i], labeling)
        return type(p).of(p.n, p.edges, p.labels, induced, p.edge_labeled)

    def sample(self, i: int) -> tuple[float, int]:
        return float(self.args[i]), int(self.conf.get("sampling_seed", 1))


App = Callable[[Call], DataFrame]
APPS: dict[str, App] = {}


def app(*names: str) -> Callable[[Callable[[Call, str], DataFrame]], None]:
    """Registers an app under names; it gets the name that was called."""

    def add(f: Callable[[Call, str], DataFrame]) -> None:
        for name in names:
            APPS[name] = lambda c, n=name: f(c, n)

    return add


def strategy(name: str) -> str:
    name = name.removesuffix("_estimate").removesuffix("_old")
    return next((s for end, s in (("_pa_mcvc", "mcvc"), ("_pa_po", "papo"), ("_po", "po"), ("_pa", "pa")) if name.endswith(end)), "po")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


@app("patterns_and_plans_heuristic")
def _plans(c: Call, name: str) -> DataFrame:
    rows = [(p.key(), explain_plan(type(p).of(p.n, p.edges, None, c.flag(0)))) for p in vertex_patterns(c.size)]
    return c.graph.spark.createDataFrame(rows, "pattern string, plan string")


@app("subgraphs_listing_po")
def _edges(c: Call, name: str) -> DataFrame:
    return _count(apps.edge_subgraphs(c.graph, c.size).df)


@app("subgraphs_listing_pa")
def _edges_pa(c: Call, name: str) -> DataFrame:
    return apps.counts(c.graph, apps.edge_subgraphs_by_pattern(c.graph, c.size))


@app("induced_subgraphs_listing_po")
def _induced(c: Call, name: str) -> DataFrame:
    return _count(apps.induced_subgraphs(c.graph, c.size).df)


@app("induced_subgraphs_listing_pa", "induced_subgraphs_listing_pa_mcvc")
def _induced_pa(c: Call, name: str) -> DataFrame:
    return apps.counts(c.graph, apps.induced_by_pattern(c.graph, c.size, strategy(name)))


@app("induced_subgraphs_listing_sample_po")
def _induced_sample(c: Call, name: str) -> DataFrame:
    return _count(apps.induced_subgraphs(c.graph, c.size, c.sample(0)).df)


@app("induced_subgraphs_listing_sample_pa")
def _induced_sample_pa(c: Call, name: str) -> DataFrame:
    return apps.counts(c.graph, apps.induced_by_pattern(c.graph, c.size, "pa", c.sample(0)))


@app("motifs_po", "motifs_pa", "motifs_pa_mcvc")
def _motifs(c: Call, name: str) -> DataFrame:
    return apps.motifs(c.graph, c.size, strategy(name))


@app("motifs_sample_po", "motifs_sample_pa")
def _motifs_sample(c: Call, name: str) -> DataFrame:
    return apps.motifs(c.graph, c.size, strategy(name), sample=c.sample(0))


@app("cliques_custom_kclist", "cliques_po", "cliques_pa")
def _cliques(c: Call, name: str) -> DataFrame:
    return _count(apps.cliques(c.graph, c.size, "kclist" if name.endswith("kclist") else strategy(name)))


@app("maximal_cliques_po", "maximal_cliques_pa", "maximal_cliques_custom_quick")
def _maximal(c: Call, name: str) -> DataFrame:
    return _count(apps.maximal_cliques(c.graph, c.size, "custom" if "custom" in name else strategy(name)))


@app("quasi_cliques_po", "quasi_cliques_pa", "quasi_cliques_pa_po")
def _quasi(c: Call, name: str) -> DataFrame:
    return _count(apps.quasi_cliques(c.graph, c.size, float(c.args[0]), strategy(name)))


@app("query_specialization_po", "query_specialization_pa", "query_specialization_pa_po")
def _special(c: Call, name: str) -> DataFrame:
    return _count(apps.query_specialization(c.graph, c.pattern(), strategy(name)))


@app("fsm_po", "fsm_pa", "fsm_pa_mcvc", "fsm_pa_po")
def _fsm(c: Call, name: str) -> DataFrame:
    return fsm.frequent_subgraphs(c.graph, int(c.args[0]), c.size, strategy(name))


@app("pattern_querying_po")
def _query_po(c: Call, name: str) -> DataFrame:
    return _count(apps.query_by_edges(c.graph, c.pattern()).df)


@app("pattern_querying_pa_mcvc_old")
def _query_cover(c: Call, name: str) -> DataFrame:
    return _count(apps.query_from_cover(c.graph, c.pattern()).df)


@app("pattern_querying_pa", "pattern_querying_pa_mcvc", "pattern_querying_induced_pa", "pattern_querying_induced_pa_mcvc")
def _query(c: Call, name: str) -> DataFrame:
    return _count(apps.query(c.graph, c.pattern(induced="induced" in name), strategy(name)).df)


@app("pattern_querying_sample_pa", "pattern_querying_induced_sample_pa")
def _query_sample(c: Call, name: str) -> DataFrame:
    return _count(apps.query(c.graph, c.pattern(induced="induced" in name), "pa", c.sample(1)).df)


@app("periodic_subgraphs_induced_po", "periodic_subgraphs_induced_pa", "periodic_subgraphs_induced_pa_mcvc")
def _periodic(c: Call, name: str) -> DataFrame:
    return _count(apps.periodic_subgraphs(c.graph, c.size, int(c.args[0]), strategy(name)))


@app("label_search_po", "label_search_pa")
def _labels(c: Call, name: str) -> DataFrame:
    found = apps.label_search(c.graph, c.size, c.ints(0), strategy(name), c.flag(1) or strategy(name) == "pa")
    parts = found if isinstance(found, list) else [found]
    out = parts[0].df.select("v0")
    for f in parts[1:]:
        out = out.unionAll(f.df.select("v0"))
    return _count(out)


@app("keyword_search_po")
def _keywords(c: Call, name: str) -> DataFrame:
    return _count(apps.keyword_search(c.graph, c.size, c.ints(0), c.flag(1)).df)


@app("minimal_keyword_search_po", "minimal_keyword_search_pa")
def _minimal(c: Call, name: str) -> DataFrame:
    return _count(apps.minimal_keyword_search(c.graph, c.size, c.ints(0), strategy(name), c.flag(1)).df)


@app("pattern_query_generator")
def _pattern_queries(c: Call, name: str) -> DataFrame:
    found = apps.pattern_query_generator(c.graph, c.size, float(c.args[0]), int(c.args[1]), int(c.args[2]))
    if len(c.args) > 3:
        for kind, key in found.items():
            write_pattern(c.graph.spark, parse(key), f"{c.args[3]}/{kind}")
    return c.graph.spark.createDataFrame(sorted(found.items()), "kind string, pattern string")


@app("label_query_generator")
def _label_queries(c: Call, name: str) -> DataFrame:
    return apps.label_query_generator(c.graph, c.size, float(c.args[0]), int(c.args[1]), int(c.args[2]))


@app("canonical_pattern_generator_vertex")
def _canonical(c: Call, name: str) -> DataFrame:
    df = c.graph.spark.createDataFrame([(text_of(p),) for p in vertex_patterns(c.size)], "pattern string")
    if c.args:
        df.coalesce(1).write.text(c.args[0])
    return df


def _estimate(base: str, budget_at: int) -> App:
    """Subgraphs a millisecond of another app, within a budget of seconds."""

    def run(c: Call) -> DataFrame:
        def count(g: Graph) -> int:
            return APPS[base](Call(g, c.size, c.args, c.conf)).first().n

        rate = apps.throughput(c.graph, count, float(c.args[budget_at]))
        return c.graph.spark.createDataFrame([(rate,)], "throughput double")

    return run


for _base, _at in (
    ("query_specialization_po", 1), ("query_specialization_pa", 1), ("query_specialization_pa_po", 1), ("label_search_pa", 2), ("label_search_po", 2),
    ("minimal_keyword_search_po", 2), ("minimal_keyword_search_pa", 2),
):
    APPS[f"{_base}_estimate"] = _estimate(_base, _at)


def run(spark: SparkSession, labeling: str, path: str, name: str, steps: int, args: list[str], conf: dict[str, str] | None = None) -> DataFrame:
    if name not in APPS:
        raise SystemExit(f"no app {name}; there are: {' '.join(sorted(APPS))}")
    return APPS[name](Call(read_graph(spark, path, labeling), steps + 1, args, conf or {}))


def main(argv: list[str]) -> None:
    if len(argv) < 4:
        raise SystemExit(__doc__)
    labeling, path, name, steps, *rest = argv
    conf = dict(x.split(":", 1) for x in rest if ":" in x and "/" not in x)
    args = [x for x in rest if not (":" in x and "/" not in x)]
    spark = SparkSession.builder.appName(name).getOrCreate()
    began = time.monotonic()
    df = run(spark, labeling, path, name, int(steps), args, conf)
    df.show(100, truncate=False)
    ms = int(1000 * (time.monotonic() - began))
    total = df.agg(F.sum("n")).first()[0] if "n" in df.columns else df.count()
    print(f"numSubgraphs {total} elapsedMs {ms} throughput {(total or 0) / max(1, ms):.3f}")


if __name__ == "__main__":
    main(sys.argv[1:])
