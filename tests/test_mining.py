import random
from collections import Counter
from functools import reduce
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions.pattern import Pattern, from_mask, vertex_patterns
from lodestone.operators import apps, fsm
from lodestone.operators import graph as G
from lodestone.operators.frontier import Frontier
from lodestone.sources import text

CUBE = [(0, 1), (0, 3), (0, 4), (1, 2), (1, 5), (2, 3), (2, 7), (3, 6), (4, 5), (4, 6), (5, 7), (6, 7)]
CUBE_LABELS = [1, 1, 2, 2, 2, 2, 1, 3]
SQUARE = Pattern.of(4, [(0, 1), (0, 2), (1, 3), (2, 3)])


def make(spark, edges, labels, labeling="v", marks=None, **options):
    rows = [(u, v, (marks or {}).get((u, v), [])) for u, v in edges]
    return G.from_edges(spark.createDataFrame(rows, "u long, v long, labels array<int>"), spark.createDataFrame(list(enumerate(labels)), "id long, label int"), labeling, **options)


@pytest.fixture(scope="module")
def cube(spark):
    g = make(spark, CUBE, CUBE_LABELS)
    return g.kept()


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(11)
    edges = [(i, j) for j in range(12) for i in range(j) if rng.random() < 0.35]
    labels = [rng.randint(1, 3) for _ in range(12)]
    marks = {e: sorted(rng.sample(range(10), 4)) for e in edges}
    return make(spark, edges, labels, marks=marks).kept(), edges, labels, marks


def induced(edges, n, k):
    near = {frozenset(e) for e in edges}
    for vs in combinations(range(n), k):
        mask = sum(1 << (b * (b - 1) // 2 + a) for b in range(k) for a in range(b) if frozenset((vs[a], vs[b])) in near)
        p = from_mask(k, mask)
        if p.connected():
            yield vs, p


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_cube_goldens(cube):
    assert [apps.induced_subgraphs(cube, k).count() for k in (1, 2, 3)] == [8, 12, 24]
    assert [apps.cliques(cube, k).count() for k in (1, 2, 3)] == [8, 12, 0]
    assert [apps.cliques(cube, k, "po").count() for k in (2, 3)] == [12, 0]
    assert apps.query(cube, SQUARE).count() == 6
    assert apps.query(cube, Pattern.of(4, SQUARE.edges, (1, 1, 2, 2))).count() == 2
    assert apps.query_by_edges(cube, Pattern.of(4, SQUARE.edges, (1, 1, 2, 2))).count() == 2
    assert [fsm.frequent_subgraphs(cube, 2, m).count() for m in (1, 2, 3)] == [3, 7, 14]
    assert fsm.frequent_subgraphs(cube, 2, 3, "pa").count() == 14


def test_motifs_against_brute_force(noisy):
    g, edges, labels, _ = noisy
    for k in (3, 4):
        plain = Counter(p.key() for _, p in induced(edges, 12, k))
        named = Counter(Pattern.of(k, p.edges, [labels[v] for v in vs]).key() for vs, p in induced(edges, 12, k))
        for s in ("po", "pa", "mcvc"):
            assert as_dict(apps.motifs(g, k, s, labelled=False)) == plain
        assert as_dict(apps.motifs(g, k)) == named
    assert as_dict(apps.motifs(g, 3, "pa")) == Counter(Pattern.of(3, p.edges, [labels[v] for v in vs]).key() for vs, p in induced(edges, 12, 3))
    f = Frontier.vertices(g).extend(3)
    assert f.count_next().first().n == sum(1 for _ in induced(edges, 12, 4))


def test_edge_subgraphs_against_brute_force(noisy):
    g, edges, labels, _ = noisy
    want = Counter()
    for some in combinations(edges, 3):
        vs = sorted({v for e in some for v in e})
        p = Pattern.of(len(vs), [(vs.index(a), vs.index(b)) for a, b in some], [labels[v] for v in vs])
        if p.connected():
            want[p.key()] += 1
    assert as_dict(apps.edge_subgraphs(g, 3).by_pattern()) == want
    plain = Counter()
    for k, n in want.items():
        from lodestone.functions.pattern import parse

        plain[parse(k).unlabelled().key()] += n
    assert {k: n for k, n in as_dict(apps.counts(g, apps.edge_subgraphs_by_pattern(g, 3))).items() if n} == plain


def test_cliques_and_quasi_cliques(noisy):
    g, edges, _, _ = noisy
    near = {frozenset(e) for e in edges}
    full = lambda vs: all(frozenset(x) in near for x in combinations(vs, 2))
    for k in (3, 4):
        want = {vs for vs in combinations(range(12), k) if full(vs)}
        for s in ("kclist", "po", "pa"):
            assert {tuple(r) for r in apps.cliques(g, k, s).collect()} == want
        alone = {vs for vs in want if not any(full((*vs, x)) for x in range(12) if x not in vs)}
        for s in ("custom", "po", "pa"):
            assert {tuple(r) for r in apps.maximal_cliques(g, k, s).collect()} == alone
    want = {vs for vs, p in induced(edges, 12, 4) if all(len(x) >= 2 for x in p.adjacent())}
    for s in ("po", "pa", "papo"):
        assert {tuple(r) for r in apps.quasi_cliques(g, 4, 0.6, s).collect()} == want
    assert sum(r.triangles for r in G.triangle_count(g).collect()) == 3 * apps.cliques(g, 3).count()


def matches(p, edges, labels, n):
    """Classes of automorphic matches, by brute force: sets of edges."""
    near = {frozenset(e) for e in edges}
    out = set()

    def grow(image):
        i = len(image)
        if i == p.n:
            out.add((frozenset(frozenset((image[a], image[b])) for a, b, _ in p.edges), frozenset(image)))
            return
        for v in range(n):
            if v in image or p.labels is not None and labels[v] != p.labels[i]:
                continue
            ok = all((frozenset((v, image[j])) in near) if p.edge_label(j, i) is not None else (not p.induced or frozenset((v, image[j])) not in near) for j in range(i))
            if ok:
                grow([*image, v])

    grow([])
    return len(out)


def test_queries_against_brute_force(noisy):
    g, edges, labels, _ = noisy
    for p in (*vertex_patterns(4), Pattern.of(5, [(0, 1), (0, 2), (0, 3), (1, 2), (2, 4), (3, 4)])):
        for induced_ in (False, True):
            q = Pattern.of(p.n, p.edges, None, induced_)
            want = matches(q, edges, labels, 12)
            assert {apps.query(g, q, s).count() for s in ("pa", "mcvc", "naive")} == {want}
        if p.n == 4 and p.m < 6:
            assert apps.query_by_edges(g, p).count() == matches(p, edges, labels, 12)
    named = Pattern.of(4, SQUARE.edges, (1, 2, 1, 2))
    assert apps.query(g, named).count() == apps.query(g, named, "mcvc").count() == matches(named, edges, labels, 12)


def test_fsm_strategies_agree(noisy):
    g, _, _, _ = noisy
    rows = [{r.pattern: (r.support, r.n) for r in fsm.frequent_subgraphs(g, 2, 3, s).collect()} for s in ("po", "pa", "mcvc")]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    index = g.spark.createDataFrame([(v, v % 3) for v in range(12)], "vertex long, graph_id int")
    assert fsm.database_frequent(g, index, 0.5, 2).filter("ratio < 0.5").count() == 0


def test_periodic(noisy):
    g, edges, _, marks = noisy

    def holds(times):
        return any(b > a and 2 * b - a in times for a in times for b in times)

    want = set()
    for vs, p in induced(edges, 12, 3):
        times = reduce(lambda a, b: a & b, [set(marks[(vs[i], vs[j])]) for i, j, _ in p.edges])
        if holds(times):
            want.add(vs)
    for s in ("po", "pa", "mcvc"):
        assert {tuple(sorted((r.v0, r.v1, r.v2))) for r in apps.periodic_subgraphs(g, 3, 3, s).collect()} == want


def test_searches(noisy):
    g, edges, labels, _ = noisy
    some = {1, 2}
    want = sum(1 for vs, _ in induced(edges, 12, 3) if {labels[v] for v in vs} <= some)
    assert apps.label_search(g, 3, some).count() == apps.label_search(g, 3, some, filter_graph=False).count() == want
    assert sum(f.count() for f in apps.label_search(g, 3, some, "pa")) == want
    want = sum(1 for vs, p in induced(edges, 12, 4) if all(sum(labels[v] == w for v in vs) == 1 for w in some) and all(labels[v] in some or i in p.articulation() for i, v in enumerate(vs)))
    assert apps.minimal_keyword_search(g, 4, some).count() == want
    found = {r[0] for r in apps.keyword_search(g, 2, some).df.select(F.array_sort(F.array("e0", "e1"))).collect() for r in [(tuple(r[0]),)]}
    ids = {tuple(sorted(e)): i for i, e in enumerate(sorted(edges))}
    want = set()
    for (a, x), (b, y) in combinations(sorted((i, e) for e, i in ids.items()), 2):
        new = set(y) - set(x)
        if len(new) == 1:
            seen, last = {labels[v] for v in x} & some, {labels[v] for v in new} & some
            if seen and last and last - seen and seen - last and seen | last == some:
                want.add((a, b))
    assert found == want


def test_query_specialization(noisy):
    g, edges, labels, _ = noisy
    p = Pattern.of(3, [(0, 1), (1, 2)], (1, 2, 1))
    near = sorted(edges)
    want = set()
    for some in combinations(range(len(near)), 3):
        chosen = [near[i] for i in some]
        for left in combinations(chosen, 2):
            vs = sorted({v for e in left for v in e})
            if len(vs) != 3 or not {v for e in set(chosen) - set(left) for v in e} & set(vs):
                continue
            if Pattern.of(3, [(vs.index(a), vs.index(b)) for a, b in left], [labels[v] for v in vs]).key() == p.key():
                want.add(some)
    for s in ("papo", "pa", "po"):
        assert {tuple(r.edges) for r in apps.query_specialization(g, p, s).collect()} == want


def test_filters_and_switches(noisy):
    g, edges, labels, _ = noisy
    small = g.filter_vertices(lambda v, own: own[0] != 3)
    assert small.edges.count() == sum(labels[a] != 3 and labels[b] != 3 for a, b in edges)
    assert g.filter_edges(lambda u, lu, v, lv, e, le: lu[0] == lv[0]).edges.count() == sum(labels[a] == labels[b] for a, b in edges)
    degree = Counter(v for e in edges for v in e)
    assert g.filter_vertices_given_graph(lambda d: F.col("degree") >= 4).vertices.count() == sum(degree[v] >= 4 for v in range(12))
    assert g.filter_edges_given_graph(lambda d: F.size("nb_src") > F.size("nb_dst")).edges.count() == sum(degree[min(e)] > degree[max(e)] for e in edges)
    triangles = apps.query(g, Pattern.of(3, [(0, 1), (0, 2), (1, 2)]))
    assert triangles.to_vertices().count() == triangles.to_edges().count() == triangles.count()
    grown = triangles.to_vertices().extend(1)
    assert grown.count() >= 0
    f = Frontier.vertices(g).extend(1).filter(lambda x: x.label(x.k - 1) != 3).explore(2)
    assert f.count() == sum(1 for vs, _ in induced(edges, 12, 3) if all(labels[v] != 3 for v in vs))
    assert Frontier.vertices(g).extend(3, (1.0, 3)).count() == Frontier.vertices(g).extend(3).count()
    assert apps.random_walks(g, 3, 100).count() <= 12


def test_shuffled_adjacency_gives_the_same(noisy, spark):
    g, edges, labels, marks = noisy
    big = make(spark, edges, labels, marks=marks, broadcast_edges=1)
    assert as_dict(apps.motifs(big, 3)) == as_dict(apps.motifs(g, 3))


def test_text_round_trip_and_cli(spark, cube, tmp_path):
    path = f"{tmp_path}/cube"
    text.write_graph(cube, path)
    g = text.read_graph(spark, path, "v")
    assert g.num_vertices == 8 and g.num_edges == 12
    assert [tuple(r) for r in g.edges.orderBy("id").select("id", "src", "dst").collect()] == [(i, *e) for i, e in enumerate(CUBE)]
    assert [r.label for r in g.vertex_label.orderBy("v").collect()] == CUBE_LABELS
    text.write_single_file(cube, f"{tmp_path}/one")
    assert text.read_single_file(spark, f"{tmp_path}/one").edges.count() == 12
    (tmp_path / "list.txt").write_text("# edges\n" + "".join(f"{v * 10} {u * 10}\n" for u, v in CUBE))
    assert text.read_edge_list(spark, f"{tmp_path}/list.txt").edges.count() == 12
    assert G.by_degree(cube).edges.count() == 12
    assert cli.run(spark, "v", path, "fsm_po", 2, ["2"]).count() == 14
    assert cli.run(spark, "v", path, "cliques_custom_kclist", 1, []).first().n == 12
    assert cli.run(spark, "n", path, "motifs_pa", 2, []).agg(F.sum("n")).first()[0] == 24
    assert len(cli.APPS) == 55


def test_canonical_patterns_of_generators(noisy):
    g = noisy[0]
    found = apps.pattern_query_generator(g, 4, 1.0, 1, 3)
    assert set(found) == {f"{d}_dense_{f}_frequent" for d in ("least", "most") for f in ("least", "most")}
    places = {r.place for r in apps.label_query_generator(g, 3, 1.0, 1, 2).collect()}
    assert places == {"least", "middle", "most"}
