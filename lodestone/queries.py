"""Mining queries over graphs that are derived from the whole relational tables, and the SQL that gives the same rows.

Graphs: bought (parts in one order), dealt (parts in one order at one discount), trade (nations of customers and suppliers;
edge labels: months; label: region).  Parts are labelled by the first digit of their brand.  Every lineitem takes part; the
bought graph, whose vertices have some 120 neighbours, serves where subgraphs of two edges and triangles are counted, the
dealt one where larger subgraphs are listed.  A graph is made once for a session and a folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pattern import Pattern, dot, edge_patterns, parse, vertex_patterns
from .operators import apps, fsm
from .operators import graph as G
from .operators.context import Context
from .operators.frontier import Frontier, match
from .operators.graph import Graph, from_edges
from .operators.store import fresh_path
from .plans.order import heuristic
from .sources import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[tuple[str, str, str], Graph] = {}


def _once(make: Callable[[SparkSession, str], Graph]) -> Callable[[SparkSession, str], Graph]:
    """The graph of a folder, and the tables derived from it, are made once in a session."""

    def get(spark: SparkSession, sf_dir: str) -> Graph:
        key = (spark.sparkContext.applicationId, make.__name__, sf_dir)
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return get


def _parts(spark: SparkSession, sf_dir: str, *keys: str) -> Graph:
    items = table(spark, sf_dir, "lineitem").select(*keys, "l_partkey").repartition(*keys).distinct()  # one shuffle serves the join too
    pairs = items.withColumnRenamed("l_partkey", "u").join(items.withColumnRenamed("l_partkey", "v"), list(keys)).filter("u < v").select("u", "v")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 1).cast("int").alias("label"))
    return from_edges(pairs, parts, "v", packed=True)


@_once
def bought(spark: SparkSession, sf_dir: str) -> Graph:
    return _parts(spark, sf_dir, "l_orderkey")


@_once
def dealt(spark: SparkSession, sf_dir: str) -> Graph:
    return _parts(spark, sf_dir, "l_orderkey", "l_discount")


@_once
def trade(spark: SparkSession, sf_dir: str) -> Graph:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("ts"))
    df = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey <> s_nationkey")
    pairs = df.select(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v"), F.array("ts").alias("labels")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1).alias("label"))
    return from_edges(pairs, nations, "v", packed=True)


# the same graphs in SQL
B = "e AS (SELECT DISTINCT x.l_partkey AS u, y.l_partkey AS v FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_partkey < y.l_partkey)"
E = "e AS (SELECT DISTINCT x.l_partkey AS u, y.l_partkey AS v FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_discount = y.l_discount WHERE x.l_partkey < y.l_partkey)"
AD = "a AS (SELECT u, v FROM e UNION ALL SELECT v AS u, u AS v FROM e), d AS (SELECT u, count(*) AS d FROM a GROUP BY u)"
BA, A = f"{B}, {AD}", f"{E}, {AD}"
L = "l AS (SELECT p_partkey AS v, CAST(substr(p_brand, 7, 1) AS INTEGER) AS label FROM part)"
T = "t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v)"
NT = """m AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS ts
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey),
 e AS (SELECT DISTINCT u, v FROM m)"""


def four(edges: str) -> str:
    """Numbers of the six 4-vertex graphs as induced subgraphs (k4, diamond, c4, paw, star, path), from counts of non-induced ones (all_*)."""
    return f"""{edges}, {AD}, {T}, te AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY u, v),
 pc AS (SELECT x.v AS p, y.v AS q, count(*) AS n FROM a x JOIN a y ON x.u = y.u AND x.v < y.v GROUP BY 1, 2),
 raw AS (SELECT (SELECT coalesce(sum(d * (d - 1) * (d - 2) / 6), 0) FROM d) AS s,
  (SELECT coalesce(sum((x.d - 1) * (y.d - 1)), 0) FROM e JOIN d x ON x.u = e.u JOIN d y ON y.u = e.v) - 3 * (SELECT count(*) FROM t) AS p,
  (SELECT coalesce(sum(x.d + y.d + z.d - 6), 0) FROM t JOIN d x ON x.u = a JOIN d y ON y.u = b JOIN d z ON z.u = c) AS w,
  (SELECT coalesce(sum(n * (n - 1) / 2), 0) FROM te) AS dm, (SELECT coalesce(sum(n * (n - 1) / 2), 0) / 2 FROM pc) AS cy,
  (SELECT count(*) FROM t JOIN e x ON x.u = t.a JOIN e y ON y.u = t.b AND y.v = x.v JOIN e z ON z.u = t.c AND z.v = x.v) AS k),
 i1 AS (SELECT *, dm - 6 * k AS di FROM raw), i2 AS (SELECT *, cy - di - 3 * k AS c4, w - 4 * di - 12 * k AS paw FROM i1),
 f AS (SELECT CAST(k AS BIGINT) AS k4, CAST(di AS BIGINT) AS diamond, CAST(c4 AS BIGINT) AS c4, CAST(paw AS BIGINT) AS paw, CAST(s - paw - 2 * di - 4 * k AS BIGINT) AS star, CAST(p - 4 * c4 - 2 * paw - 6 * di - 12 * k AS BIGINT) AS path,
  CAST(s AS BIGINT) AS all_star, CAST(p AS BIGINT) AS all_path, CAST(w AS BIGINT) AS all_paw, CAST(dm AS BIGINT) AS all_diamond, CAST(cy AS BIGINT) AS all_c4, CAST(k AS BIGINT) AS all_k4 FROM i2)"""


FOUR = four(E)


def rolled(words: str, seed: int) -> str:
    """operators.frontier.roll in SQL."""
    return f"CAST(concat('0x', substr(md5(concat({words}, ',{seed}')), 1, 8)) AS BIGINT) / 4294967296.0"


#: Connected sets of three vertices in the order of enumeration; j: whether the last two are joined.
TRIPLES = """p2 AS (SELECT u AS v0, v AS v1 FROM e), p3 AS (SELECT p.v0, p.v1, x.v AS v2, EXISTS (SELECT 1 FROM a y WHERE y.u = p.v1 AND y.v = x.v) AS j FROM p2 p JOIN a x ON x.u = p.v0 WHERE x.v > p.v1
 UNION ALL SELECT p.v0, p.v1, x.v, false FROM p2 p JOIN a x ON x.u = p.v1 WHERE x.v > p.v0 AND NOT EXISTS (SELECT 1 FROM a y WHERE y.u = p.v0 AND y.v = x.v))"""

WEDGE, TRIANGLE = Pattern.of(3, [(0, 1), (0, 2)]), Pattern.of(3, [(0, 1), (0, 2), (1, 2)])
SHAPES = {
    "k4": Pattern.of(4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]),
    "diamond": Pattern.of(4, [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]),
    "c4": Pattern.of(4, [(0, 1), (0, 2), (1, 3), (2, 3)]),
    "paw": Pattern.of(4, [(0, 1), (0, 2), (1, 2), (0, 3)]),
    "star": Pattern.of(4, [(0, 1), (0, 2), (0, 3)]),
    "path": Pattern.of(4, [(0, 1), (1, 2), (2, 3)]),
}
HOUSE = Pattern.of(5, [(0, 1), (0, 2), (0, 3), (1, 2), (2, 4), (3, 4)])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


@register(f"WITH {L} SELECT label, count(*) AS n FROM l GROUP BY label")
def vertex_label_frequency(spark, sf):
    return bought(spark, sf).label_frequencies()


@register(f"WITH {BA} SELECT u AS v, CAST(d AS BIGINT) AS degree FROM d ORDER BY d DESC, u LIMIT 20")
def degree_topk(spark, sf):
    return bought(spark, sf).degrees.select("v", "degree").orderBy(F.desc("degree"), "v").limit(20)


@register(f"WITH {B}, {L} SELECT least(x.label, y.label) AS low, greatest(x.label, y.label) AS high, count(*) AS n FROM e JOIN l x ON x.v = e.u JOIN l y ON y.v = e.v GROUP BY 1, 2")
def edge_count_by_label_pair(spark, sf):
    f = Frontier.edges(bought(spark, sf)).extend(1)
    return f.by_key({"low": F.least("la0", "lb0"), "high": F.greatest("la0", "lb0")})


@register(f"WITH {B} SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS BIGINT) AS id, u AS src, v AS dst FROM e")
def edge_ids(spark, sf):
    g = bought(spark, sf)
    return from_edges(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).edges.select("id", "src", "dst")


@register(f"WITH {BA} SELECT u AS old, CAST(row_number() OVER (ORDER BY d DESC, u) - 1 AS BIGINT) AS new FROM d")
def degree_order(spark, sf):
    g = bought(spark, sf)
    some = g.degrees.filter("degree > 0").withColumn("low", -F.col("degree"))
    return G.ranked(some, "low", "v").select(F.col("v").alias("old"), F.col("__rank").alias("new"))


@register(f"WITH {B}, {T} SELECT v, count(*) AS triangles FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v")
def vertex_triangles(spark, sf):
    return G.triangle_count(bought(spark, sf))


@register(f"WITH {A}, {T}, n AS (SELECT (SELECT count(*) FROM t) AS tri, (SELECT sum(d * (d - 1) / 2) FROM d) AS w) SELECT '{TRIANGLE.key()}' AS pattern, CAST(tri AS BIGINT) AS n FROM n UNION ALL SELECT '{WEDGE.key()}', CAST(w - 3 * tri AS BIGINT) FROM n")
def motif3(spark, sf):
    return apps.motifs(dealt(spark, sf), 3, labelled=False)


@register(ORACLES["motif3"])
def motif3_by_pattern(spark, sf):
    return apps.motifs(dealt(spark, sf), 3, "pa", labelled=False)


_ALL4 = " UNION ALL ".join(f"SELECT '{p.key()}' AS pattern, {k} AS n FROM f" for k, p in SHAPES.items())


@register(f"WITH {FOUR} SELECT * FROM ({_ALL4}) WHERE n > 0")
def motif4(spark, sf):
    return apps.motifs(dealt(spark, sf), 4, labelled=False)


@register(f"WITH {FOUR} SELECT * FROM ({_ALL4}) WHERE n > 0")
def motif4_by_cover(spark, sf):
    return apps.motifs(dealt(spark, sf), 4, "mcvc", labelled=False)


def _shape_labels(df: DataFrame) -> DataFrame:
    part = F.split("pattern", ";")
    edges = F.size(F.split(part[2], ",")).cast("long")
    return df.select(edges.alias("edges"), F.array_join(F.array_sort(F.split(part[1], ",")), ",").alias("labels"), "n").groupBy("edges", "labels").agg(F.sum("n").alias("n"))


@register(
    f"""WITH {A}, {L}, {T}, w AS (SELECT x.v AS a, x.u AS b, y.v AS c FROM a x JOIN a y ON x.u = y.u AND x.v < y.v LEFT JOIN e ON e.u = x.v AND e.v = y.v WHERE e.u IS NULL),
 s AS (SELECT 2 AS edges, a, b, c FROM w UNION ALL SELECT 3, a, b, c FROM t)
 SELECT CAST(edges AS BIGINT) AS edges, array_to_string(list_sort([CAST(x.label AS VARCHAR), CAST(y.label AS VARCHAR), CAST(z.label AS VARCHAR)]), ',') AS labels, count(*) AS n
 FROM s JOIN l x ON x.v = a JOIN l y ON y.v = b JOIN l z ON z.v = c GROUP BY 1, 2"""
)
def motif3_labelled(spark, sf):
    return _shape_labels(apps.motifs(dealt(spark, sf), 3, labelled=True))


@register(f"WITH {FOUR} SELECT c4 + diamond + 3 * k4 AS n FROM f")
def square_query(spark, sf):
    return _n(apps.query(dealt(spark, sf), SHAPES["c4"]).df)


@register(f"WITH {FOUR} SELECT diamond + 6 * k4 AS n FROM f")
def chordal_square_query(spark, sf):
    return _n(apps.query(dealt(spark, sf), SHAPES["diamond"], "mcvc").df)


@register(f"WITH {FOUR} SELECT c4 AS n FROM f")
def induced_square_query(spark, sf):
    p = SHAPES["c4"]
    return _n(apps.query(dealt(spark, sf), Pattern.of(p.n, p.edges, None, induced=True)).df)


@register(
    f"""WITH {A} SELECT count(*) AS n FROM e r JOIN a s ON s.u = r.u JOIN a o ON o.u = r.v AND o.v = s.v
 JOIN a p ON p.u = r.u AND p.v <> r.v AND p.v <> s.v JOIN a q ON q.u = p.v AND q.v <> r.u AND q.v <> s.v AND q.v <> r.v JOIN a z ON z.u = r.v AND z.v = q.v"""
)
def house_query(spark, sf):
    return _n(apps.query(dealt(spark, sf), HOUSE).df)


@register(f"WITH {A}, {L} SELECT count(*) AS n FROM a x JOIN a y ON x.u = y.u AND x.v <> y.v JOIN l b ON b.v = x.u JOIN l a1 ON a1.v = x.v JOIN l c ON c.v = y.v WHERE a1.label = 1 AND b.label = 2 AND c.label = 3")
def labelled_path_query(spark, sf):
    return _n(apps.query(dealt(spark, sf), Pattern.of(3, [(0, 1), (1, 2)], (1, 2, 3))).df)


@register(f"WITH {FOUR} SELECT '{SHAPES['star'].key()}' AS pattern, all_star AS n FROM f UNION ALL SELECT '{SHAPES['path'].key()}', all_path FROM f UNION ALL SELECT '{TRIANGLE.key()}', (SELECT count(*) FROM t) FROM f")
def edge_subgraphs3(spark, sf):
    return apps.edge_subgraphs(dealt(spark, sf), 3).by_pattern(False)


@register(f"WITH {E}, {T} SELECT a AS v0, b AS v1, c AS v2 FROM t")
def clique3(spark, sf):
    return apps.cliques(dealt(spark, sf), 3)


_C4 = f"WITH {E}, {T} SELECT t.a AS v0, t.b AS v1, t.c AS v2, x.v AS v3 FROM t JOIN e x ON x.u = t.a JOIN e y ON y.u = t.b AND y.v = x.v JOIN e z ON z.u = t.c AND z.v = x.v AND x.v > t.c"


@register(_C4)
def clique4(spark, sf):
    return apps.cliques(dealt(spark, sf), 4)


@register(_C4)
def clique4_by_pattern(spark, sf):
    return apps.cliques(dealt(spark, sf), 4, "pa")


@register(_C4)
def clique4_by_vertices(spark, sf):
    return apps.cliques(dealt(spark, sf), 4, "po")


@register(
    f"WITH {NT}, {T} SELECT count(*) AS n FROM t JOIN e x ON x.u = t.c JOIN e p ON p.u = t.a AND p.v = x.v JOIN e q ON q.u = t.b AND q.v = x.v"
    " JOIN e y ON y.u = x.v JOIN e r ON r.u = t.a AND r.v = y.v JOIN e s ON s.u = t.b AND s.v = y.v JOIN e w ON w.u = t.c AND w.v = y.v"
)
def clique5(spark, sf):
    return _n(apps.cliques(trade(spark, sf), 5))


@register(f"WITH {A}, {T} SELECT t.a AS v0, t.b AS v1, t.c AS v2 FROM t WHERE NOT EXISTS (SELECT 1 FROM a x JOIN a y ON y.u = x.u JOIN a z ON z.u = x.u WHERE x.v = t.a AND y.v = t.b AND z.v = t.c)")
def maximal_clique3(spark, sf):
    return apps.maximal_cliques(dealt(spark, sf), 3)


@register(f"WITH {FOUR} SELECT c4 + diamond + k4 AS n FROM f")
def quasi_clique4(spark, sf):
    return _n(apps.quasi_cliques(dealt(spark, sf), 4, 0.6))


@register(f"WITH {FOUR} SELECT c4 + diamond + k4 AS n FROM f")
def quasi_clique4_by_pattern(spark, sf):
    return _n(apps.quasi_cliques(dealt(spark, sf), 4, 0.6, "papo"))


_ONE, _ONEB = (f"""{edges}, {L}, x AS (SELECT a.u, a.v, p.label AS lu, q.label AS lv FROM a JOIN l p ON p.v = a.u JOIN l q ON q.v = a.v),
 s1 AS (SELECT least(lu, lv) AS p, greatest(lu, lv) AS q, lu AS own, count(DISTINCT u) AS n FROM x GROUP BY 1, 2, 3),
 one AS (SELECT p, q, min(n) AS support FROM s1 GROUP BY 1, 2)""" for edges in (A, BA))


@register(f"WITH {_ONEB} SELECT concat(p, ',', q) AS labels, CAST(support AS BIGINT) AS support FROM one WHERE support >= 60")
def fsm_1edge(spark, sf):
    found = fsm.frequent_subgraphs(bought(spark, sf), 60, 1)
    return found.select(F.array_join(F.array_sort(F.split(F.split("pattern", ";")[1], ",")), ",").alias("labels"), "support")


_TWO = f"""WITH {_ONE}, w AS (SELECT x.u AS c, x.lu AS lc, CASE WHEN x.lv <= y.lv THEN x.v ELSE y.v END AS s, CASE WHEN x.lv <= y.lv THEN y.v ELSE x.v END AS t, least(x.lv, y.lv) AS ls, greatest(x.lv, y.lv) AS lt
  FROM x JOIN x y ON x.u = y.u AND x.v < y.v
  JOIN one o ON o.p = least(x.lu, x.lv) AND o.q = greatest(x.lu, x.lv) AND o.support >= 150 JOIN one r ON r.p = least(y.lu, y.lv) AND r.q = greatest(y.lu, y.lv) AND r.support >= 150),
 ends AS (SELECT lc, ls, lt, count(DISTINCT c) AS nc, count(DISTINCT s) AS ns, count(DISTINCT t) AS nt FROM w GROUP BY 1, 2, 3),
 same AS (SELECT lc, ls, count(DISTINCT v) AS n FROM (SELECT lc, ls, s AS v FROM w WHERE ls = lt UNION ALL SELECT lc, ls, t FROM w WHERE ls = lt) GROUP BY 1, 2)
 SELECT ends.lc AS center, ends.ls AS low, ends.lt AS high, CAST(CASE WHEN ends.ls = ends.lt THEN least(nc, same.n) ELSE least(nc, ns, nt) END AS BIGINT) AS support FROM ends LEFT JOIN same ON same.lc = ends.lc AND same.ls = ends.ls AND ends.ls = ends.lt
 WHERE CASE WHEN ends.ls = ends.lt THEN least(nc, same.n) ELSE least(nc, ns, nt) END >= 150"""


def _wedge_rows(found: DataFrame) -> DataFrame:
    """Two-edge patterns as center, low, high, support: the center is the vertex in both edges."""
    part = F.split("pattern", ";")
    labels, ends = F.split(part[1], ","), F.split(part[2], r"[,-]")
    two = found.filter(F.size(F.split(part[2], ",")) == 2).select(labels.alias("l"), ends.alias("e"), "support")
    center = F.when((F.col("e")[0] == F.col("e")[2]) | (F.col("e")[0] == F.col("e")[3]), F.col("e")[0]).otherwise(F.col("e")[1]).cast("int")
    two = two.withColumn("c", center)
    outer = F.array_sort(F.filter(F.transform("l", lambda x, i: F.when(i != F.col("c"), x.cast("int"))), lambda x: x.isNotNull()))
    return two.select(F.get("l", F.col("c")).cast("int").alias("center"), outer[0].alias("low"), outer[1].alias("high"), "support")


@register(_TWO)
def fsm_2edge(spark, sf):
    return _wedge_rows(fsm.frequent_subgraphs(dealt(spark, sf), 150, 2))


@register(_TWO)
def fsm_2edge_by_pattern(spark, sf):
    return _wedge_rows(fsm.frequent_subgraphs(dealt(spark, sf), 150, 2, "pa"))


@register(
    f"""WITH {E}, {L}, x AS (SELECT DISTINCT least(p.label, q.label) AS lo, greatest(p.label, q.label) AS hi, r.p_size AS graph_id FROM e JOIN l p ON p.v = e.u JOIN l q ON q.v = e.v
  JOIN part r ON r.p_partkey = e.u JOIN part s ON s.p_partkey = e.v WHERE r.p_size = s.p_size)
 SELECT concat(lo, ',', hi) AS labels, count(*) AS graphs FROM x GROUP BY 1 HAVING count(*) >= 0.06 * (SELECT count(DISTINCT p_size) FROM part)"""
)
def database_fsm(spark, sf):
    g = dealt(spark, sf)
    index = table(spark, sf, "part").select(F.col("p_partkey").alias("vertex"), F.col("p_size").alias("graph_id"))
    same = g.edges.join(index.select(F.col("vertex").alias("src"), F.col("graph_id").alias("a")), "src").join(index.select(F.col("vertex").alias("dst"), F.col("graph_id").alias("b")), "dst").filter("a = b")
    found = fsm.database_frequent(Graph(g.vertices, same.select("id", "src", "dst", "labels"), "v"), index, 0.06, 1)
    return found.select(F.array_join(F.array_sort(F.split(F.split("pattern", ";")[1], ",")), ",").alias("labels"), "graphs")


_TWO_LABELS = f"""WITH {A}, {L}, ee AS (SELECT e.u, e.v FROM e JOIN l p ON p.v = e.u JOIN l q ON q.v = e.v WHERE p.label IN (1, 2) AND q.label IN (1, 2)),
 aa AS (SELECT u, v FROM ee UNION ALL SELECT v, u FROM ee), tt AS (SELECT count(*) AS n FROM ee x JOIN ee y ON x.v = y.u JOIN ee z ON z.u = x.u AND z.v = y.v),
 ww AS (SELECT coalesce(sum(d * (d - 1) / 2), 0) AS n FROM (SELECT count(*) AS d FROM aa GROUP BY u)) SELECT CAST(ww.n - 2 * tt.n AS BIGINT) AS n FROM ww, tt"""


@register(_TWO_LABELS)
def label_search3(spark, sf):
    return _n(apps.label_search(dealt(spark, sf), 3, [1, 2], filter_graph=False).df)


@register(_TWO_LABELS)
def filter_vertices_then_induced3(spark, sf):
    g = dealt(spark, sf).filter_vertices(lambda v, labels: labels[0].isin(1, 2))
    return _n(apps.induced_subgraphs(g, 3).df)


@register(f"WITH {B}, {L} SELECT count(*) AS n FROM e JOIN l p ON p.v = e.u JOIN l q ON q.v = e.v WHERE p.label <> q.label")
def filter_edges_then_count(spark, sf):
    return _n(bought(spark, sf).filter_edges(lambda u, lu, v, lv, e, le: lu[0] != lv[0]).edges)


@register(f"WITH {BA} SELECT count(*) AS n FROM e JOIN d x ON x.u = e.u JOIN d y ON y.u = e.v WHERE x.d >= 5 AND y.d >= 5")
def filter_by_degree_then_count(spark, sf):
    return _n(bought(spark, sf).filter_vertices_given_graph(lambda g: F.col("degree") >= 5).edges)


@register(
    f"""WITH {A}, {L} SELECT count(*) AS n FROM a x JOIN a y ON y.u = x.u AND y.v <> x.v JOIN l c ON c.v = x.u JOIN l p ON p.v = x.v JOIN l q ON q.v = y.v
 WHERE p.label = 1 AND q.label = 2 AND c.label NOT IN (1, 2) AND NOT EXISTS (SELECT 1 FROM a z WHERE z.u = x.v AND z.v = y.v)"""
)
def minimal_keyword_search3(spark, sf):
    return _n(apps.minimal_keyword_search(dealt(spark, sf), 3, [1, 2]).df)


@register(
    f"""WITH {E}, {L}, x AS (SELECT row_number() OVER (ORDER BY e.u, e.v) AS id, e.u, e.v, p.label AS lu, q.label AS lv FROM e JOIN l p ON p.v = e.u JOIN l q ON q.v = e.v),
 y AS (SELECT f.*, CASE WHEN s.u IN (f.u, f.v) THEN s.lv ELSE s.lu END AS new FROM x f JOIN x s ON s.id > f.id AND (s.u IN (f.u, f.v) OR s.v IN (f.u, f.v)))
 SELECT count(*) AS n FROM y WHERE (new = 2 AND (lu = 1 OR lv = 1) AND lu <> 2 AND lv <> 2) OR (new = 1 AND (lu = 2 OR lv = 2) AND lu <> 1 AND lv <> 1)"""
)
def keyword_search2(spark, sf):
    return _n(apps.keyword_search(dealt(spark, sf), 2, [1, 2]).df)


@register(f"WITH {NT} SELECT DISTINCT m.u AS v0, m.v AS v1 FROM m JOIN m b ON b.u = m.u AND b.v = m.v AND b.ts > m.ts JOIN m c ON c.u = m.u AND c.v = m.v AND c.ts = 2 * b.ts - m.ts")
def periodic_edge(spark, sf):
    return apps.periodic_subgraphs(trade(spark, sf), 2, 3).select(F.least("v0", "v1").alias("v0"), F.greatest("v0", "v1").alias("v1")).select(F.col("v0").cast("int").alias("v0"), F.col("v1").cast("int").alias("v1"))


_PT = f"""WITH {NT}, {T}, ts AS (SELECT t.a, t.b, t.c, x.ts FROM t JOIN m x ON x.u = t.a AND x.v = t.b JOIN m y ON y.u = t.a AND y.v = t.c AND y.ts = x.ts JOIN m z ON z.u = t.b AND z.v = t.c AND z.ts = x.ts)
 SELECT count(*) AS n FROM (SELECT DISTINCT p.a, p.b, p.c FROM ts p JOIN ts q ON q.a = p.a AND q.b = p.b AND q.c = p.c AND q.ts > p.ts JOIN ts r ON r.a = p.a AND r.b = p.b AND r.c = p.c AND r.ts = 2 * q.ts - p.ts)"""


def _periodic_triangles(g: Graph, strategy: str) -> DataFrame:
    found = apps.periodic_subgraphs(g, 3, 3, strategy)
    sides = g.edges.select("src", "dst")
    s = F.array_sort(F.array("v0", "v1", "v2"))
    tri = found.select(s.alias("s")).select(*[F.col("s")[i].alias(f"v{i}") for i in range(3)])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        tri = tri.join(g.sized(sides.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{j}"))), [f"v{i}", f"v{j}"])
    return _n(tri)


@register(_PT)
def periodic_triangle(spark, sf):
    return _periodic_triangles(trade(spark, sf), "po")


@register(_PT)
def periodic_triangle_by_pattern(spark, sf):
    return _periodic_triangles(trade(spark, sf), "pa")


_QS = f"""WITH {A}, {L}, {T} SELECT CAST(coalesce(sum(x.d + y.d + z.d - 6), 0) AS BIGINT) AS n FROM t JOIN d x ON x.u = a JOIN d y ON y.u = b JOIN d z ON z.u = c JOIN l p ON p.v = a JOIN l q ON q.v = b JOIN l r ON r.v = c
 WHERE list_sort([p.label, q.label, r.label]) = [1, 2, 3]"""
_123 = Pattern.of(3, TRIANGLE.edges, (1, 2, 3))


@register(_QS)
def query_specialization3(spark, sf):
    return _n(apps.query_specialization(dealt(spark, sf), _123))


@register(_QS)
def query_specialization3_by_pattern(spark, sf):
    return _n(apps.query_specialization(dealt(spark, sf), _123, "pa"))


@register(f"WITH {BA} SELECT CAST(sum(d * (d - 1) / 2) AS BIGINT) AS total, CAST(max(u) AS BIGINT) AS last FROM d WHERE d > 1")
def aggregate_wedges(spark, sf):
    f = apps.query(bought(spark, sf), Pattern.of(3, [(0, 1), (0, 2)]))
    return f.df.agg(F.sum(F.lit(1)).alias("total"), F.max(f"v{f.plan.order.index(0)}").alias("last"))


@register(f"WITH {BA}, {L} SELECT label, CAST(sum(d * (d - 1) / 2) AS BIGINT) AS n FROM d JOIN l ON l.v = d.u WHERE d > 1 GROUP BY label")
def wedges_by_center_label(spark, sf):
    g = bought(spark, sf)
    f = apps.query(g, Pattern.of(3, [(0, 1), (0, 2)]))
    center = f"v{f.plan.order.index(0)}"
    each = f.df.groupBy(F.col(center).alias("v")).agg(F.count("*").alias("own"))  # before the join, which has a row for each vertex then
    return each.join(g.sized(g.vertex_label), "v").groupBy("label").agg(F.sum("own").alias("n"))


@register(f"WITH {E}, {T} SELECT count(*) AS n FROM t")
def pattern_to_vertex_switch(spark, sf):
    f = apps.query(dealt(spark, sf), TRIANGLE).to_vertices()
    return _n(f.filter(lambda g: g.complete()).df)


@register(f"WITH {E}, {T} SELECT count(*) AS n FROM t")
def pattern_to_edge_switch(spark, sf):
    return _n(apps.query(dealt(spark, sf), TRIANGLE).to_edges().df)


@register("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 6), (5, 21), (6, 112)) AS t(k, n)")
def canonical_patterns(spark, sf):
    return spark.createDataFrame([(k, len(vertex_patterns(k))) for k in range(1, 7)], "k int, n int")


# samples and generators: chance depends on words and a seed alone, so SQL draws the same


@register(
    f"""WITH {A}, {TRIPLES}, s2 AS (SELECT * FROM p2 WHERE {rolled("concat(v0, ',', v1)", 7)} <= sqrt(0.5)), s3 AS (SELECT p3.* FROM p3 JOIN s2 ON s2.v0 = p3.v0 AND s2.v1 = p3.v1 WHERE {rolled("concat(p3.v0, ',', p3.v1, ',', p3.v2)", 7)} <= sqrt(0.5))
 SELECT CASE WHEN j THEN '{TRIANGLE.key()}' ELSE '{WEDGE.key()}' END AS pattern, count(*) AS n FROM (SELECT v0, v1, v2, j AND EXISTS (SELECT 1 FROM a y WHERE y.u = s3.v0 AND y.v = s3.v2) AS j FROM s3) GROUP BY 1"""
)
def motif3_sampled(spark, sf):
    return apps.motifs(dealt(spark, sf), 3, labelled=False, sample=(0.5, 7))


@register(f"WITH {A}, {T} SELECT count(*) AS n FROM t WHERE {rolled("concat(a, ',', b)", 5)} <= sqrt(0.3) AND {rolled("concat(a, ',', b, ',', c)", 5)} <= sqrt(0.3)")
def triangle_query_sampled(spark, sf):
    return _n(apps.query(dealt(spark, sf), TRIANGLE, "naive", (0.3, 5)).df)


@register(
    f"""WITH {A}, s AS (SELECT p_partkey AS v0 FROM part WHERE {rolled("p_partkey", 3)} < least(1.0, 200.0 / (SELECT count(*) FROM part))), w AS (SELECT v0, min(v) AS v1 FROM s JOIN a ON a.u = v0 WHERE v > v0 GROUP BY v0),
 c AS (SELECT w.*, v AS x, true AS near FROM w JOIN a ON a.u = v0 WHERE v > v1 UNION ALL SELECT w.*, a.v, false FROM w JOIN a ON a.u = v1 WHERE a.v > v0 AND NOT EXISTS (SELECT 1 FROM a y WHERE y.u = w.v0 AND y.v = a.v)),
 g AS (SELECT v0, v1, min(x) AS x, arg_min(near, x) AS near FROM c GROUP BY v0, v1)
 SELECT CASE WHEN near AND EXISTS (SELECT 1 FROM a y WHERE y.u = g.v1 AND y.v = g.x) THEN '{TRIANGLE.key()}' ELSE '{WEDGE.key()}' END AS pattern, count(*) AS n FROM g GROUP BY 1"""
)
def random_walk_patterns(spark, sf):
    return apps.random_walks(dealt(spark, sf), 3, 200, 3).by_pattern(False)


_SETS = f"""WITH {A}, {L}, {TRIPLES}, s2 AS (SELECT * FROM p2 WHERE {rolled("concat(v0, ',', v1)", 5)} <= sqrt(0.5)), s3 AS (SELECT p3.* FROM p3 JOIN s2 ON s2.v0 = p3.v0 AND s2.v1 = p3.v1 WHERE {rolled("concat(p3.v0, ',', p3.v1, ',', p3.v2)", 5)} <= sqrt(0.5)),
 w AS MATERIALIZED (SELECT list_sort([x.label, y.label, z.label]) AS s FROM s3 JOIN l x ON x.v = v0 JOIN l y ON y.v = v1 JOIN l z ON z.v = v2), c AS MATERIALIZED (SELECT s, count(*) AS n FROM w WHERE len(list_distinct(s)) = 3 GROUP BY s),
 q AS (SELECT quantile_disc(n, 0.5) AS mid FROM c)
 SELECT concat(s[1], ',', s[2], ',', s[3]) AS labels, n, place FROM ((SELECT s, n, 'least' AS place FROM c ORDER BY n, s LIMIT 5) UNION ALL (SELECT s, n, 'most' FROM c ORDER BY n DESC, s LIMIT 5) UNION ALL (SELECT s, n, 'middle' FROM c ORDER BY abs(n - (SELECT mid FROM q)), s LIMIT 5))"""


@register(_SETS)
def label_query_generator(spark, sf):
    return apps.label_query_generator(dealt(spark, sf), 3, 0.5, 5, 5).withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@register("SELECT * FROM (VALUES ('least_dense_least_frequent', 2), ('least_dense_most_frequent', 2), ('most_dense_least_frequent', 3), ('most_dense_most_frequent', 3)) AS t(kind, edges)")
def pattern_query_generator(spark, sf):
    found = apps.pattern_query_generator(dealt(spark, sf), 3, 1.0, 1, 3)
    return spark.createDataFrame([(kind, parse(key).m) for kind, key in sorted(found.items())], "kind string, edges int")


@register("SELECT true AS positive")
def throughput_of_induced3(spark, sf):
    rate = apps.throughput(dealt(spark, sf), lambda g: apps.induced_subgraphs(g, 3).count(), 5.0, share=0.5)
    return spark.createDataFrame([(rate > 0,)], "positive boolean")


# enumerators


@register(f"WITH {A} SELECT count(*) AS n FROM e x JOIN e y ON x.v = y.u")
def rising_paths(spark, sf):
    f = Frontier.vertices(dealt(spark, sf)).extend(1)
    return _n(f.extend(2, using=lambda g: F.filter(f"n{g.k - 1}", lambda x: x > F.col(f"v{g.k - 1}"))).df)


@register(f"WITH {A}, {T} SELECT CAST((SELECT sum(x.d + y.d - 2) FROM e JOIN d x ON x.u = e.u JOIN d y ON y.u = e.v) - 3 * (SELECT count(*) FROM t) AS BIGINT) AS n")
def neighbourhood_of_edges(spark, sf):
    return _n(Frontier.vertices(dealt(spark, sf)).extend(2).extend_all().df)


@register(f"WITH o AS (SELECT * FROM part), {E}0, e AS (SELECT * FROM e0 WHERE u >= 100), {AD}, {T} SELECT CAST((SELECT coalesce(sum(d * (d - 1) / 2), 0) FROM d) - 2 * (SELECT count(*) FROM t) AS BIGINT) AS n".replace("e AS (SELECT DISTINCT", "e0 AS (SELECT DISTINCT", 1).replace(")0, e AS", "), e AS", 1))
def around_word3(spark, sf):
    return _n(apps.around_word(dealt(spark, sf), 3, 100).df)


EVEN = E.replace("WHERE", "WHERE x.l_partkey % 2 = 0 AND y.l_partkey % 2 = 0 AND")


@register(f"WITH {four(EVEN)} SELECT all_c4 AS n FROM f")
def even_squares_from_cover(spark, sf):
    return _n(apps.query_from_cover(dealt(spark, sf), SHAPES["c4"], lambda f: f.word(f.k - 1) % 2 == 0).df)


@register(f"WITH {FOUR} SELECT '{SHAPES['k4'].key()}' AS pattern, all_k4 AS n FROM f " + " ".join(f"UNION ALL SELECT '{SHAPES[k].key()}', all_{k} FROM f" for k in ("diamond", "c4", "paw", "star", "path")))
def subgraphs_by_pattern4(spark, sf):
    return apps.counts(dealt(spark, sf), apps.subgraphs_by_pattern(dealt(spark, sf), 4))


# the same by joins alone, as on a graph with hubs


def by_joins(g: Graph) -> Graph:
    return replace(g, list_degree=0)


@register(ORACLES["motif3"])
def motif3_by_joins(spark, sf):
    return apps.motifs(by_joins(dealt(spark, sf)), 3, labelled=False)


@register(ORACLES["induced_square_query"])
def induced_square_by_joins(spark, sf):
    p = SHAPES["c4"]
    return _n(apps.query(by_joins(dealt(spark, sf)), Pattern.of(p.n, p.edges, None, induced=True)).df)


@register(ORACLES["maximal_clique3"])
def maximal_clique3_by_joins(spark, sf):
    return apps.maximal_cliques(by_joins(dealt(spark, sf)), 3)


@register(f"{_C4} WHERE NOT EXISTS (SELECT 1 FROM a p JOIN a q ON q.u = p.u JOIN a r ON r.u = p.u JOIN a s ON s.u = p.u WHERE p.v = t.a AND q.v = t.b AND r.v = t.c AND s.v = x.v)".replace(f"WITH {E}, ", f"WITH {A}, ", 1))
def maximal_clique4(spark, sf):
    return apps.maximal_cliques(dealt(spark, sf), 4)


# switches and labels of edges


@register(f"WITH {A}, {T} SELECT CAST((SELECT sum(d * (d - 1) / 2) FROM d) AS BIGINT) AS n, CAST(3 * (SELECT count(*) FROM t) AS BIGINT) AS closed")
def edge_to_vertex_switch(spark, sf):
    f = apps.edge_subgraphs(dealt(spark, sf), 2).to_vertices(3)
    return f.df.agg(F.count("*").alias("n"), F.sum(F.when(f.complete(), 1).otherwise(0)).alias("closed"))


@register(f"WITH {A}, {T} SELECT count(*) AS n FROM t")
def vertex_to_pattern_switch(spark, sf):
    f = Frontier.vertices(dealt(spark, sf)).extend(2)
    return _n(f.to_pattern(Frontier.pattern(f.graph, TRIANGLE).plan).matches().df)


_MARKED = f"WITH {NT}, f AS (SELECT u, v, min(ts) AS ts FROM m GROUP BY u, v), x AS (SELECT u, v FROM f WHERE ts = (SELECT min(ts) FROM f)), xx AS (SELECT u, v FROM x UNION ALL SELECT v, u FROM x) SELECT count(*) AS n FROM xx p JOIN xx q ON p.u = q.u AND p.v < q.v"


def _marked_path(g: Graph) -> Pattern:
    first = g.edge_label.agg(F.min("label")).first()[0]
    return Pattern.of(3, [(0, 1, first), (0, 2, first)], None, edge_labeled=True)


@register(_MARKED)
def edge_labelled_path_query(spark, sf):
    g = replace(trade(spark, sf), labeling="ve")
    return _n(apps.query(g, _marked_path(g)).df)


@register(_MARKED)
def edge_labelled_path_query_by_edges(spark, sf):
    g = replace(trade(spark, sf), labeling="ve")
    return _n(apps.query_by_edges(g, _marked_path(g)).df)


@register(f"WITH {A}, {L} SELECT c.label AS center, least(p.label, q.label) AS low, greatest(p.label, q.label) AS high, count(*) AS n FROM a x JOIN a y ON x.u = y.u AND x.v < y.v JOIN l c ON c.v = x.u JOIN l p ON p.v = x.v JOIN l q ON q.v = y.v GROUP BY 1, 2, 3")
def labels_on_matches(spark, sf):
    f = apps.query(dealt(spark, sf), WEDGE).with_labels()
    c, p, q = (F.col(f"l{f.plan.order.index(i)}") for i in range(3))
    return f.by_key({"center": c, "low": F.least(p, q), "high": F.greatest(p, q)})


# aggregations


@register(f"WITH {A}, {TRIPLES}, s AS (SELECT CASE WHEN j AND EXISTS (SELECT 1 FROM a y WHERE y.u = v0 AND y.v = v2) THEN '{TRIANGLE.key()}' ELSE '{WEDGE.key()}' END AS pattern, v0, v1, v2 FROM p3) SELECT pattern, max(greatest(v0, v1, v2)) AS last FROM s GROUP BY 1")
def motif_max_by_pattern(spark, sf):
    return apps.induced_subgraphs(dealt(spark, sf), 3).by_pattern(False, F.greatest("v0", "v1", "v2"), "max", "last")


@register(f"WITH {A}, {L}, {TRIPLES}, s AS (SELECT CASE WHEN j AND EXISTS (SELECT 1 FROM a y WHERE y.u = v0 AND y.v = v2) THEN '{TRIANGLE.key()}' ELSE '{WEDGE.key()}' END AS pattern, label FROM p3 JOIN l ON l.v = v0) SELECT pattern, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1")
def motif_labels_by_pattern(spark, sf):
    f = apps.induced_subgraphs(dealt(spark, sf), 3)
    sets = f.by_pattern(False, f.label(0), "collect_set", "labels").select("pattern", F.array_join(F.array_sort("labels").cast("array<string>"), ",").alias("labels"))
    return sets.join(f.by_pattern(False, None, "sum", "n"), "pattern")


@register(f"WITH {A}, {L} SELECT x.label, array_to_string(list_sort(list(DISTINCT y.label)), ',') AS near FROM a JOIN l x ON x.v = a.u JOIN l y ON y.v = a.v GROUP BY 1")
def label_neighbourhoods(spark, sf):
    f = Frontier.edges(dealt(spark, sf)).extend(1)
    both = f.through(lambda g: g.df.select(F.explode(F.array(F.struct(F.col("la0").alias("x"), F.col("lb0").alias("y")), F.struct(F.col("lb0").alias("x"), F.col("la0").alias("y")))).alias("p")).select("p.*"))
    sets = both.by_key({"label": F.col("x")}, F.col("y"), "collect_set", "near")
    return sets.select("label", F.array_join(F.array_sort("near").cast("array<string>"), ",").alias("near"))


@register(f"WITH {A}, {L} SELECT p.label, CAST(bit_xor(e.u * 4294967296 + e.v) AS BIGINT) AS mixed FROM e JOIN l p ON p.v = e.u GROUP BY 1")
def edges_reduced_by_label(spark, sf):
    f = Frontier.edges(dealt(spark, sf)).extend(1)
    return f.reduced({"label": F.col("la0")}, F.col("e0"), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b), "mixed")


@register(f"WITH {E}, {T} SELECT v, count(*) AS n FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v")
def triangles_by_callback(spark, sf):
    f = apps.query(dealt(spark, sf), TRIANGLE)
    return f.through(lambda g: g.df.select(F.explode(g.words()).alias("v"))).by_key({"v": F.col("v")})


@register(f"WITH {A} SELECT count(*) AS n FROM e")
def processed_edges(spark, sf):
    seen = spark.sparkContext.accumulator(0)
    Frontier.edges(dealt(spark, sf)).extend(1).process(lambda rows: seen.add(sum(1 for _ in rows)))
    return spark.createDataFrame([(seen.value,)], "n long")


@register(f"WITH {A}, {T} SELECT name, n FROM (VALUES ('edges', (SELECT count(*) FROM e)), ('triangles', (SELECT count(*) FROM t)), ('vertices', (SELECT count(*) FROM part))) AS x(name, n)")
def concurrent_counts(spark, sf):
    g = dealt(spark, sf)
    steps = {"edges": g.edges.count, "triangles": apps.query(g, TRIANGLE).count, "vertices": g.vertices.count}
    found = Context(spark).with_parallelism(3).submit_all(list(steps.values()))
    return spark.createDataFrame([(k, o.value) for k, o in zip(steps, found, strict=True)], "name string, n long")


@register(f"WITH {A}, {T} SELECT level, n FROM (VALUES (1, (SELECT count(*) FROM part)), (2, (SELECT count(*) FROM e)), (3, CAST((SELECT sum(d * (d - 1) / 2) FROM d) - 2 * (SELECT count(*) FROM t) AS BIGINT))) AS x(level, n)")
def observed_levels(spark, sf):
    f, watches = Frontier.vertices(dealt(spark, sf)), []
    for level in range(1, 4):
        f, watch = f.extend(1).observed(f"level{level}")
        watches.append((level, watch))
    done = Context(spark).diagnose(f.count)
    if not done.outcome.ok or not done.figures.tasks:
        raise RuntimeError("the step did not run")
    return spark.createDataFrame([(level, watch.get["n"]) for level, watch in watches], "level int, n long")


# frequent subgraphs of three edges, graph views, texts and patterns


@register(
    f"""WITH {A}, {T}, pt AS (SELECT x.v AS p, x.u AS q, y.v AS r, z.v AS s FROM a x JOIN a y ON y.u = x.u AND y.v <> x.v JOIN a z ON z.u = y.v AND z.v <> x.u AND z.v <> x.v)
 SELECT pattern, CAST(support AS BIGINT) AS support FROM (SELECT '{Pattern.of(2, [(0, 1)]).key()}' AS pattern, (SELECT count(*) FROM d) AS support
 UNION ALL SELECT '{WEDGE.key()}', least((SELECT count(*) FROM d WHERE d >= 2), (SELECT count(DISTINCT a.v) FROM a JOIN d ON d.u = a.u WHERE d >= 2))
 UNION ALL SELECT '{SHAPES['star'].key()}', least((SELECT count(*) FROM d WHERE d >= 3), (SELECT count(DISTINCT a.v) FROM a JOIN d ON d.u = a.u WHERE d >= 3))
 UNION ALL SELECT '{SHAPES['path'].key()}', (SELECT least(count(DISTINCT p), count(DISTINCT q)) FROM pt) UNION ALL SELECT '{TRIANGLE.key()}', (SELECT count(DISTINCT v) FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t))) WHERE support >= 20"""
)
def fsm_3edge_unlabelled(spark, sf):
    return fsm.frequent_subgraphs(dealt(spark, sf), 20, 3, labelled=False).select("pattern", "support")


@register(_TWO)
def fsm_2edge_by_pattern_then_growth(spark, sf):
    return _wedge_rows(fsm.frequent_subgraphs(dealt(spark, sf), 150, 2, "papo"))


@register(ORACLES["minimal_keyword_search3"])
def minimal_keyword_search3_by_pattern(spark, sf):
    return _n(apps.minimal_keyword_search(dealt(spark, sf), 3, [1, 2], "pa").df)


_GROWN = f"WITH {A}, {L}, g AS (SELECT e.u, e.v FROM e JOIN l p ON p.v = e.u JOIN l q ON q.v = e.v WHERE least(p.label, q.label) = 1 AND greatest(p.label, q.label) = 2) SELECT count(*) AS n FROM (SELECT DISTINCT g.u, g.v, a.v AS x FROM g JOIN a ON a.u IN (g.u, g.v) JOIN l ON l.v = a.v WHERE l.label = 3 AND a.v NOT IN (g.u, g.v))"
_12 = Pattern.of(2, [(0, 1)], (1, 2))


@register(_GROWN)
def grown_by_label(spark, sf):
    return apps.grown_by_label(dealt(spark, sf), _12, 3)


@register(_GROWN)
def grown_by_label_from_matches(spark, sf):
    return apps.grown_by_label(dealt(spark, sf), _12, 3, "papo")


def _same_size(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """The edges between parts of one size, which are the component graphs, and the index of parts to them."""
    g, index = dealt(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("vertex"), F.col("p_size").alias("graph_id"))
    same = g.edges.join(index.select(F.col("vertex").alias("src"), F.col("graph_id").alias("a")), "src").join(index.select(F.col("vertex").alias("dst"), F.col("graph_id").alias("b")), "dst").filter("a = b")
    return Graph(g.vertices, same.select("id", "src", "dst", "labels"), "v").kept(), index


@register(
    f"""WITH {E}0, e AS (SELECT e0.u, e0.v FROM e0 JOIN part p ON p.p_partkey = e0.u JOIN part q ON q.p_partkey = e0.v WHERE p.p_size = q.p_size), {AD}, {T},
 w AS (SELECT p_size AS graph_id, sum(d * (d - 1) / 2) AS n FROM d JOIN part ON p_partkey = d.u GROUP BY 1), z AS (SELECT p_size AS graph_id, count(*) AS n FROM t JOIN part ON p_partkey = t.a GROUP BY 1),
 g AS (SELECT w.graph_id, '{WEDGE.key()}' AS pattern, w.n - 3 * coalesce(z.n, 0) AS n FROM w LEFT JOIN z ON z.graph_id = w.graph_id UNION ALL SELECT graph_id, '{TRIANGLE.key()}', n FROM z)
 SELECT graph_id, pattern, CAST(round(n * 1000000 / sum(n) OVER (PARTITION BY graph_id)) AS BIGINT) AS millionths FROM g WHERE n > 0""".replace("e AS (SELECT DISTINCT", "e0 AS (SELECT DISTINCT", 1).replace(")0, e AS", "), e AS", 1)
)
def graphlet_shares(spark, sf):
    g, index = _same_size(spark, sf)
    return apps.graphlet_features(g, 3, index).select("graph_id", "pattern", F.round(F.col("share") * 1000000).cast("long").alias("millionths"))


@register("SELECT true AS within")
def graphlet_kernel(spark, sf):
    g, index = _same_size(spark, sf)
    classes = index.select("graph_id").distinct().withColumn("label", F.col("graph_id") % 2)
    area = apps.graphlet_kernel_auc(g, 3, index, classes)
    return spark.createDataFrame([(0 <= area <= 1,)], "within boolean")


@register(f"WITH {A} SELECT count(*) AS n FROM e JOIN d x ON x.u = e.u JOIN d y ON y.u = e.v WHERE x.d > y.d")
def filter_edges_given_graph_then_count(spark, sf):
    return _n(dealt(spark, sf).filter_edges_given_graph(lambda df: F.size("nb_src") > F.size("nb_dst")).edges)


@register(f"WITH {NT}, {T} SELECT concat(a, ',', b, ',', c) AS triangle, count(z.ts) AS n, min(z.ts) AS first FROM t LEFT JOIN (SELECT t.a AS ta, t.b AS tb, t.c AS tc, x.ts FROM t JOIN m x ON x.u = t.a AND x.v = t.b JOIN m y ON y.u = t.a AND y.v = t.c AND y.ts = x.ts JOIN m w ON w.u = t.b AND w.v = t.c AND w.ts = x.ts) z ON z.ta = a AND z.tb = b AND z.tc = c GROUP BY 1")
def common_months_of_triangles(spark, sf):
    g = trade(spark, sf)
    found = _rising3(apps.cliques(g, 3))
    pairs = found.select("group", F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("u"), F.col(f"v{j}").alias("v")) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("p")).select("group", "p.*")
    return g.common_edge_labels(pairs).select(F.col("group").alias("triangle"), F.size("labels").cast("long").alias("n"), F.array_min("labels").alias("first"))


def _rising3(df: DataFrame) -> DataFrame:
    return df.withColumn("group", F.concat_ws(",", "v0", "v1", "v2"))


_IDS = f"WITH {E} SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS BIGINT) AS id, u AS src, v AS dst FROM e"


def _numbered(g: Graph) -> Graph:
    ids = from_edges(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).edges
    return Graph(g.vertices, ids, "v")


@register(_IDS)
def text_graph(spark, sf):
    path = fresh_path(spark, "graph")
    text.write_graph(_numbered(dealt(spark, sf)), path)
    return text.read_graph(spark, path, "v").edges.select("id", "src", "dst")


@register(_IDS)
def single_file_graph(spark, sf):
    path = fresh_path(spark, "graph")
    text.write_single_file(_numbered(dealt(spark, sf)), path)
    return text.read_single_file(spark, path).edges.select("id", "src", "dst")


@register(f"WITH {L} SELECT v, label FROM l")
def text_graph_labels(spark, sf):
    path = fresh_path(spark, "graph")
    text.write_graph(_numbered(dealt(spark, sf)), path)
    return text.vertex_labelled(spark, path).vertex_label


@register(f"WITH {A}, k AS (SELECT u AS key, row_number() OVER (ORDER BY u) - 1 AS id FROM d), x AS (SELECT p.id AS src, q.id AS dst FROM e JOIN k p ON p.key = e.u JOIN k q ON q.key = e.v) SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM x")
def edge_list_graph(spark, sf):
    path = fresh_path(spark, "edges")
    text.edge_list(dealt(spark, sf)).select(F.concat_ws(" ", "v", "u").alias("value")).write.text(path)
    return text.read_edge_list(spark, path).edges.select("id", "src", "dst")


@register(
    f"""WITH {A}, r AS (SELECT p_partkey AS v, row_number() OVER (ORDER BY coalesce(d, 0) DESC, p_partkey) - 1 AS new FROM part LEFT JOIN d ON d.u = p_partkey), x AS (SELECT least(p.new, q.new) AS src, greatest(p.new, q.new) AS dst FROM e JOIN r p ON p.v = e.u JOIN r q ON q.v = e.v)
 SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM x"""
)
def reordered_by_degree(spark, sf):
    return G.by_degree(dealt(spark, sf)).edges.select("id", "src", "dst")


@register("SELECT p_partkey AS vertex, p_size AS graph_id FROM part")
def graph_index(spark, sf):
    path = fresh_path(spark, "index")
    table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("value")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path)
    return text.read_graph_index(spark, path)


@register("SELECT * FROM (VALUES " + ", ".join(f"('{p.key()}', {p.m}, {len(dot(p).splitlines())})" for p in SHAPES.values()) + ") AS t(pattern, edges, lines)")
def pattern_files(spark, sf):
    folder, rows = fresh_path(spark, "patterns"), []
    for name, p in SHAPES.items():
        text.write_pattern(spark, Pattern.of(p.n, p.edges, [1] * p.n), f"{folder}/{name}")
        q = text.read_pattern(spark, f"{folder}/{name}", "n")
        rows.append((q.key(), q.m, len(dot(q).splitlines())))
    return spark.createDataFrame(rows, "pattern string, edges int, lines int")


@register("SELECT * FROM (VALUES (4, 3), (5, 5), (6, 5), (7, 4), (8, 2), (9, 1), (10, 1)) AS t(edges, n)")
def pattern_set(spark, sf):
    folder = fresh_path(spark, "sets")
    made, found = text.pattern_set(spark, 5, folder), text.pattern_set(spark, 5, folder)
    both = made.join(found, "pattern")
    return both.groupBy(F.size(F.split(F.split("pattern", ";")[2], ",")).alias("edges")).agg(F.count("*").cast("int").alias("n"))


@register("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 5), (5, 12), (6, 30)) AS t(m, n)")
def canonical_patterns_by_edges(spark, sf):
    return spark.createDataFrame([(m, len(edge_patterns(m))) for m in range(1, 7)], "m int, n int")


@register("SELECT * FROM (VALUES " + ", ".join(f"('{p.key()}', 4)" for p in SHAPES.values()) + ") AS t(pattern, steps)")
def plans4(spark, sf):
    return spark.createDataFrame([(p.key(), len(heuristic(p).steps)) for p in vertex_patterns(4)], "pattern string, steps int")


def flagship(spark: SparkSession) -> DataFrame:
    return motif3(spark, "/root/testdata/sf0.001")
