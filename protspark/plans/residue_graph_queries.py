"""Residue-graph analytics. Each customer is a graph; a line is an edge from its number to a quantity step."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.functions.lineage import written
from protspark.functions.vectors import explode_vector
from protspark.operators import centrality as C
from protspark.operators import residue_graph as G
from protspark.operators.cleaning import demo_node_features, graph_targets, node_features, position_features
from protspark.plans.geometry_queries import KNN_SQL
from protspark.plans.elimination import SOLVE_SQL
from protspark.plans.registry import query, r6, table
from protspark.plans.stand_ins import PAIRS_SQL, POINTS_SQL, points

KEY = G.KEY


def graphs(spark, sf):
    """At most 15 nodes per graph by construction, as many graphs as customers with orders."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    lines = li.join(o, li.l_orderkey == o.o_orderkey)
    return lines.groupBy(F.col("o_custkey").alias(KEY), F.col("l_linenumber").cast("long").alias("i"), (F.pmod("l_quantity", F.lit(8)) + 8).cast("long").alias("j")).agg(
        (F.max("l_discount") + 0.01).alias("w"), (F.min("l_quantity") / 10).alias("dist"), F.min("l_tax").alias("g_mem"))


GRAPH_SQL = """e AS (SELECT o_custkey AS graph_id, CAST(l_linenumber AS BIGINT) AS i, CAST(l_quantity % 8 + 8 AS BIGINT) AS j, max(l_discount) + 0.01 AS w, min(l_quantity) / 10 AS dist, min(l_tax) AS g_mem
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
    adj AS (SELECT graph_id, i AS a, j AS b, w FROM e UNION ALL SELECT graph_id, j, i, w FROM e), nodes AS (SELECT DISTINCT graph_id, a AS idx FROM adj),
    size AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1)"""


def ends(edges):
    """First and last node of each graph."""
    n = G.graph_nodes(edges).groupBy(KEY).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return n.select(KEY, F.col("lo").alias("idx")), n.select(KEY, F.col("hi").alias("idx"))


def solved(spark, sf, max_nodes=2_000):
    e = written(graphs(spark, sf))  # read for the nodes, the ends, the system and its check
    nodes = G.graph_nodes(e)
    sources, sinks = ends(e)
    return e, nodes, G.potentials(e, nodes, sources, sinks, max_nodes=max_nodes)


@query("gra01_potentials", f"WITH {GRAPH_SQL} SELECT graph_id, n, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS total FROM size")
def potentials(spark, sf):
    """Largest row error of the solved system, and the sum of the potentials (charges cancel)."""
    e, nodes, phi = solved(spark, sf)
    p = phi.select(KEY, "idx", "phi")
    flow = G.adjacency(e).join(p.withColumnsRenamed({"idx": "nbr", "phi": "other"}), [KEY, "nbr"]).groupBy(KEY, "idx").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("other")).alias("wp"))
    lo, hi = ends(e)
    b = lo.withColumn("b", F.lit(1.0)).unionByName(hi.withColumn("b", F.lit(-1.0)))
    row = p.join(flow, [KEY, "idx"]).join(b, [KEY, "idx"], "left").na.fill(0.0, ["b"]).withColumn("err", F.abs((F.col("d") + 1e-3) * F.col("phi") - F.col("wp") - F.col("b")))
    return row.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), r6(F.max("err")).alias("residual"), (F.round(F.sum("phi"), 4) + 0.0).alias("total"))


#: Row and column numbers follow the nodes; the first node is the source, the last one the sink.
POTENTIAL_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
    nb AS (SELECT graph_id, idx, row_number() OVER (PARTITION BY graph_id ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY graph_id) AS n FROM nodes),
    links AS (SELECT graph_id, a, b, max(w) AS w FROM adj WHERE a <> b GROUP BY 1, 2, 3),
    deg AS (SELECT graph_id, a, sum(w) AS d FROM links GROUP BY 1, 2),
    m0 AS (SELECT x.graph_id AS g, x.r AS i, y.r AS j, x.n, CAST(CASE WHEN x.r = y.r THEN 1e-3 + coalesce(d, 0.0) ELSE -coalesce(w, 0.0) END AS DOUBLE) AS v
           FROM nb x JOIN nb y USING (graph_id) LEFT JOIN links l ON l.graph_id = x.graph_id AND l.a = x.idx AND l.b = y.idx LEFT JOIN deg ON deg.graph_id = x.graph_id AND deg.a = x.idx
           UNION ALL SELECT graph_id, r, n, n, CAST(CASE WHEN r = n - 1 THEN -1 WHEN r = 0 THEN 1 ELSE 0 END AS DOUBLE) FROM nb),
    {SOLVE_SQL}
    SELECT graph_id, idx, round(v, 5) + 0.0 AS phi FROM solved JOIN nb ON graph_id = g AND r = i"""


@query("gra01_potentials_dense", POTENTIAL_SQL)
def potentials_dense(spark, sf):
    return solved(spark, sf)[2].select(KEY, "idx", (F.round("phi", 5) + 0.0).alias("phi"))


@query("gra01_potentials_iterated", POTENTIAL_SQL)
def potentials_iterated(spark, sf):
    """The same by conjugate gradients, as for graphs that are too large to be solved densely."""
    return solved(spark, sf, max_nodes=1)[2].select(KEY, "idx", (F.round("phi", 5) + 0.0).alias("phi"))


@query("gra02_edge_flux", f"""
    WITH {GRAPH_SQL} SELECT graph_id, i, j, round(abs(i * i - j * 3) / (dist + 1e-6), 6) + 0.0 AS flux FROM e""")
def edge_flux(spark, sf):
    e = graphs(spark, sf)
    phi = G.graph_nodes(e).select(KEY, "idx", F.when(F.col("idx") < 8, F.col("idx") * F.col("idx")).otherwise(F.col("idx") * 3).cast("double").alias("phi"))
    return G.edge_flux(e, phi).select(KEY, "i", "j", r6("flux").alias("flux"))


@query("gra03_adapt_conductance", f"""
    WITH {GRAPH_SQL} SELECT graph_id, i, j, round(0.8 * CASE WHEN g_mem > 0.05 THEN 1.0 ELSE g_mem END + 0.2 * (1.0 + dist), 6) + 0.0 AS g_mem FROM e""")
def adapt_conductance(spark, sf):
    e = graphs(spark, sf).withColumns({"flux": F.col("dist"), "g_mem": F.when(F.col("g_mem") > 0.05, F.lit(float("nan"))).otherwise(F.col("g_mem"))})
    return G.adapt_conductance(e).select(KEY, "i", "j", r6("g_mem").alias("g_mem"))


@query("gra04_minmax_by_graph", f"""
    WITH {GRAPH_SQL} SELECT graph_id, i, j, round(CASE WHEN max(w) OVER p = min(w) OVER p THEN 0 ELSE (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p + 1e-12) END, 6) + 0.0 AS w FROM e WINDOW p AS (PARTITION BY graph_id)""")
def minmax(spark, sf):
    return G.minmax_by_graph(graphs(spark, sf), "w").select(KEY, "i", "j", r6("w").alias("w"))


@query("gra05_flux_target", f"""
    WITH {GRAPH_SQL}, f AS (SELECT *, CASE WHEN w > 0.03 THEN dist ELSE 0 END AS flux FROM e)
    SELECT graph_id, i, j, round(0.05 + 0.95 * CASE WHEN max(flux) OVER p > 0 THEN flux / (max(flux) OVER p + 1e-12) ELSE flux END, 6) + 0.0 AS target FROM f WINDOW p AS (PARTITION BY graph_id)""")
def flux_target(spark, sf):
    e = graphs(spark, sf)
    flux = e.where("w > 0.03").select(KEY, F.col("j").alias("i"), F.col("i").alias("j"), F.col("dist").alias("flux"))
    return G.flux_target(e.select(KEY, "i", "j"), flux).select(KEY, "i", "j", r6("target").alias("target"))


@query("gra06_build_graphs", f"""
    WITH {KNN_SQL} SELECT model_id AS graph_id, i, j, round(dist, 6) + 0.0 AS dist, true AS in_range FROM knn JOIN (SELECT model_id FROM pts GROUP BY 1 HAVING count(*) >= 8) USING (model_id)""")
def build_graphs(spark, sf):
    g = G.build_graphs(points(spark, sf), sigma=0.25)
    return g.select(KEY, "i", "j", r6("dist").alias("dist"), ((F.col("g_mem") >= 0) & (F.col("g_mem") <= 1)).alias("in_range"))


@query("gra07_fit_scalers", f"""
    WITH {POINTS_SQL} SELECT 'node' AS kind, 0 AS dim, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x) + 1e-6, 6) + 0.0 AS std FROM pts
    UNION ALL SELECT 'node', 1, round(avg(y), 6) + 0.0, round(stddev_pop(y) + 1e-6, 6) + 0.0 FROM pts UNION ALL SELECT 'node', 2, round(avg(z), 6) + 0.0, round(stddev_pop(z) + 1e-6, 6) + 0.0 FROM pts""")
def fit_scalers(spark, sf):
    s = G.fit_scalers(points(spark, sf).withColumn("features", F.array("x", "y", "z")))
    return s.select("kind", "dim", r6("mean").alias("mean"), r6("std").alias("std"))


@query("gra08_apply_scalers", f"""
    WITH {POINTS_SQL}, s AS (SELECT avg(x) AS mx, stddev_pop(x) + 1e-6 AS sx, avg(y) AS my, stddev_pop(y) + 1e-6 AS sy FROM pts)
    SELECT idx, round((x - mx) / (sx + 1e-6), 6) + 0.0 AS a, round((y - my) / (sy + 1e-6), 6) + 0.0 AS b, round(z, 6) + 0.0 AS c FROM pts, s""")
def apply_scalers(spark, sf):
    v = points(spark, sf).withColumn("features", F.array("x", "y", "z"))
    scaled = G.apply_scalers(v, G.fit_scalers(v), keep_raw=2)
    return scaled.select("idx", *[r6(F.col("features")[k]).alias(n) for k, n in enumerate("abc")])


@query("gra09_degree_centrality", f"WITH {GRAPH_SQL} SELECT graph_id, a AS idx, round(count(*) / (any_value(n) - 1), 6) + 0.0 AS degree FROM adj JOIN size USING (graph_id) GROUP BY 1, 2")
def degree_centrality(spark, sf):
    return C.degree_centrality(graphs(spark, sf)).select(KEY, "idx", r6("degree").alias("degree"))


def pagerank_sql(iters: int) -> str:
    out = "o AS (SELECT graph_id, a, sum(w) AS out FROM adj GROUP BY 1, 2), r0 AS (SELECT graph_id, idx, 1.0::DOUBLE / n AS pr FROM nodes JOIN size USING (graph_id))"
    steps = [f"""r{k} AS MATERIALIZED (SELECT nodes.graph_id, nodes.idx, 0.85 * coalesce(s, 0) + 0.15 / n AS pr FROM nodes JOIN size USING (graph_id) LEFT JOIN
        (SELECT adj.graph_id, adj.b AS idx, sum(pr * w / out) AS s FROM adj JOIN o ON o.graph_id = adj.graph_id AND o.a = adj.a JOIN r{k - 1} r ON r.graph_id = adj.graph_id AND r.idx = adj.a GROUP BY 1, 2) f
        ON f.graph_id = nodes.graph_id AND f.idx = nodes.idx)""" for k in range(1, iters + 1)]
    return f"WITH {GRAPH_SQL}, {out}, {', '.join(steps)} SELECT graph_id, idx, round(pr, 6) + 0.0 AS pagerank FROM r{iters}"


@query("gra10_pagerank", pagerank_sql(6))
def pagerank(spark, sf):
    return C.pagerank(graphs(spark, sf), iters=6, tol=None).select(KEY, "idx", r6("pagerank").alias("pagerank"))


def eigen_sql(iters: int) -> str:
    steps = [f"""x{k} AS MATERIALIZED (SELECT adj.graph_id, adj.a AS idx, sum(w * o.x) + any_value(s.x) AS x FROM adj JOIN x{k - 1} o ON o.graph_id = adj.graph_id AND o.idx = adj.b
        JOIN x{k - 1} s ON s.graph_id = adj.graph_id AND s.idx = adj.a GROUP BY 1, 2)""" for k in range(1, iters + 1)]
    return f"""WITH {GRAPH_SQL}, x0 AS (SELECT graph_id, idx, 1.0::DOUBLE AS x FROM nodes), {', '.join(steps)}
        SELECT graph_id, idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY graph_id)), 6) + 0.0 AS eigen FROM x{iters}"""


@query("gra11_eigenvector", eigen_sql(6))
def eigenvector(spark, sf):
    return C.eigenvector_centrality(graphs(spark, sf), iters=6, tol=None).select(KEY, "idx", r6("eigen").alias("eigen"))


def _squared(name: str, k: int, scaled: bool) -> str:
    """Matrix ``name_k`` as the square of the one before, scaled to a largest entry of 1 if asked."""
    product = f"SELECT x.graph_id, x.a, y.b, sum(x.v * y.v) AS v FROM {name}{k - 1} x JOIN {name}{k - 1} y ON x.graph_id = y.graph_id AND x.b = y.a GROUP BY 1, 2, 3"
    return f"{name}{k} AS MATERIALIZED (" + (f"SELECT graph_id, a, b, v / max(v) OVER (PARTITION BY graph_id) AS v FROM ({product})" if scaled else product) + ")"


def pagerank_limit_sql(doublings: int) -> str:
    """The fixed point: the series of all powers of the step, 2 ** doublings of them, by squaring each graph's matrix."""
    steps = ["m0 AS MATERIALIZED (SELECT adj.graph_id, adj.b AS a, adj.a AS b, 0.85 * w / out AS v FROM adj JOIN o ON o.graph_id = adj.graph_id AND o.a = adj.a)",
             "x0 AS (SELECT graph_id, idx, 0.15::DOUBLE / n AS x FROM nodes JOIN size USING (graph_id))"]
    for k in range(1, doublings + 1):
        steps += [f"""x{k} AS MATERIALIZED (SELECT graph_id, idx, sum(x) AS x FROM (SELECT * FROM x{k - 1} UNION ALL SELECT m.graph_id, m.a, m.v * x.x FROM m{k - 1} m
            JOIN x{k - 1} x ON x.graph_id = m.graph_id AND x.idx = m.b) GROUP BY 1, 2)""", _squared("m", k, False)]
    return f"""WITH {GRAPH_SQL}, o AS (SELECT graph_id, a, sum(w) AS out FROM adj GROUP BY 1, 2), {', '.join(steps[:-1])}
        SELECT graph_id, idx, round(x, 6) + 0.0 AS pagerank FROM x{doublings}"""


@query("gra10_pagerank_converged", pagerank_limit_sql(8))
def pagerank_converged(spark, sf):
    return C.pagerank(graphs(spark, sf), tol=1e-15).select(KEY, "idx", r6("pagerank").alias("pagerank"))


def eigen_limit_sql(squarings: int) -> str:
    """Powers of ``A / largest degree + I``, squared again and again, applied to ones."""
    steps = [_squared("m", k, True) for k in range(1, squarings + 1)]
    return f"""WITH {GRAPH_SQL}, top AS (SELECT graph_id, max(d) AS d FROM (SELECT graph_id, a, sum(w) AS d FROM adj GROUP BY 1, 2) GROUP BY 1),
        m0 AS MATERIALIZED (SELECT graph_id, a, b, w / d AS v FROM adj JOIN top USING (graph_id) UNION ALL SELECT graph_id, idx, idx, 1.0::DOUBLE FROM nodes), {', '.join(steps)},
        x AS (SELECT graph_id, a AS idx, sum(v) AS x FROM m{squarings} GROUP BY 1, 2)
        SELECT graph_id, idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY graph_id)), 6) + 0.0 AS eigen FROM x"""


@query("gra11_eigenvector_converged", eigen_limit_sql(16))
def eigenvector_converged(spark, sf):
    return C.eigenvector_centrality(graphs(spark, sf), tol=1e-12).select(KEY, "idx", r6("eigen").alias("eigen"))


DIST_SQL = "RECURSIVE " + GRAPH_SQL + """, walk AS (SELECT graph_id, idx AS s, idx AS v, 0 AS d FROM nodes
        UNION SELECT walk.graph_id, s, b, d + 1 FROM walk JOIN adj ON adj.graph_id = walk.graph_id AND adj.a = v WHERE d < 14),
    dist AS (SELECT graph_id, s, v, min(d) AS d FROM walk GROUP BY 1, 2, 3)"""


@query("gra12_closeness", f"""
    WITH {DIST_SQL}, c AS (SELECT graph_id, s AS idx, count(*) - 1 AS r, sum(d) AS t FROM dist GROUP BY 1, 2)
    SELECT graph_id, idx, round(CASE WHEN t > 0 THEN r / t * r / (n - 1) ELSE 0 END, 6) + 0.0 AS closeness FROM c JOIN size USING (graph_id)""")
def closeness(spark, sf):
    return C.closeness(graphs(spark, sf)).select(KEY, "idx", r6("closeness").alias("closeness"))


def lengths_sql(rounds: int = 14) -> str:
    """Weighted distances by relaxing every edge once a round; a graph here has at most 15 nodes."""
    steps = [f"""d{k} AS MATERIALIZED (SELECT graph_id, s, v, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT x.graph_id, x.s, adj.b, x.d + adj.w FROM d{k - 1} x
        JOIN adj ON adj.graph_id = x.graph_id AND adj.a = x.v) GROUP BY 1, 2, 3)""" for k in range(1, rounds + 1)]
    return f"{GRAPH_SQL}, d0 AS (SELECT graph_id, idx AS s, idx AS v, 0.0::DOUBLE AS d FROM nodes), {', '.join(steps)}, dist AS (SELECT * FROM d{rounds})"


def weighted_betweenness_sql(rounds: int = 14) -> str:
    """Path counts forward and dependencies back along the edges on shortest paths, one step a round."""
    steps = ["p0 AS (SELECT graph_id, idx AS s, idx AS v, 1.0::DOUBLE AS c FROM nodes)"]
    steps += [f"""p{k} AS MATERIALIZED (SELECT graph_id, s, v, sum(c) AS c FROM (SELECT * FROM p0 UNION ALL SELECT t.graph_id, t.s, t.v, p.c FROM tight t
        JOIN p{k - 1} p ON p.graph_id = t.graph_id AND p.s = t.s AND p.v = t.u) GROUP BY 1, 2, 3)""" for k in range(1, rounds + 1)]
    steps += [f"h0 AS (SELECT graph_id, s, v, 1 / c AS c FROM p{rounds})"]
    steps += [f"""h{k} AS MATERIALIZED (SELECT graph_id, s, v, sum(c) AS c FROM (SELECT * FROM h0 UNION ALL SELECT t.graph_id, t.s, t.u, h.c FROM tight t
        JOIN h{k - 1} h ON h.graph_id = t.graph_id AND h.s = t.s AND h.v = t.v) GROUP BY 1, 2, 3)""" for k in range(1, rounds + 1)]
    return f"""WITH {lengths_sql(rounds)}, tight AS MATERIALIZED (SELECT x.graph_id, x.s, x.v AS u, y.v FROM dist x JOIN adj ON adj.graph_id = x.graph_id AND adj.a = x.v
            JOIN dist y ON y.graph_id = x.graph_id AND y.s = x.s AND y.v = adj.b WHERE x.d + adj.w = y.d), {', '.join(steps)},
        b AS (SELECT graph_id, v AS idx, sum(p.c * h.c - 1) AS b FROM p{rounds} p JOIN h{rounds} h USING (graph_id, s, v) WHERE s <> v GROUP BY 1, 2)
        SELECT nodes.graph_id, nodes.idx, round(coalesce(b, 0) * CASE WHEN n > 2 THEN 1.0::DOUBLE / ((n - 1) * (n - 2)) ELSE 1.0 END, 6) + 0.0 AS betweenness
        FROM nodes JOIN size USING (graph_id) LEFT JOIN b ON b.graph_id = nodes.graph_id AND b.idx = nodes.idx"""


@query("gra12_closeness_weighted", f"""
    WITH {lengths_sql()}, c AS (SELECT graph_id, s AS idx, count(*) - 1 AS r, sum(d) AS t FROM dist GROUP BY 1, 2)
    SELECT graph_id, idx, round(CASE WHEN t > 0 THEN r / t * r / (n - 1) ELSE 0 END, 6) + 0.0 AS closeness FROM c JOIN size USING (graph_id)""")
def closeness_weighted(spark, sf):
    return C.closeness(graphs(spark, sf), weight="w").select(KEY, "idx", r6("closeness").alias("closeness"))


@query("gra13_betweenness", f"""
    WITH {DIST_SQL}, paths AS (SELECT graph_id, idx AS s, idx AS v, 0 AS d FROM nodes
        UNION ALL SELECT p.graph_id, p.s, adj.b, p.d + 1 FROM paths p JOIN adj ON adj.graph_id = p.graph_id AND adj.a = p.v JOIN dist t ON t.graph_id = p.graph_id AND t.s = p.s AND t.v = adj.b AND t.d = p.d + 1),
    sig AS (SELECT graph_id, s, v, any_value(d) AS d, CAST(count(*) AS DOUBLE) AS c FROM paths GROUP BY 1, 2, 3),
    b AS (SELECT x.graph_id, x.v AS idx, sum(x.c * y.c / z.c) AS b FROM sig x JOIN sig y ON y.graph_id = x.graph_id AND y.s = x.v JOIN sig z ON z.graph_id = x.graph_id AND z.s = x.s AND z.v = y.v
        WHERE x.s <> x.v AND y.v <> x.v AND x.d + y.d = z.d GROUP BY 1, 2)
    SELECT nodes.graph_id, nodes.idx, round(coalesce(b, 0) * CASE WHEN n > 2 THEN 1.0::DOUBLE / ((n - 1) * (n - 2)) ELSE 1.0 END, 6) + 0.0 AS betweenness FROM nodes JOIN size USING (graph_id)
    LEFT JOIN b ON b.graph_id = nodes.graph_id AND b.idx = nodes.idx""")
def betweenness(spark, sf):
    return C.betweenness(graphs(spark, sf)).select(KEY, "idx", r6("betweenness").alias("betweenness"))


@query("gra13_betweenness_weighted", weighted_betweenness_sql())
def betweenness_weighted(spark, sf):
    return C.betweenness(graphs(spark, sf), weight="w").select(KEY, "idx", r6("betweenness").alias("betweenness"))


MEMORY_SQL = GRAPH_SQL + """, m AS (SELECT graph_id, i, j, g_mem * g_mem * dist * dist AS memory FROM e WHERE dist <= 3)"""


def memory(spark, sf):
    e = graphs(spark, sf)
    return G.memory_scores(e.select(KEY, "i", "j", "dist"), e.select(KEY, "i", "j", F.col("g_mem").alias("q")), cutoff=3.0)


@query("gra14_memory_scores", f"WITH {MEMORY_SQL} SELECT graph_id, i, j, round(memory, 6) + 0.0 AS memory FROM m")
def memory_scores(spark, sf):
    return memory(spark, sf).select(KEY, "i", "j", r6("memory").alias("memory"))


@query("gra14_node_memory", f"WITH {MEMORY_SQL} SELECT graph_id, idx, round(sum(memory), 6) + 0.0 AS memory FROM (SELECT graph_id, i AS idx, memory FROM m UNION ALL SELECT graph_id, j, memory FROM m) GROUP BY 1, 2")
def node_memory(spark, sf):
    return G.node_memory(memory(spark, sf)).withColumn("memory", r6("memory"))


@query("gra15_normalize_weights", f"""
    WITH {GRAPH_SQL} SELECT graph_id, i, j, round(w / (avg(w) OVER (PARTITION BY graph_id) * 10), 8) + 0.0 AS w FROM e
    UNION ALL SELECT e.graph_id, e.i, 15, 1.0 FROM (SELECT DISTINCT graph_id, i FROM e WHERE g_mem > 0.03) e JOIN nodes ON nodes.graph_id = e.graph_id AND nodes.idx = 15""")
def normalize_weights(spark, sf):
    e = written(graphs(spark, sf))  # read for the weights, the pairs and the nodes
    pairs = e.where("g_mem > 0.03").select(KEY, "i", F.lit(15).cast("long").alias("j"))
    return G.normalize_weights(e, pairs, G.graph_nodes(e)).withColumn("w", F.round("w", 8) + F.lit(0.0))


@query("gra16_position_features", """
    SELECT substr(s_name, length(s_name) - 3) AS pdb_id, s_suppkey AS position, s_acctbal AS "ddG", round(s_suppkey / 1000, 6) + 0.0 AS position_frac, CASE WHEN s_nationkey < 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ss_h,
        CASE WHEN s_nationkey BETWEEN 8 AND 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ss_e, CASE WHEN s_nationkey > 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ss_c, CAST(s_nationkey AS DOUBLE) AS sasa, coalesce(n, 0) * 1.0::DOUBLE AS memory
    FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def position_feature_table(spark, sf):
    s, li = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    key = [F.right("s_name", F.lit(4)).alias("pdb_id"), F.col("s_suppkey").alias("position")]
    ss = F.when(F.col("s_nationkey") < 8, "H").when(F.col("s_nationkey") <= 15, "E").otherwise("?")
    n = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("memory"))
    cent = s.join(n, s.s_suppkey == n.l_suppkey).select(*key, "memory", *[F.lit(0.0).alias(c) for c in ("betweenness", "closeness", "eigen")])
    f = position_features(s.select(*key), s.select(*key, ss.alias("ss"), F.col("s_nationkey").cast("double").alias("sasa")), cent, s.select(*key, F.col("s_acctbal").alias("ddG")))
    return f.select("pdb_id", "position", "ddG", r6("position_frac").alias("position_frac"), "ss_h", "ss_e", "ss_c", "sasa", "memory")


@query("gra17_graph_targets", """
    SELECT doc_id AS uniprot, coalesce(a, 0) AS "A_target", coalesce(CAST(quality AS DOUBLE), 0) AS "ddG_target"
    FROM documents LEFT JOIN (SELECT user_id, round(avg(value), 6) + 0.0 AS a FROM events WHERE event_type <> 'error' GROUP BY 1) ON user_id = doc_id LEFT JOIN labels USING (doc_id)""")
def targets(spark, sf):
    d, lab, e = table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "events")
    scores = e.select(F.col("user_id").alias("uniprot"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("score"))
    t = graph_targets(d.select(F.col("doc_id").alias("uniprot")), scores, lab.select(F.col("doc_id").alias("uniprot"), F.col("quality").alias("DDG_pred"), "toxic"))
    return t.select("uniprot", r6("A_target").alias("A_target"), "ddG_target")


@query("gra16_demo_node_features", f"""
    WITH {PAIRS_SQL}, near AS (SELECT * FROM pairs WHERE dist <= 0.1), deg AS (SELECT idx, count(*) AS d FROM (SELECT i AS idx FROM near UNION ALL SELECT j FROM near) GROUP BY 1),
    c AS (SELECT model_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(idx) AS last FROM pts GROUP BY 1)
    SELECT pts.idx, round(pts.idx / last, 6) + 0.0 AS pos_frac, round(coalesce(d, 0) / last, 6) + 0.0 AS deg_frac, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 6) + 0.0 AS radius, round(z, 6) + 0.0 AS z
    FROM pts JOIN c USING (model_id) LEFT JOIN deg ON deg.idx = pts.idx""")
def demo_features(spark, sf):
    from protspark.operators.geometry import contacts

    p = points(spark, sf).withColumn("aa", F.lit("L"))
    f = demo_node_features(p, contacts(p, 0.1), ["model_id"])
    at = lambda k: r6(F.element_at("features", 20 + k))
    return f.select("idx", at(1).alias("pos_frac"), at(2).alias("deg_frac"), at(3).alias("radius"), at(4).alias("z"))
