"""Queries on graphs and clusters. The tables have no call graph: bipartite edges of the order tables stand for one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import python_source
from .registry import Registry

QUERIES = query = Registry()
EDGES = "e AS MATERIALIZED (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem)"


def edges(load):
    return load("lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")
    ).distinct()


def nodes(e):
    return e.select(F.explode(F.array("source", "target")).alias("node")).distinct()


@query(
    f"WITH {EDGES} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY node ORDER BY in_degree DESC, node LIMIT 10",
)
def degree_topk(load):
    """E12, H2."""
    return graph.top(graph.degrees(edges(load), "source", "target"), "in_degree", "node", 10)


def _rounds(n: int) -> str:
    """PageRank by unrolled rounds."""
    parts = [
        EDGES,
        "v AS MATERIALIZED (SELECT DISTINCT unnest([source, target]) AS node FROM e)",
        "o AS MATERIALIZED (SELECT source, count(*) AS n FROM e GROUP BY source)",
        "c AS (SELECT count(*)::DOUBLE AS n FROM v)",
        "r0 AS MATERIALIZED (SELECT node, 1.0 / c.n AS rank FROM v, c)",
    ]
    for i in range(1, n + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT v.node, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM v CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM {p} WHERE node NOT IN (SELECT source FROM o)) l LEFT JOIN (SELECT e.target, sum({p}.rank / o.n) AS got FROM e JOIN o ON o.source = e.source JOIN {p} ON {p}.node = e.source GROUP BY e.target) g ON g.target = v.node)",
        )
    return f"WITH {', '.join(parts)}"


@query(f"{_rounds(3)} SELECT node, round(rank, 9) AS rank FROM r3")
def pagerank_fixed(load):
    """Three rounds."""
    e = edges(load)
    return graph.pagerank(nodes(e), e, iterations=3, tolerance=0).select("node", F.round("rank", 9).alias("rank"))


def _rested(n: int) -> str:
    """The ranks of the first of n unrolled rounds that moves them less than a millionth for each node."""
    every = " UNION ALL ".join(
        f"SELECT {i} AS i, x.node, x.rank, abs(x.rank - y.rank) AS moved FROM r{i} x JOIN r{i - 1} y USING (node)" for i in range(1, n + 1)
    )
    return f"{_rounds(n)}, u AS ({every}), t AS (SELECT i FROM u GROUP BY i HAVING sum(moved) < 1e-6 * (SELECT n FROM c) ORDER BY i LIMIT 1) SELECT node, round(rank, 9) AS rank FROM u JOIN t USING (i) ORDER BY 2 DESC, node LIMIT 10"


@query(_rested(48))
def pagerank_converged(load):
    """Until the ranks rest; the top ten."""
    e = edges(load)
    return graph.top(graph.pagerank(nodes(e), e).withColumn("rank", F.round("rank", 9)), "rank", "node", 10)


@query("SELECT n_name AS class_name, round(sum(coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0)), 2) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def score_by_class(load):
    """Sums of a class's methods, 0 for those without a score."""
    methods = load("supplier").join(load("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("full_name"), F.col("n_name").alias("class_name")
    )
    scores = load("supplier").where("s_acctbal > 0").select(
        F.col("s_name").alias("node"), F.col("s_acctbal").alias("rank")
    )
    return graph.class_scores(methods, scores).select("class_name", F.round("score", 2).alias("score"))


@query("SELECT l_partkey AS caller, l_suppkey AS callee, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS edge_type FROM lineitem GROUP BY ALL")
def call_graph_edges(load):
    """The last type of each edge."""
    calls = load("lineitem").select(
        F.col("l_partkey").alias("caller"),
        F.col("l_suppkey").alias("callee"),
        F.col("l_returnflag").alias("edge_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )
    none = calls.sparkSession.createDataFrame([], "full_name long, kind string, class_name string")
    return graph.call_graph(none, calls, "ordinal")[1]


@query("SELECT s AS kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'external' ELSE 'method' END AS s FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey) GROUP BY s")
def call_graph_nodes(load):
    """Defined nodes, and external ones for unknown callees."""
    defs = load("customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("full_name"),
        F.lit("method").alias("kind"),
        F.lit(None).cast("string").alias("class_name"),
    )
    calls = load("orders").select(
        F.lit(-1).cast("long").alias("caller"),
        F.col("o_custkey").alias("callee"),
        F.lit("call").alias("edge_type"),
        F.col("o_orderkey").alias("ordinal"),
    )
    return graph.call_graph(defs, calls, "ordinal")[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'p' || l_partkey AS symbol, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS refs FROM lineitem GROUP BY l_partkey")
def symbol_index(load):
    """The sorted places that call each symbol."""
    refs = load("lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("ref"), F.array(F.concat(F.lit("p"), "l_partkey")).alias("symbols")
    )
    return graph.symbol_index(refs).select("symbol", F.array_join("refs", ",").alias("refs"))


@query("SELECT * FROM (VALUES ('pkg.a.A.go', 'main', 'pkg.a.main'), ('pkg.a.A.run', 'h', 'pkg.b.helper'), ('pkg.a.A.run', 'os.path.join', NULL), ('pkg.a.A.run', 'self.go', 'pkg.a.A.go'), ('pkg.a.main', 'A', 'pkg.a.A')) t(caller, symbol, callee)")
def source_facts(load):
    """Calls of an in-line module, resolved."""
    source = "import os\nfrom .b import helper as h\n\nclass A:\n    def run(self):\n        self.go()\n        h()\n        os.path.join('a')\n\n    def go(self):\n        main()\n\ndef main():\n    A()\n"
    files = load("region").sparkSession.createDataFrame(
        [("pkg.a", source, False), ("pkg.b", "def helper():\n    pass\n", False)],
        "module_name string, source string, is_package boolean",
    )
    return python_source.calls_with_targets(python_source.source_facts(files))


COSINE = "round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)"
CLUSTERS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE {COSINE} >= 0.4),
k AS MATERIALIZED (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4), q AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM k) AND b IN (FROM k)),
r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, q.b FROM r JOIN q ON q.a = r.b), m AS MATERIALIZED (SELECT a AS id, min(b) AS c FROM r GROUP BY a),
w AS (SELECT v.vec_id AS id, coalesce((SELECT c::VARCHAR FROM m WHERE m.id = v.vec_id), (SELECT min(c)::VARCHAR FROM p JOIN m ON m.id = p.b WHERE p.a = v.vec_id), '-1') AS cluster FROM embeddings v)"""


@query(f"{CLUSTERS} SELECT id, cluster FROM w")
def dbscan(load):
    """Density clusters of the vectors, by all pairs within a cosine of 0.4."""
    v = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.dbscan_vectors(v, 0.4, 4)


@query(
    f"{CLUSTERS} SELECT w.id, w.cluster, v.label, count(*) FILTER (WHERE w.cluster <> '-1') OVER (PARTITION BY w.cluster)::BIGINT AS size, (SELECT count(DISTINCT cluster) FROM w WHERE cluster <> '-1')::BIGINT AS n_clusters, (SELECT count(*) FROM w WHERE cluster = '-1')::BIGINT AS n_noise FROM w JOIN embeddings v ON v.vec_id = w.id",
)
def cluster_frame(load):
    """Points with their cluster, its size and their own columns, and the counts of clusters and noise."""
    v = load("embeddings")
    found = graph.dbscan_vectors(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.4, 4)
    frame = graph.cluster_frame(found, v.select(F.col("vec_id").alias("id"), "label"))
    return frame.join(F.broadcast(graph.cluster_counts(found)))


def _axes(rounds: int = 3000) -> str:
    """The first two principal axes, by power iterations on the covariance, the second kept at right angles to the first."""
    unit = "list_transform(w, lambda z: z / sqrt(list_sum(list_transform(w, lambda y: y * y))))"
    times = "list_transform(a, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] * v[i])))"
    start = "list_transform(range(1, len(a) + 1), lambda i: (1.0 + 0.01 * i)::DOUBLE)"
    square = "list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * f[i]))"
    signed = "list_transform(v, lambda z: z * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))]))"
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS MATERIALIZED (SELECT i, avg(x) AS m FROM x GROUP BY i), y AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM x JOIN m USING (i)),
c AS MATERIALIZED (SELECT i, list(c ORDER BY j) AS row FROM (SELECT p.i, q.i AS j, sum(p.x * q.x) AS c FROM y p JOIN y q USING (vec_id) GROUP BY p.i, q.i) GROUP BY i),
mat AS MATERIALIZED (SELECT list(row ORDER BY i) AS a FROM c),
u AS (SELECT 0 AS k, {start} AS v FROM mat UNION ALL SELECT k + 1, {unit} FROM (SELECT k, {times} AS w FROM u, mat) WHERE k < {rounds}),
e AS MATERIALIZED (SELECT v AS f FROM u WHERE k = {rounds}),
t AS (SELECT 0 AS k, {start} AS v FROM mat UNION ALL SELECT k + 1, {unit} FROM (SELECT k, {times.replace("v[i]", "(v[i] - o * f[i])")} AS w FROM (SELECT k, v, f, {square} AS o FROM t, e), mat) WHERE k < {rounds}),
g AS MATERIALIZED (SELECT {signed} AS one FROM (SELECT f AS v FROM e)), h AS MATERIALIZED (SELECT {signed} AS two FROM t WHERE k = {rounds})"""


@query(
    f"{_axes()} SELECT vec_id, round(list_sum(list_transform(range(1, len(one) + 1), lambda i: one[i] * embedding[i]::DOUBLE)), 4) AS x, round(list_sum(list_transform(range(1, len(two) + 1), lambda i: two[i] * embedding[i]::DOUBLE)), 4) AS y FROM embeddings, g, h",
)
def reduce_dimensions(load):
    """Principal components in place of neighbour embeddings."""
    return graph.reduce_dimensions(load("embeddings"), "embedding", 2).select(
        "vec_id", F.round(F.get("reduced", 0), 4).alias("x"), F.round(F.get("reduced", 1), 4).alias("y")
    )
