"""Queries over link graphs and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import table
from .registry import query

_LINKS = "links AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem)"
_EDGES = f"{_LINKS}, nodes AS (SELECT p_partkey AS node FROM part WHERE p_size > 10), edges AS (SELECT DISTINCT source, target FROM links WHERE source != target AND source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes))"


def _edges(spark, sf) -> DataFrame:
    """Parts that follow each other in an order, between active parts."""
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), nxt.alias("target"))
    return graph.edges(links, table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_EDGES} SELECT source, target FROM edges")
def edge_projection(spark, sf):
    return _edges(spark, sf)


_SEEDS = "seeds AS (SELECT p_brand AS query, p_partkey AS node, p_retailprice AS s, p_partkey % 2 = 0 AS passes FROM part WHERE p_size = 50)"


def _hop_sql(n: int, before: str, seen: str, decay: float) -> str:
    return f"""r{n} AS (SELECT f.query, b.target AS node, f.s, f.path || '>' || CAST(b.target AS VARCHAR) AS path FROM {before} f JOIN both_ways b ON f.node = b.source ANTI JOIN ({seen}) v ON v.query = f.query AND v.node = b.target),
b{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, node ORDER BY s DESC, path) AS k FROM r{n}) WHERE k = 1),
c{n} AS (SELECT query, node, s, path FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s * {decay}, 9) DESC, node) AS place FROM b{n}) WHERE place <= 10)"""


_EXPAND = f"""{_EDGES}, {_SEEDS}, both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
f0 AS (SELECT query, node, s, CAST(node AS VARCHAR) AS path FROM seeds WHERE passes),
{_hop_sql(1, "f0", "SELECT query, node FROM f0", 0.5)},
{_hop_sql(2, "c1", "SELECT query, node FROM f0 UNION ALL SELECT query, node FROM c1", 0.25)},
found AS (SELECT o.* FROM (SELECT query, 1 AS hop, node, s * 0.5 AS score, path FROM c1 UNION ALL SELECT query, 2, node, s * 0.25, path FROM c2) o ANTI JOIN seeds USING (query, node))"""


def _expanded(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size = 50")
    seeds = parts.select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"), (F.col("p_partkey") % 2 == 0).alias("passes"))
    return graph.expand(seeds, _edges(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_EXPAND} SELECT query, hop, node, round(score, 6) AS score, path FROM found WHERE hop = 1")
def expand_hop1(spark, sf):
    return _expanded(spark, sf).where("hop = 1")


@query(f"WITH {_EXPAND} SELECT query, hop, node, round(score, 6) AS score, path FROM found")
def expand_2hop(spark, sf):
    return _expanded(spark, sf)


_TREE = """t AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, r_regionkey * 10 + 5 AS ordinal FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey * 7 % 25 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 50 FROM customer)"""
_WALK = f"""{_TREE}, walk AS (SELECT node, 0 AS depth, node AS path, 0 AS pass, ordinal FROM t WHERE parent IS NULL
UNION ALL SELECT t.node, depth + 1, path || '>' || t.node, pass + CASE WHEN t.ordinal < w.ordinal THEN 1 ELSE 0 END, t.ordinal FROM t JOIN walk w ON t.parent = w.node)"""


def _tree(spark, sf) -> DataFrame:
    """Regions, nations and customers as one tree (node, parent, ordinal)."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") * 10 + 5).cast("long").alias("ordinal"))
    nations = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), (F.col("n_nationkey") * 7 % 25).cast("long").alias("ordinal"))
    customers = table(spark, sf, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"), (F.col("c_custkey") % 50).cast("long").alias("ordinal"))
    return regions.unionByName(nations).unionByName(customers)


def _with_ancestors(spark, sf) -> DataFrame:
    tree = _tree(spark, sf)
    return tree.join(graph.closure(tree), "node", "left")


@query(f"WITH RECURSIVE {_WALK} SELECT node, path FROM walk")
def page_tree(spark, sf):
    """Each page with its path from the root; a path is as long as the tree is deep."""
    up = F.array_sort(F.collect_list(F.when(F.col("ancestor").isNotNull(), F.struct((-F.col("depth")).alias("d"), "ancestor"))))
    return _with_ancestors(spark, sf).groupBy("node").agg(up.alias("up")).select("node", F.array_join(F.concat(F.transform("up", lambda a: a["ancestor"]), F.array("node")), ">").alias("path"))


@query(f"WITH RECURSIVE {_WALK} SELECT node, CAST(depth AS INTEGER) AS depth FROM walk")
def tree_flatten_depth(spark, sf):
    return _with_ancestors(spark, sf).groupBy("node").agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


@query(f"WITH RECURSIVE {_WALK} SELECT node, EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 5 = 0 AND contains('>' || path || '>', '>n' || n_nationkey || '>') AND node != 'n' || n_nationkey) AS blocked FROM walk")
def ancestor_closure(spark, sf):
    """Blocked if any page above it is rejected."""
    rejected = table(spark, sf, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ancestor"), F.lit(True).alias("bad"))
    return _with_ancestors(spark, sf).join(rejected, "ancestor", "left").groupBy("node").agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("blocked"))


@query(f"WITH RECURSIVE {_WALK} SELECT node, CAST(depth AS INTEGER) AS depth FROM walk WHERE starts_with(path, 'r1>')")
def branch_closure(spark, sf):
    """All pages below one page."""
    return _with_ancestors(spark, sf).where("ancestor = 'r1'").select("node", "depth")


@query(f"WITH RECURSIVE {_WALK} SELECT node, CAST(pass AS BIGINT) AS pass, CAST(ordinal AS BIGINT) AS ordinal FROM walk")
def topo_order(spark, sf):
    """When each page is applied, parents first: by (pass, ordinal). A page waits one pass more than its parent if it stands before it."""
    tree = _tree(spark, sf)
    own = tree.select(F.col("node").alias("parent"), F.col("ordinal").alias("above"))
    late = tree.join(own, "parent", "left").select("node", "ordinal", F.coalesce(F.col("ordinal") < F.col("above"), F.lit(False)).cast("long").alias("late"))
    higher = graph.closure(tree).join(late.select(F.col("node").alias("ancestor"), F.col("late").alias("up")), "ancestor").groupBy("node").agg(F.sum("up").alias("up"))
    return late.join(higher, "node", "left").select("node", (F.col("late") + F.coalesce("up", F.lit(0))).alias("pass"), "ordinal")


#: Ten suppliers a plan: a root, some levels, and in every third plan a cycle.
_PLANS = """n AS (SELECT s_suppkey // 10 AS plan, s_suppkey AS node, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 < 3 THEN s_suppkey - s_suppkey % 10
 WHEN s_suppkey % 10 < 7 THEN s_suppkey - 1 WHEN s_suppkey // 10 % 3 > 0 THEN s_suppkey - s_suppkey % 10 WHEN s_suppkey % 10 < 9 THEN s_suppkey + 1 ELSE s_suppkey - 2 END AS parent,
 'T' || (s_suppkey % 4) AS title, CASE WHEN s_suppkey % 20 = 0 THEN 'synthesis' ELSE 'leaf' END AS kind FROM supplier)"""
_REACH = f"{_PLANS}, reach AS (SELECT node, parent AS anc, 1 AS depth FROM n WHERE parent IS NOT NULL UNION SELECT r.node, n.parent, depth + 1 FROM reach r JOIN n ON r.anc = n.node WHERE n.parent IS NOT NULL AND depth < 12), near AS (SELECT node, anc, min(depth) AS depth FROM reach GROUP BY node, anc)"


def _plans(spark, sf) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    place, plan = k % 10, F.floor(k / 10)
    parent = F.when(place == 0, None).when(place < 3, k - place).when(place < 7, k - 1).when(plan % 3 > 0, k - place).when(place < 9, k + 1).otherwise(k - 2)
    return table(spark, sf, "supplier").select(plan.alias("plan"), k.alias("node"), parent.alias("parent"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("title"), F.when(k % 20 == 0, "synthesis").otherwise("leaf").alias("kind"))


@query(f"WITH RECURSIVE {_REACH} SELECT node FROM near WHERE node = anc")
def cycle_check(spark, sf):
    """Pages that are above themselves."""
    return graph.closure(_plans(spark, sf)).where("cyclic").select("node")


@query(f"""WITH RECURSIVE {_REACH}, kids AS (SELECT plan, parent, count(*) AS n, count(DISTINCT lower(title)) AS titles FROM n WHERE parent IS NOT NULL GROUP BY plan, parent),
per AS (SELECT plan, count(*) AS c, count(*) FILTER (parent IS NULL) AS roots, count(*) FILTER (parent IS NULL AND kind != 'synthesis') AS odd FROM n GROUP BY plan)
SELECT plan, 'root_count' AS rule FROM per WHERE roots != 1 UNION SELECT plan, 'root_kind' FROM per WHERE odd > 0 UNION SELECT plan, 'too_many_nodes' FROM per WHERE c > 50
UNION SELECT plan, 'missing_parent' FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM n) UNION SELECT plan, 'fan_out' FROM kids WHERE n > 8 UNION SELECT plan, 'sibling_title' FROM kids WHERE titles < n
UNION SELECT plan, 'cycle' FROM near JOIN n USING (node) WHERE node = anc UNION SELECT plan, 'depth' FROM near JOIN n USING (node) WHERE depth >= 4 AND node != anc
UNION SELECT plan, 'unreachable' FROM n WHERE parent IS NOT NULL AND node NOT IN (SELECT near.node FROM near JOIN n r ON near.anc = r.node WHERE r.parent IS NULL)
UNION SELECT plan, CASE WHEN role IS NULL THEN 'role_missing' ELSE 'role_mismatch' END FROM (SELECT *, CASE node % 6 WHEN 0 THEN 'root' WHEN 1 THEN 'category' END AS role FROM n) WHERE CASE WHEN role IS NULL THEN parent IS NOT NULL ELSE role IS DISTINCT FROM CASE WHEN parent IS NULL THEN 'root' END END""")
def plan_tree_rules(spark, sf):
    role = F.when(F.col("node") % 6 == 0, "root").when(F.col("node") % 6 == 1, "category")
    return graph.tree_rules(_plans(spark, sf).withColumn("role", role))


@query("SELECT o_orderkey AS version, lag(o_orderkey) OVER w AS parent, CASE WHEN o_orderstatus = 'P' THEN first_value(o_orderkey) OVER w END AS restores FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_chain(spark, sf):
    """Each version with the one it follows, and the one that a restoring version goes back to."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("parent"), F.when(F.col("o_orderstatus") == "P", F.first("o_orderkey").over(w)).alias("restores"))
