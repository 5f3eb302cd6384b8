"""Link graphs and trees: edge projection, gated expansion, closures, orders, rule checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import kept

DECAY = (0.5, 0.25)
PER_HOP = 10


def edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source, target) between known nodes (column ``node``), without self loops."""
    known = lambda c: nodes.select(F.col("node").alias(c))
    return links.select("source", "target").where("source != target").distinct().join(known("source"), "source", "left_semi").join(known("target"), "target", "left_semi")


def expand(seeds: DataFrame, links: DataFrame, per_hop: int = PER_HOP, decay: tuple[float, ...] = DECAY) -> DataFrame:
    """(query, hop, node, score, path): best paths from gated seeds over links in both directions.

    ``seeds``: (query, node, score, passes). Hop h scores seed score times decay[h]; per node the best path counts,
    ties by path; per query and hop the best ``per_hop`` go on. Nodes seen before aren't reached again; seeds that
    did not pass may be gone through, but are not returned.
    """
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    frontier = seeds.where("passes").select("query", "node", F.col("score").alias("seed_score"), F.col("node").cast("string").alias("path"))
    seen = frontier.select("query", "node")
    out = None
    for hop, factor in enumerate(decay, 1):
        reached = (
            frontier.join(both, frontier["node"] == both["source"])
            .select("query", F.col("target").alias("node"), "seed_score", F.concat_ws(">", "path", F.col("target").cast("string")).alias("path"))
            .join(seen, ["query", "node"], "left_anti")
        )
        best = reached.groupBy("query", "node").agg(F.min_by(F.struct("seed_score", "path"), F.struct((-F.col("seed_score")).alias("s"), "path")).alias("b")).select("query", "node", "b.*")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.round(F.col("seed_score") * factor, 9).desc(), "node"))
        chosen = best.withColumn("place", place).where(F.col("place") <= per_hop)
        emitted = chosen.select("query", F.lit(hop).alias("hop"), "node", (F.col("seed_score") * factor).alias("score"), "path")
        out = emitted if out is None else out.unionByName(emitted)
        frontier = chosen.select("query", "node", "seed_score", "path")
        seen = seen.unionByName(frontier.select("query", "node"))
    return out.join(seeds.select("query", "node"), ["query", "node"], "left_anti").select("query", "hop", "node", "score", "path")


def closure(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth, cyclic) from (node, parent): all ancestors, found by joins that double the distance each time.

    Each step is written to the shared folder, so plans stay small; it ends when no new pair is found. A node on a
    cycle is its own ancestor and marked. Rows grow with the number of nodes times their depth.
    """
    found = kept(parents.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    pairs = found.count()
    while pairs:
        further = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        found, before = kept(found.unionByName(further).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure"), pairs
        pairs = found.count()
        if pairs == before:
            break
    return found.withColumn("cyclic", F.col("node") == F.col("ancestor"))


# The roles of pages below the root, by their kind.
ROLES = {"concept": "category", "entity": "entity", "source-summary": "source"}


def tree_rules(nodes: DataFrame, most_nodes: int = 50, fan_out: int = 8, most_depth: int = 4) -> DataFrame:
    """(plan, rule) for plans (plan, node, parent, title, kind, and maybe role) that break a rule of a plan tree.

    A stated role must be the one that the place and kind of a node give it; a node of another kind must state one.
    """
    per = nodes.groupBy("plan").agg(
        F.count("*").alias("n"), F.countDistinct("node").alias("ids"), F.count_if(F.col("parent").isNull()).alias("roots"),
        F.count_if(F.col("parent").isNull() & (F.col("kind") != "synthesis")).alias("odd_roots"),
    )
    rule = lambda condition, name: F.when(condition, name)
    counted = per.select("plan", F.explode(F.array_compact(F.array(
        rule(F.col("n") > most_nodes, "too_many_nodes"), rule(F.col("ids") != F.col("n"), "duplicate_node"), rule(F.col("roots") != 1, "root_count"), rule(F.col("odd_roots") > 0, "root_kind"),
    ))).alias("rule"))
    orphans = nodes.where("parent is not null").join(nodes.select("plan", F.col("node").alias("parent")).distinct(), ["plan", "parent"], "left_anti").select("plan", F.lit("missing_parent").alias("rule"))
    children = nodes.where("parent is not null").groupBy("plan", "parent").agg(F.count("*").alias("n"), F.countDistinct(F.lower("title")).alias("titles"))
    wide = children.where(F.col("n") > fan_out).select("plan", F.lit("fan_out").alias("rule"))
    same = children.where(F.col("titles") < F.col("n")).select("plan", F.lit("sibling_title").alias("rule"))
    key = lambda c: F.struct("plan", F.col(c).alias("node"))
    above = closure(nodes.select(key("node").alias("node"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    cyclic = above.where("cyclic").select("node.plan", F.lit("cycle").alias("rule"))
    deep = above.where((F.col("depth") >= most_depth) & ~F.col("cyclic")).select("node.plan", F.lit("depth").alias("rule"))
    keyed = nodes.select("plan", key("node").alias("node"), "parent", "kind", *(["role"] if "role" in nodes.columns else []))
    roots = keyed.where("parent is null").select(F.col("node").alias("ancestor"))
    reached = above.join(roots, "ancestor", "left_semi").select("node").distinct()
    lost = keyed.where("parent is not null").join(reached, "node", "left_anti").select("plan", F.lit("unreachable").alias("rule"))
    out = counted.unionByName(lost)
    if "role" in nodes.columns:
        by_kind = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        wanted = F.when(F.col("parent").isNull(), "root").otherwise(by_kind[F.col("kind")])
        bad = F.when(F.col("role").isNotNull() & ~F.col("role").eqNullSafe(wanted), "role_mismatch").when(F.col("role").isNull() & wanted.isNull(), "role_missing")
        out = out.unionByName(keyed.select("plan", bad.alias("rule")).where("rule is not null"))
    for more in (orphans, wide, same, cyclic, deep):
        out = out.unionByName(more)
    return out.distinct()
