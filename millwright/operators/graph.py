"""Graph operators as rounds of joins, each round a written table.

Components follow the smallest neighbour; shortest paths relax all edges of the frontier at
once. Edges are written once, so a round reads them and not the plan they came from, and lineage
never grows past one round. Rounds end by themselves; what could go on for ever (a cycle where
there must be none) is told from a long chain by the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.guards import Refusal
from millwright.session import staged

#: Rounds after which nodes are counted, to tell a cycle from a long chain.
FIRST_COUNT = 8


def _nodes(edges: DataFrame) -> int:
    return edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().count()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for nodes (id) over undirected edges (a, b): the smallest id reachable.

    A round takes the smallest label among the neighbours and then the label's own label, so
    long chains halve with every round. Labels only ever fall, so the rounds end."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "component-edges")
    now = staged(nodes.select("id", F.col("id").alias("component")), "components")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "component").hint("merge"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = now.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("p"), "component")
        hooked = staged(hooked, "components", instead_of=now)
        roots = hooked.groupBy(F.col("component").alias("p0")).agg(F.min("p").alias("best"))  # a label hooks as a whole
        moved = hooked.join(roots, F.col("component") == F.col("p0")).select("id", "component", F.least("p", "best").alias("p"))
        jump = moved.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        after = moved.join(jump, "p", "left").select("id", F.least("p", F.coalesce("pp", "p")).alias("component"), F.col("component").alias("was"))
        now = staged(after, "components", instead_of=hooked)
        if now.where("component <> was").isEmpty():
            return now.select("id", "component")


def shortest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost, prev, hops): least cost over directed edges (a, b, cost) from each
    source (source), the node before on that path (the smallest among equals) and its edges. A
    negative cycle is refused."""
    kind = dict(edges.dtypes)["a"]
    edges = staged(edges.select("a", "b", F.col("cost").cast("double").alias("w")), "path-edges")
    best = front = staged(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("prev"), F.lit(0).alias("hops")), "paths")
    step, most = 0, FIRST_COUNT
    while True:
        step += 1
        if step > most and step > (most := _nodes(edges)):
            raise Refusal("negative cycle", step, [])
        reach = front.join(edges, front["node"] == edges["a"])
        reach = reach.groupBy("source", F.col("b").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("prev"), (F.col("hops") + 1).alias("hops"))).alias("n"))
        known = best.select("source", "node", F.col("cost").alias("old"))
        better = reach.join(known, ["source", "node"], "left").where(F.col("old").isNull() | (F.col("n.cost") < F.col("old"))).select("source", "node", "n.*")
        front = staged(better, "path-front")
        if front.isEmpty():
            return best
        kept = best.join(front.select("source", "node"), ["source", "node"], "left_anti")
        best = staged(kept.unionByName(front), "paths", instead_of=best if step > 1 else None)


def paths(best: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, target, step, node) of the paths in `best` to the given ends (source, target),
    step 0 at the source."""
    best = staged(best.select("source", "node", "prev", "hops"), "path-best")
    now = staged(ends.join(best.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", F.col("target").alias("node"), F.col("hops").alias("step")), "path-steps")
    out = now
    while True:  # a step of a path has a smaller number than the one before, and none is below 0
        back = now.join(best.select("source", "node", "prev"), ["source", "node"]).where(F.col("prev").isNotNull() & (F.col("step") > 0))
        now = staged(back.select("source", "target", F.col("prev").alias("node"), (F.col("step") - 1).alias("step")), "path-steps")
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a node that nothing points to, over directed edges
    (a, b); an order for sizing. A cycle is refused."""
    edges = staged(edges.select("a", "b").distinct(), "level-edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now, step, most = staged(nodes.withColumn("level", F.lit(0)), "levels"), 0, FIRST_COUNT
    front = now.select("node")
    while True:
        step += 1
        front = staged(front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct(), "level-front")
        if front.isEmpty():
            return now
        if step > most and step >= (most := now.count()):
            raise Refusal("cycle", step, [])
        now = staged(now.join(front.withColumn("up", F.lit(step)), "node", "left").select("node", F.coalesce("up", "level").alias("level")), "levels", instead_of=now if step > 1 else None)


def pair_summary(edges: DataFrame, value: str) -> DataFrame:
    """(a, b, n, least, most, total) by unordered pair."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))
