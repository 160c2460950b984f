"""The planning domain over the driver's tables: one function for each domain table, and the
same table as a DuckDB common table expression in CTE.

Parts are items (below 25: raw resources) whose recipes take two smaller parts, so recipes are
acyclic; orders are deliveries in five phases; embeddings are sockets in space; events are a
raster of 100 columns; nations are sites, linked where one buys more from another than it sells
to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import table

#: Parts below this number are raw resources.
RAW = 25


def items(spark: SparkSession, sf: str) -> DataFrame:
    """item, raw, form, stack."""
    form = F.element_at(F.array(F.lit("solid"), F.lit("liquid"), F.lit("gas")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_partkey") < RAW).alias("raw"), form.alias("form"), (50 * (1 + F.col("p_size") % 4)).alias("stack"))


def recipe_io(spark: SparkSession, sf: str) -> DataFrame:
    """parent, ord, child, amount, made (outputs of a cycle)."""
    part = table(spark, sf, "part").where(F.col("p_partkey") >= RAW)
    io = F.array(F.struct(F.lit(1).alias("ord"), F.expr("p_partkey div 2").alias("child"), (1 + F.col("p_size") % 4).alias("amount")), F.struct(F.lit(2).alias("ord"), F.expr("p_partkey div 3").alias("child"), (1 + F.col("p_size") % 3).alias("amount")))
    return part.select(F.col("p_partkey").alias("parent"), F.explode(io).alias("e"), (1 + F.col("p_partkey") % 2).alias("made")).select("parent", "e.ord", "e.child", "e.amount", "made")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """parent, child, qty: of child for one parent."""
    return recipe_io(spark, sf).select("parent", "child", (F.col("amount") / F.col("made")).alias("qty"))


def alternates(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of alternate recipes: every seventh part can be made of one other part."""
    part = table(spark, sf, "part").where((F.col("p_partkey") >= RAW) & (F.col("p_partkey") % 7 == 0))
    return part.select(F.col("p_partkey").alias("parent"), F.expr("p_partkey div 4").alias("child"), (2.0 + F.col("p_size") % 3).alias("qty"))


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """phase, item, qty of all that is ordered."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("phase"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("phase", F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("qty"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """target: every delivered item that is made."""
    return table(spark, sf, "lineitem").where(F.col("l_partkey") >= RAW).select(F.col("l_partkey").alias("target")).distinct()


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    """nation, region, item, qty: what each nation's customers order most of, among items that are
    made; the smallest item among equals."""
    lines = table(spark, sf, "lineitem").where(F.col("l_partkey") >= RAW).select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("nation", F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("qty"))
    best = rows.groupBy("nation").agg(F.max(F.struct("qty", (-F.col("item")).alias("no"))).alias("m")).select("nation", (-F.col("m.no")).alias("item"), F.col("m.qty").alias("qty"))
    return best.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation")


def sockets(spark: SparkSession, sf: str) -> DataFrame:
    """id, x, y, z, item, purity."""
    at = lambda i: (F.element_at("embedding", i).cast("double") * 1000)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.col("label").alias("item"), (F.col("vec_id") % 3).cast("int").alias("purity"))


def terrain(spark: SparkSession, sf: str) -> DataFrame:
    """id, r, c, z, kind: a raster of 100 columns."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("cast(event_id div 100 as int)").alias("r"), (F.col("event_id") % 100).cast("int").alias("c"), F.col("value").alias("z"), F.col("event_type").alias("kind"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, cost: directed links from a nation to those it buys more lines from than they do from
    it."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    supp = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    forth = F.when(F.col("a") < F.col("b"), 1).otherwise(-1)
    net = joined.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum(forth).alias("net"), F.count_if(forth == 1).alias("there"), F.count_if(forth == -1).alias("back"))
    return net.where("net <> 0").select(F.when(F.col("net") > 0, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("net") > 0, F.col("y")).otherwise(F.col("x")).alias("b"), (1 + F.greatest("there", "back") % 97).cast("double").alias("cost"))


def schematics(spark: SparkSession, sf: str) -> DataFrame:
    """id, kind, tier, recipe: each part unlocks itself."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), (F.col("p_size") % 10).alias("tier"), F.col("p_partkey").alias("recipe"))


CTE = {
    "item": "SELECT p_partkey AS item, p_partkey < 25 AS raw, ['solid','liquid','gas'][(p_size % 3 + 1)::INT] AS form, 50 * (1 + p_size % 4) AS stack FROM part",
    "recipe_io": "SELECT p_partkey AS parent, 1 AS ord, p_partkey // 2 AS child, 1 + p_size % 4 AS amount, 1 + p_partkey % 2 AS made FROM part WHERE p_partkey >= 25 UNION ALL SELECT p_partkey, 2, p_partkey // 3, 1 + p_size % 3, 1 + p_partkey % 2 FROM part WHERE p_partkey >= 25",
    "edge": "SELECT parent, child, amount / made AS qty FROM recipe_io",
    "alternate": "SELECT p_partkey AS parent, p_partkey // 4 AS child, 2.0::DOUBLE + p_size % 3 AS qty FROM part WHERE p_partkey >= 25 AND p_partkey % 7 = 0",
    "delivery": "SELECT substr(o_orderpriority, 1, 1)::INT AS phase, l_partkey AS item, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "target": "SELECT DISTINCT l_partkey AS target FROM lineitem WHERE l_partkey >= 25",
    "socket": "SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z, label AS item, (vec_id % 3)::INT AS purity FROM embeddings",
    "terrain": "SELECT event_id AS id, (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, value AS z, event_type AS kind FROM events",
    "trade": "SELECT CASE WHEN net > 0 THEN x ELSE y END AS a, CASE WHEN net > 0 THEN y ELSE x END AS b, (1 + greatest(there, back) % 97)::DOUBLE AS cost FROM (SELECT least(c_nationkey, s_nationkey) AS x, greatest(c_nationkey, s_nationkey) AS y, count(*) FILTER (c_nationkey < s_nationkey) AS there, count(*) FILTER (c_nationkey > s_nationkey) AS back, there - back AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) WHERE net <> 0",
    "schematic": "SELECT p_partkey AS id, p_type AS kind, p_size % 10 AS tier, p_partkey AS recipe FROM part",
}

#: Least costs between nations: p (source, node, cost).
_PATHS = """p(source, node, cost) USING KEY (source, node) AS (SELECT DISTINCT a, a, 0.0::DOUBLE FROM trade UNION
  SELECT n.source, n.b, n.cost FROM (SELECT v.source, t.b, min(v.cost + t.cost) AS cost FROM p v JOIN trade t ON t.a = v.node GROUP BY 1, 2) n LEFT JOIN recurring.p u ON u.source = n.source AND u.node = n.b WHERE u.cost IS NULL OR n.cost < u.cost)"""
#: Components of `node` over `link`, which has both directions: cc (id, comp).
_CC = """cc(id, comp) USING KEY (id) AS (SELECT id, id FROM node UNION
  SELECT n.id, n.comp FROM (SELECT l.a AS id, min(v.comp) AS comp FROM cc v JOIN link l ON l.b = v.id GROUP BY 1) n JOIN recurring.cc u ON u.id = n.id WHERE n.comp < u.comp)"""
_LINKS = """orders_ AS (SELECT o_custkey AS cust, o_orderdate::DATE AS day, o_orderpriority AS p, o_orderkey FROM orders),
node AS (SELECT DISTINCT cust AS id FROM orders_), e AS (SELECT cust AS a, lead(cust) OVER (PARTITION BY day, p ORDER BY cust, o_orderkey) AS b FROM orders_),
link AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b), """ + _CC


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query over the named domain tables; `body` may start with more expressions, each
    ended by a comma, before its SELECT."""
    heads = ", ".join(f"{n} AS ({CTE[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}{', ' if heads and body.lstrip()[:6].upper() != 'SELECT' else ' '}{body}"
