"""The trade graph: customers, suppliers, parts and nations from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import LabeledGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str, every_item: bool = False) -> LabeledGraph:
    """Ids are key * 4 + kind (0 customer, 1 supplier, 2 part, 3 nation). Large returned line items, or all of them, link customer, supplier and part; nations link to who is in them."""
    c, s, p, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "nation"))
    key = lambda column, kind: F.col(column).cast("long") * 4 + kind
    vertices = (
        c.select(key("c_custkey", 0).alias("id"), F.col("c_mktsegment").alias("label"))
        .unionAll(s.select(key("s_suppkey", 1), F.lit("SUPPLIER")))
        .unionAll(p.select(key("p_partkey", 2), F.col("p_type")))
        .unionAll(n.select(key("n_nationkey", 3), F.concat(F.lit("NATION,R"), F.col("n_regionkey").cast("string"))))
    )
    items = table(spark, sf_dir, "lineitem")
    if not every_item:
        items = items.filter((F.col("l_quantity") >= 48) & (F.col("l_returnflag") == "R"))
    items = items.select("l_orderkey", "l_suppkey", "l_partkey")
    trade = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    cust, supp, part = key("o_custkey", 0), key("l_suppkey", 1), key("l_partkey", 2)
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    edges = trade.select(F.inline(F.array(pair(cust, supp), pair(supp, part), pair(cust, part))))
    edges = edges.unionAll(c.select(key("c_custkey", 0), key("c_nationkey", 3))).unionAll(s.select(key("s_suppkey", 1), key("s_nationkey", 3)))
    return LabeledGraph.of(vertices, edges)
