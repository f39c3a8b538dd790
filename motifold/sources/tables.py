"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.functions.predicates import Stored
from motifold.plans.graph import NodeTable, TableGraph, edge_table, node_table


#: Fixed schemas of the star-schema tables; stating them saves a job for each table that a graph is built from.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def priorities(orders: DataFrame) -> DataFrame:
    """The different priorities of each customer's orders, in order."""
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))


def order_lists(orders: DataFrame) -> DataFrame:
    """Arrays of each customer's orders: the different priorities; the prices above 400,000 (empty without any); the keys of those
    above 450,000 (null without any)."""
    over = lambda price, value: F.array_sort(F.collect_list(F.when(F.col("o_totalprice") > price, F.col(value))))
    lists = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), over(400000, "o_totalprice").alias("prices"), over(450000, "o_orderkey").alias("dear"))
    return lists.withColumn("dear", F.when(F.size("dear") > 0, F.col("dear")))


def star_graph(spark: SparkSession, sf_dir: str, with_lists: bool = False) -> TableGraph:
    """Customers, suppliers, nations, regions, parts (also labelled by type) and orders. with_lists: customers have order_lists()."""
    customer, supplier, nation, region, part, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem"))
    customers = node_table(customer, "c_custkey", "Customer", "customer")
    if with_lists:
        wide = customers.frame.join(order_lists(orders), "c_custkey", "left")
        customers = NodeTable(wide, customers.labels, customers.stored | {"priorities": Stored(strings=F.col("priorities"))} | {p: Stored(numbers=F.col(p)) for p in ("prices", "dear")})
    nodes = [customers, node_table(supplier, "s_suppkey", "Supplier", "supplier"), node_table(nation, "n_nationkey", "Nation", "nation"), node_table(region, "r_regionkey", "Region", "region"), node_table(part, "p_partkey", "Part", "part", "p_type"), node_table(orders, "o_orderkey", "Order", "order")]
    c, s, n, r = ("c_custkey", "customer", "Customer"), ("s_suppkey", "supplier", "Supplier"), "nation", "region"
    p = ("l_partkey", "part", "Part")
    edges = [
        edge_table(orders, "PLACED", ("o_custkey", "customer", "Customer"), ("o_orderkey", "order", "Order"), unique=True),
        edge_table(lineitem, "CONTAINS", ("l_orderkey", "order", "Order"), p),
        *[edge_table(lineitem.where(F.col("l_returnflag") == f), f"SHIPPED_{f}", ("l_suppkey", "supplier", "Supplier"), p) for f in "ANR"],
        edge_table(customer, "IN_NATION", c, ("c_nationkey", n, "Nation"), unique=True),
        edge_table(supplier, "IN_NATION", s, ("s_nationkey", n, "Nation"), unique=True),
        edge_table(nation, "IN_REGION", ("n_nationkey", n, "Nation"), ("n_regionkey", r, "Region"), unique=True),
    ]
    return TableGraph(nodes, edges)
