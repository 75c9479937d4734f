"""A star catalogue over order tables: orders are the cells, line items the values, parts the features."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.catalog import Dimension, Field, StarCatalog
from cellframe.schemas import table

SCHEMAS = {
    "orders": table(
        "o_orderkey long", "o_custkey long", "o_orderstatus", "o_totalprice double", "o_orderdate timestamp",
        "o_orderpriority",
    ),
    "customer": table("c_custkey long", "c_name", "c_nationkey int", "c_acctbal double", "c_mktsegment"),
    "nation": table("n_nationkey int", "n_name", "n_regionkey int"),
    "region": table("r_regionkey int", "r_name"),
    "part": table("p_partkey long", "p_name", "p_brand", "p_type", "p_size int", "p_retailprice double"),
}

RETAIL_CATALOG = StarCatalog(
    root="orders",
    root_key="o_orderkey",
    dimensions=(
        Dimension("customer", "c_custkey", "orders", "o_custkey"),
        Dimension("nation", "n_nationkey", "customer", "c_nationkey"),
        Dimension("region", "r_regionkey", "nation", "n_regionkey"),
    ),
    required=("customer",),
    bundle_dimensions=("customer", "nation"),
    values="lineitem",
    value_cell="l_orderkey",
    value_feature="l_partkey",
    value_type="l_returnflag",
    value_column="l_quantity",
    served_type="N",
    features="part",
    feature_key="p_partkey",
    feature_name="p_name",
    gene_flag="isgene",
    feature_species="p_type",
    fields=(
        Field("order_total", "orders", "o_totalprice", "numeric", "Total price of the order."),
        Field("order_status", "orders", "o_orderstatus", description="State of the order."),
        Field("order_priority", "orders", "o_orderpriority", description="Priority of the order."),
        Field("customer_id", "customer", "c_custkey", description="Customer who placed the order."),
        Field("customer_balance", "customer", "c_acctbal", "numeric", "Account balance of the customer."),
        Field("segment", "customer", "c_mktsegment", description="Market segment of the customer."),
        Field("nation", "nation", "n_name", description="Nation of the customer."),
        Field("region", "region", "r_name", description="Region of the customer's nation."),
    ),
    schemas=SCHEMAS,
    default_fields=("orders.o_totalprice", "orders.o_orderpriority", "customer.*", "nation.n_name", "region.r_name"),
    bundle_fields=("orders.o_totalprice", "orders.o_orderpriority", "customer.c_custkey", "nation.n_name"),
    bundle_column="customer.c_custkey",
    barcode_column="orders.o_orderpriority",
    species_field="segment",
    species_fields=("segment",),
    species=("FURNITURE", "MACHINERY"),
    default_species="FURNITURE",
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def retail_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The order tables under their catalogue names; parts above size 25 play the genes."""
    tables = {name: read(spark, folder, name) for name in ("orders", "customer", "nation", "region", "lineitem")}
    tables["part"] = read(spark, folder, "part").withColumn("isgene", F.col("p_size") > 25)
    return tables
