"""Matrix form: ordinals, coordinates, dense and sparse rows, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.operators import reshape
from cellframe.operators.metrics import matrix_metrics
from cellframe.plans.audits import duplicate_keys
from cellframe.retail.catalog import read, retail_tables
from cellframe.retail.registry import query
from cellframe.sinks.matrix import features_10x, matrix_size


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a matrix value: order by part."""
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("cellkey"),
        F.col("l_partkey").alias("featurekey"),
        F.col("l_quantity").alias("exprvalue"),
    )


def _by_brand(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every line item as a value of its part's brand, and the brands as the feature axis."""
    parts = read(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    values = _values(spark, folder).join(parts, F.col("featurekey") == F.col("p_partkey"))
    return (
        values.select("cellkey", F.col("brand").alias("featurekey"), "exprvalue"),
        reshape.ordinals(parts.select(F.col("brand").alias("featurekey")), "featurekey"),
    )


def _axes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ordinals of the gene parts, and of the orders that have line items."""
    parts = retail_tables(spark, folder)["part"].filter("isgene")
    cells = read(spark, folder, "orders").select(F.col("o_orderkey").alias("cellkey"))
    return reshape.axes(
        parts.select(F.col("p_partkey").alias("featurekey")),
        reshape.cells_with_values(cells, _values(spark, folder)),
    )


GENES_SQL = "(select p_partkey, row_number() over (order by p_partkey) as r from part where p_size > 25)"
CELLS_SQL = """(select o_orderkey, row_number() over (order by o_orderkey) as c from orders
  where o_orderkey in (select l_orderkey from lineitem))"""
COORDS_SQL = f"""select r as "row", c as col, sum(l_quantity) as "value"
  from lineitem join {GENES_SQL} g on l_partkey = p_partkey join {CELLS_SQL} k on l_orderkey = o_orderkey
  group by 1, 2 having sum(l_quantity) <> 0"""
BRANDS_SQL = "(select p_brand as b, row_number() over (order by p_brand) as r from (select distinct p_brand from part))"
ENTRIES_SQL = f"""(select l_orderkey as k, r, sum(l_quantity) as v
  from lineitem join part on l_partkey = p_partkey join {BRANDS_SQL} x on p_brand = b group by 1, 2)"""


@query("select o_orderkey as cellkey, row_number() over (order by o_orderkey) as ordinal from orders")
def cell_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.ordinals(read(spark, folder, "orders").select(F.col("o_orderkey").alias("cellkey")), "cellkey")


@query(COORDS_SQL)
def coords(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.coordinates(_values(spark, folder), *_axes(spark, folder), "sum")


@query(
    f"""select (select count(*) from {GENES_SQL})::bigint as features, (select count(*) from {CELLS_SQL})::bigint as cells,
    (select count(*) from ({COORDS_SQL}))::bigint as nonzero"""
)
def coords_header(spark: SparkSession, folder: str) -> DataFrame:
    features, cells = _axes(spark, folder)
    return matrix_size(features, cells, reshape.coordinates(_values(spark, folder), features, cells, "sum"))


DENSE_SQL = f"""select k as cellkey,
  list_transform(range(1, (select count(*) from {BRANDS_SQL}) + 1), lambda i: coalesce(m[i], 0.0)) as dense
  from (select k, map(list(r), list(v)) as m from {ENTRIES_SQL} group by k)"""


@query(f"select cellkey, array_to_string(list_transform(dense, lambda x: x::integer), ' ') as \"values\" from ({DENSE_SQL})")
def dense_rows(spark: SparkSession, folder: str) -> DataFrame:
    values, brands = _by_brand(spark, folder)
    rows = reshape.dense_rows(values, brands, brands.count(), "sum")
    return rows.select("cellkey", F.array_join(F.transform("values", lambda v: v.cast("int")), " ").alias("values"))


@query(
    f"""select cellkey, cellkey::varchar || ',' || array_to_string(
      list_transform(dense, lambda x: case when x = 0 then '0' else x::varchar end), ',') as line from ({DENSE_SQL})"""
)
def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    values, brands = _by_brand(spark, folder)
    return reshape.dense_lines(values, brands, brands.count(), ",", "sum")


@query(
    f"""select k as cellkey, string_agg(r::varchar, ' ' order by r) as indices,
    string_agg(v::integer::varchar, ' ' order by r) as "values" from (
      select l_orderkey as k, r, sum(l_quantity) as v from lineitem
      join (select p_partkey, row_number() over (order by p_partkey) as r from part) p on l_partkey = p_partkey
      group by 1, 2) group by 1"""
)
def sparse_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("featurekey"))
    rows = reshape.sparse_rows(_values(spark, folder), reshape.ordinals(parts, "featurekey"), "sum")
    return rows.select(
        "cellkey",
        F.array_join("indices", " ").alias("indices"),
        F.array_join(F.transform("values", lambda v: v.cast("int")), " ").alias("values"),
    )


@query(
    """select l_orderkey as cellkey, l_partkey as featurekey, count(*)::bigint as n from lineitem
    group by 1, 2 having count(*) > 1"""
)
def dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.duplicates(_values(spark, folder))


@query("select l_orderkey as cellkey, l_partkey as featurekey, sum(l_quantity) as exprvalue from lineitem group by 1, 2")
def one_per_pair(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.one_per_pair(_values(spark, folder), "sum")


@query(
    """select p_partkey as featurekey, p_name as featurename, 'Gene Expression' as featuretype_10x, p_brand, p_type
    from part where p_size > 25""",
    name="features_10x",
)
def tenx_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = retail_tables(spark, folder)["part"].filter("isgene")
    return features_10x(
        parts.select(F.col("p_partkey").alias("featurekey"), F.col("p_name").alias("featurename"), "p_brand", "p_type")
    )


def _dense(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as dense count rows: tenths, rounded down, so that zeros occur."""
    tenth = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("int"))
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("cellkey"), tenth.alias("values"))


TENTHS_SQL = """(select vec_id, unnest(list_transform(embedding, lambda x: floor(x::double * 10)::integer)) as v,
  unnest(range(0, len(embedding))) as p from embeddings)"""


@query(f"select vec_id as cellkey, 'f' || p::varchar as featurekey, v as exprvalue from {TENTHS_SQL} where v <> 0")
def dense_to_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dense(spark, folder)
    axis = (
        rows.select(F.posexplode("values").alias("position", "v"))
        .select("position")
        .distinct()
        .withColumn("featurekey", F.concat(F.lit("f"), F.col("position").cast("string")))
    )
    return reshape.dense_to_long(rows, axis).select("cellkey", "featurekey", "exprvalue")


@query(
    f"""select vec_id as cellkey, (count(*) filter (where v <> 0))::integer as genes_detected
    from {TENTHS_SQL} group by 1"""
)
def dense_nonzero_count(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder).select(
        "cellkey", reshape.nonzero_count(F.col("values")).cast("int").alias("genes_detected")
    )


@query(
    """select sum(l_quantity) as total, (count(*) filter (where l_quantity <> 0))::bigint as nonzero,
    count(distinct l_orderkey)::bigint as cells from lineitem""",
    name="matrix_metrics",
)
def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return matrix_metrics(_values(spark, folder))


@query("select p_name, count(*)::bigint as n from part group by 1 having count(*) > 1", name="duplicate_keys")
def repeated_names(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_keys(read(spark, folder, "part"), "p_name")
