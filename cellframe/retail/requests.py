"""Selections: filters, projections, species, bundle lists, field descriptions."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe.operators.reshape import cells_with_values, cells_without_values
from cellframe.operators.star import inner_chain
from cellframe.plans import audits
from cellframe.plans.describe import category, describe_all, describe_field, field_coverage
from cellframe.plans.request import MatrixRequest, bundle_request, fan_out_cells, fan_out_expression
from cellframe.plans.runs import run_request
from cellframe.retail.catalog import RETAIL_CATALOG, read, retail_tables
from cellframe.retail.registry import query
from cellframe.schemas import REQUEST_LOG
from cellframe.session import scratch_dir

# Joins of the catalogue, as SQL.
SNOW = """orders
  join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey"""
INNER_SNOW = """orders
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey"""
LEFT_SNOW = """orders
  left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey"""

NESTED = {
    "op": "or",
    "value": [
        {
            "op": "and",
            "value": [
                {"op": "in", "field": "region", "value": ["ASIA", "EUROPE"]},
                {"op": ">", "field": "order_total", "value": 150000},
            ],
        },
        {"op": "not", "value": [{"op": "=", "field": "segment", "value": "MACHINERY"}]},
    ],
}
NESTED_SQL = """((r_name in ('ASIA', 'EUROPE') and o_totalprice > 150000) or not (c_mktsegment = 'MACHINERY'))"""
SPECIES_FILTER = {
    "op": "and",
    "value": [
        {"op": ">=", "field": "order_total", "value": 100000},
        {"op": "not", "value": [{"op": "=", "field": "segment", "value": "BUILDING"}]},
    ],
}


def _request(spark: SparkSession, folder: str, filter_: dict | None, **options) -> MatrixRequest:
    return MatrixRequest(RETAIL_CATALOG, retail_tables(spark, folder), filter_, **options)


def _filtered(spark: SparkSession, folder: str, filter_: dict) -> DataFrame:
    # The dimension keys are unique in these tables (see the duplicate_keys query), so unused ones are not joined.
    return _request(
        spark, folder, filter_, fields=("order_total",), unique_dimensions=("nation", "region")
    ).cells()


def _cells_sql(where: str) -> str:
    return f"select o_orderkey as cellkey, o_totalprice as order_total from {SNOW} where {where}"


@query(_cells_sql("c_mktsegment = 'FURNITURE'"))
def filter_eq(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, {"op": "=", "field": "segment", "value": "FURNITURE"})


@query(_cells_sql("c_mktsegment <> 'FURNITURE'"))
def filter_ne(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, {"op": "!=", "field": "segment", "value": "FURNITURE"})


@query(_cells_sql("o_totalprice >= 100000 and o_totalprice < 250000 and c_acctbal <= 5000 and c_acctbal > 0"))
def filter_range(spark: SparkSession, folder: str) -> DataFrame:
    bounds = [
        {"op": ">=", "field": "order_total", "value": 100000},
        {"op": "<", "field": "order_total", "value": 250000},
        {"op": "<=", "field": "customer_balance", "value": 5000},
        {"op": ">", "field": "customer_balance", "value": "0"},
    ]
    return _filtered(spark, folder, {"op": "and", "value": bounds})


@query(_cells_sql("r_name in ('ASIA', 'EUROPE')"))
def filter_in(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, {"op": "in", "field": "region", "value": ["ASIA", "EUROPE"]})


@query(_cells_sql("c_nationkey in (1, 3)"))
def filter_in_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, {"op": "in", "field": "customer.c_nationkey", "value": [1, "n/a", 3]})


@query(_cells_sql("not (c_mktsegment = 'MACHINERY')"))
def filter_not(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, {"op": "not", "value": [{"op": "=", "field": "segment", "value": "MACHINERY"}]})


@query(_cells_sql(NESTED_SQL))
def filter_nested(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, NESTED)


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, c_mktsegment as segment, c_mktsegment as species
    from {SNOW} where o_totalprice >= 100000 and not (c_mktsegment = 'BUILDING')
    and c_mktsegment in ('FURNITURE', 'MACHINERY')"""
)
def filter_species(spark: SparkSession, folder: str) -> DataFrame:
    return fan_out_cells(_request(spark, folder, SPECIES_FILTER, fields=("order_total", "segment")))


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, c_mktsegment as segment, c_mktsegment as species
    from {SNOW} where o_totalprice >= 100000 and c_mktsegment = 'FURNITURE'"""
)
def filter_default_species(spark: SparkSession, folder: str) -> DataFrame:
    plain = {"op": ">=", "field": "order_total", "value": 100000}
    return fan_out_cells(_request(spark, folder, plain, fields=("order_total", "segment")))


@query(
    f"""select l_orderkey as cellkey, l_partkey as featurekey, l_quantity as exprvalue, c_mktsegment as species
    from lineitem join (select o_orderkey, c_mktsegment from {INNER_SNOW} where o_totalprice >= 100000
      and not (c_mktsegment = 'BUILDING') and c_mktsegment in ('FURNITURE', 'MACHINERY')) on l_orderkey = o_orderkey
    join part on l_partkey = p_partkey where p_size > 25 and l_returnflag = 'N'"""
)
def fan_out_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of both species that a filter lets through, in one scan."""
    return fan_out_expression(_request(spark, folder, SPECIES_FILTER))


def _features_sql(flag: str) -> str:
    return f"""select p_partkey as featurekey, p_name, p_brand, p_type, p_size, p_retailprice, p_size > 25 as isgene
    from part where {flag} and p_type = 'ECONOMY'"""


@query(_features_sql("p_size > 25"))
def feature_gene(spark: SparkSession, folder: str) -> DataFrame:
    return replace(_request(spark, folder, None), feature="gene", species="ECONOMY").features()


@query(_features_sql("not (p_size > 25)"))
def feature_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return replace(_request(spark, folder, None), feature="transcript", species="ECONOMY").features()


@query(
    f"""select o_orderkey as cellkey, l_partkey as featurekey, l_quantity as exprvalue
    from lineitem left join part on l_partkey = p_partkey join (select * from {INNER_SNOW}) on l_orderkey = o_orderkey
    where p_size > 25 and l_returnflag = 'N' and {NESTED_SQL}"""
)
def expression_select(spark: SparkSession, folder: str) -> DataFrame:
    return _request(spark, folder, NESTED).expression()


@query(
    f"""select o_orderkey as cellkey, l_partkey as featurekey, l_quantity as exprvalue
    from lineitem left join part on l_partkey = p_partkey join (select * from {INNER_SNOW}) on l_orderkey = o_orderkey
    where not (p_size > 25) and l_returnflag = 'R' and c_mktsegment = 'MACHINERY' and {NESTED_SQL}"""
)
def expression_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return _request(
        spark, folder, NESTED, feature="transcript", value_type="R", species="MACHINERY"
    ).expression()


@query(
    f"""select o_orderkey as cellkey, r_name as region, o_totalprice as order_total, n_name as nation,
    c_mktsegment as segment from {SNOW} where o_totalprice > 200000"""
)
def cells_select(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("region", "order_total", "nation", "customer.c_mktsegment")
    return _request(spark, folder, {"op": ">", "field": "order_total", "value": 200000}, fields=fields).cells()


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, o_orderpriority as order_priority,
    c_custkey as customer_id, c_name, c_nationkey, c_acctbal as customer_balance, c_mktsegment as segment,
    n_name as nation, r_name as region from {SNOW} where o_orderstatus = 'F'"""
)
def cells_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return _request(spark, folder, {"op": "=", "field": "order_status", "value": "F"}).cells()


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, o_orderpriority as order_priority
    from {SNOW} where {NESTED_SQL}"""
)
def barcode_append(spark: SparkSession, folder: str) -> DataFrame:
    return _request(spark, folder, NESTED, fields=("order_total",), format="mtx").cells()


def _bundle_list(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle list: the users with a purchase."""
    return read(spark, folder, "events").filter("event_type = 'purchase'").select("user_id").distinct()


BUNDLES_SQL = "(select distinct user_id from events where event_type = 'purchase')"


def _bundle_requests(spark: SparkSession, folder: str) -> dict[str, MatrixRequest]:
    return bundle_request(
        RETAIL_CATALOG, retail_tables(spark, folder), _bundle_list(spark, folder), check=False
    )


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, o_orderpriority as order_priority,
    c_custkey as customer_id, n_name as nation from {SNOW}
    where c_custkey in {BUNDLES_SQL} and c_mktsegment = 'FURNITURE'"""
)
def bundle_list_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_requests(spark, folder)["FURNITURE"].cells()


@query(
    f"""select o_orderkey as cellkey, l_partkey as featurekey, l_quantity as exprvalue
    from lineitem join part on l_partkey = p_partkey join (select * from {INNER_SNOW}) on l_orderkey = o_orderkey
    where p_size > 25 and l_returnflag = 'N' and c_custkey in {BUNDLES_SQL} and c_mktsegment = 'MACHINERY'"""
)
def bundle_list_expression(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_requests(spark, folder)["MACHINERY"].expression()


@query(
    f"""select count(*)::bigint as requested, count(c_custkey)::bigint as loaded
    from {BUNDLES_SQL} left join customer on user_id = c_custkey"""
)
def bundle_list_check(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_requests(spark, folder)["FURNITURE"].check_bundles()


@query(
    f"""select o_orderkey as cellkey, o_totalprice as order_total, o_orderpriority as order_priority,
    c_custkey as customer_id, n_name as nation from {SNOW} where o_orderpriority = '1-URGENT'"""
)
def cells_fixed_projection(spark: SparkSession, folder: str) -> DataFrame:
    fields = RETAIL_CATALOG.bundle_fields
    return _request(spark, folder, {"op": "=", "field": "order_priority", "value": "1-URGENT"}, fields=fields).cells()


def _filled(description: DataFrame) -> DataFrame:
    """Descriptions with blanks and zeros where a kind has no value, so that every column compares plainly."""
    return description.fillna("", ["value"]).fillna(0, ["cells", "minimum", "maximum"])


def _category_sql(field: str, column: str) -> str:
    return f"""select '{field}' as field, 'categorical' as kind, coalesce({column}::varchar, '') as value,
    count(o_orderkey)::bigint as cells, 0.0::double as minimum, 0.0::double as maximum from {LEFT_SNOW} group by 3"""


def _range_sql(field: str, column: str) -> str:
    return f"""select '{field}' as field, 'numeric' as kind, '' as value, 0::bigint as cells,
    min({column}) as minimum, max({column}) as maximum from {LEFT_SNOW}"""


@query(_category_sql("order_status", "o_orderstatus"))
def detail_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(describe_field(RETAIL_CATALOG, retail_tables(spark, folder), "order_status"))


@query(_category_sql("region", "r_name"))
def detail_categorical_dim(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(describe_field(RETAIL_CATALOG, retail_tables(spark, folder), "region"))


@query(_range_sql("order_total", "o_totalprice"))
def detail_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(describe_field(RETAIL_CATALOG, retail_tables(spark, folder), "order_total"))


@query(
    """select case when p_size > 25 then 'True' else 'False' end as value, count(*)::bigint as parts
    from part group by 1"""
)
def detail_boolean(spark: SparkSession, folder: str) -> DataFrame:
    parts = retail_tables(spark, folder)["part"]
    value = category(F.col("isgene"), parts.schema["isgene"].dataType)
    return parts.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    " union all ".join(
        [
            _category_sql("order_status", "o_orderstatus"),
            _category_sql("order_priority", "o_orderpriority"),
            _category_sql("customer_id", "c_custkey"),
            _category_sql("segment", "c_mktsegment"),
            _category_sql("nation", "n_name"),
            _category_sql("region", "r_name"),
            _range_sql("order_total", "o_totalprice"),
            _range_sql("customer_balance", "c_acctbal"),
        ]
    )
)
def detail_all(spark: SparkSession, folder: str) -> DataFrame:
    dimensions = ("customer", "nation", "region")
    return _filled(describe_all(RETAIL_CATALOG, retail_tables(spark, folder), dimensions))


@query(
    " union all ".join(
        f"""select '{field}' as field, '{kind}' as kind, count({column})::bigint as cells
        from {LEFT_SNOW}"""
        for field, kind, column in (
            ("order_total", "numeric", "o_totalprice"),
            ("order_status", "categorical", "o_orderstatus"),
            ("order_priority", "categorical", "o_orderpriority"),
            ("customer_id", "categorical", "c_custkey"),
            ("customer_balance", "numeric", "c_acctbal"),
            ("segment", "categorical", "c_mktsegment"),
            ("nation", "categorical", "n_name"),
            ("region", "categorical", "r_name"),
        )
    )
)
def fields_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return field_coverage(RETAIL_CATALOG, retail_tables(spark, folder), ("customer", "nation", "region"))


@query(
    """select o_orderkey as cellkey, o_orderstatus from orders
    where o_orderkey in (select l_orderkey from lineitem)""",
    name="cells_with_values",
)
def filled_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_with_values(*_cells_and_values(spark, folder))


@query(
    """select o_orderkey as cellkey, o_orderstatus from orders
    where o_orderkey not in (select l_orderkey from lineitem)""",
    name="cells_without_values",
)
def empty_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_without_values(*_cells_and_values(spark, folder))


def _cells_and_values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = read(spark, folder, "orders").select(F.col("o_orderkey").alias("cellkey"), "o_orderstatus")
    return cells, read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("cellkey"))


@query(
    """select c_custkey as bundle, o_orderkey as cellkey from orders join customer on o_custkey = c_custkey"""
)
def bundle_cells(spark: SparkSession, folder: str) -> DataFrame:
    return audits.bundle_cells(RETAIL_CATALOG, retail_tables(spark, folder))


@query(
    """select c_custkey as bundle, 1::bigint as analyses, count(distinct o_orderkey)::bigint as cells,
    count(l_orderkey)::bigint as "values"
    from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey
    group by 1"""
)
def bundle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audits.bundle_counts(RETAIL_CATALOG, retail_tables(spark, folder))


@query(f"""select n_name as nation, count(*)::bigint as cells from {INNER_SNOW} group by 1""")
def project_counts(spark: SparkSession, folder: str) -> DataFrame:
    chain = inner_chain(RETAIL_CATALOG, retail_tables(spark, folder))
    return chain.groupBy(F.col("nation.n_name").alias("nation")).agg(F.count(F.lit(1)).alias("cells"))


FINGERPRINT_SQL = f"""select md5('gene|loom|order_total|' || count(*)::varchar || '|' ||
      coalesce(sum(('0x' || substr(md5(o_orderkey::varchar), 1, 16))::hugeint), 0)::varchar || '|' ||
      coalesce(sum(('0x' || substr(md5(o_orderkey::varchar), 17, 16))::hugeint), 0)::varchar) as fingerprint,
      count(*)::bigint as cells from {SNOW} where {NESTED_SQL}"""


@query(FINGERPRINT_SQL)
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _request(spark, folder, NESTED, fields=("order_total",)).fingerprint()


@query(f"select *, unnest([false, true]) as reused from ({FINGERPRINT_SQL})")
def request_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """A request run twice: exported the first time, and found by its fingerprint the second."""
    root = os.path.join(scratch_dir(spark), f"results-{uuid.uuid4().hex}")
    request = _request(spark, folder, NESTED, fields=("order_total",))
    parts = request.tables["part"].withColumn("featurename", F.col("p_name"))
    request = replace(request, tables={**request.tables, "part": parts})
    log, results = spark.createDataFrame([], REQUEST_LOG), spark.createDataFrame([], "result_key string")
    first = run_request(request, root, 1, "r1", log, results, on_duplicate="sum")
    logged = {f.name: None for f in REQUEST_LOG.fields} | {"request_id": "r1", "request_hash": first.fingerprint, "data_version": 1, "format": request.format}
    stored = spark.read.parquet(os.path.join(root, first.result_key, "attrs"))
    results = stored.select(F.lit(first.result_key).alias("result_key"))
    second = run_request(request, root, 1, "r2", spark.createDataFrame([logged], REQUEST_LOG), results, on_duplicate="sum")
    assert second.result_key == first.result_key
    return spark.createDataFrame([(r.fingerprint, r.cells, r.reused) for r in (first, second)], "fingerprint string, cells long, reused boolean")
