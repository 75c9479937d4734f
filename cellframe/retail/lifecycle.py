"""Maintenance: upserts, removals, notifications, the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.functions import text
from cellframe.operators import keyed
from cellframe.plans import audits, requestlog
from cellframe.plans.store import cascade
from cellframe.retail.catalog import read
from cellframe.retail.registry import query
from cellframe.streaming.notifications import action

URGENT_SQL = "(select o_custkey from orders where o_orderpriority = '1-URGENT')"


def _changed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an urgent order, their balance cleared."""
    urgent = read(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    return (
        read(spark, folder, "customer")
        .join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .withColumn("c_acctbal", F.lit(0.0))
    )


@query(
    f"""select c_custkey, c_name, c_nationkey, case when c_custkey in {URGENT_SQL} then 0.0 else c_acctbal end as c_acctbal,
    c_mktsegment from customer"""
)
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.upsert(read(spark, folder, "customer"), _changed_customers(spark, folder), "c_custkey")


def _removed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What goes with the customers that are users with an error of value above 90."""
    analysis = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("bundle_fqid"), F.col("c_custkey").alias("analysiskey")
    )
    cell = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cellkey"), F.col("o_custkey").alias("analysiskey")
    )
    bundles = (
        read(spark, folder, "events")
        .filter((F.col("event_type") == "error") & (F.col("value") > 90))
        .select(F.col("user_id").alias("bundle_fqid"))
    )
    return cell, *cascade(analysis, cell, bundles)


ERRORS_SQL = "(select user_id from events where event_type = 'error' and value > 90)"


@query(
    f"""select l_orderkey as cellkey, l_partkey as featurekey, l_quantity as exprvalue from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_custkey in {ERRORS_SQL})"""
)
def remove_bundle(spark: SparkSession, folder: str) -> DataFrame:
    _, _, cells = _removed(spark, folder)
    values = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("cellkey"), F.col("l_partkey").alias("featurekey"), F.col("l_quantity").alias("exprvalue")
    )
    return keyed.remove(values, cells, "cellkey")


@query(f"select o_orderkey as cellkey, o_custkey as analysiskey from orders where o_custkey not in {ERRORS_SQL}")
def remove_bundle_cells(spark: SparkSession, folder: str) -> DataFrame:
    cell, analyses, _ = _removed(spark, folder)
    return keyed.remove(cell, analyses, "analysiskey").select("cellkey", "analysiskey")


LATEST_SQL = """(select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n
  from events) where n = 1)"""


@query(
    f"""select user_id, event_id, strftime(ts, '%Y-%m-%dT%H%M%S.%fZ') as creation_date, event_type, value
    from {LATEST_SQL}"""
)
def latest_event(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    newest = keyed.latest(events, "user_id", "ts", "event_id")
    return newest.withColumn("creation_date", text.format_timestamp(F.col("ts"))).drop("ts")


def event_kind(event_type: Column) -> Column:
    """Events as notification types; the others keep their name."""
    names = {"signup": "CREATE", "purchase": "UPDATE", "click": "DELETE", "error": "TOMBSTONE"}
    kinds = F.create_map(*(F.lit(word) for pair in names.items() for word in pair))
    return F.coalesce(F.element_at(kinds, event_type), event_type)


EVENT_TYPE_SQL = """case event_type when 'signup' then 'CREATE' when 'purchase' then 'UPDATE' when 'click' then 'DELETE'
  when 'error' then 'TOMBSTONE' else event_type end"""


@query(
    f"""select event_id, user_id as bundle, {EVENT_TYPE_SQL} as event_type,
    case when event_type in ('signup', 'purchase') then 'upsert' when event_type in ('click', 'error') then 'remove'
    else 'invalid' end as action from events"""
)
def route_events(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "events")
        .select("event_id", F.col("user_id").alias("bundle"), event_kind(F.col("event_type")).alias("event_type"))
        .withColumn("action", action(F.col("event_type")))
    )


@query(
    """select count(*)::bigint as expected, count(o_custkey)::bigint as loaded, count(*) = count(o_custkey) as complete
    from (select distinct c_custkey from customer)
    left join (select distinct o_custkey from orders where o_orderstatus = 'F') on c_custkey = o_custkey"""
)
def verify_load(spark: SparkSession, folder: str) -> DataFrame:
    return audits.verify_load(*_expected_and_loaded(spark, folder), "bundle")


@query(
    """select c_custkey as bundle from customer
    where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')"""
)
def verify_load_missing(spark: SparkSession, folder: str) -> DataFrame:
    return audits.missing_bundles(*_expected_and_loaded(spark, folder), "bundle")


def _expected_and_loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    loaded = read(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("bundle"))
    return read(spark, folder, "customer").select("c_custkey"), loaded.distinct()


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "source")
    return audits.orphans(documents, "doc_id", read(spark, folder, "labels"), "doc_id")


@query("select user_id, min(event_id) as first_place from events group by 1")
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.ordered_distinct(read(spark, folder, "events"), "user_id", F.col("event_id"))


@query("select o_orderkey, o_orderstatus from orders")
def concat_slices(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    middle = F.lit("1998-01-01").cast("timestamp")
    early = F.coalesce(F.col("o_orderdate") < middle, F.lit(False))
    slices = rows.filter(early), rows.filter(~early)
    return keyed.concat(*slices).drop("o_orderdate")


@query(
    """select s_suppkey as key, s_name as name, 'supplier' as assay from supplier
    union all select c_custkey, c_name, 'customer' from customer"""
)
def append_rows(spark: SparkSession, folder: str) -> DataFrame:
    supplier, customer = read(spark, folder, "supplier"), read(spark, folder, "customer")
    return keyed.concat(
        supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("assay")),
        customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("assay")),
    )


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a request log."""
    kind, value = F.col("event_type"), F.col("value")
    return read(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.md5(F.concat_ws(":", kind, F.floor("value").cast("string"))).alias("request_hash"),
        F.when(value < 50, 1).otherwise(2).alias("data_version"),
        text.format_timestamp(F.col("ts")).alias("creation_date"),
        F.when(kind.isin("click", "signup"), "csv").when(kind == "purchase", "loom").when(kind == "error", "mtx").alias("format"),
        F.floor(value * 17).cast("int").alias("num_bundles"),
        F.when(value > 95, "FAILED").otherwise("SUCCEEDED").alias("job_status"),
        F.when((kind == "error") & (value > 20), "no such cell").alias("error"),
        F.from_json("props", "k int")["k"].alias("k"),
        value.alias("duration"),
    )


LOG_SQL = """(select *, data_version::varchar || '/' || request_hash || '/' || request_id || '.' || format ||
    case when format in ('csv', 'mtx') then '.zip' else '' end as result_key from (
  select event_id::varchar as request_id, md5(event_type || ':' || floor(value)::bigint::varchar) as request_hash,
  case when value < 50 then 1 else 2 end as data_version, strftime(ts, '%Y-%m-%dT%H%M%S.%fZ') as creation_date, ts,
  case when event_type in ('click', 'signup') then 'csv' when event_type = 'purchase' then 'loom'
    when event_type = 'error' then 'mtx' end as format, floor(value * 17)::integer as num_bundles,
  case when value > 95 then 'FAILED' else 'SUCCEEDED' end as job_status,
  case when event_type = 'error' and value > 20 then 'no such cell' end as error,
  (props->>'$.k')::integer as k, value as duration, event_type from events))"""


def _results(log: DataFrame) -> DataFrame:
    """Stored results: those of log rows with a small ``k``, the smallest ones empty."""
    size = F.when(F.col("k") < 10, 0).otherwise(F.col("k") * 100)
    return log.filter("k < 60").select(requestlog.result_key().alias("result_key"), size.alias("result_size")).filter(
        "result_key IS NOT NULL"
    )


NOW = "2024-01-31 12:00:00"


@query(f"select request_id, result_key from {LOG_SQL} where format is not null")
def result_key(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).filter("format IS NOT NULL")
    return log.select("request_id", requestlog.result_key().alias("result_key"))


@query(
    f"""select request_id,
    case when format is null then 'In Progress' when error is not null or job_status = 'FAILED' then 'Failed'
    when k < 60 then 'Complete' when ts < timestamp '{NOW}' - interval 30 day then 'Expired'
    when ts < timestamp '{NOW}' - interval 36 hour then 'Failed' else 'In Progress' end as status,
    case when format is null then 'accepted' when error is not null then 'error' when job_status = 'FAILED' then 'job'
    when k < 10 then 'empty' when k < 60 then 'stored' when ts < timestamp '{NOW}' - interval 30 day then 'expired'
    when ts < timestamp '{NOW}' - interval 36 hour then 'timeout' else 'running' end as reason from {LOG_SQL}"""
)
def status(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return requestlog.status(log, _results(log), F.lit(NOW).cast("timestamp"))


@query(
    f"""select request_id, case when k >= 60 and ts < timestamp '{NOW}' - interval 30 day then 't' else 'f' end as expired,
    case when ts < timestamp '{NOW}' - interval 36 hour then 't' else 'f' end as timed_out
    from {LOG_SQL} where format is not null"""
)
def expired(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).filter("format IS NOT NULL")
    joined = (
        log.withColumn("created", text.parse_timestamp(F.col("creation_date")))
        .withColumn("result_key", requestlog.result_key())
        .join(_results(log), "result_key", "left")
    )
    now = F.lit(NOW).cast("timestamp")
    return joined.select(
        "request_id",
        text.short_boolean(requestlog.is_expired(now)).alias("expired"),
        text.short_boolean(requestlog.timed_out(now)).alias("timed_out"),
    )


@query(
    f"""select data_version, request_hash, min(result_key) as result_key from {LOG_SQL}
    where k < 60 and result_key is not null group by 1, 2"""
)
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return requestlog.cached_results(log, _results(log))


@query(
    f"""select min(result_key) as result_key from {LOG_SQL} where k < 60 and data_version = 1
    and request_hash = md5('click:21') having min(result_key) is not null"""
)
def cache_lookup_one(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return requestlog.cached_result(log, _results(log), F.lit(1), F.md5(F.lit("click:21")))


@query(
    f"""select request_id, result_key from {LOG_SQL} where k > 90
    or (data_version = 2 and error is null and request_hash in (select request_hash from {LOG_SQL} where duration > 150))"""
)
def invalidate(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return requestlog.invalidated(log, log.filter("k > 90"), log.filter("duration > 150"), version=2)


@query(
    f"""select request_id, coalesce(case when k > 90 then 'deleted' end, error, '') as error from {LOG_SQL}"""
)
def invalidate_marks(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return requestlog.mark_invalidated(log, log.filter("k > 90"), "deleted").select(
        "request_id", text.or_blank(F.col("error")).alias("error")
    )


@query(f"select request_id from {LOG_SQL} where data_version = 1 and format = 'mtx' and error is null")
def log_scan(spark: SparkSession, folder: str) -> DataFrame:
    wanted = {"data_version": 1, "format": "mtx", "error": None}
    return requestlog.matching(_log(spark, folder), wanted).select("request_id")


@query(
    f"""with finished as (select (num_bundles // 500 * 500)::varchar || '-' || (num_bundles // 500 * 500 + 499)::varchar
      as bundles, format, duration from {LOG_SQL} where format is not null)
    select bundles, coalesce(format, '(all)') as format, case when grouping(format) = 1 then 1 else 0 end as level, count(*)::bigint as requests,
    round(avg(duration) * count(*), 2) as total_duration from finished group by grouping sets ((bundles, format), (bundles))"""
)
def duration_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = requestlog.duration_rollup(_log(spark, folder).filter("format IS NOT NULL"))
    total = F.round(F.col("mean_duration") * F.col("requests"), 2)
    return rolled.select("bundles", F.coalesce("format", F.lit("(all)")).alias("format"), "level", "requests", total.alias("total_duration"))


@query(
    """select event_id, strftime(ts, '%Y-%m-%dT%H%M%S.%fZ') as written, epoch_us(ts) as parsed_micros,
    ((epoch_us(timestamp '2024-01-31 12:00:00') - epoch_us(ts)) // 1000000)::bigint as age from events"""
)
def parse_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    written = text.format_timestamp(F.col("ts"))
    return (
        read(spark, folder, "events")
        .select("event_id", written.alias("written"))
        .withColumn("parsed", text.parse_timestamp(F.col("written")))
        .select(
            "event_id",
            "written",
            F.unix_micros("parsed").alias("parsed_micros"),
            F.floor(text.seconds_between(F.col("parsed"), F.lit(NOW).cast("timestamp"))).alias("age"),
        )
    )
