"""Orders as a warehouse: requests over a store, whole loads, streams of notifications, blocks and species matrices."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe import fixed
from cellframe.catalog import CELL_CATALOG
from cellframe.plans.describe import field_coverage, list_fields
from cellframe.plans.failures import FailureLog
from cellframe.plans.isolate import apply_apart
from cellframe.plans.load import Load
from cellframe.plans.request import MatrixRequest
from cellframe.plans.species import SpeciesExport
from cellframe.plans.store import Store
from cellframe.retail.catalog import RETAIL_CATALOG, read, retail_tables
from cellframe.retail.files import _warehouse
from cellframe.retail.lifecycle import event_kind
from cellframe.retail.registry import query
from cellframe.retail.requests import LEFT_SNOW, SPECIES_FILTER
from cellframe.session import build_side, durable, scratch_dir
from cellframe.sources.bundles import PARTS, calls_of, counts_of, read_landing
from cellframe.sources.results import read_expression_result, read_manifest, result_blocks
from cellframe.sinks.staged import store_result
from cellframe.streaming.notifications import NotificationHandler, read_dead_letters


def _place(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def text(name: str) -> Column:
    return F.col(name).cast("string")


def _star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Order tables as all warehouse tables: nations are specimens, regions donors, parts features."""
    tables = _warehouse(spark, folder)
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    customer, nation = read(spark, folder, "customer"), read(spark, folder, "nation")
    human = F.lit(fixed.HUMAN)
    return tables | {
        "cell_suspension": customer.select(
            text("c_custkey").alias("cellsuspensionkey"), text("c_nationkey").alias("specimenkey"),
            *blank("derived_organ_ontology", "derived_organ_label", "derived_organ_parts_ontology", "derived_organ_parts_label", "genus_species_ontology"),
            human.alias("genus_species_label"),
        ),
        "specimen": nation.select(
            text("n_nationkey").alias("specimenkey"), text("n_regionkey").alias("donorkey"), *blank("organ_ontology"), F.col("n_name").alias("organ_label"),
            *blank("organ_parts_ontology", "organ_parts_label", "diseases_ontology", "diseases_label"),
        ),
        "donor": read(spark, folder, "region").select(
            text("r_regionkey").alias("donorkey"),
            *blank("ethnicity_ontology", "ethnicity_label", "diseases_ontology", "diseases_label", "development_stage_ontology"),
            F.col("r_name").alias("development_stage_label"), *blank("sex", "is_living"),
        ),
        "library_preparation": spark.createDataFrame([("l", "", "", "", "", "", "")], "librarykey string, a string, b string, c string, d string, e string, f string").toDF(
            "librarykey", "input_nucleic_acid_ontology", "input_nucleic_acid_label", "construction_approach_ontology", "construction_approach_label", "end_bias", "strand"
        ),
        "project": read(spark, folder, "orders").select(F.col("o_orderstatus").alias("projectkey"), F.col("o_orderstatus").alias("short_name"), F.lit("orders").alias("title")).distinct(),
        "feature": read(spark, folder, "part").select(
            text("p_partkey").alias("featurekey"), F.col("p_name").alias("featurename"), F.col("p_type").alias("featuretype"), F.col("p_brand").alias("chromosome"),
            F.col("p_size").alias("featurestart"), F.col("p_size").alias("featureend"), (F.col("p_size") > 25).alias("isgene"), human.alias("genus_species"),
        ),
    }


@query(
    """select l_orderkey::varchar as cellkey, l_partkey::varchar as featurekey, l_quantity::float as exprvalue
    from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where p_size > 25 and c_mktsegment = 'BUILDING' and c_custkey % 25 = 0"""
)
def store_pruned_request(spark: SparkSession, folder: str) -> DataFrame:
    """A request over a store's tables: values of the orders of one customer in 25 and one segment, from their buckets alone."""
    store = Store(spark, _place(spark, "store"), buckets=64)
    tables = _star(spark, folder)
    wanted = F.col("bundle_uuid").cast("long") % 25 == 0
    tables["analysis"] = tables["analysis"].withColumn("protocol", F.when(wanted, F.col("protocol")).otherwise("other"))
    store.reload(tables)
    asked = {"op": "=", "field": "analysis.protocol", "value": "BUILDING"}
    return MatrixRequest(CELL_CATALOG, store.tables(), asked).expression()


@query(
    """select 'cell' as name, count(*)::bigint as rows, 2 as version from orders union all select 'expression', count(*), 2 from lineitem
    where l_orderkey in (select o_orderkey from orders) union all select 'analysis', count(*), 2 from customer
    union all select unnest(['feature', 'donor', 'specimen', 'cell_suspension', 'library_preparation', 'project', 'publication', 'contributor']), 0, 2"""
)
def store_created(spark: SparkSession, folder: str) -> DataFrame:
    """An empty store, and then the rows of each of its tables after an update that fills some."""
    store = Store(spark, _place(spark, "store"), buckets=4)
    store.create()
    version = store.upsert(_warehouse(spark, folder))
    counts = [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, rows in store.tables().items()]
    return reduce(DataFrame.unionByName, counts).withColumn("version", F.lit(version))


@query(
    f"""select * from (values ('order_total', 'orders', 'numeric', (select count(o_totalprice) from {LEFT_SNOW})),
      ('order_status', 'orders', 'categorical', (select count(o_orderstatus) from {LEFT_SNOW})),
      ('order_priority', 'orders', 'categorical', (select count(o_orderpriority) from {LEFT_SNOW})),
      ('customer_id', 'customer', 'categorical', (select count(c_custkey) from {LEFT_SNOW})),
      ('customer_balance', 'customer', 'numeric', (select count(c_acctbal) from {LEFT_SNOW})),
      ('segment', 'customer', 'categorical', (select count(c_mktsegment) from {LEFT_SNOW})),
      ('nation', 'nation', 'categorical', (select count(n_name) from {LEFT_SNOW})),
      ('region', 'region', 'categorical', (select count(r_name) from {LEFT_SNOW}))) t(field, "table", kind, cells)"""
)
def field_list(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary with the number of orders that have a value of each field."""
    tables = retail_tables(spark, folder)
    covered = field_coverage(RETAIL_CATALOG, tables, ("customer", "nation", "region")).select("field", "cells")
    return list_fields(spark, RETAIL_CATALOG).join(covered, "field").select("field", "table", "kind", "cells")


BLOCK_ROWS = 40


@query(
    f"""with sizes as (select l_orderkey as cellkey, count(*) as n from lineitem group by 1),
      placed as (select *, coalesce(sum(n) over (order by cellkey rows between unbounded preceding and 1 preceding), 0) as before from sizes),
      parts as (select *, case when n > {BLOCK_ROWS // 2} then -1 else before // {BLOCK_ROWS // 2} end as part from placed),
      begun as (select *, case when part = -1 or part is distinct from lag(part) over (order by cellkey) then 1 else 0 end as begins from parts),
      blocks as (select cellkey, sum(begins) over (order by cellkey rows unbounded preceding) - 1 as block from begun)
    select cellkey::varchar as cellkey, l_partkey::varchar as featurekey, l_quantity::float as exprvalue, block::bigint as block
    from lineitem join blocks on l_orderkey = cellkey"""
)
def stored_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items stored as a result and read back in blocks that keep an order together."""
    path = _place(spark, "result")
    numbered = F.lpad(text("l_orderkey"), 12, "0")
    store_result(read(spark, folder, "lineitem").select(numbered.alias("l_orderkey"), "l_partkey", "l_quantity"), path)
    values = read_expression_result(spark, read_manifest(spark, os.path.join(path, "manifest")))
    found = result_blocks(values, BLOCK_ROWS)
    return found.withColumn("cellkey", F.col("cellkey").cast("long").cast("string"))


SPECIES_SQL = """(select o_orderkey, c_mktsegment as species from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where o_totalprice >= 100000 and c_mktsegment in ('FURNITURE', 'MACHINERY'))"""


@query(
    f"""with kept as (select p_partkey, case when p_size % 2 = 0 then 'FURNITURE' else 'MACHINERY' end as species from part where p_size > 25),
      rows as (select *, row_number() over (partition by species order by p_partkey) as r from kept),
      listed as (select species, o_orderkey, l_partkey, sum(l_quantity) as v from {SPECIES_SQL} join lineitem on l_orderkey = o_orderkey
        where l_returnflag = 'N' and l_partkey in (select p_partkey from kept) group by all),
      cols as (select species, o_orderkey, row_number() over (partition by species order by o_orderkey) as c from (select distinct species, o_orderkey from listed)),
      entries as (select l.species, r, c, v from listed l join rows on l_partkey = p_partkey and l.species = rows.species join cols on l.o_orderkey = cols.o_orderkey and l.species = cols.species)
    select distinct species, '{fixed.MTX_BANNER}' as line from cols
    union all select species, (select count(*) from rows x where x.species = y.species)::varchar || ' ' || count(*)::varchar || ' '
      || (select count(*) from entries x where x.species = y.species)::varchar from cols y group by species
    union all select species, r::varchar || ' ' || c::varchar || ' ' || v::varchar from entries where v <> 0"""
)
def species_files(spark: SparkSession, folder: str) -> DataFrame:
    """The coordinate files of two segments, written from one scan of the line items."""
    tables = retail_tables(spark, folder)
    tables["part"] = tables["part"].withColumn("species", F.when(F.col("p_size") % 2 == 0, "FURNITURE").otherwise("MACHINERY"))
    catalog = replace(RETAIL_CATALOG, feature_species="species")
    path = _place(spark, "species")
    SpeciesExport(MatrixRequest(catalog, tables, SPECIES_FILTER), on_duplicate="sum").write_mtx(path)
    return spark.read.schema("line string, species string").text(os.path.join(path, "matrix.mtx")).select("species", "line")


LOG_RUNS = 3


@query(
    f"""with runs as (select event_id % {LOG_RUNS} + 1 as run, user_id::varchar || '.1' as bundle, event_type, value from events),
      failed as (select run, bundle, 'error ' || floor(value / 50)::bigint::varchar as reason from runs where event_type = 'error' group by all),
      loaded as (select run, bundle from runs where event_type = 'purchase' and value > 200 and (run, bundle) not in (select run, bundle from failed) group by all)
    select bundle || '/cell' as entity, reason, min(run) as first_run, max(run) as last_run, count(*)::bigint as times,
      exists (select 1 from loaded l where l.bundle = f.bundle and l.run > max(f.run)) as closed
    from failed f group by bundle, reason"""
)
def failure_log(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of three runs in one lasting log, each run merged twice; a bundle that loads closes what is open."""
    log = FailureLog(spark, _place(spark, "failures"))
    events = read(spark, folder, "events").withColumn("bundle_fqid", F.concat(text("user_id"), F.lit(".1")))
    reason = F.concat(F.lit("error "), F.floor(F.col("value") / 50).cast("string")).alias("reason")
    for run in range(LOG_RUNS):
        own = events.filter(F.col("event_id") % LOG_RUNS == run)
        failures = own.filter("event_type = 'error'").select(F.concat("bundle_fqid", F.lit("/cell")).alias("entity"), reason)
        loaded = own.filter("event_type = 'purchase' AND value > 200").select("bundle_fqid")
        for _ in range(2):
            log.merge(failures, loaded, "events", run)
    return log.read().select("entity", "reason", "first_run", "last_run", "times", F.col("closed_at").isNotNull().alias("closed"))


@query(
    """select user_id::varchar as bundle, case when user_id in (select arg_max(user_id, value) from events)
      or user_id in (select arg_min(user_id, value) from events) then 'failed' else 'applied' end as state, sum(value > 100)::bigint as large
    from events group by user_id"""
)
def batch_apart(spark: SparkSession, folder: str) -> DataFrame:
    """A batch with two users that cannot be applied: halved until they are alone, all others are applied."""
    events = read(spark, folder, "events").select(text("user_id").alias("bundle"), "value")
    ends = events.agg(F.max_by("bundle", "value"), F.min_by("bundle", "value")).first()
    path = _place(spark, "applied")
    users = durable(events.groupBy("bundle").agg(F.count_if(F.col("value") > 100).alias("large")), "users")

    def apply(part: DataFrame) -> None:
        checked = F.when(F.col("bundle").isin(*ends), F.raise_error(F.lit("cannot be applied"))).otherwise(F.col("large"))
        part.withColumn("large", checked).write.mode("append").parquet(path)

    failures = apply_apart(users, "bundle", apply, attempts=1)
    failed = users.join(spark.createDataFrame([(f.key,) for f in failures], "bundle string"), "bundle")
    applied = spark.read.schema(users.schema).parquet(path)
    return applied.select("bundle", F.lit("applied").alias("state"), "large").union(failed.select("bundle", F.lit("failed"), "large"))


def _order_texts(spark: SparkSession, folder: str, broken: Column) -> DataFrame:
    """Count files as texts, one for each order: line items are its genes. Titles come in two orders, and the TPM of orders
    for which ``broken`` holds is no number.
    """
    turned = F.col("l_orderkey") % 2 == 0
    identity = F.concat(text("l_partkey"), F.lit("."), text("l_linenumber"))
    tpm = F.when(broken, F.lit("many")).otherwise(text("l_quantity"))
    line = F.when(turned, F.concat_ws("\t", identity, F.lit("t"), tpm, text("l_linenumber"))).otherwise(F.concat_ws("\t", text("l_linenumber"), identity, tpm, F.lit("t")))
    title = F.when(turned, F.lit("gene_id\ttranscript_id(s)\tTPM\texpected_count")).otherwise(F.lit("expected_count\tgene_id\tTPM\tother"))
    orders = build_side(read(spark, folder, "orders").select("o_orderkey", "o_orderpriority"))
    items = read(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = items.select("l_orderkey", title.alias("title"), line.alias("line"))
    # an order's file is as long as its list of line items
    return lines.groupBy("l_orderkey", "title").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body")).select(
        F.concat(text("l_orderkey"), F.lit(".1")).alias("bundle_fqid"), F.concat("title", F.lit("\n"), "body", F.lit("\n")).alias("value")
    )


@query(
    """select l_orderkey::varchar || '.1' as bundle_fqid, l_partkey::varchar || '.' || l_linenumber::varchar as id, l_quantity::double as tpm,
    l_linenumber::double as expected_count from lineitem join orders on l_orderkey = o_orderkey"""
)
def count_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Count files whose titles come in different orders."""
    return counts_of(_order_texts(spark, folder, F.lit(False)), "genes").select("bundle_fqid", "id", "tpm", "expected_count")


@query(
    """select o_custkey::varchar || '.1' as bundle_fqid, o_orderkey::varchar as cell_id, floor(o_totalprice)::integer as total,
    case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false end as is_cell from orders"""
)
def call_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Droplet calls, one file for each order, with titles in two orders and calls that are neither TRUE nor FALSE."""
    call = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("NA")
    total = F.floor("o_totalprice").cast("string")
    first = F.concat_ws(",", text("o_orderkey"), total, call)
    second = F.concat_ws(",", call, F.lit("0.5"), F.concat(F.lit('"'), text("o_orderkey"), F.lit('"')), total)
    value = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CellId,Total,IsCell\n"), first)).otherwise(F.concat(F.lit("IsCell,FDR,CellId,Total\r\n"), second))
    files = read(spark, folder, "orders").select(F.concat(text("o_custkey"), F.lit(".1")).alias("bundle_fqid"), value.alias("value"))
    return calls_of(files)


#: Orders that are written to one file of each kind.
LANDED_TOGETHER = 60_000


def _land_orders(spark: SparkSession, folder: str, out: str) -> None:
    """Orders as plate bundles in a landing table: documents that differ by order, customer and nation, and count files.

    The counts of urgent orders are unreadable; an order of customer 0 modulo 50 has no analysis process. Orders are dealt
    to the parts of the table before their documents are written, so that the files of a kind are as many as its rows ask
    for, not one in each part from every task: whoever reads the table lists them all in the driver.
    """
    orders = read(spark, folder, "orders").join(build_side(read(spark, folder, "customer")), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.withColumn("bundle_fqid", F.concat(text("o_orderkey"), F.lit(".1")))
    part = F.pmod(F.xxhash64("bundle_fqid"), F.lit(PARTS)).cast("int")
    share = read(spark, folder, "orders").count() // (PARTS * LANDED_TOGETHER) + 1
    orders = orders.select("bundle_fqid", "o_orderkey", "o_orderstatus", "c_custkey", "c_nationkey")
    orders = orders.repartition(part, F.pmod(F.hash("bundle_fqid"), F.lit(share)))

    def document(key: Column, **fields: object) -> Column:
        parts = [F.concat(F.lit('{"provenance": {"document_id": "'), key, F.lit('"}'))]
        parts += [F.lit(f', "{name}": {json.dumps(value)}') for name, value in fields.items()]
        return F.concat(*parts, F.lit("}"))

    kinds = {
        "analysis_protocol": document(F.concat(F.lit("a"), text("o_orderkey")), protocol_core={"protocol_id": "smartseq2_v2.3.0"}),
        "analysis_process": F.when(F.col("c_custkey") % 50 != 0, document(text("o_orderkey"), type={"text": fixed.ANALYSIS_PROCESS})),
        "donor_organism": document(F.concat(F.lit("d"), text("c_nationkey")), biomaterial_core={"ncbi_taxon_id": [9606]}, sex="unknown", is_living="yes"),
        "specimen_from_organism": document(F.concat(F.lit("s"), text("c_nationkey")), genus_species=[{"ontology": "NCBITaxon:9606"}]),
        "cell_suspension": document(F.concat(F.lit("c"), text("o_orderkey")), genus_species=[{"ontology": "NCBITaxon:9606"}]),
        "library_preparation_protocol": document(F.lit("l"), library_construction_method={"ontology": fixed.LIBRARY_METHOD_ONTOLOGY}, input_nucleic_acid_molecule={"ontology": "OBI:0000869"}),
        "project": document(F.col("o_orderstatus"), project_core={"project_title": "orders", "project_short_name": "orders"}),
        "manifest": F.concat(F.lit('{"files": [{"name": "x.genes.results", "version": "1", "uuid": "f'), text("o_orderkey"), F.lit('"}]}')),
        "isoforms": F.lit("transcript_id\tTPM\texpected_count\nT.1\t0.0\t0.00\n"),
    }
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()))
    texts = orders.select("bundle_fqid", F.inline(listed)).filter("value IS NOT NULL")
    counts = _order_texts(spark, folder, F.col("o_orderpriority") == "1-URGENT").withColumn("kind", F.lit("genes"))
    rows = texts.unionByName(counts).select("bundle_fqid", F.lit(0).alias("ordinal"), "value", "kind", part.alias("part"))
    rows.write.partitionBy("kind", "part").parquet(os.path.join(out, "texts", "batch=0"))


LANDED_SQL = """(select o_orderkey, o_orderpriority, o_custkey % 50 <> 0 as selected, o_orderkey in (select l_orderkey from lineitem) as counted from orders)"""


@query(
    f"""select 'c' || l_orderkey::varchar as cellkey, l_partkey::varchar as featurekey, unnest(['TPM', 'Count']) as exprtype,
      unnest([sum(l_quantity), sum(l_linenumber)])::float as value from lineitem
      where l_orderkey in (select o_orderkey from {LANDED_SQL} where selected and counted and o_orderpriority <> '1-URGENT') group by l_orderkey, l_partkey
    union all select o_orderkey::varchar || '.1', case when counted then 'unreadable or missing column in gene counts' else 'no gene counts' end, 'failure', 1
      from {LANDED_SQL} where selected and (not counted or o_orderpriority = '1-URGENT')"""
)
def load_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A whole load from a landing table by waves, stopped after the first one and started again: values and failures."""
    root = _place(spark, "load")
    _land_orders(spark, folder, os.path.join(root, "landing"))
    landing = read_landing(spark, os.path.join(root, "landing"))
    labels = [("NCBITaxon:9606", fixed.HUMAN), (fixed.LIBRARY_METHOD_ONTOLOGY, "Smart-seq2"), ("OBI:0000869", "polyA RNA")]
    labels = spark.createDataFrame(labels, "term string, label string")
    orders = read(spark, folder, "orders").count()
    store, log = Store(spark, os.path.join(root, "store"), buckets=4), FailureLog(spark, os.path.join(root, "failures"))
    load = Load(spark, os.path.join(root, "run"), bundles_per_wave=orders // 2 + 1)
    first = load.select(landing).filter("wave = 0")
    load._take_in(0, landing.restrict(first), labels)
    load.run(store, landing, labels, log)
    values = store.read("expression").select("cellkey", "featurekey", "exprtype", F.col("exrpvalue").alias("value"))
    return values.union(log.open().select("entity", "reason", F.lit("failure"), F.lit(1.0).cast("float")))


@query(
    """with notes as (select user_id as c, arg_max(event_type, event_id) as kind from events where event_type <> 'view' group by 1),
      there as (select c_custkey as c from customer where c_custkey not in (select c from notes where kind in ('click', 'error')))
    select 'analysis' as what, c::varchar || '.1' as name, '' as reason from there
    union all select 'aside', c::varchar || '.1', 'not in the landing zone' from notes where kind in ('signup', 'purchase')"""
)
def handled_notifications(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a batch of notifications applied to a store: removals take effect, updates of what hasn't arrived are set aside."""
    root = _place(spark, "handled")
    store = Store(spark, os.path.join(root, "store"), buckets=4)
    tables = _warehouse(spark, folder)
    store.reload({name: tables[name] for name in ("analysis", "cell")})
    labels = spark.createDataFrame([], "term string, label string")
    log = FailureLog(spark, os.path.join(root, "failures"))
    landing = os.path.join(root, "landing")
    handler = NotificationHandler(
        store, lambda updates: read_landing(spark, landing, updates), labels, os.path.join(root, "aside"), dead_letters=os.path.join(root, "dead"), log=log
    )
    notes = read(spark, folder, "events").select(
        text("user_id").alias("bundle_uuid"), F.lit("1").alias("bundle_version"), event_kind(F.col("event_type")).alias("event_type"), F.col("event_id").alias("seq")
    )
    notes = notes.filter("event_type <> 'view'")
    for _ in range(2):  # a batch that comes again is skipped
        handler(notes, 0, "events")
    there = store.read("analysis").select(F.lit("analysis").alias("what"), F.col("bundle_fqid").alias("name"), F.lit("").alias("reason"))
    dead = read_dead_letters(spark, os.path.join(root, "dead")).select(F.lit("dead"), "bundle_fqid", "reason")
    return there.union(log.open().select(F.lit("aside"), "entity", "reason")).union(dead)
