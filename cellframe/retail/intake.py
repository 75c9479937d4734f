"""Intake: counts, droplet calls, consensus of documents, labels, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellframe import fixed
from cellframe.functions import identifiers, text
from cellframe.operators.consensus import consensus, representative, single_or_blank
from cellframe.plans import counts, metadata
from cellframe.plans.selection import select_bundles, version_gate
from cellframe.retail.catalog import read
from cellframe.retail.registry import query
from cellframe.sources.bundles import manifest_file


def _versioned_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as count rows: one bundle per supplier, ids that carry a version."""
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("bundle"),
        F.concat_ws(".", "l_returnflag", "l_linenumber").alias("id"),
        F.col("l_extendedprice").alias("tpm"),
        F.col("l_quantity").alias("expected_count"),
    )


def _order_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items summed per order and part, returned quantities counting as nothing."""
    kept = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    return counts.collapse_versions(
        read(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("bundle"),
            F.col("l_partkey").cast("string").alias("id"),
            F.col("l_extendedprice").alias("tpm"),
            kept.alias("expected_count"),
        ),
        "bundle",
    )


@query(
    """select l_suppkey as bundle, split_part(l_returnflag || '.' || l_linenumber::varchar, '.', 1) as featurekey,
    round(sum(l_extendedprice), 2) as tpm, sum(l_quantity) as counted from lineitem group by 1, 2"""
)
def version_strip_sum(spark: SparkSession, folder: str) -> DataFrame:
    collapsed = counts.collapse_versions(_versioned_counts(spark, folder), "bundle")
    return collapsed.select("bundle", "featurekey", F.round("TPM", 2).alias("tpm"), F.col("Count").alias("counted"))


ORDER_COUNTS_SQL = """(select l_orderkey as bundle, l_partkey::varchar as featurekey, sum(l_extendedprice) as tpm,
  sum(case when l_returnflag = 'R' then 0.0 else l_quantity end) as counted from lineitem group by 1, 2)"""


@query(
    f"""select bundle, featurekey, 'TPM' as exprtype, round(tpm, 2) as exrpvalue from {ORDER_COUNTS_SQL} where counted <> 0
    union all select bundle, featurekey, 'Count', counted from {ORDER_COUNTS_SQL} where counted <> 0"""
)
def unpivot_types(spark: SparkSession, folder: str) -> DataFrame:
    values = counts.typed_values(_order_counts(spark, folder), "bundle")
    return values.withColumn("exrpvalue", F.round("exrpvalue", 2))


@query(
    f"""select bundle, (count(*) filter (where counted > 0))::integer as genes_detected
    from {ORDER_COUNTS_SQL} group by 1"""
)
def genes_detected(spark: SparkSession, folder: str) -> DataFrame:
    return counts.genes_detected(_order_counts(spark, folder), "bundle")


def _droplets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as droplets, their labels as the calls."""
    documents, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    rows = documents.select(F.col("source").alias("bundle_fqid"), F.col("doc_id").alias("cell_id"), "n_chars")
    calls = (
        documents.join(labels, "doc_id")
        .select(
            F.col("source").alias("bundle_fqid"),
            F.col("doc_id").alias("cell_id"),
            F.col("n_chars").alias("total"),
            (F.col("quality") == 1).alias("is_cell"),
        )
    )
    return rows, calls


@query(
    """select md5(source || doc_id::varchar) as cellkey, source as bundle, doc_id, n_chars as total_umis,
    case when quality = 1 then 't' when quality <> 1 then 'f' else '' end as is_cell
    from documents join labels using (doc_id) where n_chars >= 100"""
)
def droplet_filter_join(spark: SparkSession, folder: str) -> DataFrame:
    kept, _ = counts.split_droplets(*_droplets(spark, folder))
    return kept.select(
        identifiers.droplet_cell_key(F.col("bundle_fqid"), F.col("cell_id")).alias("cellkey"),
        F.col("bundle_fqid").alias("bundle"),
        F.col("cell_id").alias("doc_id"),
        F.col("total").alias("total_umis"),
        text.short_boolean(F.col("is_cell")).alias("is_cell"),
    )


@query(
    """select source as bundle, doc_id from documents
    where doc_id not in (select doc_id from labels)"""
)
def droplet_uncalled(spark: SparkSession, folder: str) -> DataFrame:
    _, uncalled = counts.split_droplets(*_droplets(spark, folder))
    return uncalled.select(F.col("bundle_fqid").alias("bundle"), F.col("cell_id").alias("doc_id"))


@query("select o_orderkey as id, md5(o_orderkey::varchar || o_orderpriority) as cellkey from orders")
def cell_key_md5(spark: SparkSession, folder: str) -> DataFrame:
    key = identifiers.droplet_cell_key(F.col("o_orderkey"), F.col("o_orderpriority"))
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), key.alias("cellkey"))


@query(
    """select page_id, split_part(url, '.', 1) as uuid,
    case when position('.' in url) > 0 then substr(url, position('.' in url) + 1) else '' end as version from pages"""
)
def split_first_dot(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return read(spark, folder, "pages").select(
        "page_id",
        identifiers.bundle_uuid(url).alias("uuid"),
        text.or_blank(identifiers.bundle_version(url)).alias("version"),
    )


@query(
    """with protocols as (select p_partkey, case p_type when 'ECONOMY' then 'smartseq2_' when 'PROMO' then 'optimus_'
    else 'other_' end || p_brand as protocol from part)
    select p_partkey as analysiskey, protocol,
    case when starts_with(protocol, 'smartseq2') or starts_with(protocol, 'optimus') then 'blessed' else 'community' end
      as awg_disposition,
    case when starts_with(protocol, 'smartseq2') then 'plate' when starts_with(protocol, 'optimus') then 'droplet'
      else 'unsupported' end as assay from protocols"""
)
def disposition(spark: SparkSession, folder: str) -> DataFrame:
    start = (
        F.when(F.col("p_type") == "ECONOMY", "smartseq2_").when(F.col("p_type") == "PROMO", "optimus_").otherwise("other_")
    )
    protocol = F.col("protocol")
    return (
        read(spark, folder, "part")
        .select(F.col("p_partkey").alias("analysiskey"), F.concat(start, "p_brand").alias("protocol"))
        .withColumn("awg_disposition", identifiers.disposition(protocol))
        .withColumn("assay", F.coalesce(identifiers.assay(protocol), F.lit("unsupported")))
    )


@query(
    """select conv_id as bundle, case when count(distinct role) = 1 then min(role) else '' end as role
    from conversations group by 1""",
    name="consensus",
)
def agreed_role(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("bundle"))
        .agg(consensus(text.or_blank(F.col("role")), F.lit("")).alias("role"))
    )


@query(
    """select o_custkey as bundle, case when count(distinct o_orderpriority) = 1 then min(o_orderpriority) else '' end
    as priority, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) else '' end as status,
    min(o_orderkey) as entitykey from orders group by 1"""
)
def consensus_fields(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("bundle"))
        .agg(
            consensus(F.col("o_orderpriority"), F.lit("")).alias("priority"),
            consensus(F.col("o_orderstatus"), F.lit("")).alias("status"),
            representative(F.col("o_orderkey")).alias("entitykey"),
        )
    )


@query("select conv_id as bundle, min(turn) as entitykey from conversations group by 1")
def rep_key(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("bundle"))
        .agg(representative(F.col("turn")).alias("entitykey"))
    )


@query("""select p_partkey as entity, array_to_string(string_split(p_name, ' '), ';') as terms from part""")
def joined_values(spark: SparkSession, folder: str) -> DataFrame:
    terms = text.joined(F.split("p_name", " "))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("entity"), terms.alias("terms"))


@query(
    """select conv_id as bundle, case when count(distinct nullif(role, '')) = 1 then min(role) || ' (organoid)' else '' end
    as organ from conversations group by 1""",
    name="single_or_blank",
)
def single_role(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("bundle"))
        .agg(single_or_blank(F.nullif("role", F.lit("")), fixed.ORGANOID_MARK).alias("organ"))
    )


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ontology labels: every region but one, which stays without a label."""
    regions = read(spark, folder, "region").filter("r_name <> 'MIDDLE EAST'")
    return regions.select(F.concat(F.lit("REG:"), "r_regionkey").alias("term"), F.col("r_name").alias("label"))


@query(
    """with terms as (select n_nationkey, case when n_nationkey < 10 then 'REG:' || n_regionkey::varchar
      when n_nationkey < 15 then 'REG_' || n_regionkey::varchar
      when n_nationkey < 20 then 'REG:' || n_regionkey::varchar || ' (cell line)'
      else 'REG' || n_regionkey::varchar end as term, n_regionkey from nation)
    select c_custkey as entity, term, case when n_nationkey >= 20 or r_name is null then '' when n_nationkey >= 15
      then r_name || ' (cell line)' else r_name end as label
    from customer join terms on c_nationkey = n_nationkey
    left join (select * from region where r_name <> 'MIDDLE EAST') on n_regionkey = r_regionkey"""
)
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    number, region = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    term = (
        F.when(number < 10, F.concat(F.lit("REG:"), region))
        .when(number < 15, F.concat(F.lit("REG_"), region))
        .when(number < 20, F.concat(F.lit("REG:"), region, F.lit(fixed.CELL_LINE_MARK)))
        .otherwise(F.concat(F.lit("REG"), region))
    )
    nations = read(spark, folder, "nation").select("n_nationkey", term.alias("term"))
    entities = read(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    frame = entities.select(F.col("c_custkey").alias("entity"), "term")
    return metadata.with_label(frame, _labels(spark, folder), "term", "label")


@query(
    """with words as (select p_partkey, unnest(string_split(p_name, ' ')) as w,
      unnest(range(0, len(string_split(p_name, ' ')))) as i from part),
    labels as (select split_part(p_name, ' ', 1) as t, min(p_brand) as l from part group by 1)
    select p_partkey as entity, string_agg('W:' || w, ';' order by i) as terms,
    string_agg(coalesce(l, ''), ';' order by i) as labels from words left join labels on w = t group by 1"""
)
def label_lookup_lists(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part")
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    labels = parts.select(F.concat(F.lit("W:"), first).alias("term"), F.col("p_brand").alias("label"))
    terms = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("W:"), w))
    frame = parts.select(F.col("p_partkey").alias("entity"), terms.alias("list"))
    found = metadata.with_labels(frame, labels, "list", "found")
    return found.select(
        "entity", text.joined(F.col("list")).alias("terms"), text.joined(F.col("found")).alias("labels")
    )


def _organ_documents(spark: SparkSession, folder: str, event: str, part: str) -> DataFrame:
    """Events of one type as model documents of the user's bundle."""
    term = F.struct(F.concat(F.lit("T:"), F.floor(F.col("value") / 40).cast("string")).alias("ontology"))
    tissue = F.struct(F.concat(F.lit("P:"), F.floor(F.col("value") / 1000).cast("string")).alias("ontology"))
    return (
        read(spark, folder, "events")
        .filter(F.col("event_type") == event)
        .select(F.col("user_id").alias("bundle_fqid"), term.alias("model_organ"), tissue.alias(part))
    )


OVERRIDE_SQL = """(select user_id, case when count(distinct floor(value / 40)) = 1
    then 'T:' || min(floor(value / 40))::bigint::varchar || '{mark}' else '' end as organ,
    case when count(distinct floor(value / 1000)) = 1
    then 'P:' || min(floor(value / 1000))::bigint::varchar || '{mark}' else '' end as part
    from events where event_type = '{event}' group by 1)"""


@query(
    f"""select c_custkey as bundle,
    case when o.user_id is not null then o.organ when l.user_id is not null then l.organ else c_mktsegment end as organ,
    case when o.user_id is not null then o.part when l.user_id is not null then l.part else 'whole' end as part
    from customer left join {OVERRIDE_SQL.format(mark=' (organoid)', event='error')} o on c_custkey = o.user_id
    left join {OVERRIDE_SQL.format(mark=' (cell line)', event='click')} l on c_custkey = l.user_id"""
)
def override_chain(spark: SparkSession, folder: str) -> DataFrame:
    derived = metadata.derived_organs(
        _organ_documents(spark, folder, "error", "model_organ_part"), _organ_documents(spark, folder, "click", "tissue")
    )
    return (
        read(spark, folder, "customer")
        .join(derived, F.col("c_custkey") == F.col("bundle_fqid"), "left")
        .select(
            F.col("c_custkey").alias("bundle"),
            F.coalesce("organ", "c_mktsegment").alias("organ"),
            F.when(F.col("organ").isNotNull(), F.col("part")).otherwise("whole").alias("part"),
        )
    )


@query(
    """select n_name as term from nation union select c_mktsegment from customer
    union select unnest(string_split(p_name, ' ')) from part"""
)
def distinct_terms(spark: SparkSession, folder: str) -> DataFrame:
    words = read(spark, folder, "part").select(F.split("p_name", " ").alias("words"))
    return metadata.distinct_terms(
        {
            "nation": (read(spark, folder, "nation"), ["n_name"]),
            "customer": (read(spark, folder, "customer"), ["c_mktsegment"]),
            "part": (words, ["words"]),
        }
    )


@query(
    """select distinct 'REG:' || n_regionkey::varchar as term from nation
    where n_regionkey not in (select r_regionkey from region where r_name <> 'MIDDLE EAST')"""
)
def unresolved_terms(spark: SparkSession, folder: str) -> DataFrame:
    nations = read(spark, folder, "nation").select(F.concat(F.lit("REG:"), "n_regionkey").alias("organ_ontology"))
    terms = metadata.distinct_terms({"nation": (nations, ["organ_ontology"])})
    return metadata.unresolved_terms(terms, _labels(spark, folder))


@query(
    """with versions as (select l_orderkey, l_linenumber, case when l_discount < 0.02 then null else
      (l_quantity / 3)::integer end as major, case when l_tax > 0.06 then null else l_linenumber - 1 end as minor
      from lineitem)
    select l_orderkey as entity, l_linenumber as number from versions where major is null
    or (major = 1 and minor >= 0) or (major = 6 and minor <= 2) or major between 2 and 5"""
)
def schema_gate(spark: SparkSession, folder: str) -> DataFrame:
    major = F.when(F.col("l_discount") >= 0.02, F.rint(F.col("l_quantity") / 3).cast("int"))
    minor = F.when(F.col("l_tax") <= 0.06, F.col("l_linenumber") - 1)
    gate = version_gate(F.col("major"), F.col("minor"), fixed.SCHEMA_VERSIONS["library_preparation_protocol"])
    return (
        read(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", major.alias("major"), minor.alias("minor"))
        .filter(gate)
        .select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("number"))
    )


@query(
    """select p_partkey as bundle_fqid from part
    where (p_type = 'ECONOMY' or p_type = 'PROMO') and p_size <> 7
    and (p_size > 30 or p_size > 20 and p_retailprice < 1000)"""
)
def bundle_select(spark: SparkSession, folder: str) -> DataFrame:
    return select_bundles(_bundle_summary(spark, folder))


@query(
    """select p_partkey as bundle_fqid from part
    where (p_brand = 'Brand#2' or p_partkey in (select l_partkey from lineitem where l_quantity >= 50)) and p_size <> 7
    and (p_size > 30 or p_size > 20 and p_retailprice < 1000)"""
)
def bundle_select_listed(spark: SparkSession, folder: str) -> DataFrame:
    listed = read(spark, folder, "lineitem").filter("l_quantity >= 50").select("l_partkey")
    return select_bundles(_bundle_summary(spark, folder), projects=["Brand#2"], bundles=listed)


def _bundle_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as bundles: brand as project, type as assay, size as taxon, process and schema version."""
    size = F.col("p_size")
    cheap = F.col("p_retailprice") < 1000
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("bundle_fqid"),
        F.array("p_brand").alias("project_ids"),
        F.array(F.when(F.col("p_type") == "ECONOMY", fixed.LIBRARY_METHOD_ONTOLOGY)).alias("method_ontologies"),
        F.array(F.when(F.col("p_type") == "PROMO", fixed.LIBRARY_METHOD_LABEL)).alias("method_labels"),
        F.array(F.when(size != 7, 9606).otherwise(7955)).alias("taxa"),
        F.array(F.when(size > 20, "analysis").otherwise("import")).alias("process_types"),
        F.array(
            F.struct(
                F.when(size <= 30, F.when(cheap, 14).otherwise(15)).alias("major"),
                F.when(cheap, 1).otherwise(2).alias("minor"),
            )
        ).alias("project"),
    )


@query(
    """select distinct p_partkey as parent, unnest(string_split(p_name, ' ')) as child, 'x' as place from part"""
)
def explode_children(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's words as the contributors of a project: one row per child, through the library's own exploding."""
    person = lambda w: F.struct(w.alias("name"), F.lit(None).cast("string").alias("contact_name"), F.lit("x").alias("institution"))
    words = F.transform(F.split("p_name", " "), person)
    projects = read(spark, folder, "part").select(F.col("p_partkey").alias("projectkey"), words.alias("contributors"))
    found = metadata.contributors(projects)
    return found.select(F.col("projectkey").alias("parent"), F.col("cont_name").alias("child"), F.col("cont_institution").alias("place"))


@query(
    """select conv_id as bundle, coalesce(case when role = 'user' then text end, text || '!') as name,
    case when role = 'user' then 't' when role <> 'user' then 'f' else '' end as flag, turn from conversations"""
)
def alt_names(spark: SparkSession, folder: str) -> DataFrame:
    is_user = F.col("role") == "user"
    name = text.first_of(F.when(is_user, F.col("text")), F.concat("text", F.lit("!")))
    return read(spark, folder, "conversations").select(
        F.col("conv_id").alias("bundle"), name.alias("name"), text.short_boolean(is_user).alias("flag"), "turn"
    )


@query(
    """select p_partkey as id, concat_ws('|', p_partkey::varchar, p_name, coalesce(nullif(p_brand, 'Brand#2'), ''),
    case when p_size > 25 then 'True' else 'False' end) as line from part"""
)
def bool_text(spark: SparkSession, folder: str) -> DataFrame:
    line = text.delimited(
        F.col("p_partkey"), F.col("p_name"), F.nullif("p_brand", F.lit("Brand#2")), text.long_boolean(F.col("p_size") > 25)
    )
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))


@query(
    """select p_partkey as bundle, coalesce(list_filter(string_split(p_name, ' '), lambda w: ends_with(w, 't'))[1], '') as uuid
    from part"""
)
def manifest_entry(spark: SparkSession, folder: str) -> DataFrame:
    """The first file with a suffix: the words of a part name are the files of its manifest."""
    files = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name"), w.alias("uuid")))
    entry = manifest_file(F.col("files"), "t")
    return (
        read(spark, folder, "part")
        .select("p_partkey", files.alias("files"))
        .select(F.col("p_partkey").alias("bundle"), text.or_blank(entry["uuid"]).alias("uuid"))
    )
