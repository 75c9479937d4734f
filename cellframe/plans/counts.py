"""Cells and values from plate assays (one cell per bundle) and droplet assays (many)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellframe import fixed
from cellframe.functions.identifiers import assay, droplet_cell_key, strip_version
from cellframe.operators.consensus import representative
from cellframe.operators.keyed import concat
from cellframe.operators.reshape import entries_to_long, nonzero_entries
from cellframe.session import durable
from cellframe.sources.bundles import Landing, manifest_file


def collapse_versions(counts: DataFrame, *by: str) -> DataFrame:
    """``(by…, featurekey, TPM, Count)``: measures summed over ids that differ only in their version."""
    return counts.groupBy(*by, strip_version(F.col("id")).alias("featurekey")).agg(
        F.sum("tpm").alias(fixed.TPM), F.sum("expected_count").alias(fixed.COUNT)
    )


def typed_values(collapsed: DataFrame, *by: str) -> DataFrame:
    """One row per measure of every id that was counted at all."""
    return collapsed.filter(F.col(fixed.COUNT) != 0).unpivot(
        [*by, "featurekey"], [fixed.TPM, fixed.COUNT], "exprtype", "exrpvalue"
    )


def genes_detected(collapsed: DataFrame, *by: str) -> DataFrame:
    """``(by…, genes_detected)``: ids with a positive count."""
    return collapsed.groupBy(*by).agg(F.count_if(F.col(fixed.COUNT) > 0).cast("int").alias("genes_detected"))


def split_droplets(rows: DataFrame, calls: DataFrame, minimum: int = fixed.MIN_DROPLET_UMIS) -> tuple[DataFrame, DataFrame]:
    """Rows with enough molecules, with their call; and the rows no call exists for."""
    joined = rows.join(calls, ["bundle_fqid", "cell_id"], "left")
    return joined.filter(F.col("total") >= minimum), joined.filter(F.col("total").isNull())


def bundle_keys(landing: Landing) -> DataFrame:
    """One row per bundle: the keys its cells carry, null where a document is missing, and its assay."""
    documents = landing.documents

    def first(kind: str, name: str) -> DataFrame:
        return documents[kind].filter("ordinal = 0").select(
            "bundle_fqid", F.col("provenance.document_id").alias(name)
        )

    protocol = documents["analysis_protocol"].filter("ordinal = 0").select(
        "bundle_fqid",
        F.col("provenance.document_id").alias("analysiskey"),
        assay(F.col("protocol_core.protocol_id")).alias("assay"),
    )
    library = documents["library_preparation_protocol"].groupBy("bundle_fqid").agg(
        representative(F.col("provenance.document_id")).alias("librarykey")
    )
    files = F.when(F.col("assay") == "plate", manifest_file(F.col("files"), ".genes.results")).otherwise(
        manifest_file(F.col("files"), ".zattrs")
    )
    return (
        protocol.join(first("cell_suspension", "cellsuspensionkey"), "bundle_fqid", "left")
        .join(first("project", "projectkey"), "bundle_fqid", "left")
        .join(library, "bundle_fqid", "left")
        .join(landing.manifests.select("bundle_fqid", "files"), "bundle_fqid", "left")
        .withColumn("file", files)
        .select(
            "bundle_fqid", "assay", "cellsuspensionkey", "projectkey", "librarykey", "analysiskey",
            F.col("file.uuid").alias("file_uuid"), F.col("file.version").alias("file_version"),
        )
    )


def count_faults(landing: Landing, keys: DataFrame) -> DataFrame:
    """``(bundle_fqid, reason)`` of bundles whose counts are not all there, or not readable.

    One row per bundle and kind of file is gathered, so what is compared is as small as the list of bundles.
    """
    bundle = "bundle_fqid"

    def measured(counts: DataFrame, name: str) -> DataFrame:
        bad = F.count_if(F.col("id").isNull() | F.col("tpm").isNull() | F.col("expected_count").isNull())
        return counts.groupBy(bundle).agg(F.lit(True).alias(name), (bad > 0).alias(f"bad_{name}"))

    calls = landing.calls.groupBy(bundle, "cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell_id").isNull() | F.col("total").isNull() | F.col("is_cell").isNull()).alias("bad"))
    calls = calls.groupBy(bundle).agg((F.max("n") > 1).alias("twice"), (F.sum("bad") > 0).alias("bad_calls"), F.lit(True).alias("calls"))
    axes = landing.axis.groupBy(bundle).agg(F.count_distinct("gene_ids").alias("axes"), F.max(F.size("gene_ids")).alias("genes_listed"))
    width = F.size("values")
    rows = landing.chunks.groupBy(bundle).agg(F.min(width).alias("narrowest"), F.max(width).alias("widest"))
    found = keys.select(bundle, "assay")
    for facts in (measured(landing.genes, "genes"), measured(landing.isoforms, "isoforms"), calls, axes, rows):
        found = found.join(facts, bundle, "left")
    plate, droplet = F.col("assay") == "plate", F.col("assay") == "droplet"
    reasons = {
        "no gene counts": plate & F.col("genes").isNull(),
        "no isoform counts": plate & F.col("isoforms").isNull(),
        "unreadable or missing column in gene counts": plate & F.col("bad_genes"),
        "unreadable or missing column in isoform counts": plate & F.col("bad_isoforms"),
        "no droplet calls": droplet & F.col("calls").isNull(),
        "unreadable or missing column in droplet calls": droplet & F.col("bad_calls"),
        "two droplet calls for one barcode": droplet & F.col("twice"),
        "no dense rows": droplet & F.col("widest").isNull(),
        "no gene axis": droplet & F.col("axes").isNull(),
        "several gene axes": droplet & (F.col("axes") > 1),
        "rows of another length than the gene axis": droplet
        & ((F.col("narrowest") != F.col("genes_listed")) | (F.col("widest") != F.col("genes_listed"))),
    }
    listed = F.array_compact(F.array(*(F.when(condition, F.lit(reason)) for reason, condition in reasons.items())))
    return found.select(bundle, F.explode(listed).alias("reason"))


_KEYS = ("cellsuspensionkey", "projectkey", "librarykey", "analysiskey", "file_uuid", "file_version")


def complete(keys: DataFrame) -> DataFrame:
    """Bundles of a supported assay that lack nothing."""
    return keys.dropna(subset=["assay", *_KEYS])


def rejected(keys: DataFrame) -> DataFrame:
    """``(entity, reason)`` of the other bundles."""
    missing = F.concat_ws(",", *(F.when(F.col(k).isNull(), F.lit(k)) for k in _KEYS))
    return keys.select(
        F.col("bundle_fqid").alias("entity"),
        F.when(F.col("assay").isNull(), F.lit("unsupported analysis protocol"))
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .alias("reason"),
    ).filter(F.col("reason").isNotNull())


def plate_tables(landing: Landing, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cell, expression)`` of plate bundles; the cell is the suspension.

    Counts are dealt by bundle once, for the sums as for the join with their cells; a bundle's come from a file or two.
    """
    plate = keys.filter("assay = 'plate'")
    owner = plate.select("bundle_fqid", F.col("cellsuspensionkey").alias("cellkey"))
    genes = collapse_versions(landing.genes.repartition("bundle_fqid"), "bundle_fqid")
    isoforms = collapse_versions(landing.isoforms.repartition("bundle_fqid"), "bundle_fqid")
    cells = plate.join(genes_detected(genes, "bundle_fqid"), "bundle_fqid", "left").select(
        F.col("cellsuspensionkey").alias("cellkey"),
        *_KEYS,
        F.lit(None).cast("string").alias("barcode"),
        F.coalesce("genes_detected", F.lit(0)).alias("genes_detected"),
        F.lit(None).cast("int").alias("total_umis"),
        F.lit(None).cast("boolean").alias("emptydrops_is_cell"),
    )
    values = typed_values(concat(*(kind.join(owner, "bundle_fqid") for kind in (isoforms, genes))), "cellkey")
    return cells, values.select("cellkey", "featurekey", "exprtype", F.col("exrpvalue").cast("float"))


def droplet_tables(landing: Landing, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cell, expression, quarantine)`` of droplet bundles.

    A barcode that no call exists for is set aside by itself; the other barcodes of its bundle are loaded. Ids that become equal without their version stay separate rows.
    """
    droplet = keys.filter("assay = 'droplet'")
    # Dense rows are made sparse before the first join, so that no shuffle carries their zeros.
    sparse = landing.chunks.select("bundle_fqid", "cell_id", nonzero_entries(F.col("values")).alias("entries"))
    kept, uncalled = split_droplets(sparse, landing.calls)
    kept = kept.join(droplet, "bundle_fqid").withColumn(
        "cellkey", droplet_cell_key(F.col("bundle_fqid"), F.col("cell_id"))
    )
    cells = kept.select(
        "cellkey",
        *_KEYS,
        F.col("cell_id").alias("barcode"),
        F.size("entries").alias("genes_detected"),
        F.col("total").alias("total_umis"),
        F.col("is_cell").alias("emptydrops_is_cell"),
    ).distinct()
    # Bundles of one genome share an axis: it is kept once, small enough to broadcast, whatever their number.
    owners = landing.axis.select("bundle_fqid", F.md5(F.array_join("gene_ids", "\n")).alias("axis_id"), "gene_ids")
    axis = owners.groupBy("axis_id").agg(F.first("gene_ids").alias("gene_ids"))
    axis = durable(axis.select("axis_id", F.posexplode("gene_ids").alias("position", "gene_id")), "axis")
    placed = kept.select("bundle_fqid", "cellkey", "entries").join(owners.select("bundle_fqid", "axis_id"), "bundle_fqid")
    values = entries_to_long(placed.drop("bundle_fqid"), axis, ("axis_id",)).select(
        "cellkey",
        strip_version(F.col("gene_id")).alias("featurekey"),
        F.lit(fixed.COUNT).alias("exprtype"),
        F.col("exprvalue").alias("exrpvalue"),
    )
    lost = uncalled.select(
        F.concat_ws("/", "bundle_fqid", "cell_id").alias("entity"), F.lit("no droplet call").alias("reason")
    )
    return cells, values, lost
