"""From a landing zone to the warehouse tables and the rows that had to be set aside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.fixed import SCHEMA_VERSIONS
from cellframe.operators.keyed import concat
from cellframe.plans import counts, metadata
from cellframe.schemas import WAREHOUSE
from cellframe.session import build_side, durable
from cellframe.sources.bundles import CORRUPT, Landing

def corrupt_documents(landing: Landing) -> DataFrame:
    """``(entity, reason)`` of documents and manifests that are not valid JSON."""
    manifests = landing.manifests.filter(F.col(CORRUPT).isNotNull()).select(
        F.concat("bundle_fqid", F.lit("/manifest")).alias("entity"), F.lit("unreadable document").alias("reason")
    )
    return concat(
        manifests,
        *(
            frame.filter(F.col(CORRUPT).isNotNull()).select(
                F.concat(F.col("bundle_fqid"), F.lit(f"/{kind}_"), F.col("ordinal").cast("string")).alias("entity"),
                F.lit("unreadable document").alias("reason"),
            )
            for kind, frame in landing.documents.items()
        )
    )


def seen_bundles(landing: Landing) -> DataFrame:
    """Every bundle of which anything has arrived."""
    parts = (*landing.documents.values(), landing.manifests, landing.genes, landing.isoforms, landing.calls, landing.chunks, landing.axis)
    return concat(*(frame.select("bundle_fqid") for frame in parts)).distinct()


def sound_part(landing: Landing) -> tuple[Landing, DataFrame, DataFrame]:
    """``(landing, keys, quarantine)``: what is left when every bundle with a fault goes as a whole.

    Faults are an unreadable document, no analysis protocol, a key that cells need and that is missing, and counts that
    are absent, incomplete or unreadable. A bundle of an assay that isn't served stays: it has no cells, but its
    documents are loaded. ``keys`` are the per-bundle facts of the bundles that stay.
    """
    unreadable = durable(corrupt_documents(landing), "unreadable")
    keys = build_side(durable(counts.bundle_keys(landing), "bundle-keys"))
    without = seen_bundles(landing).join(keys, "bundle_fqid", "left_anti").select("bundle_fqid", F.lit("no analysis protocol").alias("reason"))
    lacking = counts.rejected(keys.filter("assay IS NOT NULL")).withColumnRenamed("entity", "bundle_fqid")
    faults = durable(concat(without, lacking, counts.count_faults(landing, keys)), "faults")
    broken = unreadable.select(F.element_at(F.split("entity", "/"), 1).alias("bundle_fqid"))
    gone = build_side(durable(concat(faults.select("bundle_fqid"), broken).distinct(), "set-aside"))
    listed = faults.join(build_side(broken), "bundle_fqid", "left_anti").withColumnRenamed("bundle_fqid", "entity")
    return landing.without(gone), keys.join(gone, "bundle_fqid", "left_anti"), concat(unreadable, listed)


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Columns in the table's order and types."""
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in WAREHOUSE[table].fields))


def count_tables(landing: Landing, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """``cell`` and ``expression`` of every bundle of a supported assay."""
    sound = build_side(counts.complete(keys))
    plate_cells, plate_values = counts.plate_tables(landing, sound)
    droplet_cells, droplet_values, lost = counts.droplet_tables(landing, sound)
    return {
        "cell": plate_cells.unionByName(droplet_cells),
        "expression": plate_values.unionByName(droplet_values),
    }, counts.rejected(keys).unionByName(lost)


def ingest_bundles(landing: Landing, labels: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables except ``feature``, and a quarantine frame ``(entity, reason, logged_at)``.

    Nothing fails because of one bad bundle: a bundle is loaded as a whole or listed, with no row in any table. The
    small per-bundle facts are written on the way, so that the tables do not parse the documents again and again.
    """
    arrived = landing
    landing, keys, unfit = sound_part(landing)
    labels = durable(labels, "labels")
    facts = metadata.bundle_facts(landing.documents)
    bad_dimensions = durable(metadata.unfit_specimens(facts), "unfit-specimens")
    unfit_bundles = build_side(bad_dimensions.select(F.col("entity").alias("bundle_fqid")))
    landing, keys = landing.without(unfit_bundles), keys.join(unfit_bundles, "bundle_fqid", "left_anti")
    documents = landing.documents
    # Counts of plate bundles meet the keys of the sound ones anyway, so they need not be freed of the others before.
    tables, bad_counts = count_tables(replace(landing, genes=arrived.genes, isoforms=arrived.isoforms), keys)
    dimensions = metadata.specimen_tables(facts, labels)
    project, contributor, publication = metadata.projects(documents["project"])
    tables |= dimensions
    tables |= {
        "analysis": metadata.analysis(documents["analysis_protocol"]),
        "project": project,
        "contributor": contributor,
        "publication": publication,
    }
    quarantine = concat(unfit, bad_counts, bad_dimensions).withColumn("logged_at", F.current_timestamp())
    return {name: conform(frame, name) for name, frame in tables.items()}, quarantine


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Every warehouse table without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in WAREHOUSE.items()}


def bundle_summary(landing: Landing) -> DataFrame:
    """One row per bundle with what bundle selection looks at.

    Each kind contributes the distinct values of its documents, so a bundle's arrays are as short as its set of
    values, however many documents it has. A document without a version adds none. All kinds are gathered at once, after
    the one shuffle that brings a bundle's documents together.
    """
    told = {
        "project": {"project_ids": F.array("provenance.document_id")},
        "library_preparation_protocol": {
            "method_ontologies": F.array("library_construction_approach.ontology", "library_construction_method.ontology"),
            "method_labels": F.array("library_construction_approach.ontology_label", "library_construction_method.ontology_label"),
        },
        "donor_organism": {"taxa": F.col("biomaterial_core.ncbi_taxon_id")},
        "analysis_process": {"process_types": F.array("type.text", "process_type.text")},
    }
    types = {name: "array<int>" if name == "taxa" else "array<string>" for columns in told.values() for name in columns}
    version = F.struct(F.col("provenance.schema_major_version").alias("major"), F.col("provenance.schema_minor_version").alias("minor"))
    kinds = [*dict.fromkeys([*told, *SCHEMA_VERSIONS])]

    def said(kind: str) -> DataFrame:
        values = [told.get(kind, {}).get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in types.items()]
        words = F.array(F.struct(F.lit(kinds.index(kind)).alias("kind"), *values, version.alias("version")))
        # Exploded rather than filtered, since a filter would parse the document a second time.
        return landing.documents[kind].select("bundle_fqid", F.explode(words if kind in told else F.when(version["major"].isNotNull(), words)).alias("said"))

    told_of = concat(*map(said, kinds)).repartition("bundle_fqid").groupBy("bundle_fqid").agg(F.collect_set("said").alias("said"))
    # A bundle without a name is one row, and no document is its own.
    own = F.when(F.col("bundle_fqid").isNotNull(), F.col("said"))
    of = lambda kind, among: F.filter(among, lambda s: s["kind"] == kinds.index(kind))
    found = told_of.filter(F.size(of("analysis_process", F.col("said"))) > 0).select(
        "bundle_fqid", *(of(kind, own).alias(kind) for kind in told), F.filter(own, lambda s: s["version"]["major"].isNotNull()).alias("versioned")
    )

    def listed(kind: str, name: str) -> Column:
        return F.flatten(F.filter(F.col(kind)[name], lambda v: v.isNotNull())).alias(name)

    def versions(kind: str) -> Column:
        pairs = F.transform(of(kind, F.col("versioned")), lambda s: s["version"])
        return F.when(F.size("versioned") > 0, F.array_distinct(pairs)).alias(kind)

    names = [name for columns in told.values() for name in columns]
    flat = found.select("bundle_fqid", *(listed(kind, name) for kind, columns in told.items() for name in columns), "versioned")
    values = [F.when(F.size(name) > 0, F.array_distinct(F.array_compact(name))).alias(name) for name in names]
    return flat.select("bundle_fqid", *values, *map(versions, SCHEMA_VERSIONS))
