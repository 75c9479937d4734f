"""Dimension tables from bundle documents."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cellframe import fixed
from cellframe.functions import ontology, text
from cellframe.functions.identifiers import bundle_uuid, bundle_version, disposition
from cellframe.operators.consensus import consensus, representative, single_or_blank
from cellframe.operators.keyed import concat
from cellframe.session import build_side, durable

def _terms(path: str) -> Column:
    """Ontology terms of a list attribute, empty list when absent."""
    return F.coalesce(F.col(path), F.array().cast("array<string>"))


def _agreed(value: Column) -> Column:
    return consensus(text.or_blank(value), F.lit(""))


def _agreed_terms(path: str) -> Column:
    return consensus(_terms(path), F.array(F.lit("")))


def analysis(protocols: DataFrame) -> DataFrame:
    """One row per analysis protocol document and bundle."""
    protocol = F.col("protocol_core.protocol_id")
    return protocols.select(
        F.col("provenance.document_id").alias("analysiskey"),
        "bundle_fqid",
        bundle_uuid(F.col("bundle_fqid")).alias("bundle_uuid"),
        bundle_version(F.col("bundle_fqid")).alias("bundle_version"),
        protocol.alias("protocol"),
        disposition(protocol).alias("awg_disposition"),
    ).distinct()


def projects(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(project, contributor, publication)`` without test projects; a project without a short name is none."""
    short_name = F.coalesce("project_core.project_short_name", F.lit(""))
    kept = documents.filter(~short_name.contains(fixed.TEST_PROJECT_MARK)).withColumn(
        "projectkey", F.col("provenance.document_id")
    )
    project = kept.select(
        "projectkey",
        F.col("project_core.project_short_name").alias("short_name"),
        F.col("project_core.project_title").alias("title"),
    ).distinct()
    return project, contributors(kept), publications(kept)


def contributors(kept: DataFrame) -> DataFrame:
    person = F.col("person")
    return (
        kept.select("projectkey", F.explode("contributors").alias("person"))
        .select(
            "projectkey",
            text.first_of(person["name"], person["contact_name"]).alias("cont_name"),
            text.or_blank(person["institution"]).alias("cont_institution"),
        )
        .distinct()
    )


def publications(kept: DataFrame) -> DataFrame:
    paper = F.col("paper")
    return (
        kept.select("projectkey", F.explode("publications").alias("paper"))
        .select(
            "projectkey",
            text.first_of(paper["title"], paper["publication_title"]).alias("pub_title"),
            text.or_blank(paper["doi"]).alias("pub_doi"),
        )
        .distinct()
    )


def derived_organs(organoids: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """``(bundle_fqid, organ, part)`` of bundles whose organ is a model: organoids win over cell lines."""

    def model(documents: DataFrame, part: str, mark: str, rank: int) -> DataFrame:
        return documents.groupBy("bundle_fqid").agg(
            F.struct(
                F.lit(rank).alias("rank"),
                single_or_blank(F.col("model_organ.ontology"), mark).alias("organ"),
                single_or_blank(F.nullif(F.col(f"{part}.ontology"), F.lit("")), mark).alias("part"),
            ).alias("model")
        )

    both = model(organoids, "model_organ_part", fixed.ORGANOID_MARK, 0).unionByName(
        model(cell_lines, "tissue", fixed.CELL_LINE_MARK, 1)
    )
    return both.groupBy("bundle_fqid").agg(F.min("model").alias("model")).select(
        "bundle_fqid", "model.organ", "model.part"
    )


def _marked_label(term: Column) -> Column:
    """Label of a joined term with the term's remark, empty when the term has none."""
    return F.coalesce(F.concat(F.col("_label"), ontology.mark(term)), F.lit(""))


def _lookup(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("term").alias("_plain")).agg(F.min("label").alias("_label"))


def with_label(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the label of a term column; ``labels`` is ``(term, label)`` with terms as ``prefix:accession``.

    A remark behind a term is carried over to its label. Terms without a label get empty text.
    """
    term = F.col(column)
    return (
        frame.join(_lookup(labels), ontology.plain(term) == F.col("_plain"), "left")
        .withColumn(name, _marked_label(term))
        .drop("_plain", "_label")
    )


def with_labels(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the labels of an array of terms, in the order of the terms.

    Each distinct array is looked up once; a group is regathered from its own terms only.
    """
    term = F.col("_term")
    found = (
        frame.select(column)
        .distinct()
        .select(column, F.posexplode(column).alias("_place", "_term"))
        .join(_lookup(labels), ontology.plain(term) == F.col("_plain"), "left")
        .groupBy(column)
        .agg(F.array_sort(F.collect_list(F.struct("_place", _marked_label(term).alias("_text")))).alias("_found"))
        .select(column, F.transform("_found", lambda e: e["_text"]).alias(name))
    )
    # Written, so that Spark knows how few they are and does not bring all rows of a common array into one task.
    return frame.join(build_side(durable(found, "labelled")), column, "left").withColumn(
        name, F.coalesce(name, F.array().cast("array<string>"))
    )


def distinct_terms(frames: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``(term)``: every distinct ontology term of the named columns, single or listed."""
    found = []
    for frame, columns in frames.values():
        for column in columns:
            value = F.col(column)
            if frame.schema[column].dataType.typeName() == "array":
                value = F.explode(value)
            found.append(frame.select(value.alias("term")).distinct())
    return concat(*found).filter("term != ''").distinct()


def unresolved_terms(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """Terms the label table does not know."""
    known = labels.select(F.col("term").alias("_plain")).distinct()
    return terms.join(known, ontology.plain(F.col("term")) == F.col("_plain"), "left_anti")


def donor_facts(documents: DataFrame) -> DataFrame:
    """What the donors of each bundle agree on."""
    return documents.groupBy("bundle_fqid").agg(
        representative(F.col("provenance.document_id")).alias("donorkey"),
        _agreed_terms("human_specific.ethnicity.ontology").alias("ethnicity"),
        _agreed_terms("diseases.ontology").alias("diseases"),
        _agreed(F.col("development_stage.ontology")).alias("development_stage_ontology"),
        _agreed(F.col("sex")).alias("sex"),
        _agreed(F.col("is_living")).alias("is_living"),
    )


def specimen_facts(documents: DataFrame) -> DataFrame:
    """What the specimens of each bundle agree on."""
    return documents.groupBy("bundle_fqid").agg(
        representative(F.col("provenance.document_id")).alias("specimenkey"),
        _agreed(F.col("organ.ontology")).alias("organ_ontology"),
        _agreed_terms("organ_parts.ontology").alias("organ_parts"),
        _agreed_terms("diseases.ontology").alias("diseases"),
    )


def suspension_facts(documents: DataFrame) -> DataFrame:
    """What the cell suspensions of each bundle agree on."""
    return documents.groupBy("bundle_fqid").agg(
        representative(F.col("provenance.document_id")).alias("cellsuspensionkey"),
        _agreed_terms("genus_species.ontology").alias("genus_species"),
    )


def library_facts(documents: DataFrame) -> DataFrame:
    """What the library preparations of each bundle agree on; either spelling of the method is read."""
    method = text.first_of(
        F.col("library_construction_method.ontology"), F.col("library_construction_approach.ontology")
    )
    molecule = F.col("input_nucleic_acid_molecule.ontology")
    return documents.groupBy("bundle_fqid").agg(
        representative(F.col("provenance.document_id")).alias("librarykey"),
        _agreed(molecule).alias("input_nucleic_acid_ontology"),
        _agreed(method).alias("construction_approach_ontology"),
        _agreed(F.col("end_bias")).alias("end_bias"),
        _agreed(F.col("strand")).alias("strand"),
        (F.count_if(method.isNull() | molecule.isNull()) == 0).alias("complete"),
    )


#: Prefixes of the columns that :func:`bundle_facts` gives for each kind of document.
_KINDS = ("donor", "specimen", "suspension", "library", "organ")


def bundle_facts(documents: Mapping[str, DataFrame]) -> DataFrame:
    """What a bundle's documents say of it: one row for each bundle that has a donor, written once and read several times.

    Columns are named by kind and fact, and null where a bundle has no document of the kind. Every kind is summed up by
    bundle, so that they meet where they lie.
    """
    facts = {
        "donor": donor_facts(documents["donor_organism"]),
        "specimen": specimen_facts(documents["specimen_from_organism"]),
        "suspension": suspension_facts(documents["cell_suspension"]),
        "library": library_facts(documents["library_preparation_protocol"]),
        "organ": derived_organs(documents["organoid"], documents["cell_line"]),
    }
    named = [facts[kind].select("bundle_fqid", *(F.col(c).alias(f"{kind}.{c}") for c in facts[kind].columns[1:])) for kind in _KINDS]
    return durable(reduce(lambda left, right: left.join(right, "bundle_fqid", "left"), named), "bundle-facts")


def _fact(kind: str, name: str) -> Column:
    return F.col(f"`{kind}.{name}`").alias(name)


def _facts(facts: DataFrame, kind: str) -> list[Column]:
    """The columns of a kind, by their own names."""
    return [_fact(kind, c.partition(".")[2]) for c in facts.columns if c.startswith(f"{kind}.")]


def _sound() -> Column:
    there = _fact("specimen", "specimenkey").isNotNull() & _fact("suspension", "cellsuspensionkey").isNotNull()
    return there & F.coalesce(_fact("library", "complete"), F.lit(False))


def unfit_specimens(facts: DataFrame) -> DataFrame:
    """``(entity, reason)`` of bundles that have a donor but lack one of the other kinds."""
    return facts.filter(~_sound()).select(
        F.col("bundle_fqid").alias("entity"),
        F.when(_fact("specimen", "specimenkey").isNull(), "no specimen")
        .when(_fact("suspension", "cellsuspensionkey").isNull(), "no cell suspension")
        .when(_fact("library", "librarykey").isNull(), "no library preparation")
        .otherwise("library preparation without method or molecule")
        .alias("reason"),
    )


def specimen_tables(facts: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """``donor``, ``specimen``, ``cell_suspension`` and ``library_preparation`` of the bundles that lack nothing."""
    kept = facts.filter(_sound())
    specimenkey, organ = _fact("specimen", "specimenkey"), _fact("organ", "organ")
    donor = kept.select(*_facts(facts, "donor")).distinct()
    specimen = kept.select(*_facts(facts, "specimen"), _fact("donor", "donorkey")).distinct()
    suspension = kept.select(
        _fact("suspension", "cellsuspensionkey"),
        specimenkey,
        F.coalesce(organ, _fact("specimen", "organ_ontology")).alias("derived_organ_ontology"),
        F.when(organ.isNotNull(), F.array(_fact("organ", "part"))).otherwise(_fact("specimen", "organ_parts")).alias("parts"),
        _fact("suspension", "genus_species"),
    ).distinct()
    library = kept.select(*_facts(facts, "library")).drop("complete").distinct()
    return {
        "donor": _donor_rows(donor, labels),
        "specimen": _specimen_rows(specimen, labels),
        "cell_suspension": _suspension_rows(suspension, labels),
        "library_preparation": _library_rows(library, labels),
    }


def _donor_rows(donor: DataFrame, labels: DataFrame) -> DataFrame:
    donor = with_labels(donor, labels, "ethnicity", "ethnicity_labels")
    donor = with_labels(donor, labels, "diseases", "diseases_labels")
    donor = with_label(donor, labels, "development_stage_ontology", "development_stage_label")
    return donor.select(
        "donorkey",
        text.joined(F.col("ethnicity")).alias("ethnicity_ontology"),
        text.joined(F.col("ethnicity_labels")).alias("ethnicity_label"),
        text.joined(F.col("diseases")).alias("diseases_ontology"),
        text.joined(F.col("diseases_labels")).alias("diseases_label"),
        "development_stage_ontology",
        "development_stage_label",
        "sex",
        "is_living",
    )


def _specimen_rows(specimen: DataFrame, labels: DataFrame) -> DataFrame:
    specimen = with_label(specimen, labels, "organ_ontology", "organ_label")
    specimen = with_labels(specimen, labels, "organ_parts", "parts_labels")
    specimen = with_labels(specimen, labels, "diseases", "diseases_labels")
    return specimen.select(
        "specimenkey",
        "donorkey",
        "organ_ontology",
        "organ_label",
        text.joined(F.col("organ_parts")).alias("organ_parts_ontology"),
        text.joined(F.col("parts_labels")).alias("organ_parts_label"),
        text.joined(F.col("diseases")).alias("diseases_ontology"),
        text.joined(F.col("diseases_labels")).alias("diseases_label"),
    )


def _suspension_rows(suspension: DataFrame, labels: DataFrame) -> DataFrame:
    suspension = with_label(suspension, labels, "derived_organ_ontology", "derived_organ_label")
    suspension = with_labels(suspension, labels, "parts", "parts_labels")
    suspension = with_labels(suspension, labels, "genus_species", "species_labels")
    return suspension.select(
        "cellsuspensionkey",
        "specimenkey",
        "derived_organ_ontology",
        "derived_organ_label",
        text.joined(F.col("parts")).alias("derived_organ_parts_ontology"),
        text.joined(F.col("parts_labels")).alias("derived_organ_parts_label"),
        text.joined(F.col("genus_species")).alias("genus_species_ontology"),
        text.joined(F.col("species_labels")).alias("genus_species_label"),
    )


def _library_rows(library: DataFrame, labels: DataFrame) -> DataFrame:
    library = with_label(library, labels, "input_nucleic_acid_ontology", "input_nucleic_acid_label")
    library = with_label(library, labels, "construction_approach_ontology", "construction_approach_label")
    return library.select(
        "librarykey",
        "input_nucleic_acid_ontology",
        "input_nucleic_acid_label",
        "construction_approach_ontology",
        "construction_approach_label",
        "end_bias",
        "strand",
    )
