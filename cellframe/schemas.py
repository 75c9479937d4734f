"""Column types of the warehouse tables and of the documents they are read from."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def table(*columns: str) -> T.StructType:
    """Build a schema from ``"name type"`` texts; a trailing ``!`` means not null, the default type is string."""
    fields = []
    for column in columns:
        required = column.endswith("!")
        name, _, kind = column.rstrip("!").partition(" ")
        fields.append(T.StructField(name, _TYPES[kind or "string"], not required))
    return T.StructType(fields)


WAREHOUSE = {
    "cell": table(
        "cellkey!", "cellsuspensionkey!", "projectkey!", "librarykey!", "analysiskey!", "file_uuid!",
        "file_version!", "barcode", "genes_detected int", "total_umis int", "emptydrops_is_cell bool",
    ),
    "expression": table("cellkey!", "featurekey!", "exprtype!", "exrpvalue float!"),
    "feature": table(
        "featurekey!", "featurename!", "featuretype", "chromosome", "featurestart int", "featureend int",
        "isgene bool", "genus_species!",
    ),
    "analysis": table(
        "analysiskey!", "bundle_fqid!", "bundle_uuid!", "bundle_version!", "protocol", "awg_disposition"
    ),
    "donor": table(
        "donorkey!", "ethnicity_ontology", "ethnicity_label", "diseases_ontology", "diseases_label",
        "development_stage_ontology", "development_stage_label", "sex", "is_living",
    ),
    "specimen": table(
        "specimenkey!", "donorkey!", "organ_ontology", "organ_label", "organ_parts_ontology",
        "organ_parts_label", "diseases_ontology", "diseases_label",
    ),
    "cell_suspension": table(
        "cellsuspensionkey!", "specimenkey!", "derived_organ_ontology", "derived_organ_label",
        "derived_organ_parts_ontology", "derived_organ_parts_label", "genus_species_ontology",
        "genus_species_label",
    ),
    "library_preparation": table(
        "librarykey!", "input_nucleic_acid_ontology", "input_nucleic_acid_label",
        "construction_approach_ontology", "construction_approach_label", "end_bias", "strand",
    ),
    "project": table("projectkey!", "short_name!", "title!"),
    "publication": table("projectkey!", "pub_title!", "pub_doi"),
    "contributor": table("projectkey!", "cont_name!", "cont_institution"),
}

_TERM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("text", "ontology", "ontology_label")]
)
_TERMS = T.ArrayType(_TERM)


def _document(**fields: T.DataType) -> T.StructType:
    provenance = T.StructType(
        [
            T.StructField("document_id", T.StringType()),
            T.StructField("schema_major_version", T.IntegerType()),
            T.StructField("schema_minor_version", T.IntegerType()),
        ]
    )
    return T.StructType(
        [T.StructField("provenance", provenance)] + [T.StructField(n, t) for n, t in fields.items()]
    )


_PERSON = table("name", "contact_name", "institution")
_PAPER = table("title", "publication_title", "doi")

DOCUMENTS = {
    "donor_organism": _document(
        human_specific=T.StructType([T.StructField("ethnicity", _TERMS)]),
        diseases=_TERMS,
        development_stage=_TERM,
        sex=T.StringType(),
        is_living=T.StringType(),
        biomaterial_core=T.StructType([T.StructField("ncbi_taxon_id", T.ArrayType(T.IntegerType()))]),
    ),
    "specimen_from_organism": _document(
        genus_species=_TERMS, organ=_TERM, organ_parts=_TERMS, diseases=_TERMS
    ),
    "cell_suspension": _document(genus_species=_TERMS),
    "library_preparation_protocol": _document(
        input_nucleic_acid_molecule=_TERM,
        library_construction_method=_TERM,
        library_construction_approach=_TERM,
        end_bias=T.StringType(),
        strand=T.StringType(),
    ),
    "organoid": _document(model_organ=_TERM, model_organ_part=_TERM),
    "cell_line": _document(model_organ=_TERM, tissue=_TERM),
    "project": _document(
        project_core=table("project_title", "project_short_name"),
        contributors=T.ArrayType(_PERSON),
        publications=T.ArrayType(_PAPER),
    ),
    "analysis_protocol": _document(protocol_core=table("protocol_id")),
    "analysis_process": _document(type=table("text"), process_type=table("text")),
}

MANIFEST = T.StructType([T.StructField("files", T.ArrayType(table("name", "uuid", "version")))])
NOTIFICATION = table("bundle_uuid", "bundle_version", "event_type", "seq long")
REQUEST_LOG = table(
    "request_id!", "request_hash", "data_version int", "creation_date", "genus_species", "format",
    "feature", "num_bundles int", "job_status", "error",
)
DATA_VERSION = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("creation_date", T.StringType()),
        T.StructField("project_cells", T.MapType(T.StringType(), T.LongType())),
        T.StructField("schema_versions", T.MapType(T.StringType(), T.StringType())),
    ]
)
RESULT_MANIFEST = T.StructType(
    [
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("url", T.StringType()),
                        T.StructField("meta", table("content_length long", "record_count long")),
                    ]
                )
            ),
        ),
        T.StructField(
            "schema", T.StructType([T.StructField("elements", T.ArrayType(table("name")))])
        ),
        T.StructField("meta", table("content_length long", "record_count long")),
    ]
)
EXPRESSION_RESULT = table("cellkey", "featurekey", "exprvalue float")
