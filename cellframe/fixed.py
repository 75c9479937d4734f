"""Every name and number here must be exactly this for results to be right."""

# Output formats, feature kinds and species a request may name.
FORMATS = ("loom", "csv", "mtx")
ZIPPED_FORMATS = ("csv", "mtx")
FEATURES = ("gene", "transcript")
HUMAN = "Homo sapiens"
MOUSE = "Mus musculus"
SPECIES = (HUMAN, MOUSE)

# Request states.
COMPLETE = "Complete"
IN_PROGRESS = "In Progress"
FAILED = "Failed"
EXPIRED = "Expired"

# Value types stored per cell and feature; only one of them is served.
TPM = "TPM"
COUNT = "Count"

# Filter operators.
COMPARISONS = ("=", "!=", ">", "<", ">=", "<=", "in")
LOGICALS = ("and", "or", "not")

# Columns a request returns when it names none.
DEFAULT_FIELDS = (
    "cell.genes_detected",
    "cell.file_uuid",
    "cell.file_version",
    "cell.total_umis",
    "cell.emptydrops_is_cell",
    "cell.barcode",
    "cell_suspension.*",
    "donor.*",
    "specimen.organ_ontology",
    "specimen.organ_label",
    "specimen.organ_parts_ontology",
    "specimen.organ_parts_label",
    "library_preparation.*",
    "project.*",
    "analysis.*",
)

# Columns a bundle-list request returns.
BUNDLE_FIELDS = (
    "cell.genes_detected",
    "cell.file_uuid",
    "cell.file_version",
    "cell.total_umis",
    "cell.emptydrops_is_cell",
    "cell.barcode",
    "cell_suspension.*",
    "donor.*",
    "specimen.organ_ontology",
    "specimen.organ_label",
    "specimen.organ_parts_ontology",
    "specimen.organ_parts_label",
    "library_preparation.*",
    "analysis.bundle_uuid",
    "analysis.bundle_version",
    "project.short_name",
)

# Public field name -> owning table and column.
FIELDS = (
    ("cell_suspension.provenance.document_id", "cell_suspension", "cellsuspensionkey"),
    ("genes_detected", "cell", "genes_detected"),
    ("file_uuid", "cell", "file_uuid"),
    ("file_version", "cell", "file_version"),
    ("barcode", "cell", "barcode"),
    ("total_umis", "cell", "total_umis"),
    ("emptydrops_is_cell", "cell", "emptydrops_is_cell"),
    ("specimen_from_organism.provenance.document_id", "specimen", "specimenkey"),
    ("donor_organism.provenance.document_id", "donor", "donorkey"),
    ("cell_suspension.genus_species.ontology", "cell_suspension", "genus_species_ontology"),
    ("cell_suspension.genus_species.ontology_label", "cell_suspension", "genus_species_label"),
    ("donor_organism.human_specific.ethnicity.ontology", "donor", "ethnicity_ontology"),
    ("donor_organism.human_specific.ethnicity.ontology_label", "donor", "ethnicity_label"),
    ("donor_organism.diseases.ontology", "donor", "diseases_ontology"),
    ("donor_organism.diseases.ontology_label", "donor", "diseases_label"),
    ("donor_organism.development_stage.ontology", "donor", "development_stage_ontology"),
    ("donor_organism.development_stage.ontology_label", "donor", "development_stage_label"),
    ("donor_organism.sex", "donor", "sex"),
    ("donor_organism.is_living", "donor", "is_living"),
    ("specimen_from_organism.organ.ontology", "specimen", "organ_ontology"),
    ("specimen_from_organism.organ.ontology_label", "specimen", "organ_label"),
    ("specimen_from_organism.organ_parts.ontology", "specimen", "organ_parts_ontology"),
    ("specimen_from_organism.organ_parts.ontology_label", "specimen", "organ_parts_label"),
    ("derived_organ_ontology", "cell_suspension", "derived_organ_ontology"),
    ("derived_organ_label", "cell_suspension", "derived_organ_label"),
    ("derived_organ_parts_ontology", "cell_suspension", "derived_organ_parts_ontology"),
    ("derived_organ_parts_label", "cell_suspension", "derived_organ_parts_label"),
    ("library_preparation_protocol.provenance.document_id", "library_preparation", "librarykey"),
    (
        "library_preparation_protocol.input_nucleic_acid_molecule.ontology",
        "library_preparation",
        "input_nucleic_acid_ontology",
    ),
    (
        "library_preparation_protocol.input_nucleic_acid_molecule.ontology_label",
        "library_preparation",
        "input_nucleic_acid_label",
    ),
    (
        "library_preparation_protocol.library_construction_method.ontology",
        "library_preparation",
        "construction_approach_ontology",
    ),
    (
        "library_preparation_protocol.library_construction_method.ontology_label",
        "library_preparation",
        "construction_approach_label",
    ),
    ("library_preparation_protocol.end_bias", "library_preparation", "end_bias"),
    ("library_preparation_protocol.strand", "library_preparation", "strand"),
    ("project.provenance.document_id", "project", "projectkey"),
    ("project.project_core.project_short_name", "project", "short_name"),
    ("project.project_core.project_title", "project", "title"),
    ("analysis_protocol.provenance.document_id", "analysis", "analysiskey"),
    ("dss_bundle_fqid", "analysis", "bundle_fqid"),
    ("bundle_uuid", "analysis", "bundle_uuid"),
    ("bundle_version", "analysis", "bundle_version"),
    ("analysis_protocol.protocol_core.protocol_id", "analysis", "protocol"),
    ("analysis_working_group_approval_status", "analysis", "awg_disposition"),
)
NUMERIC_FIELDS = ("genes_detected", "total_umis")
SPECIES_FIELD = "cell_suspension.genus_species.ontology_label"
SPECIES_FIELDS = ("cell_suspension.genus_species.ontology", "cell_suspension.genus_species.ontology_label")

# Key by which an update replaces the rows of a table.
UPSERT_KEYS = {
    "feature": "featurekey",
    "analysis": "analysiskey",
    "specimen": "specimenkey",
    "donor": "donorkey",
    "cell_suspension": "cellsuspensionkey",
    "library_preparation": "librarykey",
    "project": "projectkey",
    "publication": "projectkey",
    "contributor": "projectkey",
    "cell": "cellkey",
    "expression": "cellkey",
}

# Accepted schema versions per entity kind: (lowest major, its lowest minor, highest major, its highest minor).
SCHEMA_VERSIONS = {
    "project": (1, 0, 14, 1),
    "library_preparation_protocol": (1, 0, 6, 2),
    "analysis_protocol": (1, 0, 9, 1),
    "specimen_from_organism": (9, 0, 10, 4),
    "donor_organism": (1, 0, 15, 5),
    "cell_line": (1, 0, 14, 5),
    "cell_suspension": (1, 0, 13, 3),
    "organoid": (1, 0, 11, 3),
}

# Bundle selection.
LIBRARY_METHOD_ONTOLOGY = "EFO:0008931"
LIBRARY_METHOD_LABEL = "10X v2 sequencing"
TAXA = (9606, 10090)
ANALYSIS_PROCESS = "analysis"
TEST_PROJECT_MARK = "_test_"

# Assays, recognised by the start of the protocol id.
PLATE_PROTOCOL = "smartseq2"
DROPLET_PROTOCOL = "optimus"
BLESSED = "blessed"
COMMUNITY = "community"

# A droplet barcode needs this many molecules to be kept.
MIN_DROPLET_UMIS = 100

# Marks of derived organs.
ORGANOID_MARK = " (organoid)"
CELL_LINE_MARK = " (cell line)"

# File formats.
MTX_BANNER = "%%MatrixMarket matrix coordinate real general"
FEATURE_TYPE_10X = "Gene Expression"
LOOM_SPEC_VERSION = "2.0.1"
LOOM_TIMESTAMP = "yyyyMMdd'T'HHmmss.SSSSSS'Z'"
VERSION_TIMESTAMP = "yyyy-MM-dd'T'HHmmss.SSSSSS'Z'"
PAR_Y_SUFFIX = "_PAR_Y"

# Request lifetimes and reporting interval.
RESULT_DAYS = 30
TIMEOUT_HOURS = 36
BUNDLE_INTERVAL = 500
EMPTY_SIZE = 0

# Notification types.
UPSERT_EVENTS = ("CREATE", "UPDATE")
REMOVE_EVENTS = ("DELETE", "TOMBSTONE")

# The column in which cells and values of a store say in which bucket they lie, and the bucket of values without a cell.
BUCKET = "bucket!"
NO_BUCKET = -1

# Rows of values that are read at once, at most.
EXPRESSION_BLOCK = 1_000_000
