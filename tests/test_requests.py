import pytest
from pyspark.sql import functions as F

from cellframe.catalog import CELL_CATALOG, UnknownField
from cellframe.functions.predicates import MalformedFeature, MalformedFilter
from cellframe.plans import audits
from cellframe.plans.describe import describe_all, describe_field, field_coverage, list_fields
from cellframe.plans.request import (
    EmptyManifest,
    MatrixRequest,
    MissingBundles,
    append_barcode,
    bundle_request,
    fan_out,
    fan_out_cells,
)

ALL = {"op": "!=", "field": "file_uuid", "value": ""}
SPECIES = "cell_suspension.genus_species.ontology_label"


def request(tables, filter_=ALL, **options):
    return MatrixRequest(CELL_CATALOG, tables, filter_, **options)


def keys(frame, column="cellkey"):
    return sorted(r[column] for r in frame.collect())


def triples(frame):
    return sorted(tuple(r) for r in frame.select("cellkey", "featurekey", "exprvalue").collect())


def test_cells_keep_missing_dimensions_but_need_an_analysis(snowflake):
    cells = request(snowflake, fields=("genes_detected", "library_preparation_protocol.strand")).cells()
    assert cells.columns == ["cellkey", "genes_detected", "library_preparation_protocol.strand"]
    rows = {r["cellkey"]: r for r in cells.collect()}
    assert sorted(rows) == ["c1", "c2", "c3", "c4", "c5", "c7"]
    assert rows["c4"]["library_preparation_protocol.strand"] is None


def test_values_need_every_dimension(snowflake):
    assert triples(request(snowflake).expression()) == [
        ("c1", "G1", 1.5),
        ("c2", "G1", 4.0),
        ("c2", "G3", 3.0),
        ("c3", "G1", 6.0),
        ("c3", "M1", 5.0),
    ]


def test_value_type_and_transcripts(snowflake):
    assert triples(request(snowflake, value_type="TPM").expression()) == [("c1", "G1", 9.0)]
    assert triples(request(snowflake, feature="transcript").expression()) == [("c1", "T1", 2.0)]
    assert keys(request(snowflake, feature="transcript").features(), "featurekey") == ["T1"]


def test_species_narrow_cells_and_features(snowflake):
    mouse = request(snowflake, species="Mus musculus")
    assert keys(mouse.cells()) == ["c3", "c4"]
    assert keys(mouse.features(), "featurekey") == ["M1"]
    assert triples(mouse.expression()) == [("c3", "G1", 6.0), ("c3", "M1", 5.0)]


def test_fan_out(snowflake):
    assert list(fan_out(request(snowflake))) == ["Homo sapiens"]
    named = {"op": "not", "value": [{"op": "=", "field": SPECIES, "value": "Danio rerio"}]}
    assert list(fan_out(request(snowflake, named))) == ["Homo sapiens", "Mus musculus"]
    apart = {s: keys(r.cells()) for s, r in fan_out(request(snowflake, named)).items()}
    together = fan_out_cells(request(snowflake, named)).collect()
    for species, cells in apart.items():
        assert sorted(r["cellkey"] for r in together if r["species"] == species) == cells
    assert apart == {"Homo sapiens": ["c1", "c2", "c7"], "Mus musculus": ["c3", "c4"]}


def test_default_projection_has_public_names(snowflake):
    columns = request(snowflake).cells().columns
    assert columns[:7] == [
        "cellkey", "genes_detected", "file_uuid", "file_version", "total_umis", "emptydrops_is_cell", "barcode",
    ]
    assert "specimen_from_organism.organ.ontology_label" in columns and "dss_bundle_fqid" in columns


def test_unused_unique_dimensions_are_not_joined(snowflake):
    unique = audits.unique_dimensions(CELL_CATALOG, snowflake)
    assert unique == {d.name for d in CELL_CATALOG.dimensions}
    plain = request(snowflake, fields=("genes_detected",))
    pruned = request(snowflake, fields=("genes_detected",), unique_dimensions=unique)

    def joins(frame):
        return frame._jdf.queryExecution().analyzed().toString().count("Join ")

    assert keys(plain.cells()) == keys(pruned.cells())
    assert joins(plain.cells()) == 6 and joins(pruned.cells()) == 1
    through = request(snowflake, {"op": "=", "field": "donor_organism.sex", "value": "female"}, fields=(), unique_dimensions=unique)
    assert joins(through.cells()) == 4


def test_repeated_analysis_keys_multiply_rows(spark, snowflake):
    again = spark.createDataFrame([("a1", "b7.1", "b7", "1", "smartseq2", "blessed")], snowflake["analysis"].schema)
    tables = {**snowflake, "analysis": snowflake["analysis"].union(again)}
    assert "analysis" not in audits.unique_dimensions(CELL_CATALOG, tables)
    assert keys(request(tables, fields=()).cells()).count("c1") == 2
    assert [r["n"] for r in audits.duplicate_keys(tables["analysis"], "analysiskey").collect()] == [2]


def test_mtx_requests_carry_the_barcode(snowflake):
    assert append_barcode(CELL_CATALOG, ["genes_detected"]) == ["genes_detected", "cell.barcode"]
    assert append_barcode(CELL_CATALOG, ["barcode"]) == ["barcode"]
    assert append_barcode(CELL_CATALOG, ("cell.barcode",)) == ["cell.barcode"]
    default = CELL_CATALOG.default_fields
    append_barcode(CELL_CATALOG, default)
    assert CELL_CATALOG.default_fields is default
    assert request(snowflake, fields=("total_umis",), format="mtx").cells().columns == ["cellkey", "total_umis", "barcode"]


@pytest.mark.parametrize(
    "options, error",
    [
        ({"feature": "protein"}, MalformedFeature),
        ({"format": "xlsx"}, ValueError),
        ({"fields": ("nonsense",)}, UnknownField),
        ({"filter_": {"op": "="}}, MalformedFilter),
    ],
)
def test_bad_requests_are_refused_before_planning(snowflake, options, error):
    with pytest.raises(error):
        request(snowflake, **options)


def test_bundle_list_requests(spark, snowflake):
    names = spark.createDataFrame([("b1.2019.1",), ("b2",), ("b2",)], "bundle string")
    requests = bundle_request(CELL_CATALOG, snowflake, names)
    assert keys(requests["Homo sapiens"].cells()) == ["c1", "c2", "c7"]
    assert keys(requests["Mus musculus"].cells()) == ["c3", "c4"]
    # The library is not part of this chain, so c4 has values here.
    assert triples(requests["Mus musculus"].expression()) == [("c3", "G1", 6.0), ("c3", "M1", 5.0), ("c4", "M1", 7.0)]
    assert "project.project_core.project_title" not in requests["Mus musculus"].cells().columns
    with pytest.raises(EmptyManifest):
        bundle_request(CELL_CATALOG, snowflake, names.limit(0))
    with pytest.raises(MissingBundles):
        bundle_request(CELL_CATALOG, snowflake, names.union(spark.createDataFrame([("b3",)], "b string")))


def test_fingerprint_depends_on_parameters_and_cells_not_on_order(spark, snowflake):
    def mark(tables=snowflake, **options):
        return request(tables, **options).fingerprint().first()["fingerprint"]

    base = mark(fields=("genes_detected",))
    shuffled = {**snowflake, "cell": snowflake["cell"].orderBy(F.desc("cellkey")).repartition(3)}
    assert mark(shuffled, fields=("genes_detected",)) == base
    others = {
        mark(fields=("total_umis",)),
        mark(fields=("genes_detected",), feature="transcript"),
        mark(fields=("genes_detected",), format="csv"),
        mark(fields=("genes_detected",), species="Homo sapiens"),
    }
    assert len(others | {base}) == 5


def test_describe_categories_and_ranges(snowflake):
    def categories(name):
        return {r["value"]: r["cells"] for r in describe_field(CELL_CATALOG, snowflake, name).collect()}

    assert categories("emptydrops_is_cell") == {"": 2, "True": 4, "False": 1}
    assert categories("derived_organ_label") == {"brain": 4, "lung": 2, "": 1}
    assert categories("donor_organism.sex") == {"female": 5, "": 2}
    # Missing and empty are one category.
    assert categories("derived_organ_parts_label") == {"": 7}
    numbers = describe_field(CELL_CATALOG, snowflake, "genes_detected").first()
    assert (numbers["minimum"], numbers["maximum"]) == (10.0, 70.0)
    with pytest.raises(UnknownField):
        describe_field(CELL_CATALOG, snowflake, "cell.barcode")


@pytest.mark.parametrize("unique", [(), tuple(d.name for d in CELL_CATALOG.dimensions)])
def test_describe_all_equals_each_field(snowflake, unique):
    together = {}
    for row in describe_all(CELL_CATALOG, snowflake, unique).collect():
        together.setdefault(row["field"], set()).add(tuple(row))
    assert set(together) == {f.name for f in CELL_CATALOG.fields}
    for name in ("genes_detected", "donor_organism.sex", "bundle_uuid", "file_uuid"):
        assert {tuple(r) for r in describe_field(CELL_CATALOG, snowflake, name).collect()} == together[name]


def test_describe_all_with_repeated_keys(spark, snowflake):
    again = spark.createDataFrame([("a1", "b7.1", "b7", "1", "smartseq2", "blessed")], snowflake["analysis"].schema)
    tables = {**snowflake, "analysis": snowflake["analysis"].union(again)}
    rows = describe_all(CELL_CATALOG, tables, audits.unique_dimensions(CELL_CATALOG, tables)).collect()
    assert {r["value"]: r["cells"] for r in rows if r["field"] == "derived_organ_label"} == {"brain": 4, "lung": 2, "": 1}
    assert sum(r["cells"] for r in rows if r["field"] == "bundle_uuid") == 10


def test_field_list_and_coverage(spark, snowflake):
    assert list_fields(spark, CELL_CATALOG).count() == 43
    counts = {r["field"]: r["cells"] for r in field_coverage(CELL_CATALOG, snowflake).collect()}
    assert counts["barcode"] == 5 and counts["donor_organism.sex"] == 5 and counts["genes_detected"] == 6


def test_bundle_counts(snowflake):
    counts = {r["bundle"]: tuple(r)[1:] for r in audits.bundle_counts(CELL_CATALOG, snowflake).collect()}
    assert counts == {"b1": (1, 3, 6), "b2": (1, 3, 4)}


def test_audits(spark, snowflake):
    lost = audits.orphans(snowflake["cell"], "librarykey", snowflake["library_preparation"], "librarykey")
    assert keys(lost) == ["c4"]
    expected = spark.createDataFrame([("b1.2019.1",), ("b3.1",)], "bundle string")
    assert [r[0] for r in audits.missing_bundles(expected, snowflake["analysis"]).collect()] == ["b3.1"]
    assert tuple(audits.verify_load(expected, snowflake["analysis"]).first()) == (2, 1, False)


def test_a_request_over_a_store_reads_the_buckets_of_its_cells(spark, snowflake, tmp_path):
    """Values of all other buckets are made unreadable: nobody looks."""
    import glob

    from cellframe.plans.store import Store

    store = Store(spark, str(tmp_path / "store"), buckets=16)
    store.reload(snowflake)
    wanted = {"op": "=", "field": "bundle_uuid", "value": "b1"}
    over = lambda tables: MatrixRequest(CELL_CATALOG, tables, wanted)
    lie = {r[0] for r in store.tables()["cell"].filter("analysiskey = 'a1'").select("`bucket!`").collect()}
    for file in glob.glob(f"{tmp_path}/store/tables/expression/*/bucket=*/*/part-*"):
        if int(file.split("bucket=")[1].split("/")[0]) not in lie:
            open(file, "wb").write(b"not Parquet")
    frame = over(store.tables()).expression()
    assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()
    expected = sorted(map(tuple, over(snowflake).expression().collect()))
    assert expected and sorted(map(tuple, frame.collect())) == expected
    assert frame.columns == over(snowflake).expression().columns
    with pytest.raises(Exception):
        store.read("expression").collect()
    assert sorted(map(str, over(store.tables()).cells().collect())) == sorted(map(str, over(snowflake).cells().collect()))


def test_one_selection_gives_cells_and_values(snowflake):
    for wanted in (None, {"op": ">", "field": "genes_detected", "value": 10}):
        request = MatrixRequest(CELL_CATALOG, snowflake, wanted)
        cells, values = request.selection()
        assert cells.columns == request.cells().columns and sorted(map(str, cells.collect())) == sorted(map(str, request.cells().collect()))
        assert sorted(map(str, values.collect())) == sorted(map(str, request.expression().collect()))
