import csv
import glob
import gzip
import random

import pytest
from pyspark.sql import functions as F

from cellframe.catalog import CELL_CATALOG
from cellframe.operators.metrics import matrix_metrics, metrics_agree
from cellframe.plans.request import MatrixRequest
from cellframe.sinks import staged
from cellframe.sinks.matrix import MatrixExport, features_10x


def joined(path):
    """The parts of a text data set, concatenated in name order."""
    text = b""
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, "rb") as file:
            text += file.read()
    return gzip.decompress(text).decode() if path.endswith(".gz") else text.decode()


def rows_of(path, separator):
    return list(csv.reader(joined(path).splitlines(), delimiter=separator))


@pytest.fixture(scope="module")
def matrix(spark):
    """100 features by 1000 cells, every fifth feature of a cell non-zero, and ten cells without values."""
    rng = random.Random(3)
    values = {
        (f"cell_{c:04d}", f"gene_{f:03d}"): round(rng.random() * 1000, 2)
        for c in range(1000)
        for f in range(0, 100, 5)
    }
    cells = spark.createDataFrame(
        [(f"cell_{c:04d}", c, "bra,in" if c % 2 else None, f"ACGT{c}", c % 3 == 0) for c in range(1010)],
        "cellkey string, genes_detected int, organ_label string, barcode string, emptydrops_is_cell boolean",
    )
    features = spark.createDataFrame(
        [(f"gene_{f:03d}", f"name{f}", "protein_coding", f % 2 == 0) for f in range(100)],
        "featurekey string, featurename string, featuretype string, isgene boolean",
    )
    frame = spark.createDataFrame(
        [(c, f, v) for (c, f), v in values.items()], "cellkey string, featurekey string, exprvalue float"
    ).repartition(5)
    return values, MatrixExport(cells.repartition(3), frame, features.repartition(2)), frame


def close(found, values):
    assert set(found) == set(values)
    assert all(abs(found[k] - values[k]) <= 1e-5 * values[k] for k in values)


def test_csv(spark, matrix, tmp_path):
    values, export, source = matrix
    export.write(str(tmp_path / "m"), "csv")
    rows = rows_of(f"{tmp_path}/m/expression.csv", ",")
    assert rows[0] == ["cellkey", *(f"gene_{f:03d}" for f in range(100))]
    assert [r[0] for r in rows[1:]] == [f"cell_{c:04d}" for c in range(1000)]
    assert rows[1][2] == "0"
    found = {(r[0], g): float(v) for r in rows[1:] for g, v in zip(rows[0][1:], r[1:]) if v != "0"}
    close(found, {k: v for k, v in values.items() if v})
    again = spark.createDataFrame([(c, v) for (c, _), v in found.items()], "cellkey string, exprvalue double")
    assert metrics_agree(matrix_metrics(again), matrix_metrics(source))
    genes = rows_of(f"{tmp_path}/m/genes.csv", ",")
    assert genes[:3] == [
        ["featurekey", "featurename", "featuretype", "isgene"],
        ["gene_000", "name0", "protein_coding", "True"],
        ["gene_001", "name1", "protein_coding", "False"],
    ]
    cells = rows_of(f"{tmp_path}/m/cells.csv", ",")
    assert cells[0][0] == "cellkey" and [c[0] for c in cells[1:]] == [r[0] for r in rows[1:]]
    assert cells[1][2] == "" and cells[2][2] == "bra,in"


def test_mtx(matrix, tmp_path):
    values, export, _ = matrix
    export.write(str(tmp_path / "m"), "mtx")
    lines = joined(f"{tmp_path}/m/matrix.mtx.gz").splitlines()
    assert lines[0] == "%%MatrixMarket matrix coordinate real general"
    entries = {k: v for k, v in values.items() if v}
    assert lines[1] == f"100 1000 {len(entries)}"
    features = rows_of(f"{tmp_path}/m/features.tsv.gz", "\t")
    cells = rows_of(f"{tmp_path}/m/cells.tsv.gz", "\t")
    found = {}
    places = []
    for line in lines[2:]:
        row, col, value = line.split()
        places.append((int(col), int(row)))
        found[cells[int(col)][0], features[int(row) - 1][0]] = float(value)
    close(found, entries)
    assert places == sorted(places)
    assert features[0] == ["gene_000", "name0", "Gene Expression", "protein_coding", "True"]
    assert rows_of(f"{tmp_path}/m/genes.tsv.gz", "\t")[0][0] == "featurekey"
    assert joined(f"{tmp_path}/m/barcodes.tsv.gz").split() == [f"ACGT{c}" for c in range(1000)]


def test_loom_layout(spark, matrix, tmp_path):
    values, export, _ = matrix
    export.write(str(tmp_path / "m"), "loom")
    read = lambda name: spark.read.parquet(f"{tmp_path}/m/{name}")
    genes = {r["ordinal"]: r["Accession"] for r in read("row_attrs").collect()}
    cells = {r["ordinal"]: r["CellID"] for r in read("col_attrs").collect()}
    found = {
        (cells[r["ordinal"]], genes[i]): v for r in read("matrix").collect() for i, v in zip(r["indices"], r["values"])
    }
    close(found, {k: v for k, v in values.items() if v})
    assert {"Accession", "Gene", "featurekey", "featuretype"} <= set(read("row_attrs").columns)
    assert {"CellID", "organ_label", "genes_detected"} <= set(read("col_attrs").columns)
    attributes = read("attrs").first()
    assert (attributes["rows"], attributes["columns"], attributes["LOOM_SPEC_VERSION"]) == (100, 1000, "2.0.1")


def test_empty_cells_can_be_kept(spark, matrix):
    _, export, _ = matrix
    assert export.cells.count() == 1000
    cells = spark.createDataFrame([("a",), ("b",)], "cellkey string")
    values = spark.createDataFrame([("a", "G", 1.0)], "cellkey string, featurekey string, exprvalue float")
    features = spark.createDataFrame([("G",)], "featurekey string")
    assert MatrixExport(cells, values, features, include_empty_cells=True).cell_ordinals.count() == 2


@pytest.mark.parametrize("format_, name", [("csv", "expression.csv"), ("mtx", "matrix.mtx.gz"), ("loom", "matrix")])
def test_empty_selection_writes_an_empty_result(snowflake, tmp_path, format_, name):
    nothing = {"op": "=", "field": "barcode", "value": "none such"}
    export = MatrixExport.of(MatrixRequest(CELL_CATALOG, snowflake, nothing, format=format_))
    export.write(str(tmp_path / "m"), format_)
    if format_ == "loom":
        matrix = export.values.sparkSession.read.parquet(f"{tmp_path}/m/{name}")
        assert matrix.columns == ["ordinal", "indices", "values"] and matrix.isEmpty()
    else:
        assert all(open(p, "rb").read() == b"" for p in glob.glob(f"{tmp_path}/m/{name}/part-*"))


def test_request_to_files(snowflake, tmp_path):
    """A cell listed without values is not exported; values of features of another species vanish."""
    wanted = {"op": "=", "field": "bundle_uuid", "value": ["b1", "b2"][1]}
    request = MatrixRequest(CELL_CATALOG, snowflake, wanted, species="Mus musculus", format="mtx")
    assert sorted(r[0] for r in request.cells().select("cellkey").collect()) == ["c3", "c4"]
    MatrixExport.of(request).write(str(tmp_path / "m"), "mtx")
    assert joined(f"{tmp_path}/m/matrix.mtx.gz").splitlines()[1:] == ["1 1 1", "1 1 5.0"]


def test_features_10x_puts_the_type_third(snowflake):
    assert features_10x(snowflake["feature"]).columns[:4] == [
        "featurekey", "featurename", "featuretype_10x", "featuretype",
    ]


def test_staged_rows(spark, snowflake, tmp_path):
    from cellframe.sources.results import read_staged

    for name in ("cell", "feature", "expression"):
        staged.append_staged(snowflake[name], f"{tmp_path}/{name}", "gzip" if name == "cell" else "none")
        again = read_staged(spark, f"{tmp_path}/{name}", name)
        assert sorted(map(str, again.collect())) == sorted(map(str, snowflake[name].collect()))
    staged.append_staged(snowflake["expression"], f"{tmp_path}/expression")
    assert read_staged(spark, f"{tmp_path}/expression", "expression").count() == 22


def test_rows_per_bundle(snowflake, tmp_path):
    cells = snowflake["cell"].withColumnRenamed("analysiskey", "bundle_fqid")
    staged.write_per_bundle(cells, f"{tmp_path}/cell")
    assert len(glob.glob(f"{tmp_path}/cell/bundle_fqid=a2/*.csv.gz")) >= 1
    assert len(glob.glob(f"{tmp_path}/cell/bundle_fqid=*")) == 3


def test_stored_result(snowflake, tmp_path):
    manifest = staged.store_result(snowflake["expression"].repartition(3), f"{tmp_path}/r")
    assert sum(r["record_count"] for r in manifest.collect()) == 11


def test_csv_with_empty_cells(spark, tmp_path):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cellkey string")
    values = spark.createDataFrame([("b", "G2", 1.5)], "cellkey string, featurekey string, exprvalue float")
    features = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "featurekey string")
    MatrixExport(cells, values, features, include_empty_cells=True).write_csv(f"{tmp_path}/all")
    assert joined(f"{tmp_path}/all/expression.csv").splitlines() == ["cellkey,G1,G2,G3", "a,0,0,0", "b,0,1.5,0", "c,0,0,0"]
    MatrixExport(cells, values, features.withColumn("featurename", F.lit("n")), include_empty_cells=True).write_loom_layout(f"{tmp_path}/loom")
    columns = {r["ordinal"]: (r["indices"], r["values"]) for r in spark.read.parquet(f"{tmp_path}/loom/matrix").collect()}
    assert columns == {1: ([], []), 2: ([2], [1.5]), 3: ([], [])}
    MatrixExport(cells, values, features).write_csv(f"{tmp_path}/some")
    assert joined(f"{tmp_path}/some/expression.csv").splitlines() == ["cellkey,G1,G2,G3", "b,0,1.5,0"]


def test_staged_text_keeps_empty_apart_from_missing(spark, tmp_path):
    from cellframe.sinks.staged import append_staged
    from cellframe.sources.results import read_staged

    rows = [("a", "", "x\ny", "b|c"), ("b", None, '"q"', "")]
    frame = spark.createDataFrame(rows, "librarykey string, input_nucleic_acid_ontology string, end_bias string, strand string")
    table = frame.selectExpr("librarykey", "input_nucleic_acid_ontology", "'' as l", "null as c", "null as d", "end_bias", "strand")
    append_staged(table, str(tmp_path / "s"))
    back = read_staged(spark, str(tmp_path / "s"), "library_preparation").collect()
    assert sorted((r[0], r[1], r[2], r[3], r["end_bias"], r["strand"]) for r in back) == [("a", "", "", None, "x\ny", "b|c"), ("b", None, "", None, '"q"', "")]


@pytest.mark.parametrize("on_duplicate", ["sum"])
def test_species_in_one_pass_are_the_single_exports(spark, snowflake, tmp_path, on_duplicate):
    from cellframe.plans.request import fan_out
    from cellframe.plans.species import SpeciesExport

    named = {"op": "in", "field": "cell_suspension.genus_species.ontology_label", "value": ["Homo sapiens", "Mus musculus"]}
    request = MatrixRequest(CELL_CATALOG, snowflake, named, format="mtx")
    SpeciesExport(request, on_duplicate).write_mtx(str(tmp_path / "all"))
    for species, single in fan_out(request).items():
        MatrixExport.of(single, on_duplicate=on_duplicate).write(str(tmp_path / species), "mtx")
        parts = sorted(glob.glob(f"{tmp_path}/all/matrix.mtx/species={species.replace(' ', '*')}/part-*"))
        assert "".join(open(p).read() for p in parts) == joined(f"{tmp_path}/{species}/matrix.mtx.gz")
