import gzip
import json

import pytest

from cellframe.sources import results


def write_result(folder, name, columns, parts):
    entries = []
    for i, rows in enumerate(parts):
        path = f"{folder}/{name}_{i:04d}_part_00.gz"
        with gzip.open(path, "wt") as file:
            file.writelines("|".join(row) + "\n" for row in rows)
        entries.append({"url": path, "meta": {"content_length": 1, "record_count": len(rows)}})
    manifest = {
        "entries": entries,
        "schema": {"elements": [{"name": c, "type": {"base": "character varying", "max_length": 60}} for c in columns]},
        "meta": {"content_length": 9, "record_count": sum(map(len, parts))},
    }
    path = f"{folder}/{name}_manifest"
    with open(path, "w") as file:
        json.dump(manifest, file, indent=1)
    return path


def test_manifest_leaves_out_empty_parts(spark, tmp_path):
    path = write_result(tmp_path, "gene", ["featurekey", "isgene"], [[], [("G1", "t")], []])
    row = results.read_manifest(spark, path).first()
    assert row["columns"] == ["featurekey", "isgene"] and row["record_count"] == 1
    assert [u.rsplit("/", 1)[1] for u in row["part_urls"]] == ["gene_0001_part_00.gz"]


def test_cell_result(spark, tmp_path):
    rows = [[("c1", "10", "", "brain", ""), ("c2", "20", "142", "lung", "t")], [("c3", "7", "9", "", "f")]]
    columns = ["cellkey", "genes_detected", "total_umis", "organ_label", "emptydrops_is_cell"]
    manifest = results.read_manifest(spark, write_result(tmp_path, "cell", columns, rows))
    frame = results.read_cell_result(spark, manifest)
    assert frame.columns == ["cellkey", "genes_detected", "total_umis", "specimen_from_organism.organ.ontology_label", "emptydrops_is_cell"]
    assert {r["cellkey"]: (r["genes_detected"], r["total_umis"]) for r in frame.collect()} == {
        "c1": (10, None), "c2": (20, 142.0), "c3": (7, 9.0),
    }


def test_feature_result(spark, tmp_path):
    columns = ["featurekey", "featurename", "featurestart", "isgene"]
    path = write_result(tmp_path, "gene", columns, [[("G1", "g", "5", "t")], [("T1", "t", "6", "f")]])
    frame = results.read_feature_result(spark, results.read_manifest(spark, path))
    assert sorted(map(tuple, frame.collect())) == [("G1", "g", 5, True), ("T1", "t", 6, False)]


def test_expression_result(spark, tmp_path):
    parts = [[("c1", "G1", "1.5"), ("c1", "G2", "2")], [("c2", "G1", "3")]]
    path = write_result(tmp_path, "expression", ["cellkey", "featurekey", "exrpvalue"], parts)
    frame = results.read_expression_result(spark, results.read_manifest(spark, path))
    assert sorted(map(tuple, frame.collect())) == [("c1", "G1", 1.5), ("c1", "G2", 2.0), ("c2", "G1", 3.0)]


def test_empty_results(spark, tmp_path):
    path = write_result(tmp_path, "expression", ["cellkey", "featurekey", "exrpvalue"], [[], []])
    manifest = results.read_manifest(spark, path)
    assert results.read_expression_result(spark, manifest).isEmpty()
    assert results.read_cell_result(spark, manifest).isEmpty()
    with pytest.raises(results.ResultsNotFound):
        results.read_cell_result(spark, manifest.limit(0))


def test_bundle_list(spark, tmp_path):
    path = tmp_path / "bundles.tsv"
    path.write_text("bundle_uuid\tbundle_version\nu2\t1\nu1\t1\nu2\t2\n")
    assert sorted(r["bundle"] for r in results.read_bundle_list(spark, str(path)).collect()) == ["u1", "u2"]
