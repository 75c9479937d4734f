import hashlib

import pytest
from pyspark.sql import functions as F

import bundle_files as files
from cellframe.functions import identifiers, ontology
from cellframe.plans import metadata
from cellframe.plans.ingest import bundle_summary, empty_tables, ingest_bundles
from cellframe.plans.selection import select_bundles, version_gate
from cellframe.schemas import WAREHOUSE
from cellframe.sources import annotation
from cellframe.sources.bundles import compact, manifest_file, read_bundles, read_compacted


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    files.write_plate(root)
    files.write_droplet(root)
    files.write_organoid(root)
    files.write_cell_line(root)
    return str(root)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(files.LABELS, "term string, label string")


@pytest.fixture(scope="module")
def ingested(spark, root, labels):
    tables, quarantine = ingest_bundles(read_bundles(spark, root), labels)
    return {name: [tuple(r) for r in frame.collect()] for name, frame in tables.items()}, {
        (r["entity"], r["reason"]) for r in quarantine.filter("logged_at IS NOT NULL").collect()
    }


def test_all_tables_but_features(ingested):
    tables, _ = ingested
    assert set(tables) == set(WAREHOUSE) - {"feature"}


def test_cells(ingested):
    cells = {row[0]: row for row in ingested[0]["cell"]}
    plate = ("susp-plate", "susp-plate", "proj-1", "lib-plate", "ap-plate", "file-plate", "version-plate", None, 2, None, None)
    key = lambda barcode: hashlib.md5((files.DROPLET + barcode).encode()).hexdigest()
    keys = ("susp-droplet", "proj-2", "lib-droplet", "ap-droplet", "file-droplet", "version-droplet")
    assert cells["susp-plate"] == plate
    assert cells[key("AAAA")] == (key("AAAA"), *keys, "AAAA", 2, 100, True)
    assert cells[key("CCCC")] == (key("CCCC"), *keys, "CCCC", 2, 142, False)
    # Nothing is counted in the organoid's files; the unsupported protocol gives no cell.
    assert cells["susp-organoid"][8] == 0 and len(cells) == 4


def test_expression(ingested):
    rows = sorted(ingested[0]["expression"])
    key = lambda barcode: hashlib.md5((files.DROPLET + barcode).encode()).hexdigest()
    plate = [r[1:] for r in rows if r[0] == "susp-plate"]
    assert [(f, t, round(v, 2)) for f, t, v in plate] == [
        ("ENSG01", "Count", 11.0),
        ("ENSG01", "TPM", 3.0),
        ("ENSG03", "Count", 3.25),
        ("ENSG03", "TPM", 92.29),
        ("ENST01", "Count", 4.0),
        ("ENST01", "TPM", 8.0),
    ]
    # Ids that differ only in their version stay apart.
    assert [r[1:] for r in rows if r[0] == key("CCCC")] == [("GB", "Count", 3.0), ("GB", "Count", 4.0)]
    assert [r[1:] for r in rows if r[0] == key("AAAA")] == [("GA", "Count", 1.0), ("GB", "Count", 2.0)]
    assert len(rows) == 10


def test_quarantine(ingested):
    assert ingested[1] == {
        (files.CELL_LINE, "unsupported analysis protocol"),
        (f"{files.DROPLET}/TTTT", "no droplet call"),
    }


def test_analysis(ingested):
    rows = {row[0]: row[1:] for row in ingested[0]["analysis"]}
    assert rows["ap-plate"] == (files.PLATE, "11111111-aaaa", "2019-05-14T122736.345000Z", "smartseq2_v2.3.0", "blessed")
    assert rows["ap-line"][-1] == "community" and rows["ap-droplet"][-1] == "blessed"


def test_projects(ingested):
    tables, _ = ingested
    assert sorted(tables["project"]) == [("proj-1", "kidney_atlas", "A | title"), ("proj-2", "mouse_atlas", "A | title")]
    assert sorted(tables["contributor"]) == [("proj-1", "Ada", "Uni"), ("proj-1", "Bob", "")]
    assert sorted(tables["publication"]) == [("proj-1", "Other", ""), ("proj-1", "Paper", "10.1/x")]


def test_donors(ingested):
    rows = {row[0]: row[1:] for row in ingested[0]["donor"]}
    sick = ("MONDO:0011273", "H syndrome", "EFO:0001272", "adult")
    assert rows["donor-plate"] == ("HANCESTRO:0016", "African American", *sick, "unknown", "yes")
    # Disagreeing donors: the smallest key, blanks where they differ.
    assert rows["donor-b"] == ("", "", *sick, "", "yes") and "donor-z" not in rows
    # Listed terms keep their order; unknown ones have an empty label, the odd spelling is understood.
    assert rows["donor-line"][:2] == ("HANCESTRO:0568;HANCESTRO:9999;HANCESTRO_0016", "Asian;;African American")
    assert rows["donor-droplet"][2:4] == ("", "")


def test_specimens_and_suspensions(ingested):
    specimens = {row[0]: row[1:] for row in ingested[0]["specimen"]}
    kidney = ("UBERON:0002113", "kidney", "UBERON:0014451", "cortex")
    assert specimens["specimen-plate"] == ("donor-plate", *kidney, "", "")
    assert specimens["specimen-c"] == ("donor-b", "", "", *kidney[2:], "", "")
    suspensions = {row[0]: row[1:] for row in ingested[0]["cell_suspension"]}
    human = ("NCBITaxon:9606", "Homo sapiens")
    assert suspensions["susp-plate"] == ("specimen-plate", *kidney, *human)
    assert suspensions["susp-organoid"] == ("specimen-c", "UBERON:0000955 (organoid)", "brain (organoid)", "", "", *human)
    assert suspensions["susp-line"] == ("specimen-line", "UBERON:0002390 (cell line)", "blood (cell line)", "", "", *human)
    assert suspensions["susp-droplet"] == ("specimen-droplet", *kidney[:2], "", "", "NCBITaxon:10090", "Mus musculus")


def test_libraries(ingested):
    rows = {row[0]: row[1:] for row in ingested[0]["library_preparation"]}
    assert rows["lib-plate"] == ("OBI:0000869", "polyA RNA", "EFO:0008931", "Smart-seq2", "full length", "unstranded")
    assert rows["lib-droplet"][2:4] == ("EFO:0009310", "10X v2")
    assert rows["lib-a"][-1] == "" and "lib-z" not in rows


def test_bundles_that_share_entities_give_one_row(spark, labels, tmp_path):
    files.write_plate(tmp_path, "a.1", "x")
    files.write_plate(tmp_path, "b.1", "x")
    files.write_documents(tmp_path, "b.1", "cell_suspension", ("susp-other", {"genus_species": []}))
    tables, _ = ingest_bundles(read_bundles(spark, str(tmp_path)), labels)
    counts = {name: tables[name].count() for name in ("donor", "specimen", "library_preparation", "cell_suspension", "analysis")}
    assert counts == {"donor": 1, "specimen": 1, "library_preparation": 1, "cell_suspension": 2, "analysis": 2}


def test_bad_bundles_are_set_aside_not_raised(spark, labels, tmp_path):
    files.write_plate(tmp_path, "good.1", "good")
    files.write_plate(tmp_path, "corrupt.1", "corrupt")
    (tmp_path / "corrupt.1" / "specimen_from_organism_0.json").write_text('{"provenance": ')
    files.write_plate(tmp_path, "nolib.1", "nolib")
    files.write_documents(tmp_path, "nolib.1", "library_preparation_protocol", ("lib-nolib", {"end_bias": "x"}))
    files.write_plate(tmp_path, "nomanifest.1", "nomanifest")
    (tmp_path / "nomanifest.1" / "manifest.json").unlink()
    tables, quarantine = ingest_bundles(read_bundles(spark, str(tmp_path)), labels)
    assert {(r[0], r[1]) for r in quarantine.collect()} == {
        ("corrupt.1/specimen_from_organism_0", "unreadable document"),
        ("nolib.1", "library preparation without method or molecule"),
        ("nomanifest.1", "missing file_uuid,file_version"),
    }
    assert [r[0] for r in tables["donor"].collect()] == ["donor-good"]
    assert [r[0] for r in tables["cell"].collect()] == ["susp-good"]
    assert [r["bundle_uuid"] for r in tables["analysis"].collect()] == ["good"]


def test_bundles_without_all_their_counts_are_set_aside_whole(spark, labels, tmp_path):
    def plate(name):
        files.write_plate(tmp_path, f"{name}.1", name)
        return tmp_path / f"{name}.1"

    def droplet(name, **changes):
        files.write_droplet(tmp_path, f"{name}.1", name, **changes)
        return tmp_path / f"{name}.1"

    plate("good")
    (plate("nogenes") / "q.genes.results").unlink()
    (plate("noisoforms") / "q.isoforms.results").unlink()
    bad = plate("badnumber") / "q.genes.results"
    bad.write_text(bad.read_text().replace("92.29", "many"))
    (plate("noprotocol") / "analysis_protocol_0.json").unlink()
    called = [row for row in files.DROPLETS if row[2]]
    droplet("drops", rows=called)
    (droplet("noaxis", rows=called) / "axis_0.parquet").unlink()
    (droplet("nocalls", rows=called) / "empty_drops_result.csv").unlink()
    (droplet("nochunks", rows=called) / "chunks_0.parquet").unlink()
    droplet("short", rows=[*called, ("AAAC", 100, "TRUE", [1.0, 2.0])])
    droplet("twice", rows=[*called, ("AAAA", 120, "TRUE", [1.0, 0.0, 2.0, 0.0])])
    (droplet("onedonor", rows=called) / "donor_organism_1.json").write_text("{")
    tables, quarantine = ingest_bundles(read_bundles(spark, str(tmp_path)), labels)
    assert {(r[0], r[1]) for r in quarantine.collect()} == {
        ("nogenes.1", "no gene counts"), ("noisoforms.1", "no isoform counts"), ("badnumber.1", "unreadable or missing column in gene counts"),
        ("noprotocol.1", "no analysis protocol"), ("noaxis.1", "no gene axis"), ("nocalls.1", "no droplet calls"),
        ("nochunks.1", "no dense rows"), ("short.1", "rows of another length than the gene axis"),
        ("twice.1", "two droplet calls for one barcode"), ("onedonor.1/donor_organism_1", "unreadable document"),
    }
    assert sorted(r["bundle_uuid"] for r in tables["analysis"].collect()) == ["drops", "good"]
    assert sorted(r[0] for r in tables["donor"].collect()) == ["donor-drops", "donor-good"]
    assert {r["analysiskey"] for r in tables["cell"].collect()} == {"ap-drops", "ap-good"}
    assert {r["cellkey"] for r in tables["expression"].collect()} <= {r["cellkey"] for r in tables["cell"].collect()}


def test_a_compacted_landing_zone_gives_the_same_tables(spark, root, labels, ingested, tmp_path):
    compact(spark, root, str(tmp_path))
    tables, _ = ingest_bundles(read_compacted(spark, str(tmp_path)), labels)
    for name, frame in tables.items():
        assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, ingested[0][name]))


def test_restricting_to_bundles(spark, root, labels):
    some = spark.createDataFrame([(files.PLATE,)], "bundle_fqid string")
    tables, quarantine = ingest_bundles(read_bundles(spark, root).restrict(some), labels)
    assert [r[0] for r in tables["cell"].collect()] == ["susp-plate"] and quarantine.isEmpty()


def test_reading_only_named_bundles(spark, root):
    found = read_bundles(spark, root, [files.PLATE, "missing.1", "odd{name}", "../x", "*"])
    assert {r[0] for r in found.documents["analysis_protocol"].select("bundle_fqid").collect()} == {files.PLATE}
    assert found.genes.count() == 4 and found.calls.isEmpty() and found.chunks.isEmpty()
    nothing = read_bundles(spark, root, ["missing.1"])
    assert nothing.manifests.isEmpty() and nothing.genes.isEmpty() and nothing.axis.isEmpty()


def test_names_are_taken_as_they_are(spark, tmp_path):
    for name in ("odd{a,b}.1", "odd[x]*.1", "odd a.1"):
        files.write_plate(tmp_path, name, "x")
    found = read_bundles(spark, str(tmp_path), ["odd{a,b}.1", "odd[x]*.1"])
    assert {r[0] for r in found.documents["analysis_protocol"].select("bundle_fqid").collect()} == {"odd{a,b}.1", "odd[x]*.1"}


def test_empty_tables(spark):
    assert {name: frame.schema for name, frame in empty_tables(spark).items()} == WAREHOUSE


def test_features(spark, tmp_path):
    human = tmp_path / "human.gtf"
    line = 'chr1\tX\t{kind}\t{start}\t{end}\t.\t+\t.\tgene_id "{gene}"; transcript_id "{tx}"; gene_type "miRNA"; gene_name "GN"; transcript_type "lnc RNA"; transcript_name "GN-201"; level 3;\n'
    human.write_text(
        "##comment\n"
        + line.format(kind="gene", start=1, end=9, gene="ENSG1.5", tx="no")
        + line.format(kind="transcript", start=2, end=8, gene="ENSG1.5", tx="ENST1.1")
        + line.format(kind="exon", start=2, end=4, gene="ENSG1.5", tx="ENST1.1")
        + line.format(kind="gene", start=1, end=9, gene="ENSG1.5_PAR_Y", tx="no")
        + line.format(kind="gene", start=1, end=9, gene="ENSG1.5", tx="no")
    )
    mouse = tmp_path / "mouse.gtf"
    mouse.write_text('chrX\tX\tgene\t5\t6\t.\t+\t.\tgene_id "ENSMUSG7"; gene_type "protein_coding"; gene_name "Mm";\n')
    lines = annotation.read_annotation(spark, {"Homo sapiens": str(human), "Mus musculus": str(mouse)})
    frame = annotation.features(lines)
    assert frame.columns == WAREHOUSE["feature"].fieldNames()
    assert sorted(map(tuple, frame.collect())) == [
        ("ENSG1", "GN", "miRNA", "chr1", 1, 9, True, "Homo sapiens"),
        ("ENSG1_PAR_Y", "GN", "miRNA", "chr1", 1, 9, True, "Homo sapiens"),
        ("ENSMUSG7", "Mm", "protein_coding", "chrX", 5, 6, True, "Mus musculus"),
        ("ENST1", "GN-201", "lnc RNA", "chr1", 2, 8, False, "Homo sapiens"),
    ]


def one(spark, column, *values):
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in frame.select(column).collect()]


def test_identifiers(spark):
    x = F.col("x")
    assert one(spark, identifiers.strip_version(x), "A.1.2", "B", "") == ["A", "B", ""]
    assert one(spark, identifiers.feature_id(x), "A.1", "A.1_PAR_Y", "A_PAR_Y") == ["A", "A_PAR_Y", "A_PAR_Y_PAR_Y"]
    assert one(spark, identifiers.bundle_version(x), "u.2019.1", "u") == ["2019.1", None]
    assert one(spark, identifiers.assay(x), "smartseq2_v1", "optimus", "other") == ["plate", "droplet", None]


def test_a_known_droplet_key(spark):
    frame = spark.createDataFrame([("optimus_bundle.version", "AGTGGGAGTACAGACG")], "b string, c string")
    key = frame.select(identifiers.droplet_cell_key(F.col("b"), F.col("c"))).first()[0]
    assert key == "5469c35c54d5b403cb00da7d9ea16879"


def test_ontology_terms(spark):
    x = F.col("x")
    terms = ["UBERON:1", "UBERON_1", "UBERON:1 (organoid)", "nonsense", "A:B:C", ""]
    assert one(spark, ontology.plain(x), *terms) == ["UBERON:1", "UBERON:1", "UBERON:1", None, None, None]
    assert one(spark, ontology.mark(x), *terms) == ["", "", " (organoid)", "", "", ""]


def test_terms_to_resolve(spark, labels):
    donors = spark.createDataFrame([("d", ["UBERON:1", "MONDO:0011273"], "EFO:5")], "k string, list array<string>, stage string")
    terms = metadata.distinct_terms({"donor": (donors, ["list", "stage"])})
    assert sorted(r[0] for r in metadata.unresolved_terms(terms, labels).collect()) == ["EFO:5", "UBERON:1"]


def test_manifest_entry(spark):
    frame = spark.createDataFrame([([("a.zattrs", "1"), ("b.zattrs", "2")],), ([],)], "files array<struct<name:string,uuid:string>>")
    assert [r[0] for r in frame.select(manifest_file(F.col("files"), ".zattrs")["uuid"]).collect()] == ["1", None]


def test_version_gate(spark):
    versions = [(None, None), (None, 3), (1, 0), (1, None), (0, 9), (6, 2), (6, 3), (6, None), (7, 0), (2, None), (5, 99)]
    frame = spark.createDataFrame(versions, "major int, minor int")
    passed = [r[0] for r in frame.select(version_gate(F.col("major"), F.col("minor"), (1, 0, 6, 2))).collect()]
    assert passed == [True, True, True, False, False, True, False, False, False, True, True]


def test_bundle_selection(spark, root, tmp_path):
    summary = bundle_summary(read_bundles(spark, root))

    def chosen(*args, **options):
        return sorted(r[0] for r in select_bundles(summary, *args, **options).collect())

    # The droplet bundle's method is neither of the served ones.
    assert chosen() == [files.PLATE, files.ORGANOID, files.CELL_LINE]
    assert chosen(["proj-2"]) == [files.DROPLET]
    listed = spark.createDataFrame([(files.PLATE,)], "bundle string")
    assert chosen(bundles=listed) == [files.PLATE]
    assert chosen(["proj-2"], listed) == [files.PLATE, files.DROPLET]


def test_bundle_selection_refuses_other_taxa_processes_and_versions(spark, tmp_path):
    for name in ("ok", "taxon", "process", "version", "mixed"):
        files.write_plate(tmp_path, f"{name}.1", name)
    files.write_documents(tmp_path, "taxon.1", "donor_organism", ("d", files.donor(biomaterial_core={"ncbi_taxon_id": [7955]})))
    files.write_documents(tmp_path, "process.1", "analysis_process", ("p", {"type": {"text": "import"}}))
    new, old = {"schema_major_version": 99, "schema_minor_version": 0}, {"schema_major_version": 9, "schema_minor_version": 2}
    files.write_documents(tmp_path, "version.1", "specimen_from_organism", ("s", files.specimen(provenance=new)))
    files.write_documents(
        tmp_path, "mixed.1", "specimen_from_organism", ("s", files.specimen(provenance=new)), ("t", files.specimen(provenance=old))
    )
    chosen = select_bundles(bundle_summary(read_bundles(spark, str(tmp_path))))
    assert sorted(r[0] for r in chosen.collect()) == ["mixed.1", "ok.1"]


def test_a_bundle_is_summed_up_after_one_shuffle(spark, tmp_path):
    files.write_plate(tmp_path, "one.1", "one")
    files.write_plate(tmp_path, "two.1", "two")
    major, minor = {"schema_major_version": 9, "schema_minor_version": 2}, {"schema_major_version": 9}
    files.write_documents(
        tmp_path, "two.1", "specimen_from_organism",
        *((name, files.specimen(provenance=dict(version))) for name, version in (("s", major), ("t", minor), ("u", major), ("v", {}))),
    )
    files.write_documents(tmp_path, "two.1", "donor_organism", *((name, files.donor(biomaterial_core={"ncbi_taxon_id": taxa})) for name, taxa in (("d", [9606, 10090]), ("e", [9606]))))
    files.write_documents(tmp_path, "three.1", "project", ("p", {"project_core": {}}))  # without a process it isn't listed
    summary = bundle_summary(read_bundles(spark, str(tmp_path)))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    rows = {r["bundle_fqid"]: r for r in summary.collect()}
    assert set(rows) == {"one.1", "two.1"}
    assert sorted(rows["two.1"]["taxa"]) == [9606, 10090] and rows["one.1"]["organoid"] is None
    assert sorted(map(str, (tuple(v) for v in rows["two.1"]["specimen_from_organism"]))) == ["(9, 2)", "(9, None)"]
    assert rows["one.1"]["method_labels"] is not None and None not in rows["one.1"]["method_labels"]
