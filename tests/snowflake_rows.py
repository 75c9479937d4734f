"""A tiny snowflake with missing dimension rows, nulls, two species and a repeated analysis key."""

from cellframe.schemas import WAREHOUSE

ROWS = {
    "cell": [
        # cellkey, suspension, project, library, analysis, file, version, barcode, genes, umis, is_cell
        ("c1", "s1", "p1", "l1", "a1", "f1", "v1", None, 10, None, None),
        ("c2", "s1", "p1", "l1", "a1", "f2", "v1", "AAA", 20, 142, True),
        ("c3", "s2", "p1", "l1", "a2", "f3", "v1", "CCC", None, 150, False),
        ("c4", "s2", "p2", "l9", "a2", "f4", "v1", "GGG", 40, 99, None),  # no such library
        ("c5", "s9", "p2", "l1", "a2", "f5", "v1", "TTT", 50, 100, True),  # no such suspension
        ("c6", "s1", "p1", "l1", "a9", "f6", "v1", "ACG", 60, 100, True),  # no such analysis
        ("c7", "s3", "p1", "l1", "a1", "f7", "v1", None, 70, 7, True),  # without values
    ],
    "analysis": [
        ("a1", "b1.2019.1", "b1", "2019.1", "smartseq2_v2.3.0", "blessed"),
        ("a2", "b2.2019.1", "b2", "2019.1", "optimus_v1", "blessed"),
    ],
    "cell_suspension": [
        ("s1", "sp1", "UBERON:1", "brain", "", "", "NCBITaxon:9606", "Homo sapiens"),
        ("s2", "sp1", "UBERON:2", "lung", None, None, "NCBITaxon:10090", "Mus musculus"),
        ("s3", "sp2", "UBERON:1", "brain", "", "", "NCBITaxon:9606", "Homo sapiens"),
    ],
    "specimen": [
        ("sp1", "d1", "UBERON:1", "brain", "", "", "", ""),
        ("sp2", "d2", "UBERON:3", None, "", "", "MONDO:1", "sick"),
    ],
    "donor": [
        ("d1", "", "", "MONDO:9", "well", "EFO:1", "adult", "female", "yes"),
        ("d2", "", "", "", "", "EFO:2", "embryo", None, "no"),
    ],
    "library_preparation": [("l1", "OBI:1", "polyA", "EFO:0008931", "Smart-seq2", "full length", "unstranded")],
    "project": [("p1", "one", "Project one"), ("p2", "two", "Project two")],
    "publication": [("p1", "A paper", "10.1/x")],
    "contributor": [("p1", "Ada", "Institute")],
    "feature": [
        ("G1", "g1", "protein_coding", "chr1", 1, 10, True, "Homo sapiens"),
        ("G2", "g2", "protein_coding", "chr2", 5, 50, True, "Homo sapiens"),
        ("G3", "g3", "miRNA", "chr3", 7, 70, True, "Homo sapiens"),
        ("M1", "m1", "protein_coding", "chr1", 1, 10, True, "Mus musculus"),
        ("T1", "t1", "protein_coding", "chr1", 1, 10, False, "Homo sapiens"),
    ],
    "expression": [
        ("c1", "G1", "Count", 1.5),
        ("c1", "G1", "TPM", 9.0),
        ("c1", "T1", "Count", 2.0),
        ("c2", "G3", "Count", 3.0),
        ("c2", "G1", "Count", 4.0),
        ("c3", "M1", "Count", 5.0),
        ("c3", "G1", "Count", 6.0),
        ("c4", "M1", "Count", 7.0),
        ("c5", "M1", "Count", 8.0),
        ("c6", "G1", "Count", 9.0),
        ("c1", "GX", "Count", 10.0),  # no such feature
    ],
}


def make_tables(spark):
    return {name: spark.createDataFrame(ROWS[name], schema) for name, schema in WAREHOUSE.items()}
