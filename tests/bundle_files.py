"""Small made-up bundle directories in the shape the intake reads."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq

PLATE = "11111111-aaaa.2019-05-14T122736.345000Z"
DROPLET = "22222222-bbbb.2019-05-15T101010.000000Z"
ORGANOID = "33333333-cccc.2019-05-16T101010.000000Z"
CELL_LINE = "44444444-dddd.2019-05-17T101010.000000Z"

LABELS = [
    ("UBERON:0002113", "kidney"),
    ("UBERON:0014451", "cortex"),
    ("UBERON:0000955", "brain"),
    ("UBERON:0002390", "blood"),
    ("MONDO:0011273", "H syndrome"),
    ("HANCESTRO:0016", "African American"),
    ("HANCESTRO:0568", "Asian"),
    ("EFO:0001272", "adult"),
    ("EFO:0008931", "Smart-seq2"),
    ("EFO:0009310", "10X v2"),
    ("OBI:0000869", "polyA RNA"),
    ("NCBITaxon:9606", "Homo sapiens"),
    ("NCBITaxon:10090", "Mus musculus"),
]


def term(ontology):
    return {"text": "free text", "ontology": ontology}


def write_json(folder, name, document):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as file:
        json.dump(document, file, indent=2)


def write_documents(root, bundle, kind, *documents):
    for i, (key, fields) in enumerate(documents):
        provenance = {"document_id": key, **fields.pop("provenance", {})}
        write_json(os.path.join(root, bundle), f"{kind}_{i}.json", {"provenance": provenance, **fields})


def donor(**changes):
    return {
        "human_specific": {"ethnicity": [term("HANCESTRO:0016")]},
        "diseases": [term("MONDO:0011273")],
        "development_stage": term("EFO:0001272"),
        "sex": "unknown",
        "is_living": "yes",
        "biomaterial_core": {"ncbi_taxon_id": [9606]},
        **changes,
    }


def specimen(**changes):
    return {
        "genus_species": [term("NCBITaxon:9606")],
        "organ": term("UBERON:0002113"),
        "organ_parts": [term("UBERON:0014451")],
        "diseases": [],
        **changes,
    }


def library(**changes):
    return {
        "input_nucleic_acid_molecule": term("OBI:0000869"),
        "library_construction_method": term("EFO:0008931"),
        "end_bias": "full length",
        "strand": "unstranded",
        **changes,
    }


def project(short="kidney_atlas", **changes):
    return {
        "project_core": {"project_title": "A | title", "project_short_name": short},
        "contributors": [{"name": "Ada", "institution": "Uni"}, {"contact_name": "Bob"}, {"name": "Ada", "institution": "Uni"}],
        "publications": [{"publication_title": "Paper", "doi": "10.1/x"}, {"title": "Other"}],
        **changes,
    }


def common(root, bundle, protocol, suffix, tag):
    write_documents(root, bundle, "analysis_protocol", (f"ap-{tag}", {"protocol_core": {"protocol_id": protocol}}))
    write_documents(root, bundle, "analysis_process", (f"pr-{tag}", {"type": {"text": "analysis"}}))
    write_json(
        os.path.join(root, bundle),
        "manifest.json",
        {
            "files": [
                {"name": "a.txt", "uuid": "no", "version": "no"},
                {"name": f"x{suffix}", "uuid": f"file-{tag}", "version": f"version-{tag}"},
                {"name": f"y{suffix}", "uuid": "second", "version": "second"},
            ]
        },
    )


def write_plate(root, bundle=PLATE, tag="plate", counts=((1.0, 5.0), (2.0, 6.0))):
    common(root, bundle, "smartseq2_v2.3.0", ".genes.results", tag)
    write_documents(root, bundle, "donor_organism", (f"donor-{tag}", donor()))
    write_documents(root, bundle, "specimen_from_organism", (f"specimen-{tag}", specimen()))
    write_documents(root, bundle, "cell_suspension", (f"susp-{tag}", {"genus_species": [term("NCBITaxon:9606")]}))
    write_documents(root, bundle, "library_preparation_protocol", (f"lib-{tag}", library()))
    write_documents(root, bundle, "project", ("proj-1", project()))
    folder = os.path.join(root, bundle)
    (tpm1, n1), (tpm2, n2) = counts
    with open(os.path.join(folder, "q.genes.results"), "w") as file:
        file.write("gene_id\ttranscript_id(s)\tlength\teffective_length\texpected_count\tTPM\tFPKM\n")
        file.write(f"ENSG01.1\tt\t1\t1\t{n1}\t{tpm1}\t0\n")
        file.write(f"ENSG01.2_PAR_Y\tt\t1\t1\t{n2}\t{tpm2}\t0\n")  # the same id without version
        file.write("ENSG02.1\tt\t1\t1\t0.00\t7.5\t0\n")  # not counted, so its TPM goes as well
        file.write("ENSG03.9\tt\t1\t1\t3.25\t92.29\t0\n")
    with open(os.path.join(folder, "q.isoforms.results"), "w") as file:
        file.write("transcript_id\tgene_id\tlength\teffective_length\texpected_count\tTPM\tFPKM\tIsoPct\n")
        file.write("ENST01.1\tg\t1\t1\t4.00\t8.00\t0\t0\n")


DROPLETS = [
    # barcode, total, is_cell, dense row over GA.1, GB.1, GB.2, GC
    ("AAAA", 100, "TRUE", [1.0, 0.0, 2.0, 0.0]),
    ("CCCC", 142, "FALSE", [0.0, 3.0, 4.0, 0.0]),
    ("GGGG", 99, "TRUE", [9.0, 9.0, 9.0, 9.0]),
    ("TTTT", None, None, [5.0, 0.0, 0.0, 0.0]),
]


def write_droplet(root, bundle=DROPLET, tag="droplet", rows=DROPLETS):
    common(root, bundle, "optimus_v1.0.0", ".zattrs", tag)
    write_documents(root, bundle, "donor_organism", (f"donor-{tag}", donor(sex="male", diseases=[])))
    write_documents(root, bundle, "specimen_from_organism", (f"specimen-{tag}", specimen(organ_parts=[])))
    write_documents(root, bundle, "cell_suspension", (f"susp-{tag}", {"genus_species": [term("NCBITaxon:10090")]}))
    old_spelling = library(library_construction_approach=term("EFO:0009310"))
    del old_spelling["library_construction_method"]
    write_documents(root, bundle, "library_preparation_protocol", (f"lib-{tag}", old_spelling))
    write_documents(root, bundle, "project", ("proj-2", project("mouse_atlas", contributors=[], publications=[])))
    folder = os.path.join(root, bundle)
    with open(os.path.join(folder, "empty_drops_result.csv"), "w") as file:
        file.write("CellId,Total,LogProb,PValue,Limited,FDR,IsCell\n")
        for barcode, total, call, _ in rows:
            if call:
                file.write(f"{barcode},{total},-1.5,0.1,FALSE,NA,{call}\n")
    chunks = pa.table(
        {
            "bundle_fqid": [bundle] * len(rows),
            "cell_id": [r[0] for r in rows],
            "values": pa.array([r[3] for r in rows], pa.list_(pa.float32())),
        }
    )
    pq.write_table(chunks, os.path.join(folder, "chunks_0.parquet"))
    axis = pa.table({"bundle_fqid": [bundle], "gene_ids": [["GA.1", "GB.1", "GB.2", "GC"]]})
    pq.write_table(axis, os.path.join(folder, "axis_0.parquet"))


def write_uncounted(root, bundle):
    """Count files in which nothing is counted."""
    for kind, key in (("genes", "gene_id"), ("isoforms", "transcript_id")):
        with open(os.path.join(root, bundle, f"q.{kind}.results"), "w") as file:
            file.write(f"{key}\tother\tlength\teffective_length\texpected_count\tTPM\tFPKM\n")
            file.write("ENSX.1\tt\t1\t1\t0.00\t0.0\t0\n")


def write_organoid(root, bundle=ORGANOID):
    """Two donors that disagree, and organoids that agree on their model organ."""
    common(root, bundle, "smartseq2_v2.3.0", ".genes.results", "organoid")
    write_uncounted(root, bundle)
    write_documents(
        root, bundle, "donor_organism",
        ("donor-z", donor(sex="male", human_specific={"ethnicity": []})),
        ("donor-b", donor(sex="female")),
    )
    write_documents(
        root, bundle, "specimen_from_organism",
        ("specimen-z", specimen(organ=term("UBERON:0000955"))), ("specimen-c", specimen()),
    )
    write_documents(root, bundle, "cell_suspension", ("susp-organoid", {"genus_species": [term("NCBITaxon:9606")]}))
    write_documents(root, bundle, "library_preparation_protocol", ("lib-z", library()), ("lib-a", library(strand="first")))
    write_documents(root, bundle, "organoid", ("o1", {"model_organ": term("UBERON:0000955")}), ("o2", {"model_organ": term("UBERON:0000955")}))
    # A bundle can hold a cell line as well; the organoid wins.
    write_documents(root, bundle, "cell_line", ("l1", {"model_organ": term("UBERON:0002390"), "tissue": term("UBERON:0002390")}))
    write_documents(root, bundle, "project", ("proj-t", project("x_test_y")))


def write_cell_line(root, bundle=CELL_LINE):
    """Two cell lines of one organ but different tissue; two ethnicities; an unsupported protocol."""
    common(root, bundle, "cellranger_v1", ".genes.results", "line")
    ethnicities = {"ethnicity": [term("HANCESTRO:0568"), term("HANCESTRO:9999"), term("HANCESTRO_0016")]}
    write_documents(root, bundle, "donor_organism", ("donor-line", donor(human_specific=ethnicities)))
    write_documents(root, bundle, "specimen_from_organism", ("specimen-line", specimen()))
    write_documents(root, bundle, "cell_suspension", ("susp-line", {"genus_species": [term("NCBITaxon:9606")]}))
    write_documents(root, bundle, "library_preparation_protocol", ("lib-line", library()))
    write_documents(
        root, bundle, "cell_line",
        ("l1", {"model_organ": term("UBERON:0002390"), "tissue": term("UBERON:0002113")}),
        ("l2", {"model_organ": term("UBERON:0002390"), "tissue": term("UBERON:0014451")}),
    )
    write_documents(root, bundle, "project", ("proj-1", project()))
