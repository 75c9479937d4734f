import random

import pytest
from pyspark.sql import functions as F

from cellframe.catalog import CELL_CATALOG, UnknownField
from cellframe.functions.predicates import (
    MalformedFeature,
    MalformedFilter,
    feature_kind,
    fields_of,
    mentions_species,
    to_column,
)
from cellframe.operators.star import left_chain


def eq(field, value, op="="):
    return {"op": op, "field": field, "value": value}


@pytest.mark.parametrize(
    "bad",
    [
        {},
        [],
        "text",
        {"op": "="},
        {"op": "=", "value": 1},
        {"op": "~", "field": "genes_detected", "value": 1},
        {"op": "xor", "value": []},
        {"op": "in", "field": "genes_detected", "value": 3},
        {"op": "and", "value": eq("genes_detected", 1)},
        {"op": "and", "value": [eq("genes_detected", 1)]},
        {"op": "or", "value": []},
        {"op": "not", "value": [eq("genes_detected", 1), eq("genes_detected", 2)]},
        {"op": "not", "value": "x"},
        eq("no_such_field", 1),
        eq("cell.no_such_column", 1),
        eq("expression.exrpvalue", 1),
        eq("genes_detected", None),
        eq("genes_detected", "many", ">"),
        {"op": "and", "value": [eq("genes_detected", 1), {"op": "=", "field": "barcode"}]},
    ],
)
def test_malformed_filters_are_refused(spark, bad):
    with pytest.raises(MalformedFilter):
        to_column(bad, CELL_CATALOG)


SUSPENSION = "cell_suspension.provenance.document_id"


@pytest.mark.parametrize(
    "filter_, cells",
    [
        (eq("genes_detected", 20), "c2"),
        (eq("genes_detected", "20"), "c2"),
        (eq("cell.genes_detected", 20), "c2"),
        (eq("genes_detected", 20, "!="), "c1 c4 c5 c7"),  # null is not different
        (eq("genes_detected", 40, ">"), "c5 c7"),
        (eq("genes_detected", 40, ">="), "c4 c5 c7"),
        (eq("genes_detected", 20.5, "<"), "c1 c2"),
        (eq("genes_detected", 20, "<="), "c1 c2"),
        (eq("genes_detected", "many"), ""),
        (eq("genes_detected", "many", "!="), "c1 c2 c4 c5 c7"),
        ({"op": "not", "value": [eq("genes_detected", "many")]}, "c1 c2 c4 c5 c7"),
        ({"op": "not", "value": [eq("genes_detected", "many", "!=")]}, ""),
        (eq("genes_detected", [10, "n/a", "40"], "in"), "c1 c4"),
        (eq("genes_detected", ["n/a"], "in"), ""),
        (eq("genes_detected", [], "in"), ""),
        (eq("barcode", ["AAA", 5, "TTT"], "in"), "c2 c5"),
        (eq("emptydrops_is_cell", True), "c2 c5 c7"),
        (eq("emptydrops_is_cell", "false"), "c3"),
        (eq("donor_organism.sex", "female"), "c1 c2 c3 c4"),
        (eq("specimen.diseases_label", "sick"), "c7"),
        (eq("donor_organism.diseases.ontology_label", "well"), "c1 c2 c3 c4"),
        (eq("bundle_uuid", "b2"), "c3 c4 c5"),
        (eq("project.project_core.project_short_name", "it's"), ""),
        ({"op": "not", "value": [eq(SUSPENSION, "s1")]}, "c3 c4 c7"),
        ({"op": "not", "value": eq(SUSPENSION, "s1")}, "c3 c4 c7"),
        ({"op": "and", "value": [eq("total_umis", 100, ">="), eq("emptydrops_is_cell", True)]}, "c2 c5"),
        (
            {"op": "or", "value": [eq("genes_detected", 10), eq("genes_detected", 20), eq("barcode", "GGG")]},
            "c1 c2 c4",
        ),
        (
            {
                "op": "and",
                "value": [
                    {"op": "or", "value": [eq("derived_organ_label", "brain"), eq("genes_detected", 40)]},
                    {"op": "not", "value": [{"op": "and", "value": [eq("bundle_uuid", "b1"), eq("genes_detected", 10)]}]},
                ],
            },
            "c2 c4 c7",
        ),
    ],
)
def test_filters_select_rows(snowflake, filter_, cells):
    chain = left_chain(CELL_CATALOG, snowflake).filter(to_column(filter_, CELL_CATALOG))
    assert sorted(r[0] for r in chain.select("cell.cellkey").collect()) == cells.split()


def test_fields_and_species():
    species = eq("cell_suspension.genus_species.ontology_label", "Mus musculus")
    other = eq("genes_detected", 1, ">")
    assert fields_of({"op": "and", "value": [species, other]}) == {species["field"], "genes_detected"}
    assert mentions_species({"op": "and", "value": [other, {"op": "not", "value": [species]}]}, CELL_CATALOG)
    assert mentions_species(eq("cell_suspension.genus_species.ontology", ["x"], "in"), CELL_CATALOG)
    assert not mentions_species({"op": "or", "value": [other, other]}, CELL_CATALOG)


def test_unknown_feature_kind(spark):
    with pytest.raises(MalformedFeature):
        feature_kind("protein", CELL_CATALOG)


def test_catalogue_projection():
    names = [s.output for s in CELL_CATALOG.select(["project.*", "genes_detected", "cell.barcode"])]
    assert names == [
        "project.provenance.document_id",
        "project.project_core.project_short_name",
        "project.project_core.project_title",
        "genes_detected",
        "barcode",
    ]
    assert len(CELL_CATALOG.fields) == 43
    assert len(CELL_CATALOG.select(CELL_CATALOG.default_fields)) == 6 + 8 + 9 + 4 + 7 + 3 + 6
    both = CELL_CATALOG.select(["donor.diseases_label", "specimen.diseases_label"])
    assert [s.output for s in both] == ["donor_organism.diseases.ontology_label", "specimen.diseases_label"]
    with pytest.raises(UnknownField):
        CELL_CATALOG.select(["nonsense"])
    with pytest.raises(UnknownField):
        CELL_CATALOG.select(["expression.*"])


def _random_filter(rng, depth):
    if depth and rng.random() < 0.6:
        op = rng.choice(["and", "or", "not"])
        count = 1 if op == "not" else rng.randint(2, 3)
        return {"op": op, "value": [_random_filter(rng, depth - 1) for _ in range(count)]}
    field, values = rng.choice(
        [
            ("genes_detected", [10, 20, 40, 60.5, 70]),
            ("total_umis", [7, 99, 100, 142]),
            ("barcode", ["AAA", "CCC", "zzz"]),
            ("donor_organism.sex", ["female", "male"]),
        ]
    )
    op = rng.choice(["=", "!=", ">", "<", ">=", "<=", "in"])
    return eq(field, rng.sample(values, 2) if op == "in" else rng.choice(values), op)


def _truth(filter_, row):
    """Three-valued truth of a filter over one row."""
    op, value = filter_["op"], filter_["value"]
    if op in ("and", "or", "not"):
        found = [_truth(f, row) for f in value]
        if op == "not":
            return None if found[0] is None else not found[0]
        decisive = op == "or"
        return decisive if decisive in found else None if None in found else not decisive
    actual = row[filter_["field"]]
    if actual is None:
        return None
    return {
        "=": lambda: actual == value,
        "!=": lambda: actual != value,
        ">": lambda: actual > value,
        "<": lambda: actual < value,
        ">=": lambda: actual >= value,
        "<=": lambda: actual <= value,
        "in": lambda: actual in value,
    }[op]()


def test_random_filters_against_brute_force(snowflake):
    rng = random.Random(11)
    filters = [_random_filter(rng, 3) for _ in range(60)]
    fields = ["genes_detected", "total_umis", "barcode", "donor_organism.sex"]
    columns = [F.col(s.path).alias(s.output) for s in CELL_CATALOG.select(fields)]
    answers = [to_column(f, CELL_CATALOG).alias(f"answer{i}") for i, f in enumerate(filters)]
    rows = left_chain(CELL_CATALOG, snowflake).select(*columns, *answers).collect()
    assert len(rows) == 6
    for row in rows:
        for i, filter_ in enumerate(filters):
            assert row[f"answer{i}"] == _truth(filter_, row.asDict()), filter_
