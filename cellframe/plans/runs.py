"""A request from selection to result: looked up by its fingerprint, and exported only when there is nothing to reuse."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cellframe.functions import text
from cellframe.plans.request import MatrixRequest, fingerprint
from cellframe.plans.requestlog import cached_result
from cellframe.sinks.matrix import MatrixExport


@dataclass(frozen=True)
class Run:
    """What a request came to: its fingerprint, where its result lies under the root, and whether it lay there before."""

    fingerprint: str
    cells: int
    result_key: str
    reused: bool


def run_request(
    request: MatrixRequest, root: str, version: int, request_id: str, log: DataFrame, results: DataFrame, **options
) -> Run:
    """Select the cells once, take their fingerprint, and reuse a stored result of this version or export a new one.

    ``log`` and ``results`` are the request log and the stored results (``result_key``) of earlier runs; ``options`` go
    to the export. The one selection feeds the fingerprint, the cells and the values of the export.
    """
    cells, values = request.selection()
    key = fingerprint(cells.select("cellkey"), request.feature, request.format, request.asked_fields).first()
    found = cached_result(log, results, F.lit(version), F.lit(key["fingerprint"])).first()
    if found is not None:
        return Run(key["fingerprint"], key["cells"], found["result_key"], True)
    names = [F.lit(x) for x in (version, key["fingerprint"], request_id, request.format)]
    path = request.tables[request.catalog.root].sparkSession.range(1).select(text.result_key(*names).alias("k")).first()["k"]
    export = MatrixExport(cells, values, request.features(), **options)
    export.write(os.path.join(root, path), request.format)
    return Run(key["fingerprint"], key["cells"], path, False)
