"""Exact top-k inner products by a three-phase uniform threshold.

The vectors are cut into slices of dimensions, and a node holds one slice of a block of queries and of a block of
candidates. Phase 1 gathers every node's best local scores for each query, and the smallest local score. The totals of
those candidates give a safe cutoff: the k-th of them is no more than the k-th of all. Phase 2 hands each query's cutoff
to all nodes. A total can only reach it if some slice reaches its uniform part, the smallest local score plus an equal
share of what the cutoff has above the sum of these; nodes send every such entry. Phase 3 resolves the totals of all
entries exactly and keeps the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import table
from cellframe.llm.registry import query
from cellframe.session import durable

_BLOCK = "kind string, block long, slice int, ids binary, matrix binary, dims int"


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _blocks(rows: DataFrame, queries: DataFrame, count: dict[str, int], dims: int, slices: int, exact: str) -> DataFrame:
    """Blocks of vectors: all their dimensions (slice -1) and each slice of these, rows in order of id."""

    def placed(frame: DataFrame, kind: str) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(count[kind]))
        return frame.select(F.lit(kind).alias("kind"), block.alias("block"), F.struct("id", "vector").alias("row"))

    grouped = placed(rows, "candidate").union(placed(queries, "query")).groupBy("kind", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    edges = np.linspace(0, dims, slices + 1).astype(int)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, block, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = members.values
                ids = np.asarray(own.field("id"), np.int64)
                lengths = [len(v) for v in own.field("vector")]
                matrix = np.zeros((len(ids), dims), exact)
                matrix[np.arange(dims) < np.array(lengths)[:, None]] = own.field("vector").flatten().to_numpy()
                for k in range(-1, slices):
                    part = matrix if k < 0 else matrix[:, edges[k] : edges[k + 1]]
                    row = {"kind": [kind], "block": [block], "slice": pa.array([k], pa.int32()), "ids": [ids.tobytes()]}
                    row |= {"matrix": [np.ascontiguousarray(part).tobytes()], "dims": pa.array([part.shape[1]], pa.int32())}
                    yield pa.RecordBatch.from_pydict(row)

    return grouped.select("kind", "block", "rows").mapInArrow(pack, _BLOCK)


def _matrix(batch: pa.RecordBatch, k: int, ids: str, matrix: str, dims: str, exact: str) -> tuple[np.ndarray, np.ndarray]:
    at = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
    names = np.frombuffer(at(ids), np.int64)
    return names, np.frombuffer(at(matrix), exact).reshape(len(names), at(dims))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    slices: int = 2,
    query_block: int = 512,
    candidate_block: int = 4096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` rows of ``vectors`` of highest score, all
    if there are fewer, ties to the smaller id. A score is the inner product of ``floor(scale * x)``.

    Both tables have ``id`` and ``vector``; a candidate with the query's own id doesn't count. Rows with a null id, and
    vectors that are null or hold a null, NaN or infinite component, take no part on either side. A shorter vector
    counts as one with zeros behind it. A repeated id is that many candidates, and as a query gives one result. Other
    columns are not read. Components whose products leave the whole numbers that a double holds are refused.
    """

    def whole(frame: DataFrame) -> DataFrame:
        good = frame.filter(F.col(id).isNotNull() & usable(F.col(vector)))
        number = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
        return good.select(F.col(id).cast("long").alias("id"), number.alias("vector"))

    def numbered(frame: DataFrame, name: str) -> DataFrame:
        """Rows with a number of their own, by which they go to blocks, so that no repeated id fills one."""
        return durable(frame.withColumn("row", F.monotonically_increasing_id()), name)

    rows, asked = numbered(whole(vectors), "candidates"), numbered(whole(queries).dropDuplicates(["id"]), "queries")
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    sizes = [f.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), largest.alias("top")).first() for f in (rows, asked)]
    dims = max([1, *(s["dims"] or 0 for s in sizes)])
    most = (sizes[0]["top"] or 0.0) * (sizes[1]["top"] or 0.0) * dims
    if most >= 2.0**53:
        raise ValueError("scores would not be exact")
    exact = "<f4" if most < 2.0**24 and max(s["top"] or 0.0 for s in sizes) < 2.0**24 else "<f8"
    count = {"candidate": -(-sizes[0]["n"] // candidate_block) or 1, "query": -(-sizes[1]["n"] // query_block) or 1}
    slices = min(slices, dims)
    blocks = durable(_blocks(rows, asked, count, dims, slices, exact), "vector-blocks")

    def side(kind: str, whole_vectors: bool) -> DataFrame:
        own = blocks.filter((F.col("kind") == kind) & ((F.col("slice") < 0) if whole_vectors else (F.col("slice") >= 0)))
        short = kind[0]
        return own.select(F.col("block").alias(f"{short}b"), "slice", *(F.col(c).alias(f"{short}_{c}") for c in ("ids", "matrix", "dims")))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count["candidate"] - 1).cast("long")))

    def nodes(cuts: DataFrame | None = None) -> DataFrame:
        spread = side("query", False)
        spread = spread if cuts is None else spread.join(cuts, ["qb", "slice"])
        return spread.withColumn("cb", every).join(side("candidate", False), ["cb", "slice"])

    def local_scores(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q_ids, q = _matrix(batch, row, "q_ids", "q_matrix", "q_dims", exact)
        c_ids, c = _matrix(batch, row, "c_ids", "c_matrix", "c_dims", exact)
        return q @ c.T, q_ids, c_ids

    def entry_row(batch: pa.RecordBatch, row: int, hits: np.ndarray, mins: np.ndarray | None) -> pa.RecordBatch:
        at = lambda name: batch.column(batch.schema.get_field_index(name)).slice(row, 1)
        packed = np.flatnonzero(hits).astype("<u8").tobytes()
        found = {"qb": at("qb"), "cb": at("cb"), "slice": at("slice"), "entries": [packed]}
        if mins is not None:
            found["mins"] = pa.array([mins.tolist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_pydict(found)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scores, q_ids, c_ids = local_scores(batch, row)
                mins = scores.min(axis=1)
                own = np.where(q_ids[:, None] == c_ids[None, :], -np.inf, scores)
                hits = np.zeros(own.shape, bool)
                best = np.argpartition(-own, k - 1, axis=1)[:, :k] if own.shape[1] > k else np.tile(np.arange(own.shape[1]), (len(own), 1))
                np.put_along_axis(hits, best, True, axis=1)
                yield entry_row(batch, row, hits, mins)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scores, _, _ = local_scores(batch, row)
                cut = np.array(batch.column(batch.schema.get_field_index("cuts"))[row].as_py(), np.float64)
                yield entry_row(batch, row, scores >= cut[:, None], None)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q = _matrix(batch, row, "q_ids", "q_matrix", "q_dims", exact)
                c_ids, c = _matrix(batch, row, "c_ids", "c_matrix", "c_dims", exact)
                lists = batch.column(batch.schema.get_field_index("lists"))[row].as_py()
                pairs = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in lists]))
                qi, ci = np.divmod(pairs.astype(np.int64), len(c_ids))
                total = np.empty(len(pairs), np.float64)
                for a in range(0, len(pairs), 65536):
                    total[a : a + 65536] = np.einsum("ij,ij->i", q[qi[a : a + 65536]], c[ci[a : a + 65536]])
                other = q_ids[qi] != c_ids[ci]
                qi, ci, total = qi[other], ci[other], total[other]
                order = np.lexsort((c_ids[ci], -total, qi))
                qi, ci, total = qi[order], ci[order], total[order]
                firsts = np.searchsorted(qi, qi)
                kept = np.arange(len(qi)) - firsts < k
                columns = {
                    "qb": np.full(int(kept.sum()), batch.column(batch.schema.get_field_index("qb"))[row].as_py(), np.int64),
                    "place": qi[kept].astype(np.int32), "query_id": q_ids[qi[kept]], "vec_id": c_ids[ci[kept]], "score": total[kept].astype(np.int64),
                }
                yield pa.RecordBatch.from_pydict(columns)

    def resolved(entries: DataFrame) -> DataFrame:
        """Exact totals of the entries, the best ``k`` of each pair of blocks."""
        lists = entries.groupBy("qb", "cb").agg(F.collect_list("entries").alias("lists"))
        met = lists.join(side("query", True).drop("slice"), "qb").join(side("candidate", True).drop("slice"), "cb")
        return met.mapInArrow(resolve, "qb long, place int, query_id long, vec_id long, score long")

    def best(totals: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    heads = durable(nodes().mapInArrow(gather, "qb long, cb long, slice int, entries binary, mins array<double>"), "heads")
    safe = best(resolved(heads.drop("mins"))).filter(F.col("rank") == k).select("qb", "place", F.col("score").alias("cutoff"))
    least = heads.select("qb", "slice", F.posexplode("mins").alias("place", "least")).groupBy("qb", "place", "slice").agg(F.min("least").alias("least"))
    spare = F.col("cutoff") - F.sum("least").over(Window.partitionBy("qb", "place"))
    part = F.coalesce(F.floor(F.col("least") + spare / slices), F.col("least")).cast("double")
    cuts = least.join(safe, ["qb", "place"], "left").select("qb", "slice", "place", part.alias("cut"))
    cuts = cuts.groupBy("qb", "slice").agg(F.array_sort(F.collect_list(F.struct("place", "cut"))).alias("cuts")).select("qb", "slice", "cuts.cut")
    entries = nodes(durable(cuts.withColumnRenamed("cut", "cuts"), "cutoffs")).mapInArrow(collect, "qb long, cb long, slice int, entries binary")
    return best(resolved(entries)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_SQL = """with good as (select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
  scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from good q join good c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
  placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from placed where rank <= 20"""


@query("op6_threshold_top_k", _SQL)
def op6_threshold_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)
