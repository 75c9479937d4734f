"""Mixing sources to target weights.

The words to take are cut into equal blocks. Sainte-Laguë apportionment gives the blocks to sources by the highest
quotients of their targets, and each source's blocks to its shards by the highest quotients of their sizes. A shard is
a part of a source by a seeded hash; its documents follow one another in seeded order, and its quota of blocks is
taken from the start of that order, going round again where the quota exceeds the shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import WORD, quoted, table, word_count
from cellframe.llm.registry import query
from cellframe.session import durable

_FIRST = (Window.unboundedPreceding, -1)
_MAX_REPEATS = 2


def apportion(parties: DataFrame, by: Sequence[str], key: str, votes: str, seats: str, cap: str, into: str) -> DataFrame:
    """``parties`` with their share of ``seats`` (one number in each group of ``by``) by highest quotients votes/(2k+1).

    Ties go to the smaller ``key``, which is unique in its group. No party gets more than ``cap``; what it leaves goes to
    the next quotients, and seats stay empty only when every party with votes is at its cap. Only quotients that bounds
    leave open are ranked, a few for each party, so seats are never enumerated.
    """
    group = Window.partitionBy(*by)
    half = F.count(F.lit(1)).over(group) / 2
    weight = F.col(votes).cast("double")
    by_cap = Window.partitionBy(*by).orderBy(F.when(weight > 0, F.col(cap) / weight).asc_nulls_last(), key)
    spent = F.coalesce(F.sum(F.when(weight > 0, F.col(cap))).over(by_cap.rowsBetween(*_FIRST)), F.lit(0))
    rest = F.sum(weight).over(by_cap.rowsBetween(0, Window.unboundedFollowing))

    def level(seats_in_all):
        """Seats per vote that the parties below their caps can have, were seats no whole numbers."""
        return F.when(rest > 0, (seats_in_all - spent) / rest)

    leveled = parties.withColumn("low!", level(F.col(seats) - half)).withColumn("high!", level(F.col(seats) + half))
    leveled = leveled.withColumn("low!", F.max("low!").over(group)).withColumn("high!", F.max("high!").over(group))
    sure = F.least(F.col(cap), F.greatest(F.lit(0), F.floor(weight * F.col("low!") - 0.5)))
    most = F.least(F.col(cap), F.greatest(F.lit(0), F.floor(weight * F.col("high!") + 2.5)))
    sure, most = (F.when(weight > 0, x).otherwise(0) for x in (sure, most))
    parties = leveled
    bounded = parties.withColumn("sure!", sure.cast("long")).withColumn("most!", most.cast("long"))
    bounded = bounded.withColumn("open!", F.col(seats) - F.sum("sure!").over(group))
    wanted = bounded.filter(F.col("most!") > F.col("sure!")).select(
        *by, key, votes, "open!", F.explode(F.sequence(F.col("sure!"), F.col("most!") - 1)).alias("k!")
    )
    quotient = F.col(votes) / (2 * F.col("k!") + 1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), key, "k!"))
    won = wanted.withColumn("rank!", rank).filter(F.col("rank!") <= F.col("open!")).groupBy(*by, key).agg(F.count(F.lit(1)).alias("won!"))
    quota = F.col("sure!") + F.coalesce(F.col("won!"), F.lit(0))
    return bounded.join(won, [*by, key], "left").withColumn(into, quota).drop("low!", "high!", "sure!", "most!", "open!", "won!")


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float], share: float) -> DataFrame:
    """``(source, source_size, target, src!)``: ``share`` of all sizes by weight, no target over twice its source's size.

    Sources in order of code points, null last, take the weights in turn. The level at which targets stand per unit of
    weight is the highest that any number of capped sources leaves.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    rank = F.row_number().over(order)
    weighed = sizes.select(source, "source_size", rank.alias("src!")).withColumn(
        "weight!", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src!") - 1) % len(weights) + 1)
    )
    cap = F.col("source_size") * float(_MAX_REPEATS)
    whole = Window.partitionBy()
    capped = Window.orderBy(cap / F.col("weight!"), "src!").rowsBetween(*_FIRST)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(capped), F.lit(0.0))
    level = left / (F.sum("weight!").over(whole) - F.coalesce(F.sum("weight!").over(capped), F.lit(0.0)))
    leveled = weighed.withColumn("level!", level)
    target = F.least(cap, F.max("level!").over(whole) * F.col("weight!"))
    return leveled.withColumn("target", target).drop("level!", "weight!")


def mix(
    rows: DataFrame,
    weights: Sequence[float],
    share: float = 1.5,
    id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    seed: int = 0,
    block_words: int = 16,
    shard_words: int = 1 << 20,
    prefix: str = "",
) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``copies`` (whole times taken), ``part`` (words taken once more, from
    the document's start) and ``taken`` (words in all).

    ``size`` is a column of whole numbers; null counts as 0. A null source is a source of its own, null ids share one
    place in the seeded order, and repeated rows are taken one after the other. Rows of size 0 are never taken. Columns
    of ``rows`` with the names of the results, before which ``prefix`` is put, are replaced, all others are kept; an
    empty table gives an empty one.
    """
    results = ("source_size", "target", "copies", "part", "taken")
    rows = rows.drop(*(prefix + name for name in results))
    kept = quoted(rows.columns)
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    sizes = rows.groupBy(source).agg(F.sum(words).alias("source_size"))
    sources = source_targets(sizes, source, weights, share).withColumn("blocks!", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = sources.withColumn("cap!", F.ceil(F.col("source_size") * _MAX_REPEATS / block_words))
    quotas = apportion(sources, [], "src!", "target", "blocks!", "cap!", "quota!")
    quotas = quotas.select(
        F.col(source).alias("source!"), "src!", F.col("source_size").alias("source_size!"), F.col("target").alias("target!"),
        F.col("quota!").alias("source_quota!"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("shards!"),
    )
    quotas = durable(quotas, "source-quotas")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"))
    placed = (
        rows.join(quotas, F.col(source).eqNullSafe(F.col("source!")))
        .withColumn("order!", order)
        # rows that are never taken need no order: each task's own are a group
        .withColumn("shard!", F.when(words > 0, F.conv(F.substring("order!", 1, 8), 16, 10).cast("long") % F.col("shards!")).otherwise(-1 - F.spark_partition_id()))
    )
    shards = placed.filter(words > 0).groupBy("src!", "shard!", "source_quota!").agg(F.sum(words).alias("shard_size!"))
    shards = shards.withColumn("cap!", F.ceil(F.col("shard_size!") * _MAX_REPEATS / block_words))
    shards = apportion(shards, ["src!"], "shard!", "shard_size!", "source_quota!", "cap!", "quota!")
    budget = F.least(F.col("quota!") * block_words, F.col("shard_size!") * _MAX_REPEATS)
    rounds = F.when(F.col("shard_size!") > 0, F.floor(budget / F.col("shard_size!"))).otherwise(0).cast("long")
    shards = durable(shards.select("src!", "shard!", rounds.alias("copies!"), (budget - rounds * F.col("shard_size!")).alias("rest!")), "shard-quotas")
    inside = Window.partitionBy("src!", "shard!").orderBy("order!", id, size).rowsBetween(*_FIRST)
    started = placed.withColumn("start!", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(shards, ["src!", "shard!"], "left")
    part = F.coalesce(F.least(F.greatest(F.col("rest!") - F.col("start!"), F.lit(0)), words), F.lit(0))
    copies = F.when(words > 0, F.col("copies!")).otherwise(0)
    found = (F.col("source_size!"), F.col("target!"), copies, part, copies * words + part)
    return started.select(*kept, *(c.alias(prefix + name) for c, name in zip(found, results)))


def mixed_documents(mixed: DataFrame, text: str = "text", size: str = "size", prefix: str = "", whole: bool = False) -> DataFrame:
    """A row for each time that a document of :func:`mix` is taken, its text cut after the last word taken.

    With ``whole`` no text is cut: a document of which at least half the words are taken once more is taken once more
    as a whole, and one of which fewer are is not.
    """
    copies, part = F.col(prefix + "copies").cast("int"), F.col(prefix + "part")
    if whole:
        return mixed.withColumn(text, F.explode(F.array_repeat(F.col(text), copies + ((part > 0) & (2 * part >= F.col(size))).cast("int"))))
    begun = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    none = F.array().cast("array<string>")
    last = F.when(part <= 0, none).when(part >= F.col(size), F.array(text)).otherwise(F.array(F.array_join(F.slice(begun, 1, part.cast("int")), "")))
    return mixed.withColumn(text, F.explode(F.concat(F.array_repeat(F.col(text), copies), last)))


_TARGETS_SQL = """with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
  sums as (select source, sum(size)::bigint as source_size from sized group by 1),
  ranked as (select *, row_number() over (order by source asc nulls last) as src from sums),
  weighed as (select *, [5.0, 2.0, 1.0][((src - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as cap from ranked),
  levels as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0)) as level from weighed),
  targets as (select source, src, source_size, least(cap, max(level) over () * w) as target from levels)"""

#: Every quotient of every source and of every shard is ranked here.
SQL = (
    _TARGETS_SQL
    + """,
  capped as (select *, round(sum(target) over () / 16)::bigint as seats, ceil(source_size * 2 / 16)::bigint as cap from targets),
  quotients as (select src, seats, row_number() over (order by target / (2 * k + 1) desc, src, k) as place
    from (select *, unnest(range(cap)) as k from capped)),
  quotas as (select src, count(*) as quota from quotients where place <= seats group by 1),
  placed as (select s.*, t.src, t.source_size, t.target, q.quota, md5('0:' || coalesce(doc_id::varchar, '')) as o
    from sized s join targets t on s.source is not distinct from t.source left join quotas q using (src)),
  sharded as (select *, ('0x' || substr(o, 1, 8))::bigint % greatest(1, ceil(source_size / 1048576))::bigint as shard from placed),
  shards as (select src, shard, coalesce(any_value(quota), 0) as seats, sum(size)::bigint as shard_size, ceil(sum(size) * 2 / 16)::bigint as cap
    from sharded group by 1, 2),
  shard_quotients as (select src, shard, seats, row_number() over (partition by src order by shard_size::double / (2 * k + 1) desc, shard, k) as place
    from (select *, unnest(range(cap)) as k from shards)),
  shard_quotas as (select src, shard, count(*) as quota from shard_quotients where place <= seats group by 1, 2),
  budgets as (select src, shard, shard_size, least(coalesce(quota, 0) * 16, shard_size * 2)::bigint as budget from shards left join shard_quotas using (src, shard)),
  rounds as (select src, shard, case when shard_size > 0 then budget // shard_size else 0 end as copies,
    case when shard_size > 0 then budget % shard_size else 0 end as rest from budgets),
  started as (select *, coalesce(sum(size) over (partition by src, shard order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
    from sharded)
select doc_id, size, source_size, target, (copies * size + least(greatest(rest - start, 0), size))::bigint as taken
from started join rounds using (src, shard)"""
)


@query("op2_mixture", SQL)
def op2_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(durable(docs, "sizes"), weights=(5, 2, 1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
