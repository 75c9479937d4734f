"""How far the sources of a language stand apart in their terms: hash-consed segment trees over term ids.

A group, the documents of one language and source, counts each term of its language. Over a run of term ids these counts
are the leaves of a segment tree. Trees are hash-consed: nodes with the same two children are one node, within a tree
and between the trees of all groups. Two groups are compared by walking down both trees at once; a pair of nodes that
comes up again, at whatever place, is priced once and counted as often as it comes up.

Term ids are dealt out in chunks of some thousand terms, each a subtree of its own, and sources in blocks, so that a
task holds the chunk's subtrees of two blocks of sources whatever the vocabulary and the number of sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellframe.llm.frames import table
from cellframe.llm.registry import query
from cellframe.operators.reshape import ordinals
from cellframe.session import durable

#: Probabilities are whole numbers of this part of one.
SCALE = 1_000_000_000
#: Terms a chunk is planned for; a chunk's tree has the next power of two above its terms as leaves.
CHUNK_TERMS = 3_800
BLOCK_SOURCES = 64
_HEADER = -1

#: Everything but letters ends a term: ASCII characters other than A-Z and a-z. A-Z are lower-cased.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, repeats included; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def term_counts(docs: DataFrame, entries: int = 400_000) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs`` (lang, source, text): occurrences and documents, summed by parts.

    A task gives out what it has counted whenever it holds ``entries`` counts, so a term can come more than once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def parts() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, found) in totals.items():
                names = list(times)
                for a in range(0, len(names), 50_000):
                    some = names[a : a + 50_000]
                    arrays = [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.binary()),
                        pa.array([times[t] for t in some], pa.int64()),
                        pa.array([found[t] for t in some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms(text.as_py())
                times, docs_with = totals[lang, source]
                before = len(times)
                times.update(found)
                docs_with.update(set(found))
                held += len(times) - before
                if held >= entries:
                    yield from parts()
                    totals.clear()
                    held = 0
        yield from parts()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    found = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def kept_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``(lang, source, term, n, lang_n, term_id)`` of the terms that ``least_docs`` documents of their language have.

    All rows of a language's term meet in one shuffle, at most one per source; ``term_id`` is a number of its own for
    each, and ``lang_n`` its occurrences in the language.
    """
    met = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    numbered = met.withColumn("row", F.monotonically_increasing_id())
    summed = numbered.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(same).alias("docs"), F.sum("n").over(same).alias("lang_n"), F.min("row").over(same).alias("term_id"),
    )
    return durable(summed.filter(F.col("docs") >= least_docs).drop("docs"), "kept-counts")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, g, total, lang_total, v)``: every group, its place among its language's sources in order, the
    occurrences of kept terms in it and in its language, and the number of these terms.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    named = ordinals(rows.select(F.struct("lang", "source").alias("group")), "group").select("group.*", "ordinal")
    named = durable(named, "groups")
    first = named.groupBy("lang").agg(F.min("ordinal").alias("first"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.select("lang", "term_id").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    found = named.join(first, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sums, "lang", "left")
    return durable(found.select("lang", "source", (F.col("ordinal") - F.col("first")).alias("g"), zero("total"), zero("lang_total"), zero("v")), "group-totals")


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) without overflow, three decimal digits at a time; count is at most total."""
    left, found = count, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        digits = _quotient(left, total)
        found = found * 1000 + digits
        left = left - digits * total
    return found + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    left, found = count, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        digits = left // total
        found = found * 1000 + digits
        left = left - digits * total
    return found + 1


class Trees:
    """The segment trees of several groups over the same terms, equal subtrees stored once.

    ``counts`` has a row per group and a column per term. ``below[k]`` holds the children (left, right) of every node of
    level k + 1; the nodes of level 0 are the different counts, and node 0 there is a place without a term.
    """

    def __init__(self, counts: np.ndarray) -> None:
        groups, width = counts.shape
        self.values, found = np.unique(counts, return_inverse=True)
        leaves = 1 << max(0, (width - 1).bit_length())
        nodes = np.zeros((groups, leaves), np.int64)
        nodes[:, :width] = found.reshape(counts.shape) + 1
        self.sizes, self.below = [len(self.values) + 1], []
        while nodes.shape[1] > 1:
            pairs, found = np.unique(nodes[:, 0::2] * self.sizes[-1] + nodes[:, 1::2], return_inverse=True)
            self.below.append((pairs // self.sizes[-1], pairs % self.sizes[-1]))
            nodes = found.reshape(groups, -1)
            self.sizes.append(len(pairs))
        self.roots = nodes[:, 0]

    def met(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaf pairs of the trees of groups ``left[i]`` and ``right[i]``: i ascending, both counts, how often they meet.

        All the pairs of trees are walked level by level, and within a pair of trees equal node pairs go on as one.
        """
        which, a, b = np.arange(len(left)), self.roots[left], self.roots[right]
        times = np.ones(len(left), np.int64)
        for size, (first, second) in zip(self.sizes[-2::-1], self.below[::-1]):
            both = lambda node: np.concatenate([first[node], second[node]])
            keys = (np.concatenate([which, which]) * size + both(a)) * size + both(b)
            keys, place = np.unique(keys, return_inverse=True)
            times = np.bincount(place, np.concatenate([times, times]), len(keys)).astype(np.int64)
            which, rest = np.divmod(keys, size * size)
            a, b = np.divmod(rest, size)
        real = a > 0
        return which[real], self.values[a[real] - 1], self.values[b[real] - 1], times[real]


def priced(trees: Trees, totals: np.ndarray, v: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of groups the sum over all terms of floor((p - q)**2 / q), with p of the left one, and with p of the right one."""
    ahead, back = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    which, a, b, times = trees.met(left, right)
    if len(which):
        p, q = _shares(a + 1, totals[left[which]] + v), _shares(b + 1, totals[right[which]] + v)
        square = (p - q) * (p - q)
        np.add.at(ahead, which, square // q * times)
        np.add.at(back, which, square // p * times)
    return ahead, back


def _chunk_values(chunk: pa.Table, block_sources: int, pairs_at_once: int = 256) -> pa.Table:
    """The part of a chunk of terms in the values of all ordered pairs of groups that a pair of blocks of sources has."""
    column = lambda name: chunk.column(name).to_numpy()
    a, b, g, term, n, most = (column(c) for c in ("a", "b", "g", "term_id", "n", "lang_n"))
    head = term == _HEADER
    order = np.argsort(g[head])
    groups, totals, v = g[head][order], n[head][order], int(most[head][0])
    ids, first, place = np.unique(term[~head], return_index=True, return_inverse=True)
    frequent = np.empty(len(ids), np.int64)
    frequent[np.argsort(-most[~head][first], kind="stable")] = np.arange(len(ids))
    counts = np.zeros((len(groups), len(ids)), np.int64)
    counts[np.searchsorted(groups, g[~head]), frequent[place]] = n[~head]
    in_a = np.flatnonzero(groups // block_sources == a[0])
    in_b = np.flatnonzero(groups // block_sources == b[0])
    left, right = (x.ravel() for x in np.meshgrid(in_a, in_b, indexing="ij"))
    if a[0] == b[0]:
        left, right = left[left < right], right[left < right]
    ahead, back = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    if len(ids):
        trees = Trees(counts)
        for at in range(0, len(left), pairs_at_once):
            some = slice(at, at + pairs_at_once)
            ahead[some], back[some] = priced(trees, totals, v, left[some], right[some])
    lang = pa.array([chunk.column("lang")[0].as_py()] * (2 * len(left)), pa.string())
    return pa.table({
        "lang": lang,
        "g": np.concatenate([groups[left], groups[right]]),
        "other": np.concatenate([groups[right], groups[left]]),
        "value": np.concatenate([ahead, back]),
    })


def pair_values(kept: DataFrame, groups: DataFrame, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``(lang, source, item, value)``: how far each source of a language stands from each other one, summed over all terms."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk_terms)).cast("long")
    block = F.floor(F.col("g") / block_sources).cast("long")
    known = groups.withColumn("chunks", chunks).withColumn("block", block)
    blocks = known.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    known = known.join(blocks, "lang")
    heads = known.select(
        "lang", "block", "blocks", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        F.lit(_HEADER).cast("long").alias("term_id"), F.col("total").alias("n"), F.col("v").alias("lang_n"),
    )
    counts = kept.join(known.select("lang", "source", "g", "block", "blocks", "chunks"), ["lang", "source"])
    counts = counts.select("lang", "block", "blocks", "g", F.pmod(F.xxhash64("term_id"), "chunks").alias("chunk"), "term_id", "n", "lang_n")
    dealt = heads.unionByName(counts).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "chunk", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "g", "term_id", "n", "lang_n")
    values = lambda chunk: _chunk_values(chunk, block_sources)
    parts = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(values, "lang string, g long, other long, value long")
    summed = parts.groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "g", "source")
    return summed.join(named, ["lang", "g"]).join(named.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", "item", "value")


def term_values(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """``(lang, source, item, value, rank)``: the ``ranks`` terms by which a source most exceeds its language."""
    p = _share(F.col("n") + 1, F.col("total") + F.col("v"))
    q = _share(F.col("lang_n") + 1, F.col("lang_total") + F.col("v"))
    more = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    valued = more.select("lang", "source", "item", _quotient((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    return _ranked(valued).filter(F.col("rank") <= ranks)


def _ranked(valued: DataFrame) -> DataFrame:
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_docs: int = 3, term_ranks: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every occurring pair of ``lang`` and ``source`` in ``docs``.

    Part ``pair`` has every other source of the language with its distance, part ``term`` the ``term_ranks`` terms by
    which the group most exceeds its language. Probabilities are 1 + floor(10**9 * (count + 1) / (total + V)) over the V
    terms that ``least_docs`` documents of the language have, and a value sums floor((p - q)**2 / q). Ties go to the
    smaller item in UTF-8.

    Null lang, source and text count as ''; a group without terms has count 0 for each; a language without kept terms
    has pairs of value 0 and no terms; a language with one source has no pairs. Repeated rows are documents of their
    own, texts of any length are read whole, other columns are not read, an empty table gives an empty result.
    """
    docs = docs.select("lang", "source", "text")
    kept = kept_counts(docs, least_docs)
    groups = groups_of(docs, kept)
    pairs = _ranked(durable(pair_values(kept, groups), "pair-values"))
    both = [f.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for f, name in ((pairs, "pair"), (term_values(kept, groups, term_ranks), "term"))]
    return both[0].unionByName(both[1])


SQL = """with numbered as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
  listed as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from numbered),
  counted as (select r, lang, source, term, count(*) as n from listed group by all),
  kept as (select lang, term, sum(n) as lang_n from counted group by all having count(*) >= 3),
  counts as (select lang, source, term, sum(n) as n from counted join kept using (lang, term) group by all),
  langs as (select lang, count(*) as v, sum(lang_n) as total from kept group by 1),
  sums as (select lang, source, sum(n) as total from counts group by all),
  groups as (select g.lang, g.source, coalesce(s.total, 0) as total, coalesce(l.v, 0) as v, coalesce(l.total, 0) as lang_total
    from (select distinct lang, source from numbered) g left join sums s using (lang, source) left join langs l using (lang)),
  shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
      (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)::hugeint) // (g.total + g.v)::hugeint)::hugeint as p,
      (1 + (1000000000::hugeint * (k.lang_n + 1)::hugeint) // (g.lang_total + g.v)::hugeint)::hugeint as lang_p
    from groups g join kept k using (lang) left join counts c using (lang, source, term)),
  summed as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from shares a join shares b using (lang, term) where a.source <> b.source group by all),
  pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
  exceeding as (select lang, source, term as item, (((p - lang_p) * (p - lang_p)) // lang_p)::bigint as value from shares where n > 0 and p > lang_p)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from exceeding)
where rank <= 200"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))
