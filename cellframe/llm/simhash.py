"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``radius`` bits differ little in at least
one segment, so each fingerprint looks up the small Hamming ball around each of its segments in a table of all segments,
and the whole distance of what it meets is verified. Copies share a fingerprint and are looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.llm.frames import annotated, table
from cellframe.llm.registry import query
from cellframe.session import durable

SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text: A-Z in lower case, XXH64 of every shingle of words, repeats included.

    A text with fewer words is one shingle; null and texts without words give 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - words_per_shingle + 1)]
    lasts = ends[min(words_per_shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), lasts.tolist())], "<u8")
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        block = hashes[a : a + 4096]
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``fp`` (signed 64-bit); other columns are handed on, all or those in ``keep``."""
    return annotated(docs, text, "fp long", lambda texts: {"fp": [fingerprint(t) for t in texts]}, keep)


def _segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """``(lowest bit, bits, radius of the ball)`` of each segment.

    With q, r the quotient and rest of ``radius / count``, the first r + 1 segments need balls of radius q and the
    others of q - 1: a pair beyond all of these would differ in more than ``radius`` bits.
    """
    whole, rest = divmod(radius, count)
    low, out = 0, []
    for k in range(count):
        bits = 64 // count + (k >= count - 64 % count)
        out.append((low, bits, whole if k <= rest else whole - 1))
        low += bits
    return [s for s in out if s[2] >= 0]


def _ball(bits: int, radius: int) -> list[int]:
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(bits)}
    return sorted(masks)


def _part(fp: Column, low: int, bits: int) -> Column:
    shifted = F.shiftrightunsigned(fp, low)
    return shifted if bits == 64 else shifted.bitwiseAND(F.lit((1 << bits) - 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fingerprints: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different fingerprints (``fp``, each once) at ``radius`` or fewer differing bits.

    Each pair comes once, from the first segment that finds it. Three segments serve up to 2**24 fingerprints, two
    beyond, so that a table entry meets few others by chance.
    """
    if segments is None:
        segments = 3 if fingerprints.count() <= 1 << 24 else 2
    parts = _segments(segments, radius)
    fp = F.col("fp")
    entries, probes, first = [], [], F.lit(False)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    for k, (low, bits, reach) in enumerate(parts):
        part = _part(fp, low, bits)
        entries.append(F.struct(F.lit(k).alias("k"), part.alias("key")))
        probes.extend(F.struct(F.lit(k).alias("k"), part.bitwiseXOR(F.lit(_signed(m))).alias("key")) for m in _ball(bits, reach))
        near = F.bit_count(_part(apart, low, bits)) <= reach
        earlier = F.lit(False)
        for low2, bits2, reach2 in parts[:k]:
            earlier = earlier | (F.bit_count(_part(apart, low2, bits2)) <= reach2)
        first = first | ((F.col("k") == k) & near & ~earlier)
    listed = fingerprints.select(fp.alias("b"), F.explode(F.array(*entries)).alias("e")).select("b", "e.k", "e.key")
    asked = fingerprints.select(fp.alias("a"), F.explode(F.array(*probes)).alias("e")).select("a", "e.k", "e.key")
    met = asked.join(listed, ["k", "key"])
    return met.filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & first).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b``): the smallest node that it can reach.

    Each round every node takes the smallest of itself and its neighbours, three times over, and the links are carried
    over to those; a link between equal nodes goes. Rounds end when no link is left; each is a written table.
    """
    edges = durable(edges, "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("v"), F.least("a", "up").alias("up"))
        up = durable(up, "parents")
        for _ in range(2):
            above = up.select(F.col("v").alias("up"), F.col("up").alias("above"))
            up = durable(up.join(above, "up").select("v", F.col("above").alias("up")), "parents")
        to = lambda c: up.select(F.col("v").alias(c), F.col("up").alias(f"{c}2"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("a2 <> b2")
        edges = durable(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        mapped = nodes.join(to("root"), "root", "left").select("node", F.coalesce("root2", "root").alias("root"))
        nodes = durable(mapped, "nodes")
    return nodes


def with_components(fingerprints: DataFrame, id: str = "doc_id", radius: int = 4) -> DataFrame:
    """``fingerprints`` (``id`` and ``fp``) with ``component_id``: the smallest id reachable over links, itself included.

    Also ``root``, the smallest fingerprint of the component. Fingerprints of 0 are linked like any other. Null ids take
    part, but are no one's smallest id unless all are null. Repeated rows stay, an empty table stays empty, and columns
    that have the names of the results are replaced.
    """
    fingerprints = fingerprints.drop("component_id", "root")
    classes = durable(fingerprints.groupBy("fp").agg(F.min(id).alias("least!")), "classes")
    found = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left").select("fp", "least!", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least!").alias("component_id"))
    named = durable(rooted.join(ids, "root").select("fp", "component_id", "root"), "components")
    return fingerprints.join(named, "fp")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (null last), then of the smallest text hash."""
    keys = {"null!": F.col(id).isNull(), "id!": F.coalesce(F.col(id), F.lit(0)), "hash!": F.xxhash64(text)}
    found = with_fingerprint(docs.select(F.col(id).alias("given!"), F.col(text), *(k.alias(n) for n, k in keys.items())), text, keep=["given!", *keys])
    placed = with_components(durable(found, "fingerprints"), "given!", radius)
    best = placed.groupBy("root").agg(F.min(F.struct(*keys)).alias("best!")).select(*(F.col("best!")[n].alias(n) for n in keys))
    kept = docs.withColumns(keys).join(durable(best, "kept"), list(keys), "left_semi")
    return kept.dropDuplicates(list(keys)).drop(*keys)


@query("op8_simhash_groups")
def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = durable(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    placed = with_components(found)
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
