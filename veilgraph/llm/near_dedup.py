"""Near-duplicate documents at a Jaccard similarity of word shingles: SimHash links, min-hash bands, exact check.

At a similarity of 0.8 two 64-bit SimHash fingerprints differ in ten bits on average and in three or fewer only
in a few per cent of cases, so the segment-popcount grid alone can't find such pairs. Its links are therefore
joined by pairs that share a min-hash band; both kinds are candidates only, and every one is checked exactly.
A bucket's members first meet three of them; where that leaves a bucket in several groups, an exact join over
prefixes of the sets finds what else links in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, written
from .simhash import fingerprint, links, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Two sets at 0.8 share one of 16 bands of 5 minima with probability 0.998.
BANDS, ROWS = 16, 5
_RNG = np.random.default_rng(20_240)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set, a few thousand members at a time."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * _A + _B
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    return least


def _sketch(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to doc_id, node (digest of its set of shingles), fp and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, bands = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                prints.append(fingerprint(hashes))
                own = np.unique(hashes)
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                rows = minima(own).reshape(BANDS, ROWS)
                bands.append([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in rows] if len(own) else [])
            columns = [batch.column(0), pa.array(nodes, pa.binary()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "bands"])

    return run


def _shingle_sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column(1)]
            # A doc_id that comes with several texts brings each; only the set that the node names is its own.
            own = [hashlib.blake2b(s, digest_size=16).digest() == n for s, n in zip(sets, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(own, pa.bool_()))

    return run


def _similar(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            kept = batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles as bytes) to node, size and the shingles as integers."""
    for batch in batches:
        sets = [np.frombuffer(b.as_py(), "<i8") for b in batch.column(1)]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "size", "shingles"])


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst) nodes to compare, src < dst.

    In a band's bucket each member meets three: the least and the greatest by a hash that differs by band, and
    the one whose buckets hold the most over all bands, which in a group of near copies is what they are copies
    of. So a bucket of any size gives pairs in proportion; the three are found by pre-aggregation. Fingerprints
    linked by the grid, and equal ones, bring their nodes together likewise.
    """
    posted = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    place = F.xxhash64("node", "band")
    ends = posted.groupBy("band", "key").agg(F.count("*").alias("n"), F.min_by("node", place).alias("low"), F.max_by("node", place).alias("high")).where("n > 1")
    held = cut(posted.join(ends, ["band", "key"]))
    reach = held.groupBy("node").agg(F.sum("n").alias("reach"))
    centres = held.where("n > 2").join(reach, "node").groupBy("band", "key").agg(F.max(F.struct("reach", "node"))["node"].alias("centre"))
    met = held.select("node", F.explode(F.array("low", "high")).alias("other")).union(held.where("n > 2").join(centres, ["band", "key"]).select("node", "centre"))
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").select("node", F.col("first").alias("other"))
    linked = links(first).join(first.select(F.col("fp").alias("src"), F.col("first").alias("node")), "src").join(first.select(F.col("fp").alias("dst"), F.col("first").alias("other")), "dst").select("node", "other")
    every = met.union(same).union(linked).where("node != other")
    return every.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()


def unsettled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """node, component of the members of buckets that the two ends leave in several components.

    Of five members or more some two haven't met; in a bucket of one component they needn't.
    """
    named = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "bands")
    posted = named.select("node", "component", F.posexplode("bands").alias("band", "key"))
    mixed = posted.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    return posted.join(mixed.where("n > 4 and least != most"), ["band", "key"]).select("node", "component").distinct()


def prefix_pairs(sets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) nodes of different components that can have the similarity; no pair that has it is left out.

    sets: node, shingles; parts: node, component. Shingles are ordered from the rarest. A set of n that is similar
    to one no larger shares similarity * n with it, and one of m that is similar to one no smaller shares
    2 * similarity / (1 + similarity) * m; so the first n or m less that many, and one, have a shingle in common.
    What a long passage or template gives to many sets comes last and in few prefixes. Shingles of one set alone
    take their places in its prefix but are never joined.
    """
    held = cut(sets.mapInArrow(_hashed, "node binary, size long, shingles array<long>").select("node", "size", F.explode("shingles").alias("s")))
    rare = held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    own = held.join(rare, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
    size, alone = F.col("size"), F.col("size") - F.size("all")
    asks = size - F.ceil(size * similarity - 1e-9) + 1
    lies = size - F.ceil(size * (2 * similarity / (1 + similarity)) - 1e-9) + 1
    own = own.withColumns({"alone": alone, "lies": lies - alone, "first": F.slice("all", 1, F.greatest(F.lit(0), asks - alone).cast("int"))})
    posted = own.join(parts, "node").select("node", "component", "size", "alone", "lies", F.posexplode("first").alias("at", "x"))
    posted = cut(posted.select("node", "component", "size", "lies", "at", (size - F.col("alone") - F.col("at")).alias("rest"), F.col("x.s").alias("s")))
    a, b = posted.alias("a"), posted.where("at < lies").alias("b")
    order = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") > F.col("b.node")))
    # Where a pair's first common shingle stands, no more than what follows it in either set can be shared.
    enough = F.least("a.rest", "b.rest") >= (F.col("a.size") + F.col("b.size")) * (similarity / (1 + similarity)) - 1e-9
    met = a.join(b, "s").where(order & enough & (F.col("a.component") != F.col("b.component")) & (F.col("b.size") >= F.col("a.size") * similarity - 1e-9))
    return met.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """node, shingles of the asked nodes, each from the text of its first document."""
    first = asked.join(nodes.select("node", F.col("first").alias("doc_id")), "node")
    texts = docs.join(first, "doc_id").select("node", "text")
    return texts.mapInArrow(_shingle_sets(width), "node binary, shingles binary").dropDuplicates(["node"])


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    met = pairs.join(sets.withColumnsRenamed({"node": "src", "shingles": "a"}), "src").join(sets.withColumnsRenamed({"node": "dst", "shingles": "b"}), "dst")
    return met.select("src", "dst", "a", "b").mapInArrow(_similar(similarity), "src binary, dst binary")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id of every row with a doc_id; group_id is the smallest doc_id of its near-duplicates.

    Documents with equal sets of shingles are one node. Nodes whose sets have the similarity are linked, and
    groups are the components of these links. Texts without words are one node of their own. A doc_id with
    several texts belongs to each text's group.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    sketched = written(docs.mapInArrow(_sketch(width), "doc_id long, node binary, fp long, bands array<long>"), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    pairs = written(candidate_pairs(nodes.select("node", "fp", "bands")), "pairs")
    asked = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
    edges = cut(_similar_pairs(pairs, _sets(docs, nodes, asked, width), similarity))
    parts = cut(connected_components(edges))
    open_ = cut(unsettled(nodes.select("node", "bands"), parts))
    if not open_.isEmpty():
        sets = cut(_sets(docs, nodes, open_.select("node"), width))
        more = cut(_similar_pairs(prefix_pairs(sets, open_, similarity), sets, similarity))
        if not more.isEmpty():
            parts = connected_components(edges.union(more))
    parts = parts.withColumnRenamed("node", "n")
    named = nodes.select("node", "first").join(parts, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("group_id"))
    groups = named.join(least, "component").select("node", "group_id")
    return sketched.select("doc_id", "node").join(groups, "node").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id. Rows without a doc_id stay."""
    gone = near_duplicates(docs, width, similarity).groupBy("doc_id").agg(F.min("group_id").alias("g")).where("doc_id != g").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
