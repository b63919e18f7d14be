"""SimHash near-duplicates by segment popcounts: a grid range-join under Manhattan distance, then exact bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, table, written

SEED = 42
#: Differing bits up to which fingerprints link; the grid below is exact up to this radius.
RADIUS = 3
PAIRS = 0x5555555555555555
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; A-Z lower-cased, words apart at ASCII white space."""
    # bytes.lower() and bytes.split() go by ASCII alone, as the contract does.
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    parts = zip(*(words[i:] for i in range(width))) if n > 1 else [words]
    return np.fromiter((digest(x, SEED) for x in map(b" ".join, parts)), "<u8", max(n, 1))


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits of the hashes, as a signed integer; zero for none."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (bigint) of every row; null texts count as empty, shorter ones are one shingle."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: 32 segments of two bits, each replaced in place by its number of set bits."""
    low, high = fp.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIRS))
    # The sum of the two by logic alone; the topmost segment would overflow a signed addition.
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(counts: Column) -> Column:
    """array<struct<half, cell>> of the two halves of an embedding, 16 dimensions each."""
    low, high = counts.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(counts, 32)
    return F.array(F.struct(F.lit(0).alias("half"), low.alias("cell")), F.struct(F.lit(1).alias("half"), high.alias("cell")))


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) with src < dst for distinct fingerprints at 1 to 3 differing bits, none left out.

    Segment popcounts differ by at most as much, in Manhattan distance, as the fingerprints do in bits. So of
    two linked ones one half is at distance 0 or 1 in its 16 dimensions: in the same cell of that half's grid
    or in a neighbour one step up one axis, seen from the lower side. Each fingerprint is posted in two cells
    and asks in two and their upper neighbours, 34 at most; what meets is then compared bit for bit. Cells are
    plain join keys, which a skewed one can be split by.
    """
    held = prints.select("fp", F.explode(cells(popcounts(F.col("fp")))).alias("c")).select("fp", "c.half", "c.cell")
    up = F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((2 * i).alias("at"))), lambda s: F.call_function("shiftright", F.col("cell"), s["at"] + 1).bitwiseAND(F.lit(1)) == 0)
    asked = held.select("fp", "half", F.explode(F.concat(F.array(F.col("cell")), F.transform(up, lambda s: F.col("cell") + F.call_function("shiftleft", F.lit(1).cast("long"), s["at"])))).alias("cell"), F.col("cell").alias("own"))
    met = asked.alias("a").join(held.alias("b"), ["half", "cell"])
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    apart = (F.col("a.fp") != F.col("b.fp")) & ((F.col("a.own") != F.col("cell")) | (F.col("a.fp") < F.col("b.fp")))
    return met.where(near & apart).select(F.least("a.fp", "b.fp").alias("src"), F.greatest("a.fp", "b.fp").alias("dst")).distinct()


def simhash_classes(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, n_links, component_id of every row: components of fingerprints linked at 3 bits or fewer.

    component_id is the smallest doc_id reachable, n_links the number of other fingerprints linked directly.
    Equal fingerprints are one node, so a group of copies, however large, costs one. Null and empty texts have
    fingerprint zero and link like any other; null doc_ids take part but never name a component.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(links(nodes))
    degree = edges.select(F.col("src").alias("fp")).union(edges.select(F.col("dst").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    named = nodes.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "component").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return prints.join(classes, "fp").select("doc_id", "fp", "n_links", "component_id")


def op2_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
