"""Approximate nearest neighbours by a permutation index: pivot inverted files, footrule distance, exact rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, table

#: Pivots are a bounded sample of the distinct vectors; each vector is posted with its nearest PREFIX of them.
PIVOTS, PREFIX = 512, 64
#: Candidates that go by footrule distance to the exact rerank: a share of each shard, and some at least.
SHARE, LEAST = 0.25, 256
#: Distinct vectors to a shard and queries to a block, about; a task holds one shard and one block.
SHARD, BLOCK = 16_384, 2_048
SEED = 11


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _nearest_pivots(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to (id, vector) the vector's bytes and its ordered nearest pivots; other lengths than the pivots' go."""
    units = (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.array([len(v) == len(units) for v in batch.column(1)], bool)
            ids = batch.column(0).to_numpy()[keep]
            rows = np.array([v for v, k in zip(batch.column(1).to_pylist(), keep, strict=True) if k], np.float64).reshape(-1, len(units))
            # Cosine decides; scaling first keeps extreme lengths from overflowing.
            near = np.argsort(-(rows / np.abs(rows).max(axis=1, keepdims=True)) @ units, axis=1, kind="stable")[:, :PREFIX].astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([p.tobytes() for p in near], pa.binary())], ["id", "vector", "near"])

    return run


def _search_cell(keep: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of queries against a shard: post, add up footrule gains, rerank the best exactly, keep the nearest."""

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        matrix = lambda c, kind: np.array([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])[order]
        return ids[order], matrix("vector", "<f8"), matrix("near", "<i2")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and held.num_rows:
            ids, vectors, near = arrays(held)
            q_ids, q_vectors, q_near = arrays(asked)
            scale = lambda v: v / np.abs(v).max(axis=1, keepdims=True)
            vectors, q_vectors = scale(vectors), scale(q_vectors)
            norms, q_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(q_vectors, axis=1)
            k, n = near.shape[1], len(ids)
            # The inverted files: for each pivot who has it in its prefix, and at which rank.
            flat, ranks = near.ravel(), np.tile(np.arange(k, dtype=np.int16), n)
            by_pivot = np.argsort(flat, kind="stable")
            starts = np.searchsorted(flat[by_pivot], np.arange(int(flat.max()) + 2))
            who, rank = (by_pivot // k).astype(np.int32), ranks[by_pivot]
            most = min(n, max(LEAST, int(np.ceil(SHARE * n))))
            for i in range(len(q_ids)):
                gain = np.zeros(n, np.int32)
                for r, pivot in enumerate(q_near[i].tolist()):
                    if pivot + 1 < len(starts):
                        post = slice(starts[pivot], starts[pivot + 1])
                        # Absent pivots count as at rank k: a shared one takes 2 (k - max of the ranks) off the footrule distance.
                        gain[who[post]] += k - np.maximum(rank[post], r)
                found = np.argpartition(-gain, most - 1)[:most] if most < n else np.arange(n)
                found.sort()
                scores = (vectors[found] * q_vectors[i]).sum(axis=1) / (norms[found] * q_norms[i])
                best = np.lexsort((ids[found], -scores))[:keep]
                out += [(int(q_ids[i]), int(ids[found[b]]), float(scores[b])) for b in best]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "class", "score"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of the rows where `queries` holds, of all other rows.

    Equal vectors are one class of the index with its k + 1 smallest ids, so copies, however many, cost one
    entry and all ties among them go to the smaller id. Every class is posted; each shard of about 16,000 of
    them is searched by each block of queries, which bounds what a task holds. Rows that usable() refuses,
    null ids and vectors of another length than most pivots take no part; a repeated vec_id counts once, with
    its least vector. Fewer candidates than k give fewer rows, an empty table none.
    """
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    held = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("asked"))
    held = held.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    held = cut(held)
    by_id = Window.partitionBy("v").orderBy("id")
    members = held.select("id", "v").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    classes = cut(members.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("class", F.col("ids")[0]))
    asked = held.where("asked").select("v", F.col("id").alias("query_id")).join(classes.select("v", "class"), "v").select("query_id", "class", "v")
    sample = classes.orderBy(F.xxhash64("class", F.lit(SEED)), "class").limit(PIVOTS).select("v").collect()
    lengths = [len(r["v"]) for r in sample]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = max(sorted(set(lengths)), key=lengths.count)
    near = _nearest_pivots(np.array([r["v"] for r in sample if len(r["v"]) == dims], np.float64))
    posted, wanted = (
        d.mapInArrow(near, "id long, vector binary, near binary")
        for d in (classes.select("class", "v"), asked.groupBy("class").agg(F.first("v").alias("v")))
    )
    shards, blocks = (-(-x // y) for x, y in ((classes.count(), SHARD), (asked.select("class").distinct().count(), BLOCK)))
    if not blocks:
        return vectors.sparkSession.createDataFrame([], schema)
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(n)).cast("int")
    left = wanted.select("*", dealt(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = posted.select("*", dealt(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_search_cell(k + 1), "query long, class long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    found = found.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    own = asked.select("query_id", F.col("class").alias("query")).join(found, "query").where("query_id != vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
