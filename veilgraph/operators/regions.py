"""Interval algebra over offsets: overlap, merge, subtract, as-of lookup and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without_overlap(spans: DataFrame, protected: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans that overlap no protected range of their document. Half-open; touching isn't overlap.

    A hash join on the document with the overlap as a further condition, never a nested loop.
    """
    p = protected.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(p, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def merge(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, tag, tags: regions that overlap or touch become one; the tag of the first counts.

    First is the least start, then the longest, then the least tag. Gaps-and-islands in one window and one
    aggregation on the same key, so one shuffle.
    """
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), "tag")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(order)).withColumn("_at", F.row_number().over(order))
    return islands.groupBy(key, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("tag", "_at").alias("tag"), F.array_sort(F.collect_set("tag")).alias("tags")
    ).drop("_island")


def subtract(regions: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, tag: the parts of each region that no kept span covers, empty parts left out.

    The boundaries of a region and of the kept spans within it cut it into atoms; an atom stays if no kept
    span covers it. Kept spans are merged first, so each atom is compared with its own spans only.
    """
    kept = merge(keep.select(key, "start", "end", F.lit("").alias("tag")), key).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = regions.select(key, "start", "end", "tag").withColumn("_id", F.struct("start", "end", "tag"))
    met = own.join(kept, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left")
    holes = met.groupBy(key, "_id").agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))))).alias("h"))
    starts = F.concat(F.array("_id.start"), F.transform("h", lambda h: h["e"]))
    ends = F.concat(F.transform("h", lambda h: h["s"]), F.array("_id.end"))
    parts = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"))), lambda p: p["start"] < p["end"])
    return holes.select(key, F.explode(parts).alias("p"), F.col("_id.tag").alias("tag")).select(key, "p.start", "p.end", "tag")


def as_of(points: DataFrame, headers: DataFrame, key: str = "doc_id", at: str = "start", off: str = "off", name: str = "name") -> DataFrame:
    """points with the name of the latest header at or before them, null before the first.

    One window over the union of both, so each side is sorted once and nothing is paired.
    """
    columns = points.columns
    left = points.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast("string").alias("_name"))
    right = headers.select(F.col(key).alias("_k"), F.col(off).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(name).alias("_name"))
    order = Window.partitionBy("_k").orderBy("_at", "_side", "_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.union(right).withColumn("section", F.last("_name", ignorenulls=True).over(order))
    return met.where("_side = 1").select("_row.*", "section")


def render(docs: DataFrame, regions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked: each text with its merged regions replaced by their tags; texts without regions as they are."""
    cuts = merge(regions, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("cuts"))
    met = docs.join(cuts, key, "left")
    step = lambda a, c: F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, c["start"] - a["at"]), c["tag"]).alias("out"), c["end"].alias("at"))
    done = F.aggregate("cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return met.select(key, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(done).alias("masked"))
