"""The entity table of a document and deterministic masking by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.text import admissible, floor_mask, footprint, held


def build_table(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, span, cls, src, tag of the admissible entries; of equal spans, ignoring case, the first stays.

    entries: key, ord (a total order in the document), span, cls, src. A tag is the class and a running number.
    """
    first = Window.partitionBy(key, F.lower("span")).orderBy("ord")
    kept = entries.where(admissible(F.col("span"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    nth = F.count("*").over(Window.partitionBy(key, "cls").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tag = F.concat(F.lit("["), F.upper(F.left("cls", F.lit(1))), F.lower(F.substring("cls", 2, 1 << 20)), nth.cast("string"), F.lit("]"))
    return kept.withColumn("tag", tag)


def propagate_prefixes(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """table and, for names of three words or more, their first two words under the same tag, if not there yet."""
    parts = F.split("span", r"\s+")
    long = table.where(F.col("cls").isin("COMPANY", "PERSON")).withColumn("_w", parts).where("size(_w) >= 3")
    proper = lambda i: F.get("_w", F.lit(i)).rlike(r"^[\p{Lu}0-9]") & ~F.lower(F.get("_w", F.lit(i))).isin(list(rules.PREFIX_STOP))
    made = long.where(proper(0) & proper(1)).withColumn("_p", F.regexp_replace(F.concat_ws(" ", F.get("_w", F.lit(0)), F.get("_w", F.lit(1))), r"[,.]+\z", ""))
    made = made.where(admissible(F.col("_p"))).withColumn("_low", F.lower("_p")).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_low").orderBy("ord"))).where("_n = 1")
    have = table.select(F.col(key).alias("_k"), F.lower("span").alias("_have"))
    made = made.join(have, (F.col(key) == F.col("_k")) & (F.col("_low") == F.col("_have")), "left_anti")
    extra = made.select(key, (F.col("ord") + (1 << 30)).cast(table.schema["ord"].dataType).alias("ord"), F.col("_p").alias("span"), "cls", F.concat(F.lit("prefix:"), F.col("src")).alias("src"), "tag")
    return table.select(key, "ord", "span", "cls", "src", "tag").unionByName(extra)


def mask(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked: every entry replaced by its tag, longest span first, then the structured floor."""
    rows = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("span")).alias("n"), "ord", footprint(F.col("span")).alias("p"), "tag"))).alias("rows"))
    met = docs.select(key, held(F.col(text)).alias("t")).join(rows, key, "left")
    done = F.aggregate("rows", F.col("t"), lambda t, r: F.call_function("regexp_replace", t, r["p"], F.regexp_replace(r["tag"], r"\\", r"\\\\")))
    return met.select(key, floor_mask(F.coalesce(done, F.col("t"))).alias("masked"))


def find_index(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """low, cls, n_docs, n_rows, form: entities across documents, each with its most frequent form, ties to the least."""
    forms = table.groupBy(F.lower("span").alias("low"), "cls", "span").agg(F.count("*").alias("n"))
    docs = table.groupBy(F.lower("span").alias("low"), "cls").agg(F.countDistinct(key).alias("n_docs"), F.count("*").alias("n_rows"))
    top = forms.groupBy("low", "cls").agg(F.min(F.struct((-F.col("n")).alias("n"), "span")).alias("f"))
    return docs.join(top, ["low", "cls"]).select("low", "cls", "n_docs", "n_rows", F.col("f.span").alias("form"))
