"""Scores of masked output against gold: leaks, preservation, severity, hardness, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import java
from ..functions.text import held

SEVERITY = {"NO_MASK": 1, "QUASI": 2, "DIRECT": 3}


def bounded(span: Column) -> Column:
    """The pattern of a span for counting: case-sensitive, white space tolerant, whole at ends that are word characters."""
    quoted = F.regexp_replace(span, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    body = F.regexp_replace(quoted, java(r"\s+"), java(r"\s+").replace("\\", "\\\\"))
    edge = java(r"\b")
    word = "[A-Za-z0-9_]"
    return F.concat(F.when(span.rlike("^" + word), edge).otherwise(""), body, F.when(span.rlike(word + r"\z"), edge).otherwise(""))


def occurrences(text: Column, span: Column) -> Column:
    return F.when(F.length(held(span)) > 0, F.call_function("regexp_count", held(text), bounded(span))).otherwise(0)


def strictest(gold: DataFrame, *keys: str) -> DataFrame:
    """keys, identifier_type: the strictest of conflicting labels, DIRECT over QUASI over NO_MASK."""
    level = F.lit(0)
    for name, n in SEVERITY.items():
        level = F.when(F.col("identifier_type") == name, n).otherwise(level)
    return gold.groupBy(*keys).agg(F.max_by("identifier_type", level).alias("identifier_type"))


def leaks(gold: DataFrame, docs: DataFrame, masked: DataFrame, key: str = "doc_id") -> DataFrame:
    """gold with in_original, remaining, digest: how often each span is in a document and in what was made of it.

    A document without output has null remaining. digest names a span without telling it.
    """
    texts = docs.select(key, F.col("text").alias("_o")).join(masked.select(key, F.col("masked").alias("_m")), key, "left")
    met = gold.join(texts, key)
    remaining = F.when(F.col("_m").isNotNull(), occurrences(F.col("_m"), F.col("span")))
    digest = F.substring(F.sha2("span", 256), 1, 12)
    return met.select(*gold.columns, occurrences(F.col("_o"), F.col("span")).alias("in_original"), remaining.alias("remaining"), digest.alias("digest"))


def score_documents(leaked: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a document: totals and leaks by type, spans not in the original, and whether no DIRECT one leaked."""
    found, left = F.col("in_original") > 0, F.col("remaining") > 0
    of = lambda kind: found & (F.col("identifier_type") == kind)
    sums = leaked.groupBy(key).agg(
        F.count_if(of("DIRECT")).alias("direct"), F.count_if(of("DIRECT") & left).alias("direct_leaked"),
        F.count_if(of("QUASI")).alias("quasi"), F.count_if(of("QUASI") & left).alias("quasi_leaked"),
        F.count_if(of("NO_MASK")).alias("no_mask"), F.count_if(of("NO_MASK") & left).alias("preserved"),
        F.count_if(~found).alias("unmatchable"), F.count_if(F.col("remaining").isNull() & found).alias("without_output"),
    )
    return sums.withColumn("gate", F.col("direct_leaked") == 0)


def board(scored: DataFrame) -> DataFrame:
    """One row over all documents; an empty bucket has recall 1 and preservation 0."""
    share = lambda a, b: F.sum(a) / F.when(F.sum(b) > 0, F.sum(b)).otherwise(1)
    return scored.agg(
        F.count("*").alias("docs"), (1 - share("direct_leaked", "direct")).alias("direct_recall"), (1 - share("quasi_leaked", "quasi")).alias("quasi_recall"),
        share("preserved", "no_mask").alias("preservation"), F.avg(F.col("gate").cast("int")).alias("gate_rate"), F.sum("unmatchable").alias("unmatchable"),
    )


def min_max(rows: DataFrame, weights: dict[str, float], name: str = "hardness") -> DataFrame:
    """rows with the weighted sum of columns scaled to 0..1 over all rows, to three decimals; a null adds 0."""
    ends = rows.agg(*(F.min(c).alias(f"_lo_{c}") for c in weights), *(F.max(c).alias(f"_hi_{c}") for c in weights))
    total = F.lit(0.0)
    for c, w in weights.items():
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        total = total + w * F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.when(width != 0, width).otherwise(1), F.lit(0.0))
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, F.round(total, 3)).select(*rows.columns, name)


def agreement(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """group, n, agreed, share: how often two columns agree, by group and (null group) over all."""
    both = pairs.rollup(group).agg(F.count("*").alias("n"), F.count_if(F.col(left).eqNullSafe(F.col(right))).alias("agreed"))
    return both.withColumn("share", F.col("agreed") / F.col("n"))


def policy_grid(entities: DataFrame, labels: tuple[str, ...], label: str = "label", keep: str = "should_keep") -> DataFrame:
    """policy (bit set of kept labels), kept, right: every policy over the labels, and how often it does as it should."""
    spark = entities.sparkSession
    counts = entities.groupBy(label, keep).agg(F.count("*").alias("n"))
    place = F.lit(None).cast("int")
    for i, name in enumerate(labels):
        place = F.when(F.col(label) == name, i).otherwise(place)
    grid = counts.withColumn("_bit", place).crossJoin(F.broadcast(spark.range(1 << len(labels)).withColumnRenamed("id", "policy")))
    kept = F.coalesce(F.call_function("getbit", F.col("policy"), F.col("_bit")) == 1, F.lit(False))
    return grid.groupBy("policy").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(kept == F.col(keep), F.col("n")).otherwise(0)).alias("right"))


def quantile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the value at place floor(p (n - 1)) in order, not interpolated, by counts of distinct values."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("_upto", F.expr("sum(c) over (order by v)")).withColumn("_n", F.expr("sum(c) over ()"))
    return upto.where(F.col("_upto") > F.floor(p * (F.col("_n") - 1))).agg(F.min("v").alias("value"))
