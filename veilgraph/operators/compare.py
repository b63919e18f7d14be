"""Comparing two versions of a text: aligned lines, changed words, counts that rose."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import held

_BLOCKS = "key string, ord int, kind string, earlier string, later string"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, old, new in zip(batch["key"], batch["earlier"], batch["later"], strict=True):
            a, b = (old or "").split("\n"), (new or "").split("\n")
            matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
            for i, (op, i1, i2, j1, j2) in enumerate(matcher.get_opcodes()):
                kind = {"equal": "same", "replace": "changed", "delete": "removed", "insert": "added"}[op]
                rows.append((key, i, kind, "\n".join(a[i1:i2]), "\n".join(b[j1:j2])))
        yield pd.DataFrame(rows, columns=["key", "ord", "kind", "earlier", "later"])


def diff(versions: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """key, ord, kind (same, changed, removed, added), earlier, later: blocks of whole lines in order.

    Alignment is sequential in a pair of texts, so each pair is one row of an Arrow batch; pairs are independent.
    """
    return versions.select(F.col(key).cast("string").alias("key"), F.col(earlier).alias("earlier"), F.col(later).alias("later")).mapInPandas(_blocks, _BLOCKS)


def risen_words(versions: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """key, word, was, now of the words that the later text has more often."""
    bag = lambda c, name: versions.select(key, F.explode(F.regexp_extract_all(F.lower(held(F.col(c))), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("word")).groupBy(key, "word").agg(F.count("*").alias(name))
    met = bag(later, "now").join(bag(earlier, "was"), [key, "word"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
    return met.where("now > was").select(key, "word", "was", "now")


def earlier_versions(docs: DataFrame, company: str, date: str, key: str) -> DataFrame:
    """key, before: for each document the latest one of its company with an earlier date, null without one.

    Of several on that date it is the one with the largest key. Documents without a date or company have none.
    """
    days = docs.groupBy(company, date).agg(F.max(key).alias("last")).where(F.col(company).isNotNull() & F.col(date).isNotNull())
    before = days.select(company, date, F.lag("last").over(Window.partitionBy(company).orderBy(date)).alias("before"))
    return docs.select(key, company, date).join(before, [company, date], "left").select(key, "before")


def maintain(current: DataFrame, decisions: DataFrame, key: str = "key") -> DataFrame:
    """current with the decisions (key, status) on the first row of each key; others stay as they are."""
    first = Window.partitionBy(key).orderBy("ord")
    ranked = current.withColumn("_n", F.row_number().over(first)).join(decisions.select(key, F.col("status").alias("_s")), key, "left")
    return ranked.withColumn("status", F.when((F.col("_n") == 1) & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("status"))).select(*current.columns)
