"""Composed strip plans: passes of nomination and masking, and the region form with policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.rx import java
from ..operators import entities, policies, regions, sequential, spans

#: What near a date or an amount makes it personal. Fixed value.
ANCHOR = r"\b(?:born|births?|date of birth|d\.?\s?o\.?\s?b\.?|died|date of death|passport|identity card|nric|social security|salary|salaries|wages?|remuneration)\b"
#: Ranges in which no shape is masked. Fixed value.
PROTECTED = r"\b(?:Court|Government|Commission|Committee|Chamber|Registry|Convention|Ministry|Tribunal|Council|Prosecutor|Republic|Kingdom|Parliament|Assembly)\b[^.\n]{0,30}"
FULL_DATE = r"\d{4}"


def nominate(docs: DataFrame, verdicts: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, span, cls, src: emails, addresses and the structural rails, then capitalised runs by verdict.

    verdicts: low (the span in lower case), cls. It stands for a reader's judgement of each distinct run, given
    once however often it occurs; a run without one isn't masked here and stays for review.
    """
    mails = spans.find(docs, rules.EMAIL, "", key, text).select(key, F.lit(0).alias("o"), "span", F.lit("EMAIL").alias("cls"), F.lit("rail:email").alias("src"))
    streets = reduce(DataFrame.union, [spans.find(docs, p, "", key, text) for p in rules.ADDRESSES]).select(key, F.lit(1).alias("o"), F.btrim("span").alias("span"), F.lit("ADDRESS").alias("cls"), F.lit("rail:address").alias("src"))
    rails = spans.battery(docs, key, text).select(key, F.lit(2).alias("o"), "span", "cls", "src")
    found = [mails, streets, rails]
    if verdicts is not None:
        runs = sequential.nominate_runs(docs, key, text).join(verdicts.select("low", F.col("cls").alias("_c")), F.lower("span") == F.col("low"))
        found.append(runs.select(key, F.lit(3).alias("o"), "span", F.col("_c").alias("cls"), F.lit("rail:classify").alias("src")))
    every = reduce(DataFrame.unionByName, found).distinct()
    return every.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("o", "src", "span", "cls")).cast("long")).drop("o")


def strip(docs: DataFrame, verdicts: DataFrame | None = None, passes: int = 2, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, masked), entity table: each pass reads what the last one left, all finds join one table, and the whole masks the original.

    passes is small and fixed, so the plan is unrolled; nothing is collected.
    """
    seen, entries = docs.select(key, text), None
    for k in range(passes):
        found = nominate(seen, verdicts, key, text).where(~spans_of_mask(F.col("span"))).withColumn("ord", F.col("ord") + (k << 20))
        entries = found if entries is None else entries.unionByName(found)
        table = entities.propagate_prefixes(entities.build_table(entries, key), key)
        masked = entities.mask(docs, table, key, text)
        seen = masked.withColumnRenamed("masked", text)
    return masked, table


def spans_of_mask(span):  # noqa: ANN001, ANN201
    """Whether a span is an artefact of masking, which never enters the table."""
    return span.rlike(java(rules.MASK_TAG, "i")) | span.rlike(java(rules.BARE_TAG, "i"))


def anchored(found: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None, window: int = 70, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The date and amount regions that are personal: anchored in their surroundings, or by a verdict on their text.

    A full date that is anchored once is masked wherever it stands in the document; a month alone, or an amount
    of few digits, only where it is anchored. verdicts: span, personal.
    """
    met = found.join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")), key)
    near = policies.context("_t", "start", "end", window, window).rlike(java(ANCHOR, "i"))
    told = met.withColumn("_near", near).drop("_t")
    if verdicts is not None:
        told = told.join(verdicts.select(F.col("span").alias("_v"), "personal"), F.col("span") == F.col("_v"), "left").withColumn("_near", F.col("_near") | F.coalesce("personal", F.lit(False))).drop("_v", "personal")
    anywhere = F.max(F.col("_near").cast("int")).over(Window.partitionBy(key, "span")) == 1
    return told.withColumn("_any", anywhere).where(F.col("_near") | (F.col("_any") & F.col("span").rlike(FULL_DATE))).select(*found.columns)


def legal_strip(docs: DataFrame, table: DataFrame, verdicts: DataFrame, keep: tuple[str, ...] = ("organ", "government", "court"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked, by regions over the original: the table's placements less what the policy gives back, and shapes outside protected ranges."""
    rows = policies.restore(table, verdicts, keep, key).where(~F.col("restored"))
    placed = sequential.placements(docs, rows, key, text)
    protected = spans.find(docs, PROTECTED, "", key, text)
    shapes = regions.without_overlap(policies.shape_regions(docs, key=key, text=text).select(key, "start", "end", "tag"), protected, key)
    return regions.render(docs.select(key, text), placed.select(key, "start", "end", "tag").unionByName(shapes), key, text)
