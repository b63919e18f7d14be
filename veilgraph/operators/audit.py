"""Audits of masked collections: ranking quality, redaction marks, uncovered shapes, tables in step, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rx import java
from ..functions.text import held
from .spans import matches


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10, by: str = "a", other: str = "b") -> DataFrame:
    """One row: n, mrr, recall: the mean inverse rank of the first relevant partner, and the share found in the first k.

    ranked: by, other, rank. relevant: by, other. One without a relevant partner doesn't count; none ranked is 0.
    """
    met = relevant.select(by, other).distinct().join(ranked.select(by, other, "rank"), [by, other], "left")
    each = met.groupBy(by).agg(F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), (F.count_if(F.col("rank") <= k) / F.count("*")).alias("found"))
    return each.agg(F.count("*").alias("n"), F.avg("rr").alias("mrr"), F.avg("found").alias("recall"))


def marker_sites(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, family, line: marks that a redactor left, each with its line.

    Bare asterisks count only next to a word in the same line, 35 characters around; else they are a rule or a list.
    """
    rows = docs.select(key, F.posexplode(F.split(held(F.col(text)), "\n")).alias("at", "line"))
    found = rows.select(key, "at", "line", F.explode(matches(F.col("line"), r"\[\*+\]|\[(?:REDACTED|redacted|Redacted)\]|█+|\*{3,}")).alias("m"))
    around = F.concat(F.substring(F.col("line"), F.greatest(F.lit(0), F.col("m.start") - 35) + 1, F.least(F.lit(35), F.col("m.start"))), F.substring(F.col("line"), F.col("m.end") + 1, F.lit(35)))
    family = F.when(F.col("m.span").startswith("[*"), "bracket-star").when(F.col("m.span").startswith("["), "word").when(F.col("m.span").startswith("█"), "block").otherwise("bare-star")
    return found.withColumn("family", family).where((F.col("family") != "bare-star") | around.rlike("[A-Za-z0-9]")).select(key, "at", F.col("m.start").alias("start"), "family", "line")


def probe_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, share, phrase: distinctive lines to find a document again by, at a fifth and at 65 % of those it has.

    A line is distinctive with 60 to 170 characters and three capitalised words.
    """
    lines = F.filter(F.split(held(F.col(text)), "\n"), lambda x: (F.length(x) >= 60) & (F.length(x) <= 170) & (F.size(F.regexp_extract_all(x, F.lit(java(r"\b[A-Z][a-z]+")), 0)) >= 3))
    own = docs.select(key, lines.alias("l")).where(F.size("l") > 0)
    shares = F.array(*(F.struct(F.lit(s).alias("share"), F.get("l", F.floor(s * (F.size("l") - 1)).cast("int")).alias("phrase")) for s in (0.2, 0.65)))
    return own.select(key, F.explode(shares).alias("p")).select(key, "p.share", "p.phrase")


def uncovered(found: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """found (key, span) that no gold span of its document contains or is contained in."""
    g = gold.select(F.col(key).alias("_k"), F.lower("span").alias("_g"))
    inside = F.col("_g").contains(F.lower("span")) | F.lower("span").contains(F.col("_g"))
    return found.join(g, (F.col(key) == F.col("_k")) & inside, "left_anti")


def rule_board(hits: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """rule, nominated, on_gold: how many regions (key, start, end, rule) of each rule touch a gold region."""
    g = gold.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = hits.select(key, "start", "end", "rule").distinct()
    met = rows.join(g, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_semi")
    return rows.groupBy("rule").agg(F.count("*").alias("nominated")).join(met.groupBy("rule").agg(F.count("*").alias("on_gold")), "rule", "left").fillna(0, ["on_gold"])


def out_of_step(table: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of either that the other lacks, with side; counts of repeated rows matter. Empty if in step."""
    columns = table.columns
    return table.exceptAll(expected.select(columns)).withColumn("side", F.lit("surplus")).union(expected.select(columns).exceptAll(table).withColumn("side", F.lit("missing")))


def aliases(names: DataFrame, group: str, name: str = "name", word: str = "Person") -> DataFrame:
    """group, name, alias: letters in the order of names within a group, then numbers: Person A to Z, Person 27 on."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(name))
    shown = F.when(nth <= 26, F.char(F.lit(64) + nth)).otherwise(nth.cast("string"))
    return names.select(group, name).distinct().withColumn("alias", F.concat(F.lit(word + " "), shown))


def encoder_shaped(token: Column) -> Column:
    """Whether a token looks encoded: its kinds of character change often, some capitals but not all, a digit or sign."""
    kind = F.translate(token, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    n = F.length(token)
    chars = F.split(kind, "")
    changes = F.aggregate(F.zip_with(F.slice(chars, 1, F.greatest(n - 1, F.lit(1))), F.slice(chars, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.when(b.isNotNull() & (a != b), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    letters = F.length(F.regexp_replace(token, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(token, "[^A-Z]", "")) / F.greatest(letters, F.lit(1))
    return (n > 1) & (changes >= 0.42 * (n - 1)) & (capitals >= 0.2) & (capitals <= 0.8) & token.rlike("[^A-Za-z]")
