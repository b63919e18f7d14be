"""Ranking by TF-IDF: term counts, weights, cosine over an inverted index, hybrid scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.text import held


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf: lower-case runs of three letters or apostrophes and more that aren't stop words."""
    terms = F.regexp_extract_all(F.lower(held(F.col(text))), F.lit("[a-z][a-z']{2,}"), 0)
    return docs.select(key, F.explode(terms).alias("term")).where(~F.col("term").isin(rules.TERM_STOP)).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(counts: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1; n_docs is a one-row table with N in n."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, w, norm: (1 + ln tf) idf; a term without a frequency weighs as idf 1. norm of a document, 1 if 0."""
    w = counts.join(idf, "term", "left").select(key, "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("norm", F.when(norm > 0, norm).otherwise(1.0))


def cosines(left: DataFrame, right: DataFrame, key: str = "doc_id", unordered: bool = False) -> DataFrame:
    """a, b, cos of every pair that shares a term, from weights(): exact, as other pairs are 0.

    The inverted index is the equi-join on terms, which adaptive execution can split where a term is frequent;
    products are summed in each task before the pairs are shuffled.
    """
    a = left.select(F.col(key).alias("a"), "term", (F.col("w") / F.col("norm")).alias("wa"))
    b = right.select(F.col(key).alias("b"), "term", (F.col("w") / F.col("norm")).alias("wb"))
    met = a.join(b, "term")
    return met.where(F.col("a") < F.col("b") if unordered else F.lit(True)).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))


def top_terms(left: DataFrame, right: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """a, b, terms: the n shared terms with the largest products, ties to the lesser term."""
    a = left.select(F.col(key).alias("a"), "term", F.col("w").alias("wa"))
    b = right.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    shared = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("wa") * F.col("wb")).alias("p"), "term"))).alias("t"))
    return shared.select("a", "b", F.transform(F.slice("t", 1, n), lambda t: t["term"]).alias("terms"))


def tags(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tag, weight of the vocabulary (tag, weight, term) whose term is in the text as a word, ignoring case.

    Every text is cut into words once; a term of several words is looked for by its first.
    """
    vocabulary = vocabulary.withColumn("first", F.lower(F.regexp_extract("term", r"^\W*(\w+)", 1)))
    words = docs.select(key, F.lower(held(F.col(text))).alias("t")).select(key, "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9_]+"), 0))).alias("first"))
    edge = "[A-Za-z0-9_]"
    pattern = F.concat(F.lit(f"(?<!{edge})"), F.regexp_replace(F.lower("term"), r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(f"(?!{edge})"))
    return words.join(F.broadcast(vocabulary), "first").where(F.rlike(F.col("t"), pattern)).select(key, "tag", "weight").distinct()


def facet_jaccard(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """a, b, facet: weight of the shared tags over that of all tags, for pairs that share one."""
    total = lambda t, name: t.groupBy(key).agg(F.sum("weight").alias(name)).withColumnRenamed(key, name[-1])
    both = left.select(F.col(key).alias("a"), "tag", "weight").join(right.select(F.col(key).alias("b"), "tag"), "tag").groupBy("a", "b").agg(F.sum("weight").alias("both"))
    met = both.join(total(left, "sum_a"), "a").join(total(right, "sum_b"), "b")
    return met.select("a", "b", (F.col("both") / (F.col("sum_a") + F.col("sum_b") - F.col("both"))).alias("facet"))


def hybrid(cos: Column, facet: Column, both_tagged: Column) -> Column:
    return F.when(both_tagged, 0.5 * cos + 0.5 * F.coalesce(facet, F.lit(0.0))).otherwise(cos)


def rank(scores: DataFrame, k: int, by: str = "a", other: str = "b", score: str = "cos") -> DataFrame:
    """The k best of each, ties to the lesser; Spark keeps k rows a task before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), other)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def precision_at(ranked: DataFrame, relevant: Column, k: int, by: str = "a") -> DataFrame:
    """One row: the mean share of relevant rows among each one's k best, and the share whose first is relevant."""
    each = ranked.where(F.col("rank") <= k).groupBy(by).agg((F.sum(relevant.cast("int")) / k).alias("p"), F.max(F.when(F.col("rank") == 1, relevant.cast("int"))).alias("top"))
    return each.agg(F.count("*").alias("n"), F.avg("p").alias("p_at_k"), F.avg("top").alias("top1"))


def trajectories(events: DataFrame, case: str, order: str, items: str) -> DataFrame:
    """events with added and dropped: what each row's items have beyond, or lack of, the row before in its case."""
    before = F.coalesce(F.lag(items).over(Window.partitionBy(case).orderBy(order)), F.array().cast(events.schema[items].dataType))
    held_ = events.withColumn("_before", before)
    return held_.withColumn("added", F.array_sort(F.array_except(items, "_before"))).withColumn("dropped", F.array_sort(F.array_except("_before", items))).drop("_before")


def word_bag_dice(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, dice: twice the shared word counts over all, of two texts a row; two empty texts are 1."""
    bag = lambda c, name: pairs.select(key, F.explode(F.regexp_extract_all(F.lower(held(F.col(c))), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))
    met = bag(left, "x").join(bag(right, "y"), [key, "w"], "full").fillna(0, ["x", "y"])
    sums = met.groupBy(key).agg((2 * F.sum(F.least("x", "y")) / F.sum(F.col("x") + F.col("y"))).alias("dice"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce("dice", F.lit(1.0)).alias("dice"))
