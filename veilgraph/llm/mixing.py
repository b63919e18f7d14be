"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, then seeded prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, words, written

LEVELS = ("domain", "lang", "source")
#: The weights of the query: domains by the source's number, languages, sources alike.
DOMAINS = ("web", "news", "books", "forum")
WEIGHTS = {"domain": {"web": 4.0, "news": 3.0, "books": 2.0, "forum": 1.0}, "lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
SHARE, EPOCHS, SEED = 0.6, 2, "mix"
#: Leaves of the tree up to which their plan is broadcast, a row of some 100 bytes each.
BROADCAST_LEAVES = 1 << 16
#: Hexadecimal digits of the order key that make a cell: 65,536 of them to a leaf, however many documents it has.
CELL = 4


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    named = F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number.cast("int"), F.lit(len(DOMAINS))))
    return F.when(number == "", F.lit(DOMAINS[0])).otherwise(named)


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    own = weights.get(level) or {}
    chosen = F.lit(1.0)
    for name, w in sorted(own.items()):
        chosen = F.when(F.col(level) == name, F.lit(float(w))).otherwise(chosen)
    return chosen


def water_fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """nodes with share: `budget` of each parent by `weight`, none above its `cap`; what one can't take goes to its siblings.

    Siblings by cap to weight: one is full if an equal rate for it and all after it would reach its cap. The
    rate of the first that isn't full holds for the rest.
    """
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")))
    by = Window.partitionBy(*parents).orderBy("ratio", name)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rated = nodes.withColumn("rate", F.when(rest > 0, (F.col("budget") - before) / rest))
    rate = F.max(F.when(F.col("rate") < F.col("ratio"), F.col("rate"))).over(Window.partitionBy(*parents))
    rated = rated.withColumn("level", rate)  # null where all are full
    share = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.col("cap"), F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))))
    return rated.withColumn("share", share).drop("ratio", "rate", "level")


def budgets(leaves: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """levels, tokens, budget, epoch (whole passes), rest (tokens of the pass after) of each leaf.

    leaves has the levels and tokens. The root's budget is `share` of all tokens; a leaf takes `epochs` passes
    at most and an inner node what its leaves can. A node's budget is filled among its children before
    anything is left to its own siblings, as its cap is theirs together.
    """
    held = leaves.withColumn("all", F.lit(0)).withColumn("leaf_cap", F.col("tokens") * float(epochs))
    root = held.groupBy("all").agg(F.floor(F.sum("tokens") * F.lit(float(share))).cast("double").alias("budget"))
    above, path = root, ["all"]
    for level in levels:
        nodes = held.groupBy(*path, level).agg(F.sum("leaf_cap").alias("cap")).join(above, path).withColumn("weight", _weight(level, weights))
        above = water_fill(nodes, path, level).select(*path, level, F.col("share").alias("budget"))
        path = [*path, level]
    plan = held.join(above, path).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))
    epoch = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    return plan.withColumn("epoch", epoch).withColumn("rest", F.col("budget") - F.col("epoch") * F.col("tokens")).select(*levels, "tokens", "budget", "epoch", "rest")


def order_key(epoch: Column, doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _meet(docs: DataFrame, plan: DataFrame, by: Sequence[str], leaves: int) -> DataFrame:
    """docs with their row of a plan that has one row a leaf.

    A leaf may have a third of all documents. Up to BROADCAST_LEAVES the plan travels and documents stay; beyond,
    both are dealt by leaf, and an exchange by row follows, so that a skewed partition of the join can be split.
    """
    if leaves <= BROADCAST_LEAVES:
        return docs.join(F.broadcast(plan), list(by))
    return docs.join(plan, list(by)).repartition(*by, F.xxhash64("doc_id"))


def leaf_plan(counted: DataFrame, levels: Sequence[str], seed: str, **budget: object) -> DataFrame:
    """levels, budget, epoch, cut of each leaf: the pass after the whole ones takes the keys up to cut.

    The tokens of a leaf are summed by cells of the key, so a leaf with a third of all documents is no task's
    alone; only the documents of the one cell where the rest runs out are put in order.
    """
    levels = list(levels)
    plan = written(budgets(counted.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), levels, **budget), "budgets")
    leaves = plan.count()
    keyed = _meet(counted, plan.drop("tokens"), levels, leaves).withColumn("key", order_key(F.col("epoch"), F.col("doc_id"), seed)).withColumn("cell", F.substring("key", 1, CELL))
    cells = keyed.groupBy(*levels, "rest", "cell").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("cell"))
    crossed = cells.withColumn("upto", upto).where("upto > rest").withColumn("at", F.row_number().over(Window.partitionBy(*levels).orderBy("cell"))).where("at = 1")
    crossed = crossed.select(*levels, "cell", (F.col("upto") - F.col("tokens")).alias("before"))
    inside = _meet(keyed, crossed, [*levels, "cell"], leaves)
    so_far = F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels, "cell").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("so_far", so_far).where("so_far <= rest").groupBy(*levels).agg(F.max("key").alias("last"))
    # A leaf without a crossing takes its whole pass; one whose cell has no fitting document stops before the cell.
    cut = F.when(F.col("rest") <= 0, "").when(F.col("cell").isNull(), "g").otherwise(F.coalesce("last", "cell"))
    return plan.join(crossed.drop("before"), levels, "left").join(last, levels, "left").select(*levels, "budget", "epoch", cut.alias("cut"))


LEVEL_NAMES = ["of_domain", "of_lang", "of_source"]


def _mixed(docs: DataFrame, domain: Column | None = None, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """row (struct of the columns of docs), of_domain and copies of every row."""
    named = dict(zip(LEVEL_NAMES, (domain if domain is not None else domain_of(F.col("source")), F.col("lang"), F.col("source")), strict=True))
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.size(words(F.col("text"))).cast("long").alias("tokens"), *(F.coalesce(c, F.lit("")).alias(name) for name, c in named.items()))
    counted = written(held.drop("row"), "tokens")
    plan = written(leaf_plan(counted, LEVEL_NAMES, seed, weights={level: weights.get(level.removeprefix("of_"), {}) for level in LEVEL_NAMES}, share=share, epochs=epochs), "mix")
    met = _meet(held.drop("tokens"), plan.drop("budget"), LEVEL_NAMES, plan.count())
    again = (order_key(F.col("epoch"), F.col("doc_id"), seed) <= F.col("cut")).cast("long")
    return met.select("row", "of_domain", (F.col("epoch") + again).alias("copies"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """docs with mix_domain and copies: how often each document is in the mixture, 0 included.

    Tokens are words of whole texts. A leaf gets its whole passes and, of the next seeded order, the longest
    prefix of documents that its rest holds; rows of one doc_id go together. A leaf without tokens is in once.
    Null levels count as '', null texts have no tokens. Columns of docs with the two new names are replaced.
    """
    own = [c for c in docs.columns if c not in ("mix_domain", "copies")]
    return _mixed(docs, **options).select(*(F.col("row")[c].alias(c) for c in own), F.col("of_domain").alias("mix_domain"), "copies")


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, each as often as the mixture has it."""
    mixed = _mixed(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op10_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix over all documents: the copies of each in the mixture. Tokens are white-space words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix(docs).select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "copies")


def _fill_sql(name: str, above: str, path: str, level: str) -> str:
    by = f"PARTITION BY {path} ORDER BY ratio, {level}"
    return f"""
{name}_r AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 'Infinity'::DOUBLE END AS ratio FROM
  (SELECT {path}, {level}, any_value(w_{level}) AS weight, sum(leaf_cap) AS cap FROM leaf GROUP BY {path}, {level}) JOIN {above} USING ({path})),
{name}_q AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}_r),
{name} AS (SELECT {path}, {level}, CASE WHEN rate_at IS NULL THEN cap ELSE least(cap, greatest(rate_at, 0.0) * weight) END AS budget
  FROM (SELECT *, max(CASE WHEN rate < ratio THEN rate END) OVER (PARTITION BY {path}) AS rate_at FROM {name}_q))"""


OP10_SQL = (
    r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'web'
      ELSE ['web', 'news', 'books', 'forum'][1 + CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 4] END AS d
  FROM documents),
leaf AS (
  SELECT 0 AS r, d, l, s, sum(tokens) AS tokens, CAST(2 * sum(tokens) AS DOUBLE) AS leaf_cap,
    CASE d WHEN 'web' THEN 4.0 WHEN 'news' THEN 3.0 WHEN 'books' THEN 2.0 ELSE 1.0 END::DOUBLE AS w_d,
    CASE l WHEN 'en' THEN 3.0 ELSE 1.0 END::DOUBLE AS w_l, 1.0::DOUBLE AS w_s
  FROM t GROUP BY d, l, s),
root AS (SELECT 0 AS r, CAST(floor(sum(tokens) * 0.6::DOUBLE) AS DOUBLE) AS budget FROM leaf),"""
    + _fill_sql("a", "root", "r", "d")
    + ","
    + _fill_sql("b", "a", "r, d", "l")
    + ","
    + _fill_sql("c", "b", "r, d, l", "s")
    + r""",
plan AS (
  SELECT d, l, s, CASE WHEN tokens > 0 THEN CAST(floor(floor(budget + 1e-6) / tokens) AS BIGINT) ELSE 1 END AS epoch, CAST(floor(budget + 1e-6) AS BIGINT) AS budget, CAST(tokens AS BIGINT) AS leaf_tokens
  FROM leaf JOIN c USING (r, d, l, s)),
k AS (SELECT t.*, epoch, budget - epoch * leaf_tokens AS rest, md5('mix:' || epoch || ':' || doc_id) AS key FROM t JOIN plan USING (d, l, s)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY key) AS upto FROM k)
SELECT doc_id, d AS domain, lang, source, epoch + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM u
"""
)
