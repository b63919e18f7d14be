"""The citation graph: citations and their runs, signals, authorities, edges, blended rankings and metrics."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.rx import java
from ..functions.text import held
from .spans import matches

REPORTED = rf"\b(\d{{1,4}})\s+({'|'.join(p for p, _ in rules.REPORTERS)})\s+(\d{{1,5}})\b"
NEUTRAL = rf"\[(\d{{4}})\]\s+(?:(\d{{1,2}})\s+)?({'|'.join(p for p, _ in rules.SERIES)})\s+(\d{{1,5}})\b"
SIGNAL_WINDOW, REACH = 100, 250


def _canonical(raw: Column, table: tuple) -> Column:
    name = raw
    for pattern, canon in reversed(table):
        name = F.when(raw.rlike("^(?:" + java(pattern) + r")\z"), canon).otherwise(name)
    return name


def citations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, cite of every citation in both forms; of overlapping ones the earlier counts."""
    t = held(F.col(text))
    own = docs.select(key, t.alias("_t"))
    us = own.select(key, F.explode(matches(F.col("_t"), REPORTED)).alias("m")).select(key, "m.*")
    part = lambda g, p: F.regexp_extract("span", java(p), g)
    us = us.withColumn("cite", F.concat_ws(" ", part(1, REPORTED), _canonical(part(2, REPORTED), rules.REPORTERS), part(3, REPORTED)))
    cw = own.select(key, F.explode(matches(F.col("_t"), NEUTRAL)).alias("m")).select(key, "m.*")
    volume = F.when(part(2, NEUTRAL) != "", F.concat(part(2, NEUTRAL), F.lit(" "))).otherwise("")
    cw = cw.withColumn("cite", F.concat(F.lit("["), part(1, NEUTRAL), F.lit("] "), volume, _canonical(part(3, NEUTRAL), rules.SERIES), F.lit(" "), part(4, NEUTRAL)))
    # A form never overlaps itself, so a citation can only be cut off by one of the other form before it.
    reach = F.max("end").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return us.union(cw).withColumn("_reach", reach).where("_reach is null or start >= _reach").select(key, "start", "end", "cite")


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, run, start, end, cites, cert: citations apart only by commas and pages are one run, in order.

    cert: the 45 characters before say that a higher court declined or took the case.
    """
    cites = citations(docs, key, text).join(docs.select(key, held(F.col(text)).alias("_t")), key)
    order = Window.partitionBy(key).orderBy("start")
    before = F.lag("end").over(order)
    gap = F.substring(F.col("_t"), F.col("_end") + 1, F.col("start") - F.col("_end"))
    told = cites.withColumn("_end", before).withColumn("_new", F.when(F.col("_end").isNotNull() & gap.rlike(java(rules.PARALLEL_GAP)), 0).otherwise(1))
    told = told.withColumn("run", F.sum("_new").over(order))
    ahead = F.substring(F.col("_t"), F.greatest(F.lit(0), F.col("start") - 45) + 1, F.least(F.lit(45), F.col("start")))
    told = told.withColumn("_cert", ahead.rlike(java(rules.CERT, "i")))
    return told.groupBy(key, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("start", "cite"))), lambda c: c["cite"]).alias("cites"), F.min_by("_cert", "start").alias("cert")
    )


def signals(docs: DataFrame, runs_: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, run, cls, token: how a run is introduced. A treatment makes it the treating case of the run before."""
    order = Window.partitionBy(key).orderBy("run")
    own = runs_.withColumn("_last", F.lag("end").over(order)).join(docs.select(key, held(F.col(text)).alias("_t")), key)
    begin = F.greatest(F.coalesce("_last", F.lit(0)), F.col("start") - REACH)
    own = own.withColumn("_w", F.substring(F.col("_t"), begin + 1, F.col("start") - begin))
    own = own.withColumn("_s", F.get(F.reverse(matches(F.col("_w"), rules.SIGNAL, "i")), F.lit(0)))
    own = own.withColumn("_x", F.get(F.reverse(matches(F.col("_w"), rules.TREATMENT, "i")), F.lit(0)))
    near = lambda m: F.length("_w") - F.col(m)["end"] <= SIGNAL_WINDOW
    treated = F.col("_x").isNotNull() & F.col("_last").isNotNull() & near("_x")
    said = F.regexp_replace(F.lower("_s.span"), r"\s+", " ")
    treatment = F.lower(F.regexp_extract("_x.span", java(rules.TREATMENT, "i"), 1))
    cls = F.when(said.startswith("but") | (said == "contra"), "contrary").when(said.isin("cf.", "compare"), "neutral").otherwise("support")
    told = own.select(key, "run", F.when(treated, "treating").when(F.col("_s").isNotNull() & near("_s"), cls).alias("cls"), F.when(treated, treatment).otherwise(said).alias("token"))
    return told.where("cls is not null")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of (src, dst): root is the least node reachable.

    Labels take the least of their neighbours' and then their label's own label, so a chain halves each round.
    Every round is cut by a checkpoint in the cluster's folder, or in the warehouse where the session names none.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_veilgraph")
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).where("x is not null and y is not null")
    both = both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("root")).checkpoint()
    while True:  # a round that moves nothing is the last; labels only fall
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, "x").select("x", "root", F.least("root", "near").alias("next"))
        jump = step.alias("s").join(labels.select(F.col("x").alias("_x"), F.col("root").alias("_r")), F.col("s.next") == F.col("_x"), "left")
        moved = jump.select("s.x", F.col("s.root").alias("was"), F.least("s.next", "_r").alias("root")).checkpoint()
        labels = moved.select("x", "root")
        if moved.where("was != root").isEmpty():
            return labels.withColumnRenamed("x", "node")


def authorities(runs_: DataFrame) -> DataFrame:
    """cite, root, display: parallel citations, here or in any document, are one authority.

    root is its least citation; it is shown by its least U.S., else F.3d, else F.2d citation, else by root.
    """
    pairs = runs_.select(F.col("cites")[0].alias("src"), F.explode("cites").alias("dst"))
    roots = components(pairs).withColumnRenamed("node", "cite")
    order = F.when(F.col("cite").contains(" U.S. "), 0).when(F.col("cite").contains(" F.3d "), 1).when(F.col("cite").contains(" F.2d "), 2).otherwise(3)
    shown = roots.groupBy("root").agg(F.min(F.struct(order.alias("o"), "cite")).alias("d")).select("root", F.col("d.cite").alias("display"))
    return roots.join(shown, "root").select("cite", "root", "display")


def doc_authorities(runs_: DataFrame, roots: DataFrame, own: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, root, n: how many runs of a document cite an authority, its own citation (own: key, root) left out."""
    each = runs_.select(key, "run", F.explode("cites").alias("cite")).join(roots, "cite").select(key, "run", "root").distinct().groupBy(key, "root").agg(F.count("*").alias("n"))
    return each.join(own.select(key, "root"), [key, "root"], "left_anti") if own is not None else each


def authority_edges(cited: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """a, b, w: the sum of ln(N / df) over the authorities that both cite, rounded to two places."""
    df = cited.groupBy("root").agg((F.log(F.lit(float(n_docs)) / F.count("*"))).alias("idf"))
    held_ = cited.join(df, "root")
    left, right = held_.select(F.col(key).alias("a"), "root", "idf"), held_.select(F.col(key).alias("b"), "root")
    return left.join(right, "root").where("a < b").groupBy("a", "b").agg(F.sum("idf").alias("raw"), F.count("*").alias("n_shared")).select("a", "b", F.round("raw", 2).alias("w"), "n_shared", "raw")


def text_edges(cos: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """a, b, w of unordered pairs (cos: a < b, cos) in which one is among the other's k best of least or more."""
    both = cos.union(cos.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    best = both.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= k) & (F.col("cos") >= least))
    return best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("cos"), 3).alias("w"))


def synergy(pairs: DataFrame, nodes: DataFrame, mode: str = "lift", top: int = 12, weights: tuple[float, float, float] = (3.0, 2.0, 1.0)) -> DataFrame:
    """holder, cand, score, rank: candidates by a blend of citation, text and authority.

    pairs: a < b, t (cosine), r (authority weight), c (citations between them); nodes: id. mode lift divides by
    the candidate's mean over all N - 1 others plus the global mean, sub takes the mean off, max leaves as is.
    Components are scaled by their largest value; scores are rounded to three places before they are ranked,
    ties to the lesser candidate. Fewer than two nodes give no rows.
    """
    n = nodes.agg(F.count("*").alias("n"))
    both = pairs.select(F.col("a").alias("holder"), F.col("b").alias("cand"), "t", "r", "c").union(pairs.select(F.col("b").alias("holder"), F.col("a").alias("cand"), "t", "r", "c"))
    means = both.groupBy("cand").agg(F.sum("t").alias("mt"), F.sum("r").alias("mr")).crossJoin(F.broadcast(n)).select("cand", (F.col("mt") / (F.col("n") - 1)).alias("mt"), (F.col("mr") / (F.col("n") - 1)).alias("mr"), "n")
    whole = means.agg((F.sum("mt") / F.max("n")).alias("gt"), (F.sum("mr") / F.max("n")).alias("gr"))
    held_ = both.join(means.drop("n"), "cand").crossJoin(F.broadcast(whole))
    ways = {"lift": lambda x, m, g: F.when(m + g > 0, x / (m + g)).otherwise(0.0), "sub": lambda x, m, g: F.greatest(F.lit(0.0), x - m), "max": lambda x, m, g: x}
    adjust = ways[mode]
    held_ = held_.withColumn("at", adjust(F.col("t"), F.col("mt"), F.col("gt"))).withColumn("ar", adjust(F.col("r"), F.col("mr"), F.col("gr")))
    most = held_.agg(F.max("at").alias("xt"), F.max("ar").alias("xr"), F.max("c").alias("xc"))
    share = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    score = F.round(weights[0] * share("c", "xc") + weights[1] * share("at", "xt") + weights[2] * share("ar", "xr"), 3)
    scored = held_.crossJoin(F.broadcast(most)).withColumn("score", score).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("holder").orderBy(F.desc("score"), "cand"))).where(F.col("rank") <= top).select("holder", "cand", "score", "rank")


def for_seeds(lists: DataFrame, seeds: DataFrame, top: int = 12) -> DataFrame:
    """cand, score, via, rank: the best score of a candidate over the seeds' own lists, seeds left out."""
    own = lists.join(F.broadcast(seeds.select(F.col("id").alias("holder"))), "holder").join(F.broadcast(seeds.select(F.col("id").alias("cand"))), "cand", "left_anti")
    best = own.groupBy("cand").agg(F.min(F.struct((-F.col("score")).alias("s"), "holder")).alias("b")).select("cand", (-F.col("b.s")).alias("score"), F.col("b.holder").alias("via"))
    return best.orderBy(F.desc("score"), "cand").limit(top)


def missing_authorities(cited: DataFrame, lists: DataFrame, n_docs: int, key: str = "doc_id", least: int = 2, top: int = 5) -> DataFrame:
    """key, root, n, rank: authorities that two or more of a document's candidates cite and it doesn't."""
    idf = cited.groupBy("root").agg(F.log(F.lit(float(n_docs)) / F.count("*")).alias("idf"))
    near = lists.select(F.col("holder").alias(key), "cand").join(cited.select(F.col(key).alias("cand"), "root"), "cand").groupBy(key, "root").agg(F.count("*").alias("n"))
    lacking = near.where(F.col("n") >= least).join(cited.select(key, "root"), [key, "root"], "left_anti").join(idf, "root")
    return lacking.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.col("n") * F.col("idf")), "root"))).where(F.col("rank") <= top).select(key, "root", "n", "rank")


def strengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, strength, degree of every node; weights count by their share of the largest of their type."""
    most = edges.groupBy("type").agg(F.max("w").alias("most"))
    scaled = edges.join(F.broadcast(most), "type").select(F.explode(F.array("a", "b")).alias("id"), (F.col("w") / F.col("most")).alias("s"))
    sums = scaled.groupBy("id").agg(F.sum("s").alias("strength"), F.count("*").alias("degree"))
    return nodes.select("id").join(sums, "id", "left").fillna(0, ["strength", "degree"])


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row, gini: inequality of a column, 0 for none or all zero. Values are counted before they are ordered."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("hi", F.sum("c").over(order)).withColumn("lo", F.col("hi") - F.col("c"))
    # The places lo + 1 to hi hold one value, and their sum is closed.
    places = (F.col("hi") * (F.col("hi") + 1) - F.col("lo") * (F.col("lo") + 1)) / 2
    sums = upto.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.col("v") * places).alias("p"))
    return sums.select(F.when(F.col("s") > 0, (2 * F.col("p") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(0.0).alias("gini"))
