"""Quality rules: per-document base counts, then lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, WORD, ascii_lower, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line goes if more distinct documents of its host hold it than both of these allow.
MAX_DOCS, MAX_DOCS_PERCENT = 50, 1
#: A document is depleted if fewer words, or a smaller share, than these remain of it.
MIN_LEFT_WORDS, MIN_LEFT_PERCENT = 5, 20
#: Lines that go, over all documents that lose some, up to which these are broadcast; 8 bytes each.
BROADCAST_LINES = 1 << 18


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.btrim(ascii_lower(line), F.lit(BLANKS)), BLANK_RUN, " ")


def _covered(starts: Column) -> Column:
    """Words that the windows at these sorted starts cover together."""
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, row by row.

    A null text counts as empty. Only texts in which an 8-word window comes back pay for the cover of those
    windows. All of it stays inside the row, so nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    held = docs.select(
        *keep,
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    own = [*keep, "word_chars", "n_symbols"]
    n = F.size("hashes")
    held = held.select(
        *own,
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).alias("windows"),
    )
    own += ["n_words", "n_dup_lines"]
    back = F.size("windows") > F.size(F.array_distinct("windows"))
    held = held.select(*own, F.when(back, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]) | (F.get("sorted", i + 1)["h"] == x["h"])
    held = held.select(*own, F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])).alias("starts"))
    held = held.select(*own, F.coalesce(F.when(F.col("starts").isNotNull(), _covered(F.col("starts"))), F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return held.withColumn("base_failed", failed)


def _host(host: str) -> Column:
    return F.coalesce(F.col(host), F.lit(""))


def _lines(text: Column) -> Column:
    """The normalised lines of a text that have a word."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")


def _mark(lines: Column) -> Column:
    """A digest of all normalised lines in their order: what makes two documents the same text."""
    return F.unhex(F.md5(F.array_join(lines, "\n").cast("binary")))


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, mark, at (position), line (hash), n (words) of each line with a word of every row.

    mark is the same for exact copies, all of whose normalised lines are equal, and for no others.
    """
    held = docs.select(_host(host).alias("host"), _lines(F.col("text")).alias("lines"))
    held = held.select("host", _mark(F.col("lines")).alias("mark"), F.posexplode("lines").alias("at", "l"))
    return held.select("host", "mark", "at", F.xxhash64("l").alias("line"), F.size(F.split("l", " ")).alias("n"))


def frequent_lines(lines: DataFrame, docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_percent: float = MAX_DOCS_PERCENT) -> DataFrame:
    """host, line, n_docs of those of host_lines that are above the limits.

    n_docs counts distinct documents: exact copies of one another are one, or a group of copies would make
    boilerplate of its whole text; documents that differ in any line count each. Rows shrink to one a task,
    host, line and document before they are shuffled, and to one a task and line before they are counted, so
    that a line in a third of all documents isn't dealt to one task.
    """
    counts = lines.select("host", "line", "mark").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    per_host = docs.groupBy(_host(host).alias("host")).agg(F.count("*").alias("host_docs"))
    many = counts.where(F.col("n_docs") > max_docs)
    return many.join(per_host, "host").where(100 * F.col("n_docs") > max_percent * F.col("host_docs")).select("host", "line", "n_docs")


def lost_lines(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """host, mark, gone (hashes of its lines that go), n_words and n_lines in them, of each distinct document that loses some."""
    lines = written(host_lines(docs, host), "lines")
    # Copies bring the same lines at the same positions.
    gone = lines.join(frequent_lines(lines, docs, host, **limits), ["host", "line"]).select("host", "mark", "at", "line", "n").distinct()
    lost = gone.groupBy("host", "mark").agg(F.collect_set("line").alias("gone"), F.sum("n").cast("long").alias("n_frequent_words"), F.count("*").alias("n_frequent_lines"))
    return written(lost, "lost")


def _depleted() -> Column:
    left = F.col("n_words") - F.col("n_frequent_words")
    return (F.col("n_frequent_lines") > 0) & ((left < MIN_LEFT_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words")))


def judge_quality(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """doc_id, the base columns, n_frequent_words, n_frequent_lines, kept for every document.

    Lines of frequent_lines count as removed; a document with under 5 words or under a fifth of its words
    left is depleted and, like one whose base rules failed, not kept. Null texts have no words and fail; null
    hosts form one host. Each row is judged by its own text and host, whatever its doc_id, null or repeated.
    limits: max_docs and max_percent of frequent_lines.
    """
    keyed = docs.select("doc_id", "text", _host(host).alias("host"), _mark(_lines(F.col("text"))).alias("mark"))
    base = written(base_counts(keyed, "doc_id", "host", "mark"), "base")
    judged = base.join(lost_lines(docs, host, **limits).drop("gone"), ["host", "mark"], "left").fillna(0, ["n_frequent_words", "n_frequent_lines"])
    return judged.withColumn("kept", ~F.col("base_failed") & ~_depleted()).drop("host", "mark")


def apply_quality(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The rows that judge_quality keeps, in their own columns and whole texts without the frequent lines.

    Only documents that lose lines are rewritten, in n_chars too where the table has it. No text is shuffled
    while those that lose lines are under BROADCAST_LINES lines in all, which is counted; beyond that texts
    meet their lines in a join that can be split.
    """
    lost = lost_lines(docs, host, **limits)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", _host(host).alias("host"), _mark(_lines(F.col("text"))).alias("mark"))
    # A table, as a filter on the verdict would be moved into the higher-order functions that make it and repeat them.
    based = written(base_counts(keyed, "row", "host", "mark"), "based").where(~F.col("base_failed"))
    few = (lost.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES
    met = based.join(F.broadcast(lost) if few else lost, ["host", "mark"], "left").fillna(0, ["n_frequent_words", "n_frequent_lines"]).where(~_depleted())
    lines = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normal_line(x))))
    rewritten = met.withColumn("text", F.when(F.col("gone").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("row.text")))
    size = F.when(F.col("gone").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": F.col("text"), "n_chars": size}
    return rewritten.select(*((own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_quality over all documents, by source as the host."""
    return judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words"
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
nl AS (
  SELECT doc_id, host, list_transform(lines, lambda x: regexp_replace(trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS ls FROM d),
ln AS (SELECT doc_id, host, md5(array_to_string(ls, chr(10))) AS mark, unnest(ls) AS line FROM nl),
hosts AS (SELECT host, count(*) AS nh FROM d GROUP BY host),
freq AS (SELECT ln.host, line FROM ln JOIN hosts USING (host) GROUP BY ln.host, line, nh HAVING count(DISTINCT mark) > 50 AND 100 * count(DISTINCT mark) > nh),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM ln JOIN freq USING (host, line) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_words,
    lost.n IS NOT NULL AS lost_any
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_frequent_words AS rest FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (lost_any AND (rest < 5 OR 100 * rest < 20 * n_words)) AS kept, n_frequent_words
FROM f
"""
