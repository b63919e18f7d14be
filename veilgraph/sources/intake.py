"""Intake: what a file is by its first bytes, how its text is decoded, and content that holds it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rx import java
from ..functions.text import garble_ratio, held

#: Rows of the topics table up to which it is broadcast.
BROADCAST_TOPICS = 1 << 16
TEXT_EXTENSIONS = ("txt", "text", "md", "csv", "log", "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a path, by Spark's own reader, so any store that it reads will do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly to all cores if its files give fewer tasks than there are; else as it is.

    A small table in one row group would be scanned by one core. Large tables are never shuffled for this.
    """
    tasks, cores = df._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < tasks < cores else df


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(held(name)), r"\.([a-z0-9]+)\z", 1)


def detect(content: Column, name: Column) -> Column:
    """struct<format, route>: docx, pdf and text have a reader, all else is refused; a null content is empty text."""
    head = F.hex(F.substring(F.coalesce(content, F.lit(b"")), 1, 8))
    ext = extension(name)
    zipped = head.rlike("^504B(0304|0506|0708)")
    opening = F.ltrim(F.decode(F.substring(F.coalesce(content, F.lit(b"")), 1, 16), "ISO-8859-1"))
    nul = F.hex(F.substring(F.coalesce(content, F.lit(b"")), 1, 1024)).rlike("^(?:..)*00")
    told = lambda fmt, route: F.struct(F.lit(fmt).alias("format") if isinstance(fmt, str) else fmt.alias("format"), F.lit(route).alias("route"))
    return (
        F.when(zipped & ext.isin("docx", ""), told("docx", "docx"))
        .when(zipped & ext.isin("xlsx", "pptx"), told(ext, "refuse"))
        .when(zipped, told("zip", "refuse"))
        .when(head.startswith("255044462D"), told("pdf", "pdf"))
        .when(head.startswith("D0CF11E0") & (ext == "msg"), told("msg", "refuse"))
        .when(head.startswith("D0CF11E0"), told("doc-legacy", "refuse"))
        .when(head.startswith("789F3E22"), told("tnef", "refuse"))
        .when(opening.startswith("{\\rtf"), told("rtf", "refuse"))
        .when(ext.isin("eml", "mbox", "mbx", "emlx", "mht", "mhtml"), told(ext, "refuse"))
        .when(~ext.isin(*TEXT_EXTENSIONS) & nul, told("binary", "refuse"))
        .otherwise(told(F.when(ext == "", "text").otherwise(ext), "text"))
    )


def decode_text(content: Column) -> Column:
    """struct<text, encoding, bom, eol> by the byte-order mark, else UTF-8."""
    head = F.hex(F.substring(content, 1, 3))
    utf8, le, be = head.startswith("EFBBBF"), head.startswith("FFFE"), head.startswith("FEFF")
    rest = lambda n: F.substring(content, n, 1 << 30)
    text = F.when(le, F.decode(rest(3), "UTF-16LE")).when(be, F.decode(rest(3), "UTF-16BE")).when(utf8, F.decode(rest(4), "UTF-8")).otherwise(F.decode(content, "UTF-8"))
    encoding = F.when(le, "utf-16le").when(be, "utf-16be").otherwise("utf-8")
    return F.struct(text.alias("text"), encoding.alias("encoding"), (utf8 | le | be).alias("bom"), F.when(text.contains("\r\n"), "crlf").otherwise("lf").alias("eol"))


def content_hold(text: Column) -> Column:
    """What in a text must be read by a person first, else null: the first of these reasons."""
    t = held(text)
    return (
        F.when(t.rlike(r"-----BEGIN [A-Z0-9 ]+-----"), "pem")
        .when(t.rlike(r"(?m)^(?:Received|Message-ID|MIME-Version|Return-Path|From|To|Subject|Date):[^\n]*\n(?:[ \t][^\n]*\n)*(?:Received|Message-ID|MIME-Version|Return-Path|From|To|Subject|Date):"), "mail-headers")
        .when(t.rlike(r"=\?[A-Za-z0-9_-]+\?[BbQq]\?[^?\s]+\?="), "encoded-word")
        .when(t.rlike(r"(?:=[0-9A-F]{2}){3}|=\r?\n[^\n]*=[0-9A-F]{2}"), "quoted-printable")
        .when(t.rlike(r"(?:%[0-9A-Fa-f]{2}){4}"), "percent-encoding")
        .when(t.rlike(r"(?m)^[A-Za-z0-9+/]{60,76}\n[A-Za-z0-9+/]{60,76}$"), "base64")
        .when(t.rlike(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){64,}(?![0-9A-Fa-f])"), "hex")
        .when(garble_ratio(t) > 0.05, "garbled")
    )


def csv_shape(text: Column) -> Column:
    """Columns of each row that isn't empty; a comma inside quotes doesn't part columns."""
    rows = F.filter(F.split(F.replace(held(text), F.lit("\r\n"), F.lit("\n")), "\n"), lambda r: r != "")
    return F.transform(rows, lambda r: 1 + F.size(F.regexp_extract_all(F.regexp_replace(r, '"[^"]*(?:"|\\z)', ""), F.lit(","), 0)))


def classify_topics(docs: DataFrame, topics: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, topic: the topic whose keywords are all there often enough, by the greatest sum of hits over least hits.

    topics: topic, keyword, least (1 or more); of a keyword that a topic has twice the larger least counts. A text is cut
    into words once and those that are keywords are counted; only keywords of several words, or with other characters,
    are searched one by one. Topics are broadcast up to BROADCAST_TOPICS rows, which are counted, else joined by word.
    """
    asked = topics.groupBy("topic", F.lower("keyword").alias("keyword")).agg(F.max("least").alias("least"))
    needed = asked.groupBy("topic").agg(F.count("*").alias("needed"))
    plain = F.col("keyword").rlike(r"^[a-z0-9_]+\z")
    sizes = asked.agg(F.count("*").alias("n"), F.count_if(~plain).alias("phrases")).first()
    near = F.broadcast if sizes["n"] <= BROADCAST_TOPICS else (lambda d: d)
    low = F.lower(held(F.col(text)))
    said = docs.select(key, F.explode(F.split(low, "[^a-z0-9_]+")).alias("keyword"))
    hits = said.join(near(asked.where(plain)), "keyword").groupBy(key, "topic", "keyword", "least").agg(F.count("*").alias("h"))
    if sizes["phrases"]:
        found = F.call_function("regexp_count", low, F.concat(F.lit(java(r"\b")), "keyword", F.lit(java(r"\b"))))
        hits = hits.unionByName(docs.select(key, text).join(near(asked.where(~plain))).select(key, "topic", "keyword", "least", found.alias("h")))
    scored = hits.where("h >= least").groupBy(key, "topic").agg(F.count("*").alias("met"), F.sum(F.col("h") / F.col("least")).alias("score"))
    scored = scored.join(near(needed), "topic").where("met = needed")
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "topic")).alias("b")).select(key, F.col("b.topic").alias("topic"))
