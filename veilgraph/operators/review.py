"""Review of a table of spans: answers read back, spans held against their text, tallies, headers and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import java
from ..functions.text import base_name, footprint, held
from .legal import quoted
from .spans import located

#: Classes that an answer may name, and terms of a contract that identify nobody. Fixed values.
ANSWER = r"^\s*[-*]?\s*(PERSON|COMPANY|BRAND|ADDRESS|EMAIL|PHONE|ID)\s*[:\-]\s*(.+?)\s*$"
ROLE_TERMS = (
    "the company", "company", "company's", "the agreement", "agreement", "the parties", "party", "parties", "the holder", "holder", "the members",
    "member", "members", "president", "the president", "director", "directors", "director managers", "director manager", "executive manager",
    "executive managers", "chief executive officer", "chief financial officer", "indemnified party", "indemnifying party", "supplier", "buyer",
    "seller", "landlord", "tenant", "effective date", "business day", "business days", "confidential information", "operating agreement",
    "membership interest", "membership interests",
)
#: (shape, pattern, flags) of what was redacted, the first that fits; headers of a document. Fixed values.
CONTENT_SHAPES = (
    ("money", r"^[\s$€£]*(?:US\$|S\$|\$|€|£)?\s?[\d,]+(?:\.\d+)?\s?(?:million|billion|thousand)?[\s.]*$", "i"),
    ("percent", r"^[\s]*[\d.,]+\s?(?:%|percent)[\s.]*$", "i"),
    ("bare_number", r"^[\s]*[\d,.]+[\s.]*$", ""),
    ("date", r"^(?:.{0,20}(?:january|february|march|april|may|june|july|august|september|october|november|december).{0,20}|\d{1,2}\/\d{1,2}\/\d{2,4})$", "i"),
    ("duration", r"^\s*\(?\d*\)?\s?(?:calendar |business )?(?:days?|months?|years?|weeks?)\s*$", "i"),
    ("name_shaped", r"""^[\s"']*(?:[A-Z][\w.'’-]+\s?){1,4}[\s"']*$""", ""),
    ("id_code", r"^[\s]*[A-Z0-9][A-Z0-9-]{4,}[\s]*$", ""),
)
HEADERS = ("case", "matter", "doc", "court", "date", "citation")
LOOPBACK = ("127.0.0.1", "localhost", "[::1]", "::1", "0:0:0:0:0:0:0:1")
#: Characters that one term may be written with in place of another. Fixed values.
INVISIBLE, APOSTROPHES, DASHES = "­​‌‍⁠﻿", "‘’ʼ′＇", "‐‑‒–—―−﹣－"


def answers(raw: Column) -> Column:
    """array<struct<cls, span>> of the lines of an answer that name a class and a span, quotes around it off."""
    lines = F.filter(F.split(held(raw), "\n"), lambda x: x.rlike(java(ANSWER, "i")))
    part = lambda x, g: F.regexp_extract(x, java(ANSWER, "i"), g)
    bare = lambda x: F.btrim(F.regexp_replace(part(x, 2), "^[\"'`]|[\"'`]\\z", ""))
    return F.transform(lines, lambda x: F.struct(F.upper(part(x, 1)).alias("cls"), bare(x).alias("span")))


def verified(span: Column, text: Column) -> Column:
    """struct<kind, span>: a span as its text has it: verbatim, without edge punctuation, or with other white space; else failed."""
    trimmed = base_name(span)
    loose = F.array_join(F.transform(F.split(trimmed, java(r"\s+")), quoted), java(r"\s") + "+")
    found = F.get(located(held(text), F.when(trimmed != "", loose).otherwise(r"(?!)\z.")), F.lit(0))["span"]
    told = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("span"))
    return (
        F.when(F.contains(held(text), held(span)), told("verbatim", held(span)))
        .when((trimmed != "") & F.contains(held(text), trimmed), told("trimmed", trimmed))
        .when((trimmed != "") & found.isNotNull(), told("ws-normalized", found))
        .otherwise(told("failed", held(span)))
    )


def junk_suspect(span: Column) -> Column:
    """Whether a span is a role or term of a contract; it is flagged, never dropped."""
    low = F.regexp_replace(F.regexp_replace(F.lower(held(span)), java(r"\s+"), " "), r"[.'’s]+\z", "")
    return low.isin(*ROLE_TERMS) | F.concat(F.lit("the "), low).isin(*ROLE_TERMS)


def survives(exported: Column, span: Column) -> Column:
    """Whether a span stands whole in what is given out."""
    return F.rlike(held(exported), footprint(span)) & (F.length(held(span)) > 0)


def term_key(term: Column) -> Column:
    """What makes two terms one: no invisible characters, one kind of apostrophe and dash, single blanks, lower case.

    Letters stay composed as they are: no built-in function normalises them.
    """
    folded = F.translate(held(term), APOSTROPHES + DASHES + INVISIBLE, "'" * len(APOSTROPHES) + "-" * len(DASHES))
    return F.lower(F.btrim(F.regexp_replace(folded, java(r"\s+"), " ")))


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, total, decided, waiting, standing: pending rows wait, others are decided or stand as they were marked.

    rows: status, decided; a null counts as neither.
    """
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    decided = ~pending & F.coalesce(F.col("decided"), F.lit(False))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(decided).alias("decided"), F.count_if(pending).alias("waiting"), F.count_if(~pending & ~decided).alias("standing"))


def live_suspects(suspects: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The suspects (key, span) that no row of their document covers, ignoring case."""
    have = rows.select(F.col(key).alias("_k"), F.lower("span").alias("_low")).distinct()
    return suspects.join(have, (F.col(key) == F.col("_k")) & (F.lower("span") == F.col("_low")), "left_anti")


def search(table: DataFrame, query: str, name: str, key: str = "doc_id") -> DataFrame:
    """low, cls, n_docs: entities whose text, or one of whose documents' names, contains the query, ignoring case; all for a blank one.

    table: key, span, cls and the document's name.
    """
    q = F.lit(query.strip().lower())
    hit = F.contains(F.lower("span"), q) | F.coalesce(F.contains(F.lower(F.col(name)), q), F.lit(False))
    found = table.groupBy(F.lower("span").alias("low"), "cls").agg(F.countDistinct(key).alias("n_docs"), F.bool_or(hit).alias("_hit"))
    return found.where(F.col("_hit") | (q == "")).drop("_hit")


def paragraphs(text: Column) -> Column:
    """array<string>: the text cut at blank lines or, if there is none, at newlines; pieces trimmed, empty ones left out."""
    whole = F.regexp_replace(held(text), "\r\n?", "\n")
    cut = lambda p: F.filter(F.transform(F.split(whole, p), lambda x: F.btrim(x, F.lit(" \t\n"))), lambda x: x != "")
    blank = cut(java(r"\n\s*\n+"))
    return F.when(F.size(blank) > 1, blank).otherwise(cut("\n"))


def net_class(url: Column) -> Column:
    """struct<cls, place>: app, loopback or offmachine, by what is written; what can't be read is off the machine."""
    u = held(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(authority, r":[0-9]*\z", "")
    standard = F.regexp_replace(authority, r":\z", "")
    for name, port in (("http", "80"), ("https", "443")):
        standard = F.when((scheme == name) & standard.endswith(":" + port), host).otherwise(standard)
    told = lambda cls, place: F.struct(F.lit(cls).alias("cls"), place.alias("place"))
    return (
        F.when(scheme.isin("blob", "data", "about", "javascript"), told("app", F.lit("in-page")))
        .when(scheme.isin("tauri", "ipc", "asset"), told("app", F.concat(scheme, F.lit(":"))))
        .when(host == "", told("offmachine", F.concat(F.lit("unparseable: "), F.left(u, F.lit(40)))))
        .when(host.isin("ipc.localhost", "asset.localhost", "tauri.localhost"), told("app", host))
        .when(host.isin(*LOOPBACK) | host.endswith(".localhost"), told("loopback", standard))
        .otherwise(told("offmachine", standard))
    )


def headers(text: Column) -> Column:
    """struct of the headers of a document: the first line of each name, ignoring case; null if there is none."""
    line = lambda name: F.nullif(F.btrim(F.regexp_extract(held(text), rf"(?im)^{name}[ \t]*:[ \t]*([^\n]+)", 1)), F.lit(""))
    return F.struct(*(line(n).alias(n) for n in HEADERS))


def content_shape(content: Column) -> Column:
    """What a redacted passage looks like; a long passage by its length, else the first shape that fits."""
    c = F.btrim(F.regexp_replace(held(content), java(r"\s+"), " "))
    shape = F.when(F.length(c) > 300, "long_passage")
    for name, pattern, flags in CONTENT_SHAPES:
        shape = shape.when(c.rlike(java(pattern, flags)), name)
    return shape.when(c.rlike("[A-Z][a-z]") & (F.size(F.split(c, " ")) <= 6), "short_phrase").otherwise("other_text")


def synced(rows: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, low, span, tag, occ: the floor's rows after its hits: new ones come, gone ones go, the others take tag and count.

    rows: key, span, tag. hits: key, span, tag, one row a hit; of several forms the least counts.
    """
    want = hits.groupBy(key, F.lower(F.btrim("span")).alias("low")).agg(F.min("span").alias("_s"), F.min("tag").alias("tag"), F.count("*").alias("occ"))
    have = rows.groupBy(key, F.lower(F.btrim("span")).alias("low")).agg(F.min("span").alias("span"))
    return want.join(have, [key, "low"], "left").select(key, "low", F.coalesce("span", F.btrim("_s")).alias("span"), "tag", "occ")


def cites_edges(cited: DataFrame, own: DataFrame, key: str = "doc_id") -> DataFrame:
    """s, t, w: document s cites the own citation of another document t, w times.

    cited: key, cite, n. own: key, cite; of documents with one citation the least key holds it.
    """
    owner = own.where(F.col("cite").isNotNull()).groupBy("cite").agg(F.min(key).alias("t"))
    return cited.join(owner, "cite").where(F.col(key) != F.col("t")).groupBy(F.col(key).alias("s"), "t").agg(F.sum("n").alias("w"))
