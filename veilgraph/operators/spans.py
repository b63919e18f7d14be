"""Pattern matches with offsets, and the rails that nominate identifying spans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rx import java
from ..functions.text import base_name, held

PAGE = 64


def located(text: Column, rule: Column) -> Column:
    """array<struct<start, end, span>> of the leftmost non-overlapping matches, in code points; none is [].

    rule: a Java pattern, which may differ by row.

    Pieces between matches and matches take turns, so a running end gives the offsets, in one fold. Found spans
    gather in pages of PAGE, which keeps the copying of growing arrays down in texts with very many. Patterns
    must not match an empty string.
    """
    kind = "array<struct<start:int,end:int,span:string>>"
    hits = F.regexp_extract_all(text, rule, 0)
    pairs = F.zip_with(F.split(text, rule, -1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("span")))
        full = F.size(a["page"]) >= PAGE
        grown = F.struct(end.alias("at"), F.when(full, one).otherwise(F.concat(a["page"], one)).alias("page"), F.when(full, F.concat(a["pages"], F.array(a["page"]))).otherwise(a["pages"]).alias("pages"))
        # The piece after the last match has none beside it.
        return F.when(x["hit"].isNull(), a).otherwise(grown)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("page"), F.array().cast(f"array<{kind}>").alias("pages"))
    found = F.aggregate(pairs, start, step, lambda a: F.flatten(F.concat(a["pages"], F.array(a["page"]))))
    return F.when(F.rlike(text, rule), found).otherwise(F.array().cast(kind))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """located, for one pattern of the rule tables."""
    return located(text, F.lit(java(pattern, flags)))


def find(docs: DataFrame, pattern: str, flags: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span of every match."""
    return docs.select(key, F.explode(matches(held(F.col(text)), pattern, flags)).alias("m")).select(key, "m.*")


def urls(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span of the URLs and domains that don't begin inside an email address, trailing punctuation off, distinct."""
    own = docs.select(key, matches(held(F.col(text)), rules.URL, "i").alias("u"), matches(held(F.col(text)), rules.EMAIL).alias("e"))
    inside = lambda u: F.exists("e", lambda e: (u["start"] >= e["start"]) & (u["start"] < e["end"]))
    return own.select(key, F.explode(F.filter("u", lambda u: ~inside(u))).alias("m")).select(key, F.regexp_replace("m.span", r"[.,;:]+\z", "").alias("span")).distinct()


def rail_spans(docs: DataFrame, rails: tuple = rules.RAILS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, pos, rail, cls, span: every match of every rule of a table, trimmed; one pass over each text."""
    found = [
        F.transform(F.regexp_extract_all(F.col("t"), F.lit(java(pattern, flags)), group), _named(i, rail, cls))
        for i, (rail, cls, pattern, flags, group) in enumerate(rails)
    ]
    return docs.select(key, held(F.col(text)).alias("t")).select(key, F.explode(F.concat(*found)).alias("m")).select(key, "m.*")


def _named(order: int, rail: str, cls: str):  # noqa: ANN202
    def name(hit: Column, i: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), i.alias("pos"), F.lit(rail).alias("rail"), F.lit(cls).alias("cls"), F.btrim(hit).alias("span"))

    return name


def battery(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span, cls, src of the structural rails: the first rail that finds a base name, ignoring case, keeps it."""
    found = rail_spans(docs, key=key, text=text)
    more = found.where("rail = 'header-meta'").select("*", F.regexp_extract("span", r"(?i)^EX(?:HIBIT)?[-\s]?([0-9]{1,3}\.[0-9]{1,2})\z", 1).alias("bare")).where("bare != ''")
    more = more.select(key, "ord", "pos", "rail", "cls", F.explode(F.array("bare", F.concat("bare", F.lit("*")))).alias("span"))
    link = urls(docs, key, text).select(key, F.lit(-1).alias("ord"), F.lit(0).alias("pos"), F.lit("url").alias("rail"), F.lit("ID").alias("cls"), "span")
    every = reduce(DataFrame.unionByName, [found, more, link]).withColumn("base", base_name(F.col("span"))).where("base != ''")
    first = every.groupBy(key, F.lower("base").alias("low")).agg(F.min(F.struct("ord", "pos", "base", "cls", "rail")).alias("f"))
    return first.select(key, F.col("f.base").alias("span"), F.col("f.cls").alias("cls"), F.concat(F.lit("rail:"), F.col("f.rail")).alias("src"))


def captured(docs: DataFrame, pattern: str, groups: tuple[int, ...] = (1,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span of these groups of every match, trimmed, distinct: defined terms, marks, quoted organisations."""
    arrays = [F.regexp_extract_all(held(F.col(text)), F.lit(java(pattern)), g) for g in groups]
    return docs.select(key, F.explode(F.concat(*arrays)).alias("span")).select(key, F.btrim("span").alias("span")).where("span != ''").distinct()


def xbrl_members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span of member names whose prefix is no standard one."""
    hits = F.regexp_extract_all(held(F.col(text)), F.lit(java(rules.XBRL)), 0)
    custom = F.filter(hits, lambda h: ~F.lower(F.substring_index(h, ":", 1)).isin(list(rules.XBRL_STANDARD)))
    return docs.select(key, F.explode(custom).alias("span")).distinct()


def suspicion(docs: DataFrame, features: tuple = (), threshold: int = 2, most: int = 60, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span, score, rank: surviving tokens of masked text by weighted shape features, best first.

    features: (name, weight, token pattern, pattern of the 24 characters before or None). The best score of a
    base name, ignoring case, counts; ties go by place in the text. `most` a document is the operator's own list length.
    Only tokens that some feature fits leave their text, each with its own 24 characters and not with the text.
    """

    def fits(c: Column, patterns: list[str]) -> Column:
        """Whether one of the patterns does, as one alternation where none of them refers back to a group."""
        own = [java(p) for p in dict.fromkeys(patterns)]
        if any(re.search(r"\\(?:[1-9]|k)", p) for p in own):
            return reduce(lambda a, b: a | b, [c.rlike(p) for p in own])
        return c.rlike("|".join(f"(?:{p})" for p in own)) if own else F.lit(False)

    alone = [shape for _, _, shape, ahead in features if not ahead]
    after = [(shape, ahead) for _, _, shape, ahead in features if ahead]

    def listed(t: Column) -> Column:
        token = r"[A-Za-z0-9][A-Za-z0-9.'’_/-]*"
        return F.struct(F.split(t, token, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(token), 0).alias("toks"))

    def paired(s: Column) -> Column:
        return F.struct(s["gaps"].alias("gaps"), s["toks"].alias("toks"), F.zip_with(s["gaps"], s["toks"], lambda gap, tok: F.concat(gap, tok)).alias("pairs"))

    def suspects(s: Column) -> Column:
        def before(at: Column) -> Column:
            # A token and the piece before it are two characters at least, but for an empty piece that begins the text.
            last = F.slice(s["pairs"], F.greatest(F.lit(1), at - 11), F.least(at, F.lit(12)))
            return F.right(F.concat(F.array_join(last, ""), F.get(s["gaps"], at)), F.lit(24))

        def may(at: Column) -> Column:
            tok = F.get(s["toks"], at)
            return fits(tok, alone) | (fits(tok, [x for x, _ in after]) & fits(before(at), [x for _, x in after]))

        every = F.when(F.size(s["toks"]) > 0, F.sequence(F.lit(0), F.size(s["toks"]) - 1))
        # Without a feature the score is 0, so below a threshold above it no other token counts.
        kept = F.filter(every, may) if threshold > 0 else every
        return F.transform(kept, lambda at: F.struct(at.alias("start"), F.get(s["toks"], at).alias("tok"), before(at).alias("before")))

    # A lambda's argument is worked out once, however often it is used; start is a token's place among the text's tokens.
    found = F.flatten(F.transform(F.transform(F.transform(F.array(held(F.col(text))), listed), paired), suspects))
    found = docs.select(key, F.explode(found).alias("m")).select(key, "m.*").where(F.length("tok") >= 3)
    score = F.lit(0)
    for _, weight, shape, ahead in features:
        hit = F.col("tok").rlike(java(shape))
        score = score + F.when(hit & F.col("before").rlike(java(ahead)) if ahead else hit, weight).otherwise(0)
    best = found.withColumn("score", score).where(F.col("score") >= threshold).withColumn("base", base_name(F.col("tok"))).where("base != ''")
    best = best.groupBy(key, F.lower("base").alias("low")).agg(F.max_by(F.struct("base", "start"), F.struct("score", -F.col("start"))).alias("b"), F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.expr(f"row_number() over (partition by {key} order by score desc, b.start)"))
    return ranked.where(F.col("rank") <= most).select(key, F.col("b.base").alias("span"), "score", "rank")


#: The shapes that make a surviving token suspicious. Fixed values.
SUSPICIOUS = (
    ("corp-suffix", 2, r"(?i)^(?:corp|inc|llc|llp|ltd|plc|gmbh|pte|bhd|sdn|co)\.?$", None),
    ("name-particle", 1, r"^(?:Mc|O')|(?:berg|stein|owitz|escu|opoulos|ssen)$", None),
    ("digit-hybrid", 2, r"^[A-Za-z]{2,10}-[0-9]{2,6}$|^[A-Z]{2}[0-9]{4,8}(?:-[0-9]{1,4})*$", None),
    ("file-ish", 2, r"(?i)^[a-z0-9_-]{4,40}\.(?:htm|html|pdf|docx?|xlsx?)$", None),
    ("honorific-adjacent", 2, r"^[A-Z]", r"(?:Mr|Ms|Mrs|Dr|Prof|Sir|Dame|Mdm)\.?\s*$"),
    ("title-of-adjacent", 1, r"^[A-Z]", r"(?i)(?:CEO|CFO|CTO|COO|President|Chairman|Director|founder)\s+of\s*$"),
    ("mask-adjacent-cap", 1, r"^[A-Z]", r"\[(?:Person|Company|Brand|Address|Email|Phone|Id)\d+\]\s*$"),
    ("camel-residue", 1, r"^[a-z]+[A-Z][A-Za-z]+$", None),
)
