"""Text scalars as column expressions; null texts count as empty unless a function says otherwise."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rx import java

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def held(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def replace_all(text: Column, pattern: str, mark: str, flags: str = "") -> Column:
    return F.regexp_replace(text, java(pattern, flags), mark)


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(java(pattern, flags)), 0))


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII to ASCII, one for one."""
    return F.translate(held(text), _WIDE, _NARROW)


def floor_mask(text: Column) -> Column:
    """Structured identifiers to marks, each rule over what the last one left.

    Rules are left out for texts without what all their matches hold; no mark holds it, so the given text tells.
    """
    whole = text = held(text)
    for needs, rows in groupby(zip(rules.FLOOR, rules.FLOOR_NEEDS, strict=True), itemgetter(1)):
        masked = text
        for (pattern, flags, mark), _ in rows:
            masked = replace_all(masked, pattern, mark, flags)
        text = F.when(whole.rlike(needs), masked).otherwise(text)
    return text


def base_name(span: Column) -> Column:
    """A span without marks and edge punctuation, its white space collapsed."""
    bare = F.regexp_replace(held(span), "[®™]", "")
    bare = replace_all(bare, r"""^[\s("'[]+|[\s)"',.;:\]]+$""", "")
    return F.btrim(replace_all(bare, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Pieces between runs of white space, empty ones at the ends included."""
    return F.size(F.split(held(text), java(r"\s+"), -1))


def garble_ratio(text: Column) -> Column:
    """Share of replacement, private-use and control characters; 0 for an empty text."""
    bad = F.regexp_replace(held(text), "[^\\uFFFD\\uE000-\\uF8FF\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.when(F.length(held(text)) > 0, F.length(bad) / F.length(held(text))).otherwise(0.0)


def strip_html(html: Column) -> Column:
    """Markup to text: scripts go, blocks end lines, entities and white space are folded."""
    text = replace_all(held(html), r"<script[\s\S]*?</script>|<style[\s\S]*?</style>", " ", "i")
    text = replace_all(text, r"<(?:br|/p|/div|/h\d|/li|/tr)[^>]*>", "\n", "i")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"&#\d+;", " "), r"[ \t]+", " ")
    return replace_all(replace_all(text, r"\n\s+", "\n"), r"^\s+|\s+$", "")


def density(text: Column) -> Column:
    """Weighted count of identifying surfaces a thousand words, to one decimal."""
    total = F.lit(0)
    for pattern, weight in rules.DENSITY:
        total = total + weight * count(held(text), pattern)
    return F.round(total / (word_count(text) / 1000.0), 1)


def admissible(span: Column) -> Column:
    """Whether a span may be masked document-wide: 3 characters, 5 for digits, no closed-class word."""
    bare = F.btrim(held(span))
    short_number = bare.rlike(r"^[0-9]+\z") & (F.length(bare) < 5)
    return (F.length(bare) >= 3) & ~short_number & ~(~bare.rlike(java(r"\s")) & F.lower(bare).isin(rules.FOOTPRINT_STOP))


def mask_artifact(span: Column) -> Column:
    return span.rlike(java(rules.MASK_TAG, "i")) | span.rlike(java(rules.BARE_TAG, "i"))


def collapse_tags(text: Column) -> Column:
    """Repeats of one tag with only blanks between become one."""
    return F.regexp_replace(text, r"(\[[A-Za-z]+-?\d+\])(?:[ \t]+\1(?![A-Za-z0-9_]))+", "$1")


def footprint(span: Column) -> Column:
    """The pattern of a span: white space tolerant, guarded at ends that are letters or digits.

    After the dot of an honorific the white space may be missing.
    """
    quoted = F.transform(F.split(span, java(r"\s+")), lambda t: F.concat(F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.when(t.rlike(r"(?i)^(?:Mr|Ms|Mrs|Dr|Prof|Mdm|Messrs)\.\z"), java(r"\s*")).otherwise(java(r"\s+"))))
    body = F.regexp_replace(F.array_join(quoted, "\u0001"), "\u0001", "")
    for tail in (java(r"\s*"), java(r"\s+")):  # the last token has no white space after it
        body = F.when(body.endswith(tail), F.left(body, F.length(body) - len(tail))).otherwise(body)
    edge = r"[\p{L}\p{N}]"
    return F.concat(F.lit("(?iu)"), F.when(span.rlike("^" + edge), f"(?<!{edge})").otherwise(""), body, F.when(span.rlike(edge + r"\z"), f"(?!{edge})").otherwise(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid_ein(c: Column) -> Column:
    """Whether the first two digits are a prefix that is assigned."""
    return digits(c).rlike("^[0-9]{2}") & ~F.left(digits(c), F.lit(2)).isin(list(rules.EIN_NEVER))


def valid_nhs(c: Column) -> Column:
    """Ten digits, the last a modulus-11 check of the others weighted 10 down to 2."""
    d = F.split(digits(c), "")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda a, i: a + F.get(d, i).cast("int") * (10 - i))
    check = F.pmod(11 - total % 11, F.lit(11))
    return F.when(F.length(digits(c)) != 10, False).otherwise((check != 10) & (check == F.get(d, F.lit(9)).cast("int")))


def valid_nino(c: Column) -> Column:
    """Whether the two-letter prefix can be issued."""
    prefix = F.upper(F.left(replace_all(held(c), r"\s", ""), F.lit(2)))
    return ~prefix.rlike("[DFIQUV]") & (F.substring(prefix, 2, 1) != "O") & ~prefix.isin(list(rules.NINO_NEVER))
