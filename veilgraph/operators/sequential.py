"""Operators that walk a text from front to back: chunks, sentences, capitalised runs, claims.

Each is a function of one document, run over Arrow batches; documents are independent, so nothing is shuffled
but what groups a document's own entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations whose dot ends no name, and no sentence. Fixed values.
NAME_ABBREVIATIONS = frozenset("inc ltd corp co llc llp jr sr st ave rd dr no mr mrs ms esq pte sdn bhd".split())
SENTENCE_ABBREVIATIONS = frozenset(
    "v vs no nos inc corp co ltd llc llp bros assn ass u.s u.s.c u.s.c.a s.ct l.ed f.2d f.3d f.supp fed cir ct app dist div supp stat ann "
    "cl ch art sec para pt id ibid cf eg ie etc al ex rel jr sr dr mr mrs ms st mt hon dept dep't gov natl intl jan feb mar apr jun jul "
    "aug sep sept oct nov dec r.civ.p fed.r.civ.p fed.r.evid n.y n.j d.c p.2d p.3d a.2d n.e n.w s.e s.w so.2d bankr civ crim proc evid "
    "univ comm admin".split()
)
CONNECTORS = frozenset("of and for the van der bin binte al de da".split())
NEVER_ALONE = frozenset(
    "The This That These Those There Any Each Every All No Not If In On At By To For Of And Or A An As It Its He She They We Upon Such "
    "Section Sections Paragraph Paragraphs Exhibit Exhibits Article Schedule Form Act Rules State President Managers Manager Member Members "
    "Party Parties Agreement Company Interest Interests Date Dollars Attention Facsimile Supplier Buyer".split()
)
NO_NAMES = frozenset(
    "sec irs fasb gaap xbrl ifrs edgar pcaob coso sox fda epa doj ftc gst cpf iras acra mom moh ica ura hdb usa us uk eu un who oecd nato "
    "asean ceo cfo cto coo cio evp svp avp vp gm hr pr ir esq esg ipo llc llp inc ltd corp co plc pte sdn bhd mba phd md jd ba bs bss ma ms "
    "msc bsc cpa cfa nyse amex otc otcbb sgx lse asx usd sgd eur gbp jpy cny rmb the and for not all any but new was are can may per via off "
    "out non due item part note none".split()
)


def _each(docs: DataFrame, key: str, text: str, rows: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *r) for k, t in zip(batch["_key"], batch["_text"], strict=True) for r in rows(t or "")]
            yield pd.DataFrame(out, columns=["_key", *names])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"_key {kind}, {columns}").withColumnRenamed("_key", key)


def cut_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Windows of about size characters, each beginning overlap before the last one's end, never ending inside a word.

    A window ends after its last line break if that is late enough, else at white space, else where it must.
    """
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text):
            line = text.rfind("\n", 0, stop + 1)
            if line > at + size - min(400, size / 2):
                stop = line + 1
            else:
                blank = next((i for i in range(stop, at + 1, -1) if text[i - 1].isspace() or text[i].isspace()), None)
                stop = blank or stop
        yield at, stop, text[at:stop]
        if stop >= len(text):
            return
        at = max(stop - overlap, at + 1)


def chunks(docs: DataFrame, size: int = 500, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, chunk of every text; an empty one has none."""
    return _each(docs, key, text, lambda t: cut_chunks(t, size, overlap), "start int, end int, chunk string")


_STOPS = regex.compile(r"""([.!?])["'’”)\]]*\s+(?=[A-Z“"'(\[§À-Ü])""")
_LAST = regex.compile(r"[A-Za-z.’']+$")


def cut_sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """Sentences with offsets. A dot after an abbreviation, an initial or a dotted form ends none."""
    begin = 0
    for m in _STOPS.finditer(text):
        if m[1] == ".":
            last = _LAST.search(text, begin, m.start())
            token = last[0] if last else ""
            bare = token.replace("’", "").replace("'", "").lower().lstrip(".")
            if bare in SENTENCE_ABBREVIATIONS or (len(token) == 1 and token.isalpha()) or regex.search(r"[A-Za-z]\.[A-Za-z]", token):
                continue
        said = text[begin : m.end()].strip()
        if said:
            yield begin, m.end(), said
        begin = m.end()
    if tail := text[begin:].strip():
        yield begin, len(text), tail


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _each(docs, key, text, cut_sentences, "start int, end int, sentence string")


_TOKEN = regex.compile(r"[\p{L}0-9][\p{L}0-9.&/'’-]*")
_CAPITAL, _CAMEL = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Lu}\p{Ll}+\p{Lu}")
_DIGIT_NAME = regex.compile(r"(?=.*[A-Za-z])(?!\d+(?i:st|nd|rd|th)$)(?!\d+-?(?i:[KQF])$)\d[\dA-Za-z.-]*$")


def _core(token: str) -> tuple[str, bool]:
    """A token without its sentence dot, and whether that dot ends a run."""
    bare = token[:-1]
    if not token.endswith(".") or len(bare) == 1 or token.count(".") >= 2 or bare.lower() in NAME_ABBREVIATIONS:
        return token, False
    return bare, True


def capital_runs(text: str) -> Counter:
    """Capitalised runs and how often each occurs, with names that begin with a digit.

    A run goes on over white space of 3 characters at most without an empty line, and over a small connector
    between capitals; stop words at its front are no part of it. One word alone counts if it is all capitals,
    has a capital inside, or is frequent.
    """
    tokens = [(m[0], *_core(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    frequent = Counter(t[1] for t in tokens)
    found = Counter(t[1] for t in tokens if _DIGIT_NAME.match(t[1]))

    def joined(i: int) -> bool:
        if i + 1 >= len(tokens) or tokens[i][2]:
            return False
        gap = text[tokens[i][4] : tokens[i + 1][3]]
        return len(gap) <= 3 and not gap.strip() and "\n\n" not in gap

    capital = [bool(_CAPITAL.match(t[1])) for t in tokens]
    i = 0
    while i < len(tokens):
        last = i
        while capital[i]:
            if joined(last) and capital[last + 1]:
                last += 1
            elif joined(last) and tokens[last + 1][1] in CONNECTORS and joined(last + 1) and capital[last + 2]:
                last += 2
            else:
                break
        if capital[i]:
            first = next((k for k in range(i, last) if tokens[k][1] not in NEVER_ALONE), last)
            if first < last:
                found[text[tokens[first][3] : tokens[last][3] + len(tokens[last][1])]] += 1
            else:
                w = tokens[last][1]
                shouted = w == w.upper() and w.lower() not in NO_NAMES
                if len(w) >= 3 and w not in NEVER_ALONE and (shouted or _CAMEL.match(w) or frequent[w] >= 3):
                    found[w] += 1
        i = last + 1
    return found


def nominate_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span, n: nominated capitalised runs of every text."""
    return _each(docs, key, text, lambda t: iter(capital_runs(t).items()), "span string, n int")


_HONORIFIC = regex.compile(r"(?:Mr|Ms|Mrs|Dr|Prof|Mdm|Messrs)\.", regex.I)


def claim(text: str, rows: list[tuple[str, str]]) -> Iterator[tuple[int, int, str]]:
    """start, end, tag of what each row (span, tag) masks, longest span first; none overlap.

    Where an earlier claim has part of a match, the rest of the match is claimed in pieces, white space off.
    """
    taken: list[tuple[int, int, str]] = []
    for span, tag in sorted(rows, key=lambda r: -len(r[0])):
        words = span.split()
        # After the dot of an honorific the white space may be missing.
        body = "".join(re.escape(w) + ("" if i + 1 == len(words) else r"\s*" if _HONORIFIC.fullmatch(w) else r"\s+") for i, w in enumerate(words))
        edge = r"[\p{L}\p{N}]"
        pattern = (f"(?<!{edge})" if regex.match(edge, span) else "") + body + (f"(?!{edge})" if regex.search(edge + "$", span) else "")
        fresh = []
        for m in regex.finditer(pattern, text, regex.I) if body else ():
            at = m.start()
            for s, e, _ in [*sorted(c for c in taken if c[0] < m.end() and c[1] > m.start()), (m.end(), m.end(), "")]:
                piece = text[at:s]
                if piece.strip():
                    lead = len(piece) - len(piece.lstrip())
                    fresh.append((at + lead, at + len(piece.rstrip()), tag))
                at = max(at, e)
        taken += fresh
    yield from sorted(taken)


def placements(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, tag: the offsets that a document's entity table masks in its original text."""
    entries = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "span", "tag"))).alias("_rows"))
    met = docs.join(entries, key).select(F.col(key).alias("_key"), F.col(text).alias("_text"), "_rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *c) for k, t, rows in zip(batch["_key"], batch["_text"], batch["_rows"], strict=True) for c in claim(t or "", [(r["span"], r["tag"]) for r in rows])]
            yield pd.DataFrame(out, columns=["_key", "start", "end", "tag"])

    return met.mapInPandas(run, f"_key {dict(docs.dtypes)[key]}, start int, end int, tag string").withColumnRenamed("_key", key)
