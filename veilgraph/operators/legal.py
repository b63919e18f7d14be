"""Legal rails as regions over whole texts: rule packs with guards, and names that a document defines itself.

Everything about a document happens in its own row, so nothing here shuffles but the joins with an entity table, by
document. A region is struct<start, end, span>, offsets in code points. Null texts are empty and give no region.
Gazetteers (state to demonym) are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal as rules
from ..functions.rx import java
from ..functions.text import held
from .spans import located, matches

_REGIONS = "array<struct<start:int,end:int,span:string>>"
_TAGGED = "array<struct<start:int,end:int,span:string,tag:string,rail:string>>"
_EDGE, _SPACE = java(r"\b"), java(r"\s")
_META = r"([.*+?^${}()|\[\]\\])"


# --- patterns of a name -----------------------------------------------------------------------------------------


def quoted(c: Column) -> Column:
    return F.regexp_replace(c, _META, r"\\$1")


def token_rule(name: Column) -> Column:
    """The pattern of one name token: with a plural or possessive and, from four characters on, parted by hyphens at line ends."""
    letters = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), quoted)
    body = F.when(F.length(name) >= 4, F.array_join(letters, rf"(?:-{_SPACE}{{0,2}})?")).otherwise(quoted(name))
    return F.concat(F.lit(_EDGE), body, F.lit(rf"(?:e?s)?(?:[’']s?)?{_EDGE}"))


def phrase_rule(name: Column, possessive: bool = False) -> Column:
    """The pattern of a phrase, white space tolerant, between word edges."""
    body = F.array_join(F.transform(F.split(name, java(r"\s+")), quoted), _SPACE + "+")
    return F.concat(F.lit(_EDGE), body, F.lit((r"(?:[’']s?)?" if possessive else "") + _EDGE))


def subsequence(needle: Column, hay: Column) -> Column:
    """Whether the characters of needle come in hay in that order."""
    letters = F.filter(F.split(needle, ""), lambda c: c != "")
    return F.rlike(hay, F.concat(F.lit("(?s)"), F.array_join(F.transform(letters, quoted), ".*")))


def initials(words: Column) -> Column:
    return F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def propagated(text: Column, names: Column, rule: Callable[[Column], Column] = token_rule) -> Column:
    """The regions of every name of an array, wherever it stands in the text."""
    return F.flatten(F.transform(F.array_distinct(names), lambda n: located(text, rule(n))))


def _groups(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), group)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, java(r"\s+")), lambda w: w != "")


def _before(text: Column, at: Column, width: int) -> Column:
    return F.substring(text, F.greatest(F.lit(0), at - width) + 1, F.least(F.lit(width), at))


def _after(text: Column, at: Column, width: int) -> Column:
    return F.substring(text, at + 1, F.lit(width))


def _has(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(java(pattern, flags))


def _tagged(found: Column, tag: str, rail: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["span"].alias("span"), F.lit(tag).alias("tag"), F.lit(rail).alias("rail")))


def _exploded(docs: DataFrame, arrays: list[Column], key: str) -> DataFrame:
    every = F.flatten(F.array(*(a.cast(_TAGGED) for a in arrays)))
    return docs.select(key, F.explode(F.array_distinct(every)).alias("m")).select(key, "m.*")


# --- what a document says about itself --------------------------------------------------------------------------


def aliases(text: Column, gazetteer: Mapping[str, str] | None = None) -> Column:
    """array<string>: words that the document glosses as names of institutions, by a bracket after or before an English one.

    They have four characters or more, and a letter beyond ASCII or seven lower-case letters; places of the gazetteer
    and words of ordinary prose are none.
    """
    banned = sorted({w.lower() for pair in (gazetteer or {}).items() for w in pair} | set(rules.GLOSS_STOP))
    glossed = F.concat(*(_groups(text, p) for p in rules.GLOSS))
    bare = F.transform(F.flatten(F.transform(glossed, _words)), lambda w: F.regexp_replace(w, "[“”\"',.()]", ""))
    native = lambda w: w.rlike(r"[^\x00-\x7F]") | (w.rlike(r"^[a-z]{7,}\z") & ~w.isin(*rules.GLOSS_PROSE))
    good = lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*banned) & ~_has(w, f"^{rules.GLOSSED}$") & native(w)
    return F.array_distinct(F.filter(bare, good))


def protected_ranges(text: Column, names: Column | None = None) -> Column:
    """The ranges of public bodies and of the document's own institutional words, in which nothing is masked."""
    bodies = matches(text, rules.PUBLIC_BODY)
    return bodies if names is None else F.concat(bodies, propagated(text, names, phrase_rule))


def respondent(text: Column, gazetteer: Mapping[str, str]) -> Column:
    """struct<state, demonym> of the state that an application is against, else the first, longest first, of the opening; null if none."""
    caption = F.regexp_extract(text, java(rules.RESPONDENT), 1)
    hay = F.when(caption != "", caption).otherwise(F.left(text, F.lit(600)))
    known = sorted(gazetteer.items(), key=lambda pair: -len(pair[0]))
    if not known:
        return F.lit(None).cast("struct<state:string,demonym:string>")
    states = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(d).alias("demonym")) for s, d in known))
    return F.get(F.filter(states, lambda s: F.contains(hay, s["state"])), F.lit(0))


def sections(text: Column) -> Column:
    """array<struct<start, name>> of the section headings."""
    return F.transform(matches(text, rules.SECTION_HEAD), lambda m: F.struct(m["start"].alias("start"), F.upper(F.btrim(m["span"], F.lit(" \t\r\n"))).alias("name")))


def in_facts(marks: Column, at: Column) -> Column:
    """Whether the latest heading at or before an offset is that of the facts."""
    upto = F.filter(marks, lambda s: s["start"] <= at)
    return F.coalesce(_has(F.get(upto, F.size(upto) - 1)["name"], rules.FACTS), F.lit(False))


def letter_coded(text: Column) -> Column:
    """Whether a court has coded the names of the document itself: letters in its caption, and brackets or crosses."""
    return _has(F.left(text, F.lit(1500)), rules.LETTER_CAPTION) & (_has(text, rules.BRACKETED) | _has(text, rules.CROSSED))


# --- shapes -----------------------------------------------------------------------------------------------------


def _alternation(words) -> str:  # noqa: ANN001
    return "|".join(sorted(set(words), key=lambda w: (-len(w), w)))


def gazetteer_rules(gazetteer: Mapping[str, str]) -> tuple[rules.Rule, ...]:
    """The shapes of nationalities and of places in a state."""
    states, demonyms = _alternation(gazetteer), _alternation(gazetteer.values())
    kind = r"(?:national|citizen|origin|nationality|descent)s?"
    return (
        rules.Rule("L4", "[Dem]", rf"\b(?:{demonyms})\s+{kind}\b"),
        rules.Rule("L4", "[Dem]", rf"\bnationals?\s+of\s+(?:the\s+)?(?:{states})\b"),
        rules.Rule("L4b", "[Dem]", rf"\b(?:{states})\s+{kind}\b"),
        rules.Rule("L9", "[Place]", rf"\b{rules._PLACE},\s+(?:{states}|England|Scotland|Wales|Northern Ireland)\b"),
        rules.Rule("L5-demonym", "[Dem]", rf"\b(?:{demonyms})\b"),
        rules.Rule("L5-state", "[Dem]", rf"\b(?:{states})\b"),
    )


def _guard(pack: str, m: Column, text: Column, resp: Column, marks: Column, gazetteer: Mapping[str, str]) -> Column | None:
    """Whether a match counts; None where nothing has to be asked."""
    if pack == "app-number":
        front = _before(text, m["start"], 60)
        precedent = _has(front, rules.PRECEDENT_BEFORE) | _has(_after(text, m["end"], 6), rules.PRECEDENT_AFTER)
        return _has(front, rules.OWN_NUMBER, "i") | ~precedent
    if pack == "relational":
        return _has(_before(text, m["start"], 30), rules.RELATIONAL_ANCHOR, "i")
    if pack == "L9w":
        return ~m["span"].isin(*rules.NO_PLACE, *gazetteer)
    if pack.startswith("L5"):
        # The span is taken out of its surroundings where it first stands in them.
        around = F.concat(_before(text, m["start"], 40), m["span"], _after(text, m["end"], 40))
        first = F.call_function("instr", around, m["span"])
        rest = F.concat(F.substring(around, F.lit(1), first - 1), F.substring(around, first + F.length(m["span"]), F.lit(1 << 20)))
        ok = ~_has(rest, rules.INSTITUTION_NEAR, "i")
        if pack == "L5-demonym":
            return ok & ~F.coalesce(m["span"] == resp["demonym"], F.lit(False))
        return ok & ~F.coalesce(F.contains(resp["state"], m["span"]), F.lit(False)) if pack == "L5-state" else ok
    if pack == "foreign":
        own = F.coalesce((m["span"] == resp["state"]) | (m["span"] == resp["demonym"]), F.lit(False))
        return (F.length(m["span"]) >= 3) & in_facts(marks, m["start"]) & ~own & ~_has(_before(text, m["start"], 25), rules.TITLE_BEFORE)
    return None


def shapes(docs: DataFrame, packs: tuple[str, ...] | None = None, gazetteer: Mapping[str, str] | None = None, protect: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span, tag, rail of the packs' shapes (all of them if None), one row a region and pack.

    protect: no region may touch a public body or a word that the document glosses as one. The gazetteer's packs are
    left out without a gazetteer.
    """
    gazetteer = gazetteer or {}
    table = [r for r in (*rules.PACKS, *rules.GUARDED, *(gazetteer_rules(gazetteer) if gazetteer else ())) if packs is None or r.pack in packs]
    if not table:
        raise ValueError(f"no rule in the packs {packs}")
    # Facts about a whole document are columns, worked out once before the rules use them.
    own = docs.select(key, held(F.col(text)).alias("_t"))
    t = F.col("_t")
    own = own.withColumns({"_resp": respondent(t, gazetteer), "_marks": sections(t), "_keep": protected_ranges(t, aliases(t, gazetteer)) if protect else F.array().cast(_REGIONS)})

    def regions(r: rules.Rule) -> Column:
        found = matches(t, r.pattern, r.flags)
        if r.last:
            tail = lambda m: F.regexp_extract(m["span"], java(r.pattern, r.flags), 1)
            found = F.transform(found, lambda m: F.struct((m["end"] - F.length(tail(m))).alias("start"), m["end"].alias("end"), tail(m).alias("span")))
        if _guard(r.pack, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("span")), t, F.col("_resp"), F.col("_marks"), gazetteer) is not None:
            found = F.filter(found, lambda m: _guard(r.pack, m, t, F.col("_resp"), F.col("_marks"), gazetteer))
        if protect:
            found = F.filter(found, lambda m: ~F.exists("_keep", lambda p: (m["start"] < p["end"]) & (m["end"] > p["start"])))
        return _tagged(found, r.tag, r.pack)

    return _exploded(own, [regions(r) for r in table], key)


# --- names that a document defines ------------------------------------------------------------------------------


def nominated(text: Column, n: rules.Nominator) -> Column:
    names = _groups(text, n.pattern, 1, n.flags)
    return F.array_distinct(F.filter(names, lambda x: ~x.isin(*n.stop)) if n.stop else names)


def defined_aliases(text: Column) -> Column:
    """array<string>: short forms in brackets that derive from the name before them, by its words or its initials."""
    pairs = F.zip_with(_groups(text, rules.DEFINED_ALIAS, 1), _groups(text, rules.DEFINED_ALIAS, 2), lambda n, a: F.struct(n.alias("name"), F.btrim(F.regexp_replace(a, java(r"^the\s+", "i"), "")).alias("alias")))

    def derives(p: Column) -> Column:
        words = F.transform(_words(p["name"]), lambda w: F.regexp_replace(w, r"[.,]\z", ""))
        low = F.transform(words, F.lower)
        by_words = F.forall(_words(p["alias"]), lambda a: F.array_contains(low, F.lower(a)))
        return by_words | subsequence(F.upper(F.regexp_replace(p["alias"], java(r"\s+"), "")), initials(words))

    fits = lambda p: (F.length(p["alias"]) >= 2) & ~F.upper(p["alias"]).isin(*rules.INITIALS_STOP) & ~_has(p["alias"], rules.ALIAS_STOP, "i") & derives(p)
    return F.array_distinct(F.transform(F.filter(pairs, fits), lambda p: p["alias"]))


def quoted_initials(text: Column) -> Column:
    """array<string>: initials in quotes and a bracket whose letters come, in order, among those of a name in the 100 characters before."""
    found = F.transform(matches(text, rules.QUOTED_INITIALS), lambda m: F.struct(m["start"].alias("start"), F.regexp_extract(m["span"], java(rules.QUOTED_INITIALS), 1).alias("a")))
    named = lambda m: F.exists(_groups(_before(text, m["start"], 100), rules.NAME_RUN, 0), lambda r: subsequence(m["a"], initials(_words(r))))
    return F.array_distinct(F.transform(F.filter(found, lambda m: ~m["a"].isin(*rules.INITIALS_STOP) & named(m)), lambda m: m["a"]))


def _unended(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), r"[,.]+\z", "")


def title_sides(text: Column) -> Column:
    """array<string>: the two sides of the title line, if it is that of a case."""
    title = F.regexp_extract(F.left(text, F.lit(rules.TITLE_ZONE)), java(rules.TITLE_LINE), 1)
    split = java(r"\sv\.?\s")
    sides = F.transform(F.slice(F.split(title, split), 1, 2), _unended)
    return F.when(title.rlike(split), F.filter(sides, lambda s: (s != "") & ~_has(s, rules.PARTY_STOP, "i"))).otherwise(F.array().cast("array<string>"))


def line_parties(text: Column) -> Column:
    """array<string>: names on lines of their own after one that says Between or And, up to a line that is no name."""
    lines = F.transform(F.split(F.left(text, F.lit(rules.LINE_ZONE)), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))

    def step(a: Column, x: Column) -> Column:
        opens, blank = _has(x, "^(?:Between|And)$", "i"), _has(x, r"^(?:\(\d+\))?$")
        ends = _has(x, rules.CAPTION_ROLE, "i") | (F.length(x) < 3) | (F.length(x) > 70) | ~x.rlike("^[A-Z]")
        party = ~_has(x, rules.PARTY_STOP, "i") & ~_has(x, rules.CORPORATE) & _has(x, rules.LINE_PARTY)
        left = F.when(opens, rules.CAPTION_LINES).when((a["left"] > 0) & (blank | ~ends), a["left"] - 1).otherwise(0)
        takes = ~opens & (a["left"] > 0) & ~blank & ~ends & party
        return F.struct(left.cast("int").alias("left"), F.when(takes, F.concat(a["names"], F.array(x))).otherwise(a["names"]).alias("names"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("left"), F.array().cast("array<string>").alias("names")), step, lambda a: a["names"])


def _capital(words: Column, least: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & w.rlike("^[A-Z]"))


def _by_words(text: Column, names: Column, least: int, stop: str, rule: Callable[[Column], Column]) -> Column:
    words = F.filter(_capital(F.flatten(F.transform(names, _words)), least), lambda w: ~w.rlike(stop))
    return F.concat(propagated(text, names, phrase_rule), propagated(text, F.transform(words, lambda w: F.regexp_replace(w, r"[.,]\z", "")), rule))


def title_captions(text: Column) -> Column:
    """Regions of the persons of the title line and of the caption's lines, whole and by word."""
    title = F.filter(title_sides(text), lambda s: ~_has(s, rules.CORPORATE) & _has(s, rules.TITLE_PARTY))
    return _by_words(text, F.array_distinct(F.concat(title, line_parties(text))), 2, r"^(?:The|Madam|Mdm|Mr|Mrs|Ms|Dr)\z", token_rule)


def caption_parties(text: Column) -> Column:
    """Regions of the parties that the caption's phrases name, whole and by word."""
    zone = F.left(text, F.lit(rules.CAPTION_ZONE))
    names = F.filter(F.transform(F.concat(*(_groups(zone, p) for p in rules.CAPTION_PARTIES)), F.btrim), lambda n: ~_has(n, rules.CAPTION_PUBLIC))
    whole = lambda w: F.concat(F.lit(_EDGE), quoted(w), F.lit(rf"(?:[’']s)?{_EDGE}"))
    return _by_words(text, F.array_distinct(names), 2, r"^(?:The|And|Between)\z", whole)


def firm_names(text: Column) -> Column:
    """Regions of the partners that a firm's name lists: the list, and each of them wherever they stand."""
    lists = F.transform(matches(text, rules.FIRM_LIST), lambda m: F.struct(m["start"].alias("start"), F.regexp_extract(m["span"], java(rules.FIRM_LIST), 1).alias("span")))
    whole = F.transform(lists, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["span"])).alias("end"), m["span"].alias("span")))
    words = _capital(F.flatten(F.transform(lists, lambda m: F.split(m["span"], java(r"[\s,&]+")))), 3)
    return F.concat(whole, propagated(text, words))


def own_case_cites(text: Column) -> Column:
    """Regions of earlier cases of the title's parties: the other side's words everywhere, and each cite with its report."""
    keys = F.transform(title_sides(text), lambda s: F.array_join(F.transform(F.slice(_words(s), 1, 2), quoted), _SPACE + "+"))
    name, versus = java(rules.PARTY_NAME), java(r"\s+v\.?\s+")
    ahead = lambda k: F.concat(F.lit(f"{_EDGE}({name}){versus}"), k)
    behind = lambda k: F.concat(F.lit(_EDGE), k, F.lit(rf"[A-Za-z0-9_'’., -]{{0,40}}?{versus}({name})"))

    def cites(rule: Column) -> Column:
        told = F.transform(located(text, rule), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_replace(F.call_function("regexp_extract", m["span"], rule, F.lit(1)), r"[,.]+\z", "").alias("other")))
        kept = F.filter(told, lambda m: ~_has(m["other"], rules.PARTY_STOP, "i") & ~_has(m["other"], rules.CORPORATE))
        words = F.transform(_capital(F.flatten(F.transform(kept, lambda m: _words(m["other"]))), 3), lambda w: F.regexp_replace(w, r"[.,]\z", ""))
        tail = lambda m: F.regexp_extract(_after(text, m["end"], 90), java(rules.CITE_TAIL), 0)
        whole = F.transform(F.filter(kept, lambda m: tail(m) != ""), lambda m: F.struct(m["start"].alias("start"), (m["end"] + F.length(tail(m))).alias("end"), F.substring(text, m["start"] + 1, m["end"] + F.length(tail(m)) - m["start"]).alias("span")))
        return F.concat(propagated(text, words), whole)

    return F.flatten(F.transform(keys, lambda k: F.concat(cites(ahead(k)), cites(behind(k)))))


def party_codes(text: Column) -> Column:
    """Regions of parties that go by letters, and of register numbers, wherever they stand."""
    letters = F.transform(_groups(F.left(text, F.lit(rules.PARTY_CODE_ZONE)), rules.PARTY_CODE), F.btrim)
    return propagated(text, F.concat(F.filter(letters, lambda c: ~c.isin(*rules.PARTY_CODE_STOP)), _groups(text, rules.REGISTER, 0)), phrase_rule)


def names(docs: DataFrame, rails: tuple[str, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span, tag, rail of names that documents define themselves; all rails if None."""
    t = F.col("_t")
    found = {n.rail: (n.tag, propagated(t, nominated(t, n), phrase_rule if n.tag == "[Id]" else token_rule)) for n in rules.NOMINATORS}
    exact = lambda a: F.concat(F.lit(_EDGE), a, F.lit(_EDGE))
    found |= {
        "defined-alias": ("[Person]", propagated(t, defined_aliases(t), lambda a: phrase_rule(a, possessive=True))),
        "initials": ("[Person]", propagated(t, quoted_initials(t), exact)),
        "firm-list": ("[Person]", firm_names(t)),
        "title": ("[Person]", title_captions(t)),
        "caption": ("[Person]", caption_parties(t)),
        "own-case": ("[Person]", own_case_cites(t)),
        "party-code": ("[Code]", party_codes(t)),
    }
    wanted = {rail: v for rail, v in found.items() if rails is None or rail in rails}
    if not wanted:
        raise ValueError(f"no rail in {rails}")
    own = docs.select(key, held(F.col(text)).alias("_t"))
    return _exploded(own, [_tagged(regions, tag, rail) for rail, (tag, regions) in wanted.items()], key)


def surnames(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span, tag: the first and last words of the table's persons, wherever they stand; the first row that has a word gives its tag.

    table: key, ord, span, cls, tag, at most one row a document and entity, so a document's rows meet in its own row.
    """
    bare = F.btrim(F.regexp_replace("span", r"[’']s?\z", ""))
    rows = table.where(F.col("cls") == "PERSON").select(key, "ord", "tag", _words(bare).alias("w")).where("size(w) >= 2")
    ends = rows.select(key, "tag", F.posexplode(F.array(F.element_at("w", 1), F.element_at("w", -1))).alias("i", "c"), "ord").withColumn("c", F.regexp_replace("c", r"[.,]\z", ""))
    ends = ends.where((F.length("c") >= 2) & ~F.col("c").rlike(java(rules.SURNAME_STOP)))
    first = ends.groupBy(key, F.lower("c").alias("low")).agg(F.min(F.struct("ord", "i", "c", "tag")).alias("f"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("_names"))
    met = docs.select(key, held(F.col(text)).alias("_t")).join(lists, key)
    found = F.flatten(F.transform("_names", lambda n: F.transform(located(F.col("_t"), token_rule(n["c"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["span"].alias("span"), n["tag"].alias("tag")))))
    return met.select(key, F.explode(found).alias("m")).select(key, "m.*")


# --- a firm's own papers: parties go, precedent stays -----------------------------------------------------------


def _folded_rule(name: Column) -> Column:
    """phrase_rule with a possessive, ignoring case."""
    return F.concat(F.lit("(?i)"), F.lit(_EDGE), F.array_join(F.transform(F.split(name, java(r"\s+")), quoted), _SPACE + "+"), F.lit(rf"(?:[’']s)?{_EDGE}"))


def _caption_name(line: Column) -> Column:
    """A caption's line as the name of a party; empty if it is none."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(line, "[)(|]+", " "), java(r"\s+"), " "))
    for pattern, flags in ((r"^\d{1,2}[.)]\s*", ""), (r"[,;:.\s]+$", ""), (r"\s*,?\s*et\s+al\.?$", "i"), (rules.US_DESCRIPTOR, "i"), (r"[,;:.\s]+$", "")):
        s = F.regexp_replace(s, java(pattern, flags), "")
    good = F.length(s).between(3, 70) & ~_has(s, rules.US_VENUE, "i") & s.rlike("^[A-Z0-9]") & s.rlike("[A-Za-z]{2}")
    return F.when(good, s).otherwise("")


def us_parties(text: Column) -> Column:
    """array<string>: the name nearest above each line that says a role, four lines up at most, and the sides of Re: lines."""
    zone = F.left(text, F.lit(rules.US_ZONE))
    lines = F.split(zone, "\n")
    above = lambda i: F.filter(F.transform(F.reverse(F.slice(lines, F.greatest(F.lit(1), i + 1 - rules.US_LINES), F.least(i, F.lit(rules.US_LINES)))), _caption_name), lambda s: s != "")
    by_role = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda r: _has(r["x"], rules.US_ROLE, "i")), lambda r: F.get(above(r["i"]), F.lit(0)))
    sides = F.filter(F.transform(_groups(zone, rules.US_RE_LINE), lambda x: F.split(x, java(r"\s+v\.?\s+"))), lambda p: F.size(p) > 1)
    return F.array_distinct(F.filter(F.concat(by_role, F.transform(F.flatten(sides), _caption_name)), lambda s: F.coalesce(s != "", F.lit(False))))


def us_captions(text: Column, names: Column) -> Column:
    """Regions of parties, ignoring case, with and without their legal form, and of words of theirs that the text has as no ordinary word."""
    forms = F.concat(names, F.transform(names, lambda n: F.btrim(F.regexp_replace(n, java(rules.CORPORATE_END, "i"), ""))))
    ordinary = F.array_distinct(_groups(text, r"\b[a-z]{3,}\b", 0))
    words = F.transform(F.flatten(F.transform(names, _words)), lambda w: F.regexp_replace(w, "[^A-Za-z0-9'’]", ""))
    own = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*rules.IDENTITY_STOP) & ~F.array_contains(ordinary, F.lower(w)))
    whole = lambda w: F.concat(F.lit(_EDGE), quoted(w), F.lit(rf"(?:[’']s)?{_EDGE}"))
    return F.concat(propagated(text, F.filter(forms, lambda f: F.length(f) >= 3), _folded_rule), propagated(text, own, whole))


def party_acronyms(text: Column, names: Column) -> Column:
    """Regions of words in capitals, there twice or more, whose letters come in order among those of a party's name."""
    letters = F.filter(F.transform(names, lambda n: F.upper(F.regexp_replace(n, "[^A-Za-z]", ""))), lambda s: F.length(s) >= 4)
    said = _groups(text, r"\b[A-Z][A-Z0-9]{2,7}\b", 0)
    need = lambda a: F.regexp_replace(a, "[^A-Z]", "")
    twice = lambda a: F.size(F.filter(said, lambda b: a == b)) > 1
    fits = lambda a: ~a.isin(*rules.ACRONYM_STOP) & (F.length(need(a)) >= 3) & F.exists(letters, lambda s: subsequence(need(a), s))
    found = F.filter(F.filter(F.array_distinct(said), fits), twice)
    return propagated(text, found, lambda a: F.concat(F.lit(_EDGE), a, F.lit(rf"(?:[’']s)?{_EDGE}")))


def firm_regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span, tag, rail of the parties of federal captions and of their acronyms."""
    own = docs.select(key, held(F.col(text)).alias("_t")).withColumn("_n", us_parties(F.col("_t")))
    t, n = F.col("_t"), F.col("_n")
    return _exploded(own, [_tagged(us_captions(t, n), "[Company]", "us-caption"), _tagged(party_acronyms(t, n), "[Company]", "acronym")], key)


def entity_occurrences(docs: DataFrame, table: DataFrame, classes: tuple[str, ...] = ("COMPANY", "BRAND", "PERSON"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, span, tag: the table's entities wherever they stand, ignoring case, possessives included; of equal spans the first row's tag.

    table: key, ord, span, cls, tag; a document's rows meet in its own row.
    """
    bare = F.regexp_replace(F.btrim(F.regexp_replace("span", r"[’']s?\z", "")), java(r"[,;:.\s]+$"), "")
    rows = table.where(F.col("cls").isin(*classes)).withColumn("_b", bare).where("length(_b) >= 3")
    first = rows.groupBy(key, F.lower("_b").alias("low")).agg(F.min(F.struct("ord", F.col("_b").alias("b"), "tag")).alias("f"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("_names"))
    met = docs.select(key, held(F.col(text)).alias("_t")).join(lists, key)
    found = F.flatten(F.transform("_names", lambda n: F.transform(located(F.col("_t"), _folded_rule(n["b"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["span"].alias("span"), n["tag"].alias("tag")))))
    return met.select(key, F.explode(found).alias("m")).select(key, "m.*")


def identity_words(c: Column) -> Column:
    """array<string>: the words of a name that tell it from others, in lower case without a possessive."""
    low = F.transform(F.split(held(c), "[^A-Za-z0-9'’]+"), lambda w: F.regexp_replace(F.lower(w), r"[’']s\z", ""))
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 3) & ~w.isin(*rules.IDENTITY_STOP)))


def precedents(text: Column, identity: Column | None = None) -> Column:
    """The regions of citations that stay: full ones, and short ones of a case that the document cites in full.

    identity: words of this matter's own parties; a citation that has one of them doesn't stay.
    """
    part = lambda m, g: F.regexp_extract(m["span"], java(rules.FULL_CITE), g)
    shares = lambda c: F.lit(False) if identity is None else F.coalesce(F.arrays_overlap(identity_words(c), identity), F.lit(False))
    full = F.filter(matches(text, rules.FULL_CITE), lambda m: ~shares(part(m, 1)) & ~shares(part(m, 2)))
    cited = F.flatten(F.transform(full, lambda m: F.transform(F.concat(F.split(part(m, 1), r"[ \t\n]+"), F.split(part(m, 2), r"[ \t\n]+")), lambda w: F.regexp_replace(w, r"[,.]+\z", ""))))
    known = _capital(cited, 3)
    name = lambda m: F.regexp_extract(m["span"], java(rules.SHORT_CITE), 1)
    short = F.filter(matches(text, rules.SHORT_CITE), lambda m: F.array_contains(known, name(m)) & ~shares(name(m)))
    return F.concat(full, F.filter(short, lambda m: ~F.exists(full, lambda f: (m["start"] >= f["start"]) & (m["end"] <= f["end"]))))


def matter_words(text: Column, names: Column) -> Column:
    """array<string>: identity words of the names that stand outside citations, or nowhere in the text at all.

    What only citations name is precedent, not this matter.
    """
    cites = precedents(text)
    rule = lambda n: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.array_join(F.transform(F.split(n, java(r"\s+")), quoted), _SPACE + "+"), F.lit("(?![A-Za-z0-9])"))
    outside = lambda f: F.exists(f, lambda m: ~F.exists(cites, lambda c: (m["start"] >= c["start"]) & (m["end"] <= c["end"])))
    found = F.transform(F.filter(F.transform(names, F.btrim), lambda n: F.length(n) >= 3), lambda n: F.struct(n.alias("n"), located(text, rule(n)).alias("f")))
    kept = F.filter(found, lambda x: (F.size(x["f"]) == 0) | outside(x["f"]))
    return F.array_distinct(F.flatten(F.transform(kept, lambda x: identity_words(x["n"]))))


def citation_keeps(docs: DataFrame, key: str = "doc_id", text: str = "text", names: str | None = None) -> DataFrame:
    """key, start, end, span of the precedent that a document keeps; names: an array column of this matter's parties."""
    own = docs.select(key, held(F.col(text)).alias("_t"), *([F.col(names).alias("_n")] if names else []))
    if names:
        own = own.withColumn("_w", matter_words(F.col("_t"), F.coalesce("_n", F.array().cast("array<string>"))))
    found = precedents(F.col("_t"), F.col("_w") if names else None)
    return own.select(key, F.explode(F.array_distinct(found)).alias("m")).select(key, "m.*")


# --- what comes back --------------------------------------------------------------------------------------------


def pre_anonymous(span: Column) -> Column:
    """Whether a person goes by initials already."""
    return _has(F.btrim(span), rules.PRE_ANONYMOUS)


def fold_own_cases(masked: Column) -> Column:
    """A masked person's own case loses its other side, which would tell who it is."""
    return F.regexp_replace(masked, java(rules.OWN_CASE), "$1")


def officials(docs: DataFrame, table: DataFrame, wide: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table's persons that stand behind a judicial title anywhere in their document."""
    rows = table.where(F.col("cls") == "PERSON").select(*table.columns, F.array_join(F.transform(F.split("span", java(r"\s+")), quoted), _SPACE + "+").alias("_p"))
    title = java(rules.OFFICIAL_TITLE_WIDE if wide else rules.OFFICIAL_TITLE)
    met = rows.join(docs.select(key, held(F.col(text)).alias("_t")), key)
    return met.where(F.exists(located(F.col("_t"), F.col("_p")), lambda m: _before(F.col("_t"), m["start"], 30).rlike(title))).select(*table.columns)


def respondent_forms(docs: DataFrame, table: DataFrame, gazetteer: Mapping[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table's organisations that are organs of the deciding court, or forms of the respondent state, with why."""
    met = table.where(F.col("cls") == "COMPANY").join(docs.select(key, respondent(held(F.col(text)), gazetteer).alias("_r")), key)
    s, r = F.col("span"), F.col("_r")
    state = F.contains(s, r["state"]) | s.isin("Government", "the Government") | (F.regexp_replace(s, "^the ", "") == F.concat(r["demonym"], F.lit(" Government")))
    why = F.when(_has(s, rules.ORGAN), "organ").when(r.isNotNull() & state, "respondent")
    return met.withColumn("why", why).where("why IS NOT NULL").select(*table.columns, "why")


def restore_outside_facts(masked: DataFrame, table: DataFrame, pattern: str = rules.INSTITUTIONAL_WIDE, key: str = "doc_id", text: str = "masked") -> DataFrame:
    """key, masked: the tags of institutions become their names again, but for those inside a section of facts.

    A document's tags are looked up in a map of its own; the text is cut once at its tags.
    """
    low = F.regexp_replace("span", r"[’']s?\z", "")
    rows = table.where((F.col("cls") == "COMPANY") & _has(low, pattern, "i")).groupBy(key, "tag").agg(F.min(F.struct("ord", "span")).alias("f"))
    maps = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", "f.span"))).alias("_map"))
    met = masked.select(key, held(F.col(text)).alias("_t")).join(maps, key, "left").withColumn("_marks", sections(F.col("_t")))
    t, tag = F.col("_t"), r"\[[A-Za-z]+\d+\]"
    cuts = F.filter(matches(t, tag), lambda m: F.coalesce(F.map_contains_key("_map", m["span"]), F.lit(False)) & ~in_facts(F.col("_marks"), m["start"]))
    step = lambda a, c: F.struct(F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, c["start"] - a["at"]), F.element_at("_map", c["span"]))).alias("out"), c["end"].alias("at"))
    done = F.aggregate(cuts, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return met.select(key, F.when(F.col("_map").isNull(), t).otherwise(done).alias("masked"))
