"""Legal rails over made-up texts, against answers worked out by hand, and shapes against a plain search."""

import re

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import legal as rules
from veilgraph.operators import legal

STATES = {"Poland": "Polish", "Sudan": "Sudanese", "South Sudan": "South Sudanese", "Turkey": "Turkish"}


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def spans(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def value(spark, text, f):
    return docs_of(spark, text).select(f(F.col("text")).alias("v")).first().v


CAPTION = """Title: Hundley v. Rite Aid, Inc.
Between
Tan Ah Kow
(1)
Lim Bee s/o Ong
Acme Pte Ltd
Claimants
And
Mary Poh
... Defendant
As in Hundley v. Rite Aid, 529 U.S. 45 (2000). Mr Poh met Tan and Bee's friend. John Quill Doe, Plaintiff, and Quill's dog."""


def test_nominated_names_go_everywhere(spark):
    text = 'Chan Chee Yong "Derek" and Dereks met Der-\nek. Langston’s son, Bo, told Bo’s wife. An account ending in 4885: the 4885 account, not 48851.'
    got = spans(legal.names(docs_of(spark, text, None, ""), ("nickname", "kinship-name", "account")), "rail", "span")
    assert got == [("account", "4885"), ("account", "4885"), ("kinship-name", "Bo"), ("kinship-name", "Bo’s"), ("nickname", "Der-\nek"), ("nickname", "Derek"), ("nickname", "Dereks")]


def test_aliases_and_initials_come_from_the_name(spark):
    text = "Daniel Sim (“Sim”) and Richard Michael Baldock (“RB”) signed the deed (“Agreement”) with Vale Corp (“Orion”). Sim’s own RB and RBS."
    got = spans(legal.names(docs_of(spark, text), ("defined-alias", "initials")), "rail", "span")
    assert got == [("defined-alias", "RB"), ("defined-alias", "RB"), ("defined-alias", "Sim"), ("defined-alias", "Sim"), ("defined-alias", "Sim’s"), ("initials", "RB"), ("initials", "RB")]


def test_firm_lists_and_party_codes(spark):
    text = "Between AV\nc/o Dornbush, Schaeffer & Venglia, LLP. Venglia spoke of HC/SUM 123 and AV of OA 6."
    got = spans(legal.names(docs_of(spark, text), ("firm-list", "party-code")), "rail", "span")
    assert got == [
        ("firm-list", "Dornbush"), ("firm-list", "Dornbush, Schaeffer & Venglia"), ("firm-list", "Schaeffer"), ("firm-list", "Venglia"), ("firm-list", "Venglia"),
        ("party-code", "AV"), ("party-code", "AV"), ("party-code", "HC/SUM 123"), ("party-code", "OA 6"),
    ]


def test_captions(spark):
    found = legal.names(docs_of(spark, CAPTION), ("title", "caption", "own-case"))
    title = {s for (s,) in spans(found.where("rail = 'title'"), "span")}
    assert {"Tan Ah Kow", "Lim Bee s/o Ong", "Mary Poh", "Hundley", "Poh", "Bee's"} <= title and not any("Acme" in s for s in title)
    caption = {s for (s,) in spans(found.where("rail = 'caption'"), "span")}
    assert {"John Quill Doe", "Quill's", "Mary Poh", "Poh"} <= caption
    own = {s for (s,) in spans(found.where("rail = 'own-case'"), "span")}
    assert {"Hundley", "Hundley v. Rite Aid, 529 U.S. 45 (2000)"} <= own


def test_surnames_take_the_first_rows_tag(spark):
    table = spark.createDataFrame([(0, 1, "Lau Wei Teo", "PERSON", "[Person1]"), (0, 2, "Jane Lau's", "PERSON", "[Person2]"), (0, 3, "Lau Bank", "COMPANY", "[Company1]"), (0, 4, "Mr X", "PERSON", "[Person3]")], "doc_id int, ord int, span string, cls string, tag string")
    got = spans(legal.surnames(docs_of(spark, "Lau met Teo and Jane, not Laura.", "Lau"), table), "doc_id", "span", "tag")
    assert got == [(0, "Jane", "[Person2]"), (0, "Lau", "[Person1]"), (0, "Teo", "[Person1]")]


def test_shapes_against_a_plain_search(spark):
    text = "He was a truck driver, owner of a pizzeria, aged 44 years old, in the town of Leeds; Jan. 3, 2004; 12,500 and three months detention. "
    got = spans(legal.shapes(docs_of(spark, text * 3), tuple({r.pack for r in rules.PACKS}), protect=False), "rail", "start", "end", "span")
    want = set()
    for r in rules.PACKS:
        for m in re.finditer(r.pattern, text * 3, re.I * ("i" in r.flags)):
            at = m.span(1) if r.last else m.span()
            want.add((r.pack, *at, (text * 3)[slice(*at)]))
    assert got == sorted(want) and len({r for r, *_ in got}) >= 6


def test_public_bodies_are_never_touched(spark):
    text = "The Regional Court of Leeds held that he lived in Leeds; in May 1999 the Chamber sat at the retten (District Court), near Retten."
    kept = value(spark, text, lambda t: legal.protected_ranges(t, legal.aliases(t)))
    want = [m.span() for m in re.finditer(rules.PUBLIC_BODY, text)]
    assert [(r.start, r.end) for r in kept][: len(want)] == want and not any("May" in r.span for r in kept)
    found = spans(legal.shapes(docs_of(spark, text), ("L9", "L9w")), "span")
    assert ("lived in Leeds",) in found
    assert value(spark, "the Landsret Court (länsrätten) and the appeal (kungsrätten, Board of Appeal)", legal.aliases) == ["länsrätten"]


def test_guards(spark):
    text = "An application against Poland lodged under no 1520/06. See Kudla v. Poland, no. 30210/96; 812/03, § 40; and 77/01. The victim told her mother; and far away from all of them a mother wept. A Polish and a Turkish man of Turkey, South Sudan and Poland, and then of no other place at all; a deaf son near the Court of law."
    got = spans(legal.shapes(docs_of(spark, text, None), ("app-number", "relational", "L5-demonym", "L5-state", "L5-kin", "L5-disability", "L4"), STATES, protect=False), "rail", "span")
    assert [s for r, s in got if r == "app-number"] == ["1520/06", "77/01"]
    assert [s for r, s in got if r == "relational"] == ["mother"]
    assert [s for r, s in got if r == "L5-demonym"] == ["Turkish"]
    assert [s for r, s in got if r == "L5-state"] == ["South Sudan", "Turkey"]
    assert not [s for r, s in got if r == "L5-disability"], "an institution is near"


def test_respondent_by_caption_else_opening(spark):
    of = lambda t: value(spark, t, lambda c: legal.respondent(c, STATES))
    assert of("A case in an application against the Republic of South Sudan lodged by X of Poland.").state == "South Sudan"
    assert of("Somebody from Turkey.").demonym == "Turkish" and of("Nothing.") is None and of("") is None


def test_foreign_words_only_in_the_facts(spark):
    text = "PROCEDURE\nMr Çelik sat in Bartın.\nTHE FACTS\nHe went to Çiğli with Mr Öz.\nTHE LAW\nÇiğli again."
    assert spans(legal.shapes(docs_of(spark, text), ("foreign",), protect=False), "span") == [("Çiğli",)]


def test_what_comes_back(spark):
    docs = docs_of(spark, "Judge Jane Roe sat. Mr Joe Poe came to the Court. An application against Poland lodged.")
    table = spark.createDataFrame(
        [(0, 1, "Jane Roe", "PERSON", "[Person1]"), (0, 2, "Joe Poe", "PERSON", "[Person2]"), (0, 3, "the Court", "COMPANY", "[Company1]"), (0, 4, "the Polish Government", "COMPANY", "[Company2]"), (0, 5, "Acme", "COMPANY", "[Company3]"), (0, 6, "Vale Board’s", "COMPANY", "[Company4]")],
        "doc_id int, ord int, span string, cls string, tag string",
    )
    assert spans(legal.officials(docs, table), "span") == [("Jane Roe",)]
    assert spans(legal.respondent_forms(docs, table, STATES), "span", "why") == [("the Court", "organ"), ("the Polish Government", "respondent")]
    masked = docs_of(spark, "[Company1] ruled.\nTHE FACTS\n[Company1] and [Company4].\nTHE LAW\n[Company4], [Company3], [Company44].", None).withColumnRenamed("text", "masked")
    assert spans(legal.restore_outside_facts(masked, table), "doc_id", "masked") == [(0, "the Court ruled.\nTHE FACTS\n[Company1] and [Company4].\nTHE LAW\nVale Board’s, [Company3], [Company44]."), (1, "")]
    assert [value(spark, s, legal.pre_anonymous) for s in ("Ms A", "V.B", "Jane", "Mr B.")] == [True, True, False, True]
    assert value(spark, "[Person1] v. Sweden, and Roe v. Sweden", legal.fold_own_cases) == "[Person1], and Roe v. Sweden"
    assert [value(spark, s, legal.letter_coded) for s in ("TWM v TWN [Mother]", "Roe v Poe [Mother]", "A v B XXX", "A v B")] == [True, False, True, False]


def test_federal_captions_and_acronyms(spark):
    text = "UNITED STATES DISTRICT COURT\nINTERACTIVE BROKERS LLC, a\nMEWBOURNE OIL COMPANY, )\n)\nPlaintiff, )\nRe: BKX Services Inc. et al v. Cadence Vale\nMewbourne’s oil and interactive brokers llc. MBOC is MBOC, and ABC is ABC."
    got = spans(legal.firm_regions(docs_of(spark, text, None)), "rail", "span")
    assert [s for r, s in got if r == "acronym"] == ["MBOC", "MBOC"]
    mine = {s for r, s in got if r == "us-caption"}
    assert {"MEWBOURNE OIL COMPANY", "MEWBOURNE OIL", "BKX Services Inc", "BKX", "Cadence Vale", "Cadence"} <= mine and "oil" not in mine


def test_entities_in_any_case(spark):
    table = spark.createDataFrame([(0, 1, "Acme Vale,", "COMPANY", "[Company1]"), (0, 2, "acme vale", "BRAND", "[Brand1]"), (0, 3, "x@y.z", "EMAIL", "[Email1]")], "doc_id int, ord int, span string, cls string, tag string")
    got = spans(legal.entity_occurrences(docs_of(spark, "ACME\nVALE's and Acme Vale, Acme Valet; x@y.z"), table), "span", "tag")
    assert got == [("ACME\nVALE's", "[Company1]"), ("Acme Vale", "[Company1]")]


def test_precedent_stays_but_own_cases_go(spark):
    text = "They cite Alpha Corp. v. Beta Inc., 598 F.3d 30, 35 (2d Cir. 2010). Beta, 598 F.3d at 36. Gamma, 1 F.3d at 2. Orion LLC v. Delaporte, 12 F.3d 34 (1999). So it was for Orion too."
    plain = [s for _, s in spans(legal.citation_keeps(docs_of(spark, text)), "start", "span")]
    assert plain == ["Alpha Corp. v. Beta Inc., 598 F.3d 30, 35 (2d Cir. 2010)", "Beta, 598 F.3d at 36", "Orion LLC v. Delaporte, 12 F.3d 34 (1999)"]
    docs = docs_of(spark, text).withColumn("own", F.array(F.lit("Orion LLC"), F.lit("Orion"), F.lit("Alpha Corp.")))
    assert [s for _, s in spans(legal.citation_keeps(docs, names="own"), "start", "span")] == plain[:2]


def test_no_pack_of_that_name(spark):
    with pytest.raises(ValueError):
        legal.shapes(docs_of(spark, "x"), ("L99",))
