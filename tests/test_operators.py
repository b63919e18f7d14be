"""Invariants of the operators on made-up and random inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import rules, text
from veilgraph.operators import citations, compare, entities, facets, regions, scoring, sequential, spans
from veilgraph.sources import intake
from veilgraph.streaming import strip

R = random.Random(7)


def test_offsets_are_exact(spark):
    texts = ["".join(R.choice(["é", "a.b@c.de", " ", "12", "😀", "x@y.org", "\n"]) for _ in range(R.randrange(200))) for _ in range(80)] + ["", "a@b.cd " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = spans.find(docs, rules.EMAIL).collect()
    assert found and all(texts[r.doc_id][r.start : r.end] == r.span for r in found)
    assert sum(r.doc_id == 81 for r in found) == 300


def random_regions():
    rows = []
    for doc in range(6):
        for _ in range(R.randrange(0, 14)):
            s = R.randrange(0, 40)
            rows.append((doc, s, s + R.randrange(1, 9), f"[T{R.randrange(4)}]"))
    return rows


def test_region_algebra_against_points(spark):
    a, b = random_regions(), random_regions()
    made = spark.createDataFrame(a, "doc_id int, start int, end int, tag string")
    keep = spark.createDataFrame([r[:3] for r in b], "doc_id int, start int, end int")
    points = lambda rows: {(r[0], x) for r in rows for x in range(r[1], r[2])}
    merged = [(r.doc_id, r.start, r.end) for r in regions.merge(made).collect()]
    assert points(merged) == points(a)
    ends = {(d, e) for d, _, e in merged}
    assert not any((d, s) in ends for d, s, _ in merged), "touching regions are one"
    left = [(r.doc_id, r.start, r.end) for r in regions.subtract(made, keep).collect()]
    assert points(left) == points(a) - points(b)
    free = regions.without_overlap(made, keep).collect()
    assert sorted((r.doc_id, r.start, r.end, r.tag) for r in free) == sorted(r for r in a if not points([r]) & points(b))


def test_render_replaces_what_it_says(spark):
    docs = spark.createDataFrame([(1, "0123456789é😀z"), (2, "none"), (3, None)], "doc_id int, text string")
    rows = spark.createDataFrame([(1, 2, 4, "[A]"), (1, 4, 5, "[B]"), (1, 11, 12, "[C]")], "doc_id int, start int, end int, tag string")
    assert {r.doc_id: r.masked for r in regions.render(docs, rows).collect()} == {1: "01[A]56789é[C]z", 2: "none", 3: None}


def test_as_of_takes_the_latest_before(spark):
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (2, 3)], "doc_id int, start int")
    headers = spark.createDataFrame([(1, 4, "a"), (1, 10, "b")], "doc_id int, off int, name string")
    assert {(r.doc_id, r.start): r.section for r in regions.as_of(points, headers).collect()} == {(1, 5): "a", (1, 10): "b", (1, 1): None, (2, 3): None}


def test_masking_leaks_nothing_it_knows(spark):
    docs = spark.createDataFrame([(1, "Jane  Roe met Dr.Roe and jane roe; Briology isn't Brio. a.b@c.de 91234567"), (2, None)], "doc_id int, text string")
    entries = spark.createDataFrame([(1, 1, "Jane Roe", "PERSON", "x"), (1, 2, "Brio", "BRAND", "x"), (1, 3, "Dr. Roe", "PERSON", "x")], "doc_id int, ord int, span string, cls string, src string")
    table = entities.build_table(entries)
    masked = {r.doc_id: r.masked for r in entities.mask(docs, table).collect()}
    assert masked == {1: "[Person1] met [Person2] and [Person1]; Briology isn't [Brand1]. [email] [phone]", 2: ""}
    placed = sequential.placements(docs, table).collect()
    assert sorted((r.start, r.tag) for r in placed)[0] == (0, "[Person1]") and len(placed) == 4


def test_claims_never_overlap():
    words = ["Ana", "Ana Bo", "Bo Cy", "Cy", "Ana Bo Cy"]
    for _ in range(200):
        t = " ".join(R.choice(["Ana", "Bo", "Cy", "x"]) for _ in range(12))
        got = list(sequential.claim(t, [(w, w) for w in R.sample(words, 3)]))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and all(t[s:e] == t[s:e].strip() != "" for s, e, _ in got)


@pytest.mark.parametrize("size", [20, 100, 500])
def test_chunks_cover_and_cut_no_word(size):
    t = " ".join(("word" * R.randrange(1, 3)) + R.choice(["", "\n", "."]) for _ in range(400))
    got = list(sequential.cut_chunks(t, size, size // 5))
    assert got[0][0] == 0 and got[-1][1] == len(t) and all(t[s:e] == c for s, e, c in got)
    assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(got, got[1:], strict=False))
    assert all(e == len(t) or t[e - 1].isspace() or t[e].isspace() for _, e, _ in got)


def test_sentences_and_facets():
    t = "Smith v. Jones was decided by Elizabeth E. Roe in the U.S. Court. We affirm. Is it so? Yes."
    assert [s for _, _, s in sequential.cut_sentences(t)] == ["Smith v. Jones was decided by Elizabeth E. Roe in the U.S. Court.", "We affirm.", "Is it so?", "Yes."]
    assert facets.disposition(t)[:3] == ("We affirm.", ["affirm"], "stands")
    assert facets.disposition("We affirm. The judgment is reversed.")[3] == "conflicting-dispositions-in-opinion"
    assert facets.disposition("")[3] and facets.synopsis("")[1]


def test_capital_runs():
    got = sequential.capital_runs("By Virginia Woolf and Co. of 8x8 Inc. The Company met the Board of Fine Art. EOL, EOL on 21st. TurboShine.\n\nOslo")
    assert got["Virginia Woolf and Co."] == 1 and got["Board of Fine Art"] == 1 and got["EOL"] == 2 and got["TurboShine"] == 1 and got["8x8"] == 1
    assert "The Company" not in got and "21st" not in got and "Oslo" not in got


def test_stand_in_scores(spark):
    docs = spark.createDataFrame([(1, "Bo sits on the Board with Ann."), (2, "x")], "doc_id int, text string")
    gold = spark.createDataFrame([(1, "Bo", "DIRECT"), (1, "Ann", "QUASI"), (1, "Board", "NO_MASK"), (1, "Zed", "DIRECT")], "doc_id int, span string, identifier_type string")
    score = lambda out: scoring.board(scoring.score_documents(scoring.leaks(gold, docs, spark.createDataFrame([(1, out)], "doc_id int, masked string")))).first()
    null, oracle, over = score("Bo sits on the Board with Ann."), score("[P] sits on the Board with [Q]."), score("[P]")
    assert (null.direct_recall, null.preservation, null.gate_rate, null.unmatchable) == (0, 1, 0, 1)
    assert (oracle.direct_recall, oracle.quasi_recall, oracle.preservation, oracle.gate_rate) == (1, 1, 1, 1)
    assert (over.direct_recall, over.preservation) == (1, 0)


def test_components_of_a_chain(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z1"), ("y1", "y2")]
    R.shuffle(chain)
    got = {r.node: r.root for r in citations.components(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["z1"] == "z1" and got["y2"] == "y1"


def test_gini_and_quantile(spark):
    values = [0.0, 1.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, s = len(values), sorted(values)
    want = sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(s)) / (n * sum(s))
    assert abs(citations.gini(df, "v").first().gini - want) < 1e-9
    assert scoring.quantile(df, "v", 0.5).first().value == 1.0 and citations.gini(df.limit(0), "v").first().gini == 0.0


def test_diff_puts_both_sides_back(spark):
    old, new = "a\nb\nc\nd", "a\nx\nc\nd\ne"
    got = sorted(compare.diff(spark.createDataFrame([(1, old, new), (2, None, "q")], "id int, o string, n string"), "id", "o", "n").where("key = '1'").collect(), key=lambda r: r.ord)
    assert "\n".join(r.later for r in got if r.kind != "removed") == new and "\n".join(r.earlier for r in got if r.kind != "added") == old


def test_intake_reads_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello\r\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe" + "é1".encode("utf-16le"))
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04....")
    files = intake.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.select("path", intake.detect(F.col("content"), F.col("path")).alias("f"), intake.decode_text(F.col("content")).alias("t")).collect()}
    assert (got["a.txt"].t.text, got["a.txt"].t.eol, got["a.txt"].t.bom) == ("hello\r\n", "crlf", True)
    assert (got["b.txt"].t.text, got["b.txt"].t.encoding) == ("é1", "utf-16le") and got["c.docx"].f.route == "docx"
    holds = spark.createDataFrame([("-----BEGIN RSA KEY-----",), ("From: a\nTo: b\n",), ("=?utf-8?B?w6k=?=",), ("plain",), (None,)], "t string").select(intake.content_hold(F.col("t")).alias("h")).collect()
    assert [r.h for r in holds] == ["pem", "mail-headers", "encoded-word", None, None]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail a{i}@b.org") for i in range(30)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    got = strip.floor_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in docs.select("doc_id", text.floor_mask(F.col("text"))).collect()}


def test_suspicion_has_the_features_of_the_reference(spark):
    told = {
        "the unit SE060622 was sold": {"SE060622": 2}, "unit SE060622-001 and Aurora-0204": {"SE060622-001": 2, "Aurora-0204": 2}, "of ps acquisition sub corp. then": {"corp": 2},
        "[Person1] McAdams left": {"McAdams": 2}, "[Person1] Goldstein left": {"Goldstein": 2}, "McAdams left": {}, "see REPORT_1.PDF": {"REPORT_1.PDF": 2},
        "the Director Of McAdams": {"McAdams": 2}, "a 30-day term and A1-B2": {}, "the co and a plain line": {},
    }
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id int, text string")
    got: dict = {i: {} for i in range(len(told))}
    for r in spans.suspicion(docs, spans.SUSPICIOUS).collect():
        got[r.doc_id][r.span] = r.score
    assert got == dict(enumerate(told.values()))


def test_suspicion_takes_no_text_along(spark):
    filler = "and the lot 12 " * 5000
    rows = [(1, filler + "Dr Roe, AB1234 and ab1234 of [Person1] Vale"), (2, None), (3, "Mr" + " " * 21 + "Hale Mr" + " " * 23 + "Pike"), (4, "inc."), (5, "../Mr. O'Neil _Mr._ Berg")]
    found = spans.suspicion(spark.createDataFrame(rows, "doc_id int, text string"), spans.SUSPICIOUS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("," not in kept for kept in re.findall(r"Generate explode\(.*\), \[([^\]]*)\], false", plan)) and "Generate explode" in plan, "the text would be copied for every token"
    got = {(r.doc_id, r.span, r.score, r["rank"]) for r in found.collect()}
    assert got == {(1, "Roe", 2, 1), (1, "AB1234", 2, 2), (3, "Hale", 2, 1), (4, "inc", 2, 1), (5, "O'Neil", 3, 1)}


def test_floor_mask_leaves_no_rule_out(spark):
    texts = ["a@b.org", "S1234567D", "1 2-3.4 5 6 7 8 9 0 1 2 3", "+65 6123 4567", "81234567", "123456789", "1 2 3", "x@y", "a@b.org 4111 1111 1111 1111", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.coalesce("t", F.lit(""))
    for pattern, flags, mark in rules.FLOOR:
        plain = text.replace_all(plain, pattern, mark, flags)
    got = d.select(text.floor_mask(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and [r.got for r in got][:6] == ["[email]", "[nric]", "[card]", "[phone]", "[phone]", "[number]"]
