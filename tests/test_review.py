"""Review operators over made-up rows, against answers worked out by hand."""

from pyspark.sql import functions as F

from veilgraph.operators import review


def col_of(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_answers_are_read_back_and_verified(spark):
    got = col_of(spark, review.answers, '- PERSON: "Jane Roe"\nnoise\ncompany - Acme Vale \nPLACE: Oslo', None)
    assert [(r.cls, r.span) for r in got[0]] == [("PERSON", "Jane Roe"), ("COMPANY", "Acme Vale")] and got[1] == []
    chunk = "Jane\n Roe of Acme (Vale)."
    got = col_of(spark, lambda c: review.verified(c, F.lit(chunk)), "Acme (Vale)", "Acme,", "Jane Roe", "Joe", "...")
    assert [(r.kind, r.span) for r in got] == [("verbatim", "Acme (Vale)"), ("trimmed", "Acme"), ("ws-normalized", "Jane\n Roe"), ("failed", "Joe"), ("failed", "...")]


def test_scalars(spark):
    assert col_of(spark, review.junk_suspect, "The  Company", "Agreement.", "holder", "Acme", None) == [True, True, True, False, False]
    assert col_of(spark, review.term_key, "O’Neil​–Vale  LLP", "o'neil-vale llp", None) == ["o'neil-vale llp", "o'neil-vale llp", ""]
    assert col_of(spark, lambda c: review.survives(F.lit("Jane  Roe and Janet"), c), "Jane Roe", "Jane", "Jan") == [True, True, False]
    assert col_of(spark, review.content_shape, "$1,200", "5%", "3 May 2004", "30 days", "Jane Roe", "12345-AB", "the Big thing", "x " * 200, "of it all") == [
        "money", "percent", "date", "duration", "name_shaped", "id_code", "short_phrase", "long_passage", "other_text"
    ]
    assert col_of(spark, review.paragraphs, "a\nb\n \nc\r\n\r\nd ", "a\nb\n", None) == [["a\nb", "c", "d"], ["a", "b"], []]
    got = col_of(spark, review.net_class, "https://a.org:443/x", "http://u@LOCALHOST:80/", "http://[::1]:8000", "data:x", "tauri://x", "ipc.localhost", "http://x.localhost:3/", "http://ipc.localhost/")
    assert [(r.cls, r.place) for r in got] == [("offmachine", "a.org"), ("loopback", "localhost"), ("loopback", "[::1]:8000"), ("app", "in-page"), ("app", "tauri:"), ("offmachine", "unparseable: ipc.localhost"), ("loopback", "x.localhost:3"), ("app", "ipc.localhost")]
    h = col_of(spark, review.headers, "x\nCase : Roe v Poe \nCOURT: High\nCitation:\n1 U.S. 2")[0]
    assert (h.case, h.court, h.citation, h.matter) == ("Roe v Poe", "High", None, None)


def test_tables(spark):
    rows = spark.createDataFrame([(1, "Acme", "pending", True), (1, "Vale", None, True), (1, "x", "kept", None)], "doc_id int, span string, status string, decided boolean")
    assert [tuple(r) for r in review.tally(rows, "doc_id").collect()] == [(1, 3, 1, 1, 1)]
    suspects = spark.createDataFrame([(1, "ACME"), (1, "Orion"), (2, "Acme")], "doc_id int, span string")
    assert sorted(map(tuple, review.live_suspects(suspects, rows).collect())) == [(1, "Orion"), (2, "Acme")]
    named = spark.createDataFrame([(1, "Acme", "COMPANY", "lease.txt"), (2, "ACME", "COMPANY", None), (2, "Roe", "PERSON", "memo.txt")], "doc_id int, span string, cls string, name string")
    found = lambda q: sorted((r.low, r.n_docs) for r in review.search(named, q, "name").collect())
    assert found(" CM ") == [("acme", 2)] and found("memo") == [("roe", 1)] and len(found("")) == 2
    hits = spark.createDataFrame([(1, "a@b.co", "[email]"), (1, "A@b.co ", "[email]"), (1, "new", "[number]")], "doc_id int, span string, tag string")
    floor = spark.createDataFrame([(1, "A@B.co", "[old]"), (1, "gone", "[email]")], "doc_id int, span string, tag string")
    assert sorted(tuple(r) for r in review.synced(floor, hits).collect()) == [(1, "a@b.co", "A@B.co", "[email]", 2), (1, "new", "new", "[number]", 1)]
    cited = spark.createDataFrame([(1, "1 U.S. 2", 3), (2, "1 U.S. 2", 1), (1, "9 U.S. 9", 1)], "doc_id int, cite string, n int")
    own = spark.createDataFrame([(2, "1 U.S. 2"), (3, "1 U.S. 2"), (1, None)], "doc_id int, cite string")
    assert [tuple(r) for r in review.cites_edges(cited, own).collect()] == [(1, 2, 3)]
