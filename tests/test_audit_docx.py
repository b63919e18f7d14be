import io
import zipfile

from pyspark.sql import functions as F

from veilgraph.operators import audit
from veilgraph.sources import docx, intake

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>")
        z.writestr("word/comments.xml", "<broken")
        z.writestr("word/media/a.png", b"\x89PNG")
        z.writestr("odd/x.xml", "<x/>")
    return out.getvalue()


def test_docx_tells_every_part(spark, tmp_path):
    body = "<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>é</w:t><w:tab/></w:r></w:p><w:p/><w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(word_file(body))
    (tmp_path / "b.docx").write_bytes(b"PK no")
    got = docx.extract(intake.read_files(spark, str(tmp_path))).collect()
    body_rows = sorted((r.para, r.text, r.hidden) for r in got if r.channel == "body")
    assert body_rows == [(0, "Hello é\t", False), (2, "secret", True)]
    assert {(r.channel, r.note) for r in got if r.note} == {("comment", "invalid"), ("binary", "not-read"), ("unrecognised", "not-read"), (None, "not-a-zip")}


def test_audits(spark):
    docs = spark.createDataFrame([(1, "The [***] and █████ of Acme\n* * *\n***\nA *** b [REDACTED]")], "doc_id int, text string")
    assert sorted((r.at, r.family) for r in audit.marker_sites(docs).collect()) == [(0, "block"), (0, "bracket-star"), (3, "bare-star"), (3, "word")]
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 9, 1)], "a int, b int, rank int")
    got = audit.ranking_quality(ranked, spark.createDataFrame([(1, 3), (2, 1)], "a int, b int")).first()
    assert (got.n, got.mrr, got.recall) == (2, 0.25, 0.5)
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "t string, n int")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "t string, n int")
    assert sorted((r.t, r.side) for r in audit.out_of_step(a, b).collect()) == [("x", "surplus"), ("y", "surplus"), ("z", "missing")]
    names = spark.createDataFrame([("c", "Bo"), ("c", "Al"), ("d", "Bo")], "g string, name string")
    assert {(r.g, r.name): r.alias for r in audit.aliases(names, "g").collect()} == {("c", "Al"): "Person A", ("c", "Bo"): "Person B", ("d", "Bo"): "Person A"}
    found = spark.createDataFrame([(1, "Jane Roe"), (1, "Oslo")], "doc_id int, span string")
    assert [r.span for r in audit.uncovered(found, spark.createDataFrame([(1, "roe")], "doc_id int, span string")).collect()] == ["Oslo"]
    hits = spark.createDataFrame([(1, 0, 5, "r"), (1, 9, 12, "r"), (2, 0, 1, "q")], "doc_id int, start int, end int, rule string")
    board = audit.rule_board(hits, spark.createDataFrame([(1, 4, 6)], "doc_id int, start int, end int")).collect()
    assert {(r.rule, r.nominated, r.on_gold) for r in board} == {("r", 2, 1), ("q", 1, 0)}
    shaped = spark.createDataFrame([("aB3dE9xK2",), ("plainword",), ("ABCDEF",), ("",)], "t string").select(audit.encoder_shaped(F.col("t")).alias("s"))
    assert [bool(r.s) for r in shaped.collect()] == [True, False, False, False]
