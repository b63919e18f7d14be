from urllib.parse import urlsplit

from pyspark.sql import functions as F

from veilgraph.functions import text
from veilgraph.operators import policies
from veilgraph.plans import strip
from veilgraph.streaming import strip as floor

TEXT = "Ms Jane Roe of Acme Vale Ltd. was born on 3 May 1970. On 3 May 1970 and in June 2001 she wrote to jane@roe.org. The Court of 4 July 2003 sat. Jane Roe, call (202) 274-2000."


def docs_of(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id int, text string")


def test_strip_masks_what_is_judged(spark):
    verdicts = spark.createDataFrame([("jane roe", "PERSON")], "low string, cls string")
    masked, _ = strip.strip(docs_of(spark), verdicts, passes=1)
    got = {r.doc_id: r.masked for r in masked.collect()}
    assert got[2] == got[3] == "" and not any(x in got[1] for x in ("Jane Roe", "jane@", "274-2000"))


def test_anchored_dates(spark):
    docs = docs_of(spark)
    found = policies.shape_regions(docs)
    spans = [r.span for r in strip.anchored(found.where("tag = '[Date]'"), docs, window=14).collect()]
    assert spans.count("3 May 1970") == 2, "a full date goes everywhere"
    assert "June 2001" not in spans
    told = spark.createDataFrame([("June 2001", True)], "span string, personal boolean")
    assert "June 2001" in [r.span for r in strip.anchored(found, docs, told, 14).collect()]


def test_legal_strip_gives_back_and_protects(spark):
    docs = docs_of(spark)
    table = spark.createDataFrame([(1, 1, "Jane Roe", "PERSON", "x", "[Person1]"), (1, 2, "Acme Vale Ltd", "COMPANY", "x", "[Company1]")], "doc_id int, ord int, span string, cls string, src string, tag string")
    labels = spark.createDataFrame([("acme vale ltd", "organ")], "low string, label string")
    got = {r.doc_id: r.masked for r in strip.legal_strip(docs, table, labels).collect()}
    assert "Acme Vale Ltd." in got[1] and "The Court of 4 July 2003" in got[1] and "3 May 1970" not in got[1] and "Jane Roe" not in got[1]
    assert got[2] is None and got[3] == ""


def test_floor_stream_leaves_rows_in_the_shared_folder(spark, tmp_path):
    docs_of(spark).repartition(3).write.parquet(str(tmp_path / "docs.parquet"))
    docs_of(spark).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = next(p for p in (tmp_path / "one").iterdir() if p.suffix == ".parquet")
    shared = urlsplit(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).path
    for path in (str(tmp_path / "docs.parquet"), str(one)):
        got = floor.floor_stream(spark, path)
        assert got.inputFiles() and all(urlsplit(f).path.startswith(shared) for f in got.inputFiles()), "no row is gathered in the driver"
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in docs_of(spark).select("doc_id", text.floor_mask(F.col("text"))).collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("floor_")], "no table in the driver's memory"
