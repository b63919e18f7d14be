"""The registered queries of the library: each a Spark plan over the given tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import legal as legal_rules
from ..functions import rules, text
from ..functions.rx import re2, sql_string
from ..operators import audit, citations, compare, entities, facets, legal, policies, regions, retrieval, review, scoring, sequential, spans
from ..sources import intake
from ..streaming import strip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return intake.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _floor_sql(column: str) -> str:
    for pattern, flags, mark in rules.FLOOR:
        column = f"regexp_replace({column}, {sql_string(re2(pattern, flags))}, {sql_string(mark)}, 'g')"
    return column


def _found(column: str, pattern: str, flags: str = "", group: int = 0) -> str:
    return f"regexp_extract_all({column}, {sql_string(re2(pattern, flags))}, {group})"


def _spans_sql(column: str, pattern: str, flags: str = "") -> str:
    """A list of {s, e, w}: offsets from the pieces between matches, as in spans.matches."""
    p = sql_string(re2(pattern, flags))
    gaps = f"list_transform(regexp_split_to_array({column}, {p}), lambda x: length(x))"
    hits = f"regexp_extract_all({column}, {p})"
    widths = f"list_transform({hits}, lambda x: length(x))"
    start = f"(list_sum(list_slice({gaps}, 1, i)) + coalesce(list_sum(list_slice({widths}, 1, i - 1)), 0))"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': {start}, 'w': list_extract({hits}, i)}})"


def _base_sql(c: str) -> str:
    edge = sql_string(re2(r"""^[\s("'[]+|[\s)"',.;:\]]+$"""))
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[®™]', '', 'g'), {edge}, '', 'g'), {sql_string(re2(chr(92) + 's+'))}, ' ', 'g'))"


# --- text -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_floor_sql('text')} AS masked FROM documents")
def floor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.floor_mask(F.col("text")).alias("masked"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len(string_split(m, {sql_string(mark)})) - 1 AS INT) AS {mark[1:-1]}" for _, _, mark in rules.FLOOR) + f" FROM (SELECT doc_id, {_floor_sql('text')} AS m FROM documents)")
def floor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = floor_mask(spark, sf_dir)
    return masked.select("doc_id", *((F.size(F.split("masked", mark.replace("[", r"\[").replace("]", r"\]"), -1)) - 1).alias(mark[1:-1]) for _, _, mark in rules.FLOOR))


_TAGS = (
    ("(?i)<script[\\s\\S]*?</script>|<style[\\s\\S]*?</style>", " "),
    ("(?i)<(?:br|/p|/div|/h\\d|/li|/tr)[^>]*>", "\n"),
    ("<[^>]+>", " "),
)


def _html_sql() -> str:
    c = "coalesce(html, '')"
    for pattern, mark in _TAGS:
        c = f"regexp_replace({c}, {sql_string(pattern)}, {'chr(10)' if mark == chr(10) else sql_string(mark)}, 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = f"replace({c}, {sql_string(a)}, {sql_string(b)})"
    c = f"regexp_replace(regexp_replace({c}, '&#\\d+;', ' ', 'g'), '[ \\t]+', ' ', 'g')"
    c = f"regexp_replace({c}, {sql_string(re2(chr(92) + 'n' + chr(92) + 's+'))}, chr(10), 'g')"
    return f"regexp_replace({c}, {sql_string(re2('^' + chr(92) + 's+|' + chr(92) + 's+$'))}, '', 'g')"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


def _density_sql() -> str:
    total = " + ".join(f"{w} * len({_found('text', p)})" for p, w in rules.DENSITY)
    return f"SELECT doc_id, round(({total}) / (len(regexp_split_to_array(text, {sql_string(re2(chr(92) + 's+'))})) / 1000.0::DOUBLE), 1) AS density, CAST(len(regexp_split_to_array(text, {sql_string(re2(chr(92) + 's+'))})) AS INT) AS words FROM documents"


@query(_density_sql())
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.density(F.col("text")).alias("density"), text.word_count(F.col("text")).alias("words"))


@query(f"""WITH d AS ({_density_sql()}),
b AS (SELECT *, CASE WHEN words < 100 THEN 'short' WHEN words < 400 THEN 'middle' ELSE 'long' END AS bucket FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY density DESC, doc_id) AS rn FROM b)
SELECT doc_id, bucket, density, CAST(rn AS INT) AS rn, CAST(2 - rn % 2 AS INT) AS batch FROM r WHERE rn <= 20""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 densest documents of each length, dealt to two batches; Spark keeps 20 a task before the shuffle."""
    bucket = F.when(F.col("words") < 100, "short").when(F.col("words") < 400, "middle").otherwise("long")
    ranked = density(spark, sf_dir).withColumn("bucket", bucket).withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("density"), "doc_id")))
    return ranked.where("rn <= 20").select("doc_id", "bucket", "density", "rn", (2 - F.col("rn") % 2).alias("batch"))


_GARBLE = "length(regexp_replace(text, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(text) > 0 THEN {_GARBLE} / length(text)::DOUBLE ELSE 0.0 END AS ratio FROM documents")
def garble_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.garble_ratio(F.col("text")).alias("ratio"))


FX_NUMBERS = "SELECT * FROM (VALUES ('nhs', '943 476 5919', true), ('nhs', '943 476 5918', false), ('nhs', '12345', false), ('nhs', '401 023 2137', true), ('nino', 'AB 12 34 56 C', true), ('nino', 'QQ123456C', false), ('nino', 'AO123456C', false), ('nino', 'GB123456A', false), ('ein', '12-3456789', true), ('ein', '07-1234567', false), ('ein', '00-1234567', false)) AS t(kind, value, valid)"


@query(f"SELECT kind, value, valid AS found FROM ({FX_NUMBERS})")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National numbers that are well-formed and could have been issued; the SQL has the answers as given."""
    v = F.col("value")
    found = F.when(F.col("kind") == "nhs", text.valid_nhs(v)).when(F.col("kind") == "nino", text.valid_nino(v)).otherwise(text.valid_ein(v))
    return spark.sql(FX_NUMBERS).select("kind", "value", found.alias("found"))


FX_SCALARS = "SELECT * FROM (VALUES (1, 'ＡＢＣ　１２３＠ｘ．ｃｏｍ', 'ABC　123@x.com', '(Acme®, Inc.);', 'Acme, Inc'), (2, 'plain', 'plain', '  the  \"Long   Name\", ', 'the \"Long Name'), (3, '', '', '™', ''), (4, 'ｅ', 'e', 'A.B. Corp.', 'A.B. Corp')) AS t(id, wide, folded, span, base)"


@query(f"SELECT id, folded, base FROM ({FX_SCALARS})")
def fold_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_SCALARS).select("id", text.fold_fullwidth(F.col("wide")).alias("folded"), text.base_name(F.col("span")).alias("base"))


FX_TAGS = "SELECT * FROM (VALUES (1, '[Person1] [Person1] and [Person2]', '[Person1] and [Person2]', true, true), (2, 'the', 'the', false, false), (3, '1234', '1234', false, false), (4, '12345', '12345', false, true), (5, 'Company12', 'Company12', true, true), (6, 'of it', 'of it', false, true), (7, '[card]', '[card]', true, true)) AS t(id, span, collapsed, artifact, ok)"


@query(f"SELECT id, collapsed, artifact, ok FROM ({FX_TAGS})")
def tag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("span")
    return spark.sql(FX_TAGS).select("id", text.collapse_tags(s).alias("collapsed"), text.mask_artifact(s).alias("artifact"), text.admissible(s).alias("ok"))


# --- spans and rails --------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(m.s AS INT) AS start, CAST(m.s + length(m.w) AS INT) AS \"end\", m.w AS span FROM (SELECT doc_id, unnest({_spans_sql('text', rules.EMAIL)}) AS m FROM documents)")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(table(spark, sf_dir, "documents"), rules.EMAIL)


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
u AS (SELECT page_id, unnest({_spans_sql('t', rules.URL, 'i')}) AS m FROM p),
e AS (SELECT page_id, unnest({_spans_sql('t', rules.EMAIL)}) AS m FROM p)
SELECT DISTINCT page_id, regexp_replace(u.m.w, '[.,;:]+$', '') AS span FROM u
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = u.page_id AND u.m.s >= e.m.s AND u.m.s < e.m.s + length(e.m.w))""")
def url_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.urls(table(spark, sf_dir, "pages"), "page_id", "html")


def _rails_sql(source: str, key: str, column: str) -> str:
    parts = [
        f"SELECT {key}, {i} AS ord, unnest(range(1, len(h) + 1)) - 1 AS pos, '{rail}' AS rail, '{cls}' AS cls, trim(unnest(h)) AS span FROM (SELECT {key}, {_found(column, p, flags, g)} AS h FROM {source})"
        for i, (rail, cls, p, flags, g) in enumerate(rules.RAILS)
    ]
    return " UNION ALL ".join(parts)


_BATTERY = f"""WITH f AS ({_rails_sql('documents', 'doc_id', 'text')}),
x AS (SELECT doc_id, ord, pos, rail, cls, unnest([b, b || '*']) AS span FROM (SELECT *, regexp_extract(span, '(?i)^EX(?:HIBIT)?[-\\s]?([0-9]{{1,3}}\\.[0-9]{{1,2}})$', 1) AS b FROM f WHERE rail = 'header-meta') WHERE b <> ''),
u AS (SELECT doc_id, unnest({_spans_sql('text', rules.URL, 'i')}) AS m FROM documents),
e AS (SELECT doc_id, unnest({_spans_sql('text', rules.EMAIL)}) AS m FROM documents),
l AS (SELECT DISTINCT doc_id, -1 AS ord, 0 AS pos, 'url' AS rail, 'ID' AS cls, regexp_replace(u.m.w, '[.,;:]+$', '') AS span FROM u
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = u.doc_id AND u.m.s >= e.m.s AND u.m.s < e.m.s + length(e.m.w))),
a AS (SELECT *, {_base_sql('span')} AS base FROM (SELECT * FROM f UNION ALL SELECT * FROM x UNION ALL SELECT * FROM l)),
battery AS (SELECT doc_id, base AS span, cls, 'rail:' || rail AS src, ord, pos FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(base) ORDER BY ord, pos, base, cls, rail) AS n FROM a WHERE base <> '') WHERE n = 1)
"""


@query(f"{_BATTERY} SELECT doc_id, span, cls, src FROM battery")
def battery_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.battery(table(spark, sf_dir, "documents"))


@query(f"SELECT rail, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_rails_sql('documents', 'doc_id', 'text')}) GROUP BY rail")
def rail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.rail_spans(table(spark, sf_dir, "documents")).groupBy("rail").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query()
def address_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street addresses, postal lines, unit numbers and highways: patterns that look around, which RE2 can't."""
    docs = table(spark, sf_dir, "documents")
    return reduce(DataFrame.union, [spans.find(docs, p) for p in rules.ADDRESSES])


FX_NAMES = """SELECT * FROM (VALUES
 (1, 'Acme Holdings Corporation ("Acme") signed. /s/ Jane Q Doe. The "Board of Fine Review" ("BFR") sat.'),
 (2, 'CASITE ® and Turbo Shine™ are sold by Orion & Vale LLP, see custom:WidgetMember and us-gaap:CashMember.'),
 (3, 'Filed with File No. 0-26071 at the University of North Vale; call (202) 274-2000.')) AS t(doc_id, text)"""


@query("SELECT * FROM (VALUES (1, 'defined', 'Acme'), (1, 'defined', 'BFR'), (1, 'quoted', 'Board of Fine Review'), (1, 'quoted', 'BFR'), (2, 'mark', 'CASITE'), (2, 'mark', 'Turbo Shine'), (2, 'xbrl', 'custom:WidgetMember')) AS t(doc_id, rail, span)")
def captured_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rails with groups over three made-up texts; the SQL has the answers as given."""
    docs = spark.sql(FX_NAMES)
    found = {"defined": spans.captured(docs, rules.DEFINED_TERM), "mark": spans.captured(docs, rules.MARK), "xbrl": spans.xbrl_members(docs), "quoted": spans.captured(docs, rules.QUOTED_ORG, (1, 2))}
    return reduce(DataFrame.union, [d.select("doc_id", F.lit(name).alias("rail"), "span") for name, d in found.items()])


@query()
def suspicion_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still looks like an identity in floor-masked documents."""
    masked = floor_mask(spark, sf_dir).withColumnRenamed("masked", "text")
    return spans.suspicion(masked, spans.SUSPICIOUS)


# --- entities ---------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mails = spans.find(docs, rules.EMAIL).groupBy("doc_id", "span").agg(F.min("start").alias("start")).select("doc_id", F.col("start").cast("long").alias("ord"), "span", F.lit("EMAIL").alias("cls"), F.lit("rail:email").alias("src"))
    rails = spans.battery(docs)
    ranked = rails.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("src", "span")) + (1 << 24)).cast("long"))
    return mails.unionByName(ranked.select("doc_id", "ord", "span", "cls", "src"))


_STOP_LIST = ", ".join(sql_string(w) for w in rules.FOOTPRINT_STOP)
_TABLE = f"""{_BATTERY},
m AS (SELECT doc_id, min(m.s) AS ord, m.w AS span, 'EMAIL' AS cls, 'rail:email' AS src FROM e GROUP BY doc_id, m.w),
en AS (SELECT * FROM m UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY src, span) + 16777216, span, cls, src FROM battery),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(span) ORDER BY ord) AS n FROM en
  WHERE length(trim(span)) >= 3 AND NOT (regexp_full_match(trim(span), '[0-9]+') AND length(trim(span)) < 5)
    AND NOT (NOT regexp_matches(trim(span), {sql_string(re2(chr(92) + 's'))}) AND lower(trim(span)) IN ({_STOP_LIST}))),
et AS (SELECT doc_id, ord, span, cls, src, '[' || upper(left(cls, 1)) || lower(substr(cls, 2)) || count(*) OVER (PARTITION BY doc_id, cls ORDER BY ord ROWS UNBOUNDED PRECEDING) || ']' AS tag FROM ok WHERE n = 1)
"""


@query(f"{_TABLE} SELECT doc_id, CAST(ord AS BIGINT) AS ord, span, cls, src, tag FROM et")
def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build_table(_entries(spark, sf_dir))


@query(f"""{_TABLE}, forms AS (SELECT lower(span) AS low, cls, span, count(*) AS n FROM et GROUP BY 1, 2, 3),
top AS (SELECT low, cls, span AS form, row_number() OVER (PARTITION BY low, cls ORDER BY n DESC, span) AS r FROM forms)
SELECT low, cls, n_docs, n_rows, form FROM (SELECT lower(span) AS low, cls, count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows FROM et GROUP BY 1, 2) JOIN top USING (low, cls) WHERE r = 1""")
def find_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.find_index(entity_table(spark, sf_dir))


@query()
def mask_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked by their own entity table, longest span first, then by the floor."""
    return entities.mask(table(spark, sf_dir, "documents"), entity_table(spark, sf_dir))


FX_ENTRIES = "SELECT * FROM (VALUES (1, 1, 'Lucky Mc Uranium Corporation', 'COMPANY', 'a'), (1, 2, 'Jane Q Doe', 'PERSON', 'a'), (1, 3, 'The New Firm', 'COMPANY', 'b'), (1, 4, 'jane q doe', 'PERSON', 'b'), (1, 5, 'the', 'PERSON', 'b'), (2, 1, 'Jane Q', 'PERSON', 'a'), (2, 2, 'Jane Q Roe', 'PERSON', 'a')) AS t(doc_id, ord, span, cls, src)"


@query("SELECT * FROM (VALUES (1, 'Lucky Mc Uranium Corporation', '[Company1]', 'a'), (1, 'Jane Q Doe', '[Person1]', 'a'), (1, 'The New Firm', '[Company2]', 'b'), (1, 'Lucky Mc', '[Company1]', 'prefix:a'), (1, 'Jane Q', '[Person1]', 'prefix:a'), (2, 'Jane Q', '[Person1]', 'a'), (2, 'Jane Q Roe', '[Person2]', 'a')) AS t(doc_id, span, tag, src)")
def prefix_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up entries; the SQL has the answers as given."""
    return entities.propagate_prefixes(entities.build_table(spark.sql(FX_ENTRIES))).select("doc_id", "span", "tag", "src")


# --- regions ----------------------------------------------------------------------------------------------------

_REGION_RULES = (("Email", rules.EMAIL), ("Number", r"\b[0-9][0-9 .-]{6,20}[0-9]\b"), ("Name", r"\b[A-Z][a-z]+ [a-z]+ [a-z]{2}\b"))
_KEEP = r"\b(?:the|of|and|la|der|los)\b[^.]{0,12}"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reduce(DataFrame.union, [spans.find(docs, p).select("doc_id", "start", "end", F.lit(tag).alias("tag")) for tag, p in _REGION_RULES])


def _keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(table(spark, sf_dir, "documents"), _KEEP).select("doc_id", "start", "end")


_R = " UNION ALL ".join(f"SELECT doc_id, CAST(m.s AS INT) AS s, CAST(m.s + length(m.w) AS INT) AS e, '{tag}' AS tag FROM (SELECT doc_id, unnest({_spans_sql('text', p)}) AS m FROM documents)" for tag, p in _REGION_RULES)
_K = f"SELECT doc_id, CAST(m.s AS INT) AS s, CAST(m.s + length(m.w) AS INT) AS e FROM (SELECT doc_id, unnest({_spans_sql('text', _KEEP)}) AS m FROM documents)"
_MERGED = f"""WITH r AS ({_R}),
a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e DESC, tag ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, tag) AS pos FROM a)
"""


@query(f"{_MERGED} SELECT doc_id, min(s) AS start, max(e) AS \"end\", arg_min(tag, pos) AS tag, list_sort(list_distinct(list(tag))) AS tags FROM b GROUP BY doc_id, island")
def regions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.merge(_regions(spark, sf_dir))


@query(f"WITH r AS ({_R}), k AS ({_K}) SELECT doc_id, s AS start, e AS \"end\", tag FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND r.s < k.e AND r.e > k.s)")
def regions_unprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.without_overlap(_regions(spark, sf_dir), _keep(spark, sf_dir))


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({_R})), k AS ({_K}),
p AS (SELECT doc_id, s, e, tag, unnest(range(s, e)) AS x FROM r),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND x >= k.s AND x < k.e)),
g AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, s, e, tag ORDER BY x) AS island FROM f)
SELECT doc_id, CAST(min(x) AS INT) AS start, CAST(max(x) + 1 AS INT) AS "end", tag FROM g GROUP BY doc_id, s, e, tag, island""")
def regions_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.subtract(_regions(spark, sf_dir), _keep(spark, sf_dir))


_HEADER = r"\n[A-Z][^\n]{0,80}"


@query(f"""WITH r AS ({_R}), h AS (SELECT doc_id, CAST(m.s AS INT) AS off, m.w AS name FROM (SELECT doc_id, unnest({_spans_sql('text', _HEADER)}) AS m FROM documents))
SELECT r.doc_id, r.s AS start, r.e AS "end", r.tag, (SELECT arg_max(name, off) FROM h WHERE h.doc_id = r.doc_id AND h.off <= r.s) AS section FROM r""")
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = spans.find(table(spark, sf_dir, "documents"), _HEADER).select("doc_id", F.col("start").alias("off"), F.col("span").alias("name"))
    return regions.as_of(_regions(spark, sf_dir), headers)


@query(f"""{_MERGED}, g AS (SELECT doc_id, min(s) AS s, max(e) AS e, arg_min(tag, pos) AS tag FROM b GROUP BY doc_id, island),
l AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS was FROM g),
p AS (SELECT doc_id, string_agg(substr(text, CAST(was + 1 AS BIGINT), CAST(l.s - was AS BIGINT)) || '[' || tag || ']', '' ORDER BY l.s) AS front, max(e) AS last FROM l JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN front IS NULL THEN text ELSE front || substr(text, CAST(last + 1 AS BIGINT)) END AS masked FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def regions_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.render(table(spark, sf_dir, "documents").select("doc_id", "text"), _regions(spark, sf_dir).withColumn("tag", F.concat(F.lit("["), "tag", F.lit("]"))))


# --- retrieval --------------------------------------------------------------------------------------------------

_STOPS = ", ".join(sql_string(w) for w in rules.TERM_STOP)


def _tfidf_sql(source: str, key: str) -> str:
    return f"""tf AS (SELECT {key} AS id, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z][a-z'']{{2,}}')) AS term FROM {source}) WHERE term NOT IN ({_STOPS}) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM {source}) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM tf JOIN idf USING (term)),
v AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS norm FROM w)"""


def _vectors(docs: DataFrame, key: str) -> DataFrame:
    counts = retrieval.term_counts(docs, key)
    n = docs.agg(F.count("*").alias("n"))
    return retrieval.weights(counts, retrieval.inverse_frequencies(counts, n, key), key)


@query(f"WITH {_tfidf_sql('benchmark', 'item_id')} SELECT id AS item_id, term, round(w, 6) AS w, round(norm, 6) AS norm FROM v")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "term", F.round("w", 6).alias("w"), F.round("norm", 6).alias("norm"))


_COS = f"WITH {_tfidf_sql('benchmark', 'item_id')}, c AS (SELECT x.id AS a, y.id AS b, sum(x.w / x.norm * (y.w / y.norm)) AS cos FROM v x JOIN v y USING (term) WHERE x.id < y.id GROUP BY 1, 2)"


def _benchmark_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(table(spark, sf_dir, "benchmark"), "item_id")
    return retrieval.cosines(v, v, "item_id", unordered=True)


@query(f"{_COS} SELECT a, b, round(cos, 6) AS cos FROM c")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_cosines(spark, sf_dir).withColumn("cos", F.round("cos", 6))


@query(f"""{_COS}, s AS (SELECT a, b, cos FROM c UNION ALL SELECT b, a, cos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS rn FROM s)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(cos), 3) AS w FROM r WHERE rn <= 3 AND cos >= 0.05 GROUP BY 1, 2""")
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.text_edges(_benchmark_cosines(spark, sf_dir))


_CASES = """SELECT * FROM (VALUES (1, 1, 'fever and chest pain, took aspirin daily'), (2, 1, 'chest pain again and cough, aspirin stopped'), (3, 2, 'broken wrist, no fever'), (4, 2, 'wrist healed, aspirin for pain'), (5, 3, 'nothing to report')) AS t(doc_id, cluster, text)"""
_VOCAB = "SELECT * FROM (VALUES ('sym:fever', 3, 'fever'), ('sym:chest', 3, 'chest pain'), ('dx:wrist', 2, 'wrist'), ('rx:aspirin', 1, 'aspirin')) AS t(tag, weight, term)"


@query(f"""WITH d AS ({_CASES}), vo AS ({_VOCAB}), t AS (SELECT doc_id, tag, weight FROM d, vo WHERE regexp_matches(text, '\\b' || term || '\\b')),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight) AS bo FROM t x JOIN t y USING (tag) GROUP BY 1, 2), s AS (SELECT doc_id, sum(weight) AS s FROM t GROUP BY 1)
SELECT a, b, round(bo::DOUBLE / (x.s + y.s - bo), 6) AS facet FROM p JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id""")
def facet_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = retrieval.tags(spark.sql(_CASES), spark.sql(_VOCAB))
    return retrieval.facet_jaccard(held, held).withColumn("facet", F.round("facet", 6))


_HYBRID = f"""WITH cases AS ({_CASES}), vocab AS ({_VOCAB}), {_tfidf_sql('cases', 'doc_id')},
t AS (SELECT doc_id, tag, weight FROM cases, vocab WHERE regexp_matches(text, '\\b' || term || '\\b')),
s AS (SELECT doc_id, sum(weight) AS s FROM t GROUP BY 1),
f AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight)::DOUBLE AS bo FROM t x JOIN t y USING (tag) GROUP BY 1, 2),
j AS (SELECT a, b, bo / (x.s + y.s - bo) AS facet FROM f JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id),
c AS (SELECT x.id AS a, y.id AS b, sum(x.w / x.norm * (y.w / y.norm)) AS cos FROM v x JOIN v y USING (term) WHERE x.id <> y.id GROUP BY 1, 2),
h AS (SELECT c.a, c.b, CASE WHEN c.a IN (SELECT doc_id FROM s) AND c.b IN (SELECT doc_id FROM s) THEN 0.5 * cos + 0.5 * coalesce(facet, 0) ELSE cos END AS score FROM c LEFT JOIN j ON c.a = j.a AND c.b = j.b),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM h)"""


def _hybrid(spark: SparkSession) -> DataFrame:
    docs = spark.sql(_CASES)
    v, tagged = _vectors(docs, "doc_id"), retrieval.tags(docs, spark.sql(_VOCAB))
    has = tagged.select("doc_id").distinct()
    pairs = retrieval.cosines(v, v).where("a != b").join(retrieval.facet_jaccard(tagged, tagged), ["a", "b"], "left")
    both = pairs.join(has.select(F.col("doc_id").alias("a"), F.lit(True).alias("ha")), "a", "left").join(has.select(F.col("doc_id").alias("b"), F.lit(True).alias("hb")), "b", "left")
    return both.select("a", "b", retrieval.hybrid(F.col("cos"), F.col("facet"), F.coalesce(F.col("ha") & F.col("hb"), F.lit(False))).alias("cos"))


@query(f"{_HYBRID} SELECT a, b, CAST(rn AS INT) AS rank, round(score, 6) AS score FROM r WHERE rn <= 3")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank(_hybrid(spark), 3).select("a", "b", "rank", F.round("cos", 6).alias("score"))


@query(f"{_HYBRID} SELECT count(*) AS n, avg(CASE WHEN x.cluster = y.cluster THEN 1.0 ELSE 0.0 END)::DOUBLE AS p_at_k, avg(CASE WHEN x.cluster = y.cluster THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1 FROM r JOIN cases x ON a = x.doc_id JOIN cases y ON b = y.doc_id WHERE rn = 1")
def precision_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.sql(_CASES).select("doc_id", "cluster")
    ranked = retrieval.rank(_hybrid(spark), 1).join(cases.withColumnsRenamed({"doc_id": "a", "cluster": "ca"}), "a").join(cases.withColumnsRenamed({"doc_id": "b", "cluster": "cb"}), "b")
    return retrieval.precision_at(ranked, F.col("ca") == F.col("cb"), 1)


@query("""WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{6,}'))) AS items FROM conversations),
l AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY conv_id ORDER BY turn), []) AS was FROM t)
SELECT conv_id, turn, len(list_filter(items, lambda x: NOT list_contains(was, x))) AS n_added, len(list_filter(was, lambda x: NOT list_contains(items, x))) AS n_dropped FROM l""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each turn of a conversation adds to, and drops from, the turn before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{6,}"), 0))).alias("items"))
    told = retrieval.trajectories(turns, "conv_id", "turn", "items")
    return told.select("conv_id", "turn", F.size("added").cast("long").alias("n_added"), F.size("dropped").cast("long").alias("n_dropped"))


# --- citations --------------------------------------------------------------------------------------------------

FX_CITES = """SELECT * FROM (VALUES
 (1, 'See Alpha v. Beta, 477 U.S. 242, 106 S.Ct. 2505, 91 L.Ed.2d 202 (1986). But see Gamma, 12 F.3d 34 (1999). Also [2019] SGCA 12.'),
 (2, 'As held in 106 S. Ct. 2505, and in 12 F.3d 34, overruled by Delta, 500 U.S. 1 (2001).'),
 (3, 'Compare 477 U.S. 242 with [2019] SGCA 12 and [2005] 2 SLR(R) 123; cert. denied, 522 U.S. 1061.'),
 (4, 'A lease with no authority at all, $500.')) AS t(doc_id, text)"""
_CITED = """SELECT * FROM (VALUES (1, '477 U.S. 242'), (1, '106 S.Ct. 2505'), (1, '91 L.Ed.2d 202'), (1, '12 F.3d 34'), (1, '[2019] SGCA 12'),
 (2, '106 S.Ct. 2505'), (2, '12 F.3d 34'), (2, '500 U.S. 1'), (3, '477 U.S. 242'), (3, '[2019] SGCA 12'), (3, '[2005] 2 SLR(R) 123'), (3, '522 U.S. 1061')) AS t(doc_id, cite)"""


@query(_CITED)
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of made-up texts in canonical form; the SQL has the answers as given."""
    return citations.citations(spark.sql(FX_CITES)).select("doc_id", "cite")


@query("SELECT * FROM (VALUES (1, 1, 3, false), (1, 2, 1, false), (1, 3, 1, false), (2, 1, 1, false), (2, 2, 1, false), (2, 3, 1, false), (3, 1, 1, false), (3, 2, 1, false), (3, 3, 1, false), (3, 4, 1, true)) AS t(doc_id, run, n, cert)")
def citation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.runs(spark.sql(FX_CITES)).select("doc_id", F.col("run").cast("int").alias("run"), F.size("cites").alias("n"), "cert")


@query("SELECT * FROM (VALUES (1, 1, 'support', 'see'), (1, 2, 'contrary', 'but see'), (2, 3, 'treating', 'overruled'), (3, 1, 'neutral', 'compare')) AS t(doc_id, run, cls, token)")
def citation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(FX_CITES)
    return citations.signals(docs, citations.runs(docs)).select("doc_id", F.col("run").cast("int").alias("run"), "cls", "token")


@query("SELECT * FROM (VALUES ('477 U.S. 242', '106 S.Ct. 2505', '477 U.S. 242'), ('106 S.Ct. 2505', '106 S.Ct. 2505', '477 U.S. 242'), ('91 L.Ed.2d 202', '106 S.Ct. 2505', '477 U.S. 242'), ('12 F.3d 34', '12 F.3d 34', '12 F.3d 34'), ('[2019] SGCA 12', '[2019] SGCA 12', '[2019] SGCA 12'), ('500 U.S. 1', '500 U.S. 1', '500 U.S. 1'), ('[2005] 2 SLR(R) 123', '[2005] 2 SLR(R) 123', '[2005] 2 SLR(R) 123'), ('522 U.S. 1061', '522 U.S. 1061', '522 U.S. 1061')) AS t(cite, root, display)")
def authority_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.authorities(citations.runs(spark.sql(FX_CITES)))


def _cited(spark: SparkSession) -> DataFrame:
    found = citations.runs(spark.sql(FX_CITES))
    return citations.doc_authorities(found, citations.authorities(found))


_ROOTS = f"WITH ci AS (SELECT DISTINCT doc_id, CASE WHEN cite IN ('477 U.S. 242', '106 S.Ct. 2505', '91 L.Ed.2d 202') THEN '106 S.Ct. 2505' ELSE cite END AS root FROM ({_CITED})), df AS (SELECT root, ln(4.0::DOUBLE / count(*)) AS idf FROM ci GROUP BY 1)"


@query(f"{_ROOTS} SELECT x.doc_id AS a, y.doc_id AS b, round(sum(idf), 2) AS w, count(*) AS n_shared FROM ci x JOIN ci y USING (root) JOIN df USING (root) WHERE x.doc_id < y.doc_id GROUP BY 1, 2")
def authority_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.authority_edges(_cited(spark), 4).drop("raw")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine pairs of the benchmark passages, with made-up authority and citation weights from their ids."""
    r, c = ((F.col("a") + F.col("b")) % 5).cast("double"), F.when((F.col("a") * 7 + F.col("b")) % 11 == 0, 1).otherwise(0)
    return _benchmark_cosines(spark, sf_dir).select("a", "b", F.round("cos", 6).alias("t"), r.alias("r"), c.alias("c"))


_SYN = f"""{_COS}, pa AS (SELECT a, b, round(cos, 6) AS t, CAST((a + b) % 5 AS DOUBLE) AS r, CASE WHEN (a * 7 + b) % 11 = 0 THEN 1 ELSE 0 END AS c FROM c),
bo AS (SELECT a AS holder, b AS cand, t, r, c FROM pa UNION ALL SELECT b, a, t, r, c FROM pa),
nn AS (SELECT count(*) AS n FROM benchmark),
me AS (SELECT cand, sum(t) / (max(n) - 1) AS mt, sum(r) / (max(n) - 1) AS mr FROM bo, nn GROUP BY cand),
gl AS (SELECT sum(mt) / max(n) AS gt, sum(mr) / max(n) AS gr FROM me, nn)"""


def _synergy_sql(t: str, r: str) -> str:
    return f"""{_SYN}, ad AS (SELECT holder, cand, c, {t} AS xt, {r} AS xr FROM bo JOIN me USING (cand), gl),
mx AS (SELECT max(c) AS mc, max(xt) AS mxt, max(xr) AS mxr FROM ad),
sc AS (SELECT holder, cand, round(3.0::DOUBLE * CASE WHEN mc > 0 THEN c / mc::DOUBLE ELSE 0 END + 2.0::DOUBLE * CASE WHEN mxt > 0 THEN xt / mxt ELSE 0 END + 1.0::DOUBLE * CASE WHEN mxr > 0 THEN xr / mxr ELSE 0 END, 3) AS score FROM ad, mx),
ra AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY score DESC, cand) AS rn FROM sc WHERE score > 0)"""


_LIFT = _synergy_sql("CASE WHEN mt + gt > 0 THEN t / (mt + gt) ELSE 0 END", "CASE WHEN mr + gr > 0 THEN r / (mr + gr) ELSE 0 END")


@query(f"{_LIFT} SELECT holder, cand, score, CAST(rn AS INT) AS rank FROM ra WHERE rn <= 12")
def synergy_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return citations.synergy(_pairs(spark, sf_dir), nodes, "lift")


@query(f"{_synergy_sql('greatest(0.0, t - mt)', 'greatest(0.0, r - mr)')} SELECT holder, cand, score, CAST(rn AS INT) AS rank FROM ra WHERE rn <= 12")
def synergy_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return citations.synergy(_pairs(spark, sf_dir), nodes, "sub")


@query(f"""{_LIFT}, sd AS (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3),
be AS (SELECT cand, score, holder AS via, row_number() OVER (PARTITION BY cand ORDER BY score DESC, holder) AS o FROM ra WHERE rn <= 12 AND holder IN (FROM sd) AND cand NOT IN (FROM sd))
SELECT cand, score, via FROM be WHERE o = 1 ORDER BY score DESC, cand LIMIT 12""")
def synergy_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select(F.col("item_id").alias("id"))
    return citations.for_seeds(synergy_lift(spark, sf_dir), seeds)


@query("SELECT * FROM (VALUES (2, '[2019] SGCA 12', CAST(2 AS BIGINT), 1), (3, '12 F.3d 34', CAST(2 AS BIGINT), 1)) AS t(doc_id, root, n, rank)")
def missing_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark)
    lists = spark.sql("SELECT * FROM (VALUES (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)) AS t(holder, cand)")
    return citations.missing_authorities(cited, lists, 4)


_EDGES = f"""{_COS}, s AS (SELECT a, b, cos FROM c UNION ALL SELECT b, a, cos FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS rn FROM s),
ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(cos), 3) AS w FROM r WHERE rn <= 3 AND cos >= 0.05 GROUP BY 1, 2),
sd AS (SELECT id, sum(w) / (SELECT max(w) FROM ed) AS strength, count(*) AS degree FROM (SELECT a AS id, w FROM ed UNION ALL SELECT b, w FROM ed) GROUP BY id),
st AS (SELECT item_id AS id, coalesce(strength, 0.0) AS strength, coalesce(degree, 0) AS degree FROM benchmark LEFT JOIN sd ON item_id = id)"""


def _strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return citations.strengths(nodes, text_edges(spark, sf_dir).withColumn("type", F.lit("text")))


@query(f"{_EDGES} SELECT id, round(strength, 4) AS strength, degree FROM st")
def graph_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strengths(spark, sf_dir).withColumn("strength", F.round("strength", 4))


@query(f"{_EDGES}, o AS (SELECT strength, row_number() OVER (ORDER BY strength) AS i, count(*) OVER () AS n FROM st) SELECT round(sum((2 * i - n - 1) * strength) / (max(n) * sum(strength)), 5) AS gini FROM o")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.gini(_strengths(spark, sf_dir), "strength").withColumn("gini", F.round("gini", 5))


# --- scores -----------------------------------------------------------------------------------------------------


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mails = spans.find(docs, rules.EMAIL).select("doc_id", "span", F.lit("DIRECT").alias("identifier_type"))
    first = docs.select("doc_id", F.regexp_extract("text", r"[A-Za-z]{5,}", 0).alias("span"), F.lit("NO_MASK").alias("identifier_type")).where("span != ''")
    return mails.union(first).distinct()


_LEAK = f"""WITH em AS (SELECT DISTINCT doc_id, unnest({_found('text', rules.EMAIL)}) AS span, 'DIRECT' AS ty FROM documents),
fi AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]{{5,}}') AS span, 'NO_MASK' AS ty FROM documents WHERE regexp_extract(text, '[A-Za-z]{{5,}}') <> ''),
go AS (SELECT * FROM em UNION SELECT * FROM fi),
te AS (SELECT doc_id, text AS o, {_floor_sql('text')} AS m FROM documents),
sp AS (SELECT g.doc_id, g.ty, o, m, CASE WHEN regexp_matches(span, '^\\w') THEN '\\b' ELSE '' END || regexp_replace(span, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') || CASE WHEN regexp_matches(span, '\\w$') THEN '\\b' ELSE '' END AS p FROM go g JOIN te USING (doc_id)),
oc AS (SELECT doc_id, ty, len(regexp_extract_all(o, p)) > 0 AS inside, len(regexp_extract_all(m, p)) > 0 AS remains FROM sp),
ds AS (SELECT doc_id, count(*) FILTER (inside AND ty = 'DIRECT') AS direct, count(*) FILTER (inside AND remains AND ty = 'DIRECT') AS direct_leaked,
  count(*) FILTER (inside AND ty = 'NO_MASK') AS no_mask, count(*) FILTER (inside AND remains AND ty = 'NO_MASK') AS preserved, count(*) FILTER (NOT inside) AS unmatchable FROM oc GROUP BY doc_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(scoring.leaks(_gold(spark, sf_dir), table(spark, sf_dir, "documents"), floor_mask(spark, sf_dir)))


@query(f"{_LEAK} SELECT doc_id, direct, direct_leaked, no_mask, preserved, unmatchable, direct_leaked = 0 AS gate FROM ds")
def leak_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails as DIRECT gold and each document's first long word as NO_MASK, against the floor's output."""
    return _scored(spark, sf_dir).select("doc_id", "direct", "direct_leaked", "no_mask", "preserved", "unmatchable", "gate")


@query(f"{_LEAK} SELECT count(*) AS docs, 1 - sum(direct_leaked)::DOUBLE / greatest(sum(direct), 1) AS direct_recall, 1.0::DOUBLE AS quasi_recall, sum(preserved)::DOUBLE / greatest(sum(no_mask), 1) AS preservation, avg(CASE WHEN direct_leaked = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS gate_rate, CAST(sum(unmatchable) AS BIGINT) AS unmatchable FROM ds")
def leak_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.board(_scored(spark, sf_dir))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS agreed, count(*) FILTER (quality = 1 - toxic)::DOUBLE / count(*) AS share FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("_k", 1 - F.col("toxic"))
    return scoring.agreement(pairs, "source", "quality", "_k")


FX_GOLD = "SELECT * FROM (VALUES (1, 'jane', 'QUASI'), (1, 'jane', 'DIRECT'), (1, 'oslo', 'NO_MASK'), (1, 'oslo', 'QUASI'), (2, 'jane', 'NO_MASK')) AS t(doc_id, span, identifier_type)"


@query("SELECT * FROM (VALUES (1, 'jane', 'DIRECT'), (1, 'oslo', 'QUASI'), (2, 'jane', 'NO_MASK')) AS t(doc_id, span, identifier_type)")
def severity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.strictest(spark.sql(FX_GOLD), "doc_id", "span")


_LABELS = ("organ", "government", "court", "company", "other")


@query(f"""WITH x AS (SELECT CASE s % 5 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_LABELS))} END AS label, s % 5 AS bit, quality = 1 AS k FROM
  (SELECT CAST(regexp_extract(source, '[0-9]+') AS INT) AS s, quality FROM documents JOIN labels USING (doc_id)))
SELECT CAST(p AS BIGINT) AS policy, CAST(count(*) FILTER ((p >> bit) & 1 = 1) AS BIGINT) AS kept, CAST(count(*) FILTER (((p >> bit) & 1 = 1) = k) AS BIGINT) AS "right" FROM x, range(32) g(p) GROUP BY p""")
def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 keep policies over five labels, against a verdict."""
    s = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 5
    ents = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, _LABELS)), s).alias("label")).join(table(spark, sf_dir, "labels"), "doc_id").select("label", (F.col("quality") == 1).alias("should_keep"))
    return scoring.policy_grid(ents, _LABELS)


_HARD = f"SELECT doc_id, words, density FROM ({_density_sql()})"


@query(f"WITH h AS ({_HARD}) SELECT doc_id, words, density, round(1.0 * (words - (SELECT min(words) FROM h))::DOUBLE / (SELECT max(words) - min(words) FROM h) + 2.0 * (density - (SELECT min(density) FROM h)) / (SELECT max(density) - min(density) FROM h), 3) AS hardness FROM h")
def hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.min_max(density(spark, sf_dir).select("doc_id", "words", "density"), {"words": 1.0, "density": 2.0})


@query(f"WITH h AS ({_HARD}), o AS (SELECT words, row_number() OVER (ORDER BY words) - 1 AS i, count(*) OVER () AS n FROM h) SELECT words AS value FROM o WHERE i = floor(0.5 * (n - 1))")
def index_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quantile(density(spark, sf_dir), "words", 0.5)


# --- walks over a text ------------------------------------------------------------------------------------------


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.chunks(table(spark, sf_dir, "documents"))


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.sentences(table(spark, sf_dir, "documents"))


@query()
def capital_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.nominate_runs(table(spark, sf_dir, "documents"))


@query()
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.placements(table(spark, sf_dir, "documents"), entity_table(spark, sf_dir))


FX_OPINION = """SELECT * FROM (VALUES
 (1, 'The appellant sued his former employer in 1999, and the district court entered summary judgment for the employer on every claim that he had raised. He appeals. We affirm the judgment in part and reverse in part.'),
 (2, 'If the findings are not clearly erroneous, we affirm. The U.S. position is noted.'),
 (3, 'The order of the district court is hereby vacated.')) AS t(doc_id, text)"""


@query("SELECT * FROM (VALUES (1, 'We affirm the judgment in part and reverse in part.', 'mixed', NULL), (2, NULL, NULL, 'no-operative-disposition-found'), (3, 'The order of the district court is hereby vacated.', 'disturbed', NULL)) AS t(doc_id, disposition, outcome, disposition_reason)")
def opinion_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of made-up opinions; the SQL has the answers as given."""
    return facets.facets(spark.sql(FX_OPINION)).select("doc_id", "disposition", "outcome", "disposition_reason")


@query()
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.paragraphs(table(spark, sf_dir, "documents"))


FX_SHAPES = "SELECT * FROM (VALUES (1, 'On 3 May 2004 he paid EUR 1,200 under the Data Act 1998, aged 44, in 2001, no. 345/02.')) AS t(doc_id, text)"


@query("SELECT * FROM (VALUES ('3 May', '[Date]'), ('3 May 2004', '[Date]'), ('May 2004', '[Date]'), ('May 20', '[Date]'), ('2004', '[Date]'), ('2001', '[Date]'), ('EUR 1,200', '[Amount]'), ('aged 44', '[Age]'), ('345/02', '[Code]')) AS t(span, tag) WHERE span <> 'May 20'")
def shape_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.shape_regions(spark.sql(FX_SHAPES)).select("span", "tag")


# --- review -----------------------------------------------------------------------------------------------------

_URLS = """SELECT * FROM (VALUES (-1, 'http://user@LOCALHOST:80/x'), (-2, 'https://[::1]:8443/'), (-3, 'data:text/plain,x'), (-4, 'ipc://x'), (-5, 'no address'), (-6, 'http://a.localhost:3'), (-7, CAST(NULL AS VARCHAR(9)))) AS t(page_id, url)"""


@query(f"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM (SELECT page_id, url FROM pages UNION ALL {_URLS})),
a AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', '')) AS h FROM u),
b AS (SELECT *, regexp_replace(h, ':[0-9]*$', '') AS host, CASE WHEN s = 'http' AND h LIKE '%:80' OR s = 'https' AND h LIKE '%:443' THEN regexp_replace(h, ':[0-9]*$', '') ELSE regexp_replace(h, ':$', '') END AS p FROM a)
SELECT page_id, CASE WHEN s IN ('blob', 'data', 'about', 'javascript', 'tauri', 'ipc', 'asset') THEN 'app' WHEN host = '' THEN 'offmachine' WHEN host IN ('127.0.0.1', 'localhost', '[::1]', '::1', '0:0:0:0:0:0:0:1') OR host LIKE '%.localhost' THEN 'loopback' ELSE 'offmachine' END AS cls,
CASE WHEN s IN ('blob', 'data', 'about', 'javascript') THEN 'in-page' WHEN s IN ('tauri', 'ipc', 'asset') THEN s || ':' WHEN host = '' THEN 'unparseable: ' || left(u, 40) ELSE p END AS place FROM b""")
def net_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address leaves the machine, by what is written: all pages and planted addresses."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url").union(spark.sql(_URLS))
    return urls.select("page_id", review.net_class(F.col("url")).alias("n")).select("page_id", "n.*")


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\s*\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS b,
list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(CASE WHEN len(b) > 1 THEN b ELSE l END) AS INT) AS n, md5(array_to_string(CASE WHEN len(b) > 1 THEN b ELSE l END, '|')) AS digest FROM p""")
def paragraph_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", review.paragraphs(F.col("text")).alias("p"))
    return cut.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


def _shape_cases() -> str:
    return " ".join(f"WHEN regexp_matches(c, {sql_string(re2(p, flags))}) THEN '{name}'" for name, p, flags in review.CONTENT_SHAPES)


_CONTENTS = "SELECT * FROM (VALUES (-1, '$1,200'), (-2, '5%'), (-3, '3 May 2004'), (-4, '30 days'), (-5, 'Jane Roe'), (-6, '12345-AB'), (-7, 'the Big thing'), (-8, '12.5'), (-9, '')) AS t(doc_id, c)"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents UNION ALL {_CONTENTS}),
n AS (SELECT doc_id, trim(regexp_replace(c, {sql_string(re2(chr(92) + 's+'))}, ' ', 'g')) AS c FROM l)
SELECT shape, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, CASE WHEN length(c) > 300 THEN 'long_passage' {_shape_cases()} WHEN regexp_matches(c, '[A-Z][a-z]') AND len(string_split(c, ' ')) <= 6 THEN 'short_phrase' ELSE 'other_text' END AS shape FROM n) GROUP BY shape""")
def content_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, and planted passages, by shape."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("c")).union(spark.sql(_CONTENTS))
    return lines.select("doc_id", review.content_shape(F.col("c")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT source, count(*) AS total, count(*) FILTER (toxic = 0 AND quality = 1) AS decided, count(*) FILTER (toxic = 1) AS waiting, count(*) FILTER (toxic = 0 AND quality <> 1) AS standing
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def review_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source; a toxic one waits, one of quality is decided."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return review.tally(rows.select("source", F.when(F.col("toxic") == 1, "pending").alias("status"), (F.col("quality") == 1).alias("decided")), "source")


@query(f"{_TABLE}, s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._-]+@[A-Za-z0-9.]+|[A-Z][a-z]+')) AS span FROM documents) SELECT s.doc_id, s.span FROM s WHERE NOT EXISTS (SELECT 1 FROM et WHERE et.doc_id = s.doc_id AND lower(et.span) = lower(s.span))")
def live_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words and address-like ones that the entity table doesn't cover."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+@[A-Za-z0-9.]+|[A-Z][a-z]+"), 0)).alias("span")).distinct()
    return review.live_suspects(found, entity_table(spark, sf_dir))


@query(f"""{_TABLE}, n AS (SELECT et.*, source FROM et JOIN documents USING (doc_id))
SELECT lower(span) AS low, cls, count(DISTINCT doc_id) AS n_docs FROM n GROUP BY 1, 2 HAVING bool_or(contains(lower(span), 'an') OR contains(lower(source), 'an'))""")
def find_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with "an" in their text, or in the name of a source that has them."""
    named = entity_table(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return review.search(named, "an", "source")


_LETTERS = """SELECT * FROM (VALUES (-1, 'Case : Roe v Poe
COURT: High Court
Date:2004'), (-2, 'matter: Vale lease
Doc: Memo'), (-3, CAST(NULL AS VARCHAR(9)))) AS t(doc_id, text)"""


@query("SELECT doc_id, " + ", ".join(f"nullif(trim(regexp_extract(coalesce(text, ''), '(?im)^{n}[ \\t]*:[ \\t]*([^\\n]+)', 1)), '') AS \"{n}\"" for n in review.HEADERS) + f" FROM (SELECT doc_id, text FROM documents UNION ALL {_LETTERS})")
def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.sql(_LETTERS))
    return docs.select("doc_id", review.headers(F.col("text")).alias("h")).select("doc_id", "h.*")


# --- legal rails ------------------------------------------------------------------------------------------------

#: Planted beside the documents, so that every rail has something to find.
LEGAL = """SELECT * FROM (VALUES
 (-1, 'THE FACTS
The applicant lived in Leeds for three months and worked as a truck driver. His wife, Bo, got 12,500 and two witnesses spoke. It was six months imprisonment, Jan. 3, 2004, thirty (30) days, a 10-day stay, 40,000 shares and 450 grams of heroin. Bo’s brother was in his 40s, 44 years old.'),
 (-2, 'Application (no. 1520/06) against Poland lodged in 2006. See Kudla v. Poland, no. 30210/96, and 812/03, § 40. The victim told her mother. A mother wept near Court. They went from Leeds in Article 5 to Oslo.'),
 (-3, 'Chan Chee Yong “Derek” came. DEREK did not, but Derek and the Dereks did, and Der-ek’s friend. The account number ending in 4885 was closed; the 4885 account and 14885 were not. She is known as “Coffey”, and Cof-feys came. ABC-12345-2019 is a code; Roman Catholic and Hokkien.'),
 (-4, CAST(NULL AS VARCHAR(9))), (-5, '')) AS t(doc_id, text)"""


def _legal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.sql(LEGAL))


_LD = f"d AS (SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, text FROM documents UNION ALL {LEGAL}))"


def _rule_sql(r: legal_rules.Rule) -> str:
    cut = f"regexp_extract(m.w, {sql_string(re2(r.pattern, r.flags))}, 1)" if r.last else "m.w"
    return f"SELECT doc_id, CAST(m.s + length(m.w) - length({cut}) AS INT) AS start, CAST(m.s + length(m.w) AS INT) AS \"end\", {cut} AS span, '{r.tag}' AS tag, '{r.pack}' AS rail FROM (SELECT doc_id, unnest({_spans_sql('text', r.pattern, r.flags)}) AS m FROM d)"


@query(f"WITH {_LD} " + " UNION ".join(_rule_sql(r) for r in legal_rules.PACKS))
def legal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pack that asks nothing of its surroundings, over the documents and planted ones."""
    return legal.shapes(_legal_docs(spark, sf_dir), tuple({r.pack for r in legal_rules.PACKS}), protect=False)


def _guarded_sql() -> str:
    say = lambda p, flags="": sql_string(re2(p, flags))
    of = {r.pack: r for r in legal_rules.GUARDED}
    before = lambda n: f"substr(text, greatest(0, start - {n}) + 1, least({n}, start))"
    places = ", ".join(map(sql_string, legal_rules.NO_PLACE))
    own, precedent, after = say(legal_rules.OWN_NUMBER, "i"), say(legal_rules.PRECEDENT_BEFORE), say(legal_rules.PRECEDENT_AFTER)
    return f"""WITH {_LD}, a AS ({_rule_sql(of['app-number'])}), r AS ({_rule_sql(of['relational'])}), p AS ({_rule_sql(of['L9w'])})
SELECT DISTINCT a.* FROM a JOIN d USING (doc_id) WHERE regexp_matches({before(60)}, {own}) OR NOT (regexp_matches({before(60)}, {precedent}) OR regexp_matches(substr(text, "end" + 1, 6), {after}))
UNION ALL SELECT DISTINCT r.* FROM r JOIN d USING (doc_id) WHERE regexp_matches({before(30)}, {say(legal_rules.RELATIONAL_ANCHOR, 'i')})
UNION ALL SELECT DISTINCT p.* FROM p WHERE span NOT IN ({places})"""


@query(_guarded_sql())
def legal_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application numbers that are no precedent's, kin of somebody, and places after a preposition."""
    return legal.shapes(_legal_docs(spark, sf_dir), ("app-number", "relational", "L9w"), protect=False)


def _names_sql() -> str:
    edge = sql_string(r"\b")
    nominated = " UNION ".join(
        f"SELECT doc_id, '{n.rail}' AS rail, '{n.tag}' AS tag, unnest({_found('text', n.pattern, n.flags, 1)}) AS name FROM d" for n in legal_rules.NOMINATORS
    )
    stop = ", ".join(map(sql_string, legal_rules.NICKNAME_STOP))
    tail, gap = sql_string(r"(?:e?s)?(?:[’']s?)?\b"), sql_string("(?:-" + re2(r"\s") + "{0,2})?")
    rule = f"CASE WHEN tag = '[Id]' THEN {edge} || name || {edge} WHEN length(name) >= 4 THEN {edge} || array_to_string(string_split(name, ''), {gap}) || {tail} ELSE {edge} || name || {tail} END"
    located = _spans_sql("text", "@").replace(sql_string("@"), "rule")
    return f"""WITH {_LD}, n AS (SELECT *, {rule} AS rule FROM ({nominated}) WHERE NOT (rail = 'nickname' AND name IN ({stop}))),
f AS (SELECT doc_id, tag, rail, unnest({located}) AS m FROM n JOIN d USING (doc_id))
SELECT DISTINCT doc_id, CAST(m.s AS INT) AS start, CAST(m.s + length(m.w) AS INT) AS "end", m.w AS span, tag, rail FROM f"""


@query(_names_sql())
def legal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and account fragments that a document gives once, wherever else it has them."""
    return legal.names(_legal_docs(spark, sf_dir), tuple(n.rail for n in legal_rules.NOMINATORS))


FX_VETO = "SELECT * FROM (VALUES ('his wife', 'kinship'), ('the family', 'kinship'), ('Czech Republic', 'institutional'), ('the soldiers', 'role-term'), ('elected judge', 'court-official'), ('Supreme Court', 'institutional'), ('Person3', 'tag-word'), ('one two three four five six seven', 'footprint'), ('Jane Roe', NULL)) AS t(span, reason)"


_VETO_CASES = " ".join(f"WHEN regexp_matches(span, {sql_string(re2(p, flags))}) THEN '{reason}'" for reason, p, flags in policies.VETOES)


@query(f"""SELECT span, CASE WHEN len(regexp_split_to_array(span, {sql_string(re2(chr(92) + 's+'))})) > {policies.SPAN_WORDS} THEN 'footprint' {_VETO_CASES} END AS reason
FROM (SELECT span FROM ({FX_VETO}) UNION SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [a-z]+)?')) FROM documents)""")
def keep_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted spans and all capitalised words of the documents, each with the word after it."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [a-z]+)?"), 0)).alias("span"))
    every = spark.sql(FX_VETO).select("span").union(found).distinct()
    return every.select("span", policies.keep_veto(F.col("span")).alias("reason"))


@query("SELECT * FROM (VALUES ('Court of Vale''s', 'court', true), ('Acme', 'company', false), ('Vale Org', 'other', false)) AS t(span, label, restored)")
def restore_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES (1, \"Court of Vale's\", 'COMPANY'), (1, 'Acme', 'COMPANY'), (1, 'Vale Org', 'COMPANY')) AS t(doc_id, span, cls)")
    verdicts = spark.sql("SELECT * FROM (VALUES ('court of vale', 'court'), ('acme', 'company')) AS t(low, label)")
    return policies.restore(rows, verdicts, ("court", "government")).select("span", "label", "restored")


FX_GATE = "SELECT * FROM (VALUES (1, false, true, true, true, 3, 0, CAST(NULL AS STRING), 0, ''), (2, false, false, false, true, 3, 3, 'x', 1, 'unreviewed,incomplete,nothing-kept,divergence,holds'), (3, true, false, false, false, 0, 0, NULL, 0, 'not-verified')) AS t(doc_id, sample, reviewed, complete, verified, rows, dead, divergence, holds, told)"


@query(f"SELECT doc_id, told AS reasons, told <> '' AS blocked FROM ({FX_GATE})")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.release_gate(spark.sql(FX_GATE)).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "blocked")


# --- audits -----------------------------------------------------------------------------------------------------


@query(f"{_COS}, o AS (SELECT a, b, cos FROM c UNION ALL SELECT b, a, cos FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS rn FROM o), l AS (SELECT x.item_id AS a, y.item_id AS b FROM benchmark x, benchmark y WHERE x.item_id <> y.item_id AND (x.item_id + y.item_id) % 7 = 0), e AS (SELECT l.a, coalesce(1.0::DOUBLE / min(rn), 0.0) AS rr, count(*) FILTER (rn <= 10)::DOUBLE / count(*) AS f FROM l LEFT JOIN r ON l.a = r.a AND l.b = r.b GROUP BY l.a) SELECT count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(f), 6) AS recall FROM e")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean inverse rank and recall of a made-up relevance (ids that add up to a multiple of 7) under text similarity."""
    cos = _benchmark_cosines(spark, sf_dir)
    ranked = retrieval.rank(cos.union(cos.select("b", "a", "cos")), 1 << 30)
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), (F.col("item_id") % 7).alias("r"))
    relevant = ids.join(ids.select(F.col("a").alias("b"), ((7 - F.col("r")) % 7).alias("r")), "r").where("a != b").select("a", "b")
    return audit.ranking_quality(ranked, relevant).select("n", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


@query(f"WITH r AS (SELECT DISTINCT doc_id, s, e, tag AS rule FROM ({_R})), k AS ({_K}) SELECT rule, count(*) AS nominated, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND r.s < k.e AND r.e > k.s)) AS on_gold FROM r GROUP BY rule")
def rule_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rule_board(_regions(spark, sf_dir).withColumnRenamed("tag", "rule"), _keep(spark, sf_dir))


@query("SELECT lang, source AS name, 'Person ' || CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE CAST(n AS VARCHAR) END AS alias FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS n FROM (SELECT DISTINCT lang, source FROM documents))")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("name")).distinct()
    return audit.aliases(names, "lang")


@query("SELECT o_orderkey, o_custkey, 'missing' AS side FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'surplus' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0")
def out_of_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without every seventh but with every eleventh once more, against orders: what each side lacks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return audit.out_of_step(orders.where("o_orderkey % 7 != 0").union(orders.where("o_orderkey % 11 = 0")), orders)


@query()
def marker_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.marker_sites(table(spark, sf_dir, "documents"))


@query()
def probe_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.probe_phrases(table(spark, sf_dir, "documents"))


@query()
def encoded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct long tokens of the documents that look encoded."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{16,}"), 0)).alias("token")).distinct()
    return tokens.where(audit.encoder_shaped(F.col("token")))


# --- intake and comparison --------------------------------------------------------------------------------------

FX_BYTES = "SELECT * FROM (VALUES ('a.docx', '504B030414', 'docx', 'docx'), ('b.xlsx', '504B030414', 'xlsx', 'refuse'), ('c.zip', '504B050600', 'zip', 'refuse'), ('d.txt', '504B4B', 'txt', 'text'), ('e.pdf', '255044462D312E', 'pdf', 'pdf'), ('f.doc', 'D0CF11E0A1', 'doc-legacy', 'refuse'), ('g.msg', 'D0CF11E0A1', 'msg', 'refuse'), ('h.txt', '789F3E2201', 'tnef', 'refuse'), ('i.txt', '7B5C72746631', 'rtf', 'refuse'), ('j.eml', '46726F6D', 'eml', 'refuse'), ('k.bin', '0001', 'binary', 'refuse'), ('l', '48656C6C6F', 'text', 'text')) AS t(name, bytes, fmt, route)"


@query(f"SELECT name, fmt AS format, route FROM ({FX_BYTES})")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.detect(F.unhex("bytes"), F.col("name"))
    return spark.sql(FX_BYTES).select("name", found.alias("f")).select("name", "f.format", "f.route")


@query()
def content_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", intake.content_hold(F.col("text")).alias("hold"))


FX_CSV = "SELECT * FROM (VALUES (1, 'a,b,c' || chr(10) || '1,\"x,y\",3' || chr(10)), (2, ''), (3, 'one')) AS t(id, text)"


@query("SELECT * FROM (VALUES (1, '3,3'), (2, '1'), (3, '1')) AS t(id, shape) WHERE id <> 2 UNION ALL SELECT 2, ''")
def csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_CSV).select("id", F.array_join(intake.csv_shape(F.col("text")).cast("array<string>"), ",").alias("shape"))


FX_TOPICS = "SELECT * FROM (VALUES ('articles', 'the', 3), ('articles', 'and', 1), ('deutsch', 'der', 2), ('deutsch', 'und', 1), ('francais', 'le', 2), ('francais', 'de', 2)) AS t(topic, keyword, least)"


@query(f"""WITH k AS ({FX_TOPICS}), h AS (SELECT doc_id, topic, least, len(regexp_extract_all(lower(text), '\\b' || keyword || '\\b')) AS h FROM documents, k),
s AS (SELECT doc_id, topic, sum(h::DOUBLE / least) AS sc FROM h GROUP BY 1, 2 HAVING min(CASE WHEN h >= least THEN 1 ELSE 0 END) = 1)
SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, topic) AS rn FROM s) WHERE rn = 1""")
def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.classify_topics(table(spark, sf_dir, "documents"), spark.sql(FX_TOPICS))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage with a later version: 'of' taken out, 'the' doubled."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("earlier"), F.regexp_replace(F.regexp_replace("text", " of ", " "), " the ", " the the ").alias("later"))


_VERSIONS = "SELECT item_id, text AS earlier, regexp_replace(regexp_replace(text, ' of ', ' ', 'g'), ' the ', ' the the ', 'g') AS later FROM benchmark"


@query(f"""WITH v AS ({_VERSIONS}), a AS (SELECT item_id, w, count(*) AS was FROM (SELECT item_id, unnest(regexp_extract_all(lower(earlier), '[\\p{{L}}\\p{{N}}]+')) AS w FROM v) GROUP BY 1, 2),
b AS (SELECT item_id, w, count(*) AS now FROM (SELECT item_id, unnest(regexp_extract_all(lower(later), '[\\p{{L}}\\p{{N}}]+')) AS w FROM v) GROUP BY 1, 2)
SELECT item_id, w AS word, coalesce(was, 0) AS was, now FROM b LEFT JOIN a USING (item_id, w) WHERE now > coalesce(was, 0)""")
def risen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.risen_words(_versions(spark, sf_dir), "item_id", "earlier", "later")


@query(f"""WITH v AS ({_VERSIONS}), a AS (SELECT item_id, w, count(*) AS x FROM (SELECT item_id, unnest(regexp_extract_all(lower(earlier), '[\\p{{L}}\\p{{N}}]+')) AS w FROM v) GROUP BY 1, 2),
b AS (SELECT item_id, w, count(*) AS y FROM (SELECT item_id, unnest(regexp_extract_all(lower(later), '[\\p{{L}}\\p{{N}}]+')) AS w FROM v) GROUP BY 1, 2)
SELECT item_id, round(2 * sum(least(coalesce(x, 0), coalesce(y, 0)))::DOUBLE / sum(coalesce(x, 0) + coalesce(y, 0)), 6) AS dice FROM a FULL JOIN b USING (item_id, w) GROUP BY item_id""")
def word_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.word_bag_dice(_versions(spark, sf_dir), "item_id", "earlier", "later").withColumn("dice", F.round("dice", 6))


@query()
def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff(_versions(spark, sf_dir), "item_id", "earlier", "later")


FX_REVIEW = "SELECT * FROM (VALUES (1, 'jane', 'pending'), (2, 'jane', 'pending'), (3, 'acme', 'pending'), (4, 'oslo', 'kept')) AS t(ord, key, status)"


@query("SELECT * FROM (VALUES (1, 'jane', 'masked'), (2, 'jane', 'pending'), (3, 'acme', 'kept'), (4, 'oslo', 'kept')) AS t(ord, key, status)")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.maintain(spark.sql(FX_REVIEW), spark.sql("SELECT * FROM (VALUES ('jane', 'masked'), ('acme', 'kept')) AS t(key, status)"))


@query("""
SELECT o.o_orderkey, arg_max(p.o_orderkey, strftime(p.o_orderdate, '%Y%m%d') || lpad(CAST(p.o_orderkey AS VARCHAR), 20, '0')) AS before
FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey
""")
def earlier_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.earlier_versions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"SELECT doc_id, {_floor_sql('text')} AS masked FROM documents")
def streaming_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor over documents as a stream of files; an extension, as the operators themselves are batch ones."""
    return strip.floor_stream(spark, f"{sf_dir}/documents.parquet")
