"""URL filters whose block decisions reach the aliases of a page by redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, cut, table

#: (verdict, host, path prefix) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def _plain_path(rest: Column) -> Column:
    """A path with its query, without the segments . and .. in the path."""
    path, query = F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*(.*)\z", 1)
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))
    held = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda a: F.array_join(a, "/"))
    ends = F.when(path.rlike(r"/\.\.?\z") & ~held.endswith("/"), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|\z)"), F.concat(held, ends, query)).otherwise(rest)


def _key(host: Column, rest: Column) -> Column:
    """host and rest (path and query) as a key: no user, no usual port, no . or .. segments, / for an empty path."""
    bare = F.regexp_replace(host, r"^[^@]*@|:(?:80|443)?\z", "")
    whole = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(bare != "", F.concat(bare, _plain_path(whole)))


def url_key(url: Column) -> Column:
    """What names a page in the alias graph: host, path and query, without scheme and fragment; null without a host."""
    return _key(url_host(url), F.regexp_extract(url, r"(?s)://[^/?#]*([^#]*)", 1))


def target_key(link: Column, host: Column, path: Column) -> Column:
    """The key of a link found on a page at host and path; null for an empty link or another scheme without ://."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    bare = F.regexp_extract(link, r"(?s)^([^#]*)", 1)
    return (
        F.when((link == "") | (host == ""), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url_key(link))
        .when(link.startswith("//"), url_key(F.concat(F.lit("http:"), link)))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (bare == ""), None)
        .when(bare.startswith("/"), _key(host, bare))
        .when(bare.startswith("?"), _key(host, F.concat(path, bare)))
        .otherwise(_key(host, F.concat(F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1), bare)))
    )


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    The rules are a parameter of the plan, some thousands at most; they become one CASE expression.
    """
    best = None
    for verdict, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        found = F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) keys joined by a redirect (meta refresh) or a canonical link in the html of pages."""
    html, url = F.col("html"), F.col("url")
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(
        url_key(url).alias("src"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        F.explode(F.concat(
            F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), 0), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
            F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), 0), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        )).alias("link"),
    )
    edges = found.select("src", target_key(F.col("link"), F.col("host"), F.col("path")).alias("dst"))
    return edges.where("src is not null and dst is not null and src != dst").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, component of every page.

    A page's own rule decides first. A page without one takes the decision of its component in the graph of
    redirects and canonical links: allow if any node's own rule allows, else block if any node's blocks, else
    default. Nodes are judged by their keys, so a link's target votes though it is no row of pages; a key's
    path is never empty. Null or malformed urls have empty host and path, no rule and no aliases; null html
    has no links; repeated pages are judged each. component is the least key among the aliases, null without
    any. Not followed: <base href>, and redirects that only a server's headers tell.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule = match_rule(host, path, rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule.getField("rule").alias("rule"), rule.getField("verdict").alias("own"), url_key(F.col("url")).alias("key"))
    edges = cut(alias_edges(pages.select("url", "html")))
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    classes = cut(connected_components(edges).withColumnRenamed("node", "key"))
    said = match_rule(F.regexp_extract("key", r"(?s)^([^/]*)", 1), F.regexp_extract("key", r"(?s)^[^/]*([^?]*)", 1), rules).getField("verdict")
    votes = classes.select("component", said.alias("own")).where("own is not null").groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allows"))
    decided = classes.join(votes, "component", "left").withColumnRenamed("key", "alias")
    # Pages without a key must not meet in one task of the outer join.
    judged = judged.withColumn("alias", F.coalesce("key", F.concat(F.lit("\u0000"), F.col("page_id").cast("string"))))
    inherited = F.when(F.col("allows") == 1, "allow").when(F.col("allows") == 0, "block").otherwise(default)
    return judged.join(decided, "alias", "left").select("page_id", "host", "path", "rule", F.coalesce("own", inherited).alias("verdict"), "component")


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls over all pages by the rules of the contract."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_PARTS = r"""
WITH p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
k AS (
  SELECT page_id, host, path, html, CASE WHEN host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS key,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
"""

#: Components by recursion over absolute links of either kind, in their commonest spelling; relative links, ports, users
#: and dot segments aren't resolved here (test_url_filters_on_random_graphs covers what the given pages don't have).
OP5_SQL = _PARTS.replace("WITH p AS", "WITH RECURSIVE p AS") + r""",
link AS (
  SELECT key AS a, unnest(regexp_extract_all(html, '(?i)<link rel="canonical" href="([^"]+)"', 1) || regexp_extract_all(html, '(?i)<meta http-equiv="refresh" content="[0-9]+; ?url=([^"]+)"', 1)) AS l
  FROM k WHERE key IS NOT NULL AND html IS NOT NULL),
pair AS (
  SELECT a, translate(regexp_extract(l, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN regexp_extract(l, '://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(l, '://[^/?#]*([^#]*)', 1) END AS b
  FROM link WHERE l LIKE '%://%'),
edge AS (SELECT a, b FROM pair WHERE a <> b UNION SELECT b, a FROM pair WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT node, b FROM reach JOIN edge ON other = a),
vote AS (
  SELECT node, bool_or(host LIKE '%.www.example.com' AND starts_with(path, '/en/') OR host = 'www.example.com' AND starts_with(path, '/en/')
      OR (host = 'com' OR host LIKE '%.com') AND NOT ((host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/'))) AS allows,
    bool_or((host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') AND host <> 'www.example.com' AND host NOT LIKE '%.www.example.com'
      OR (host = 'net' OR host LIKE '%.net') AND (starts_with(path, '/es/') OR starts_with(path, '/fr/'))) AS blocks
  FROM (SELECT node, regexp_extract(other, '^([^/]*)', 1) AS host, regexp_extract(other, '^[^/]*([^?]*)', 1) AS path FROM reach) GROUP BY node)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN vote ON k.key = vote.node
"""
