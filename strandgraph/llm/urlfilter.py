"""URL verdicts with redirect equivalence. DataFrame functions only.

A rule decides the urls of its host, and of the host's subdomains, whose path begins with
the rule's path; of several the longest wins. Redirects (meta refresh) and canonical
links of the pages join urls to components; a block decision spreads over its
component, unless a page of the component is expressly allowed: allow precedes. A page's own
rule always precedes what spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, table

# Action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved(base: Column, link: Column) -> Column:
    """A link against the url of its page, without fragment."""
    link = F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), "(?s)#.*$", "")
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(base, "(?s)[?#].*$", ""), "(?s)^.*?://[^/?#]*(?:.*/)?", 0)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", F.lit(None))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), link))
    )


def alias_key(url: Column) -> Column:
    """What tells urls apart as nodes: host in lower case and the rest, without scheme and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct pairs (a, b) of alias keys that a page's canonical links and refreshes join; pages without any give none."""
    url = F.col("url")
    tags = lambda tag, part: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))
    found = (
        pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
        .where("url is not null and html is not null")
        .select("url", F.explode(F.concat(tags(LINK, HREF), tags(REFRESH, URL))).alias("link"))
        .where("link <> ''")
    )
    return found.select(alias_key(url).alias("a"), alias_key(resolved(url, F.col("link"))).alias("b")).where("a <> b").distinct()


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """pages with __host, __path, and of the longest rule that fits __rule and __action (null: none).

    Of rules of one length, the first by text. The rules are configuration, an expression each.
    """
    out = pages.withColumn("__host", host(F.col(url_col))).withColumn("__path", path(F.col(url_col)))
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, action = None, None
    for act, rule_host, rule_path in ranked:
        fits = ((F.col("__host") == rule_host) | F.col("__host").endswith("." + rule_host)) & F.col("__path").startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)) if name is None else name.when(fits, F.lit(rule_host + rule_path))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    none = F.lit(None).cast("string")
    return out.withColumn("__rule", none if name is None else name).withColumn("__action", none if action is None else action)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, by (rule, alias or default).

    Null urls and urls without :// have empty host and path, no rule and no aliases: allowed by
    default. Null html has no links. Repeated rows give repeated results; an empty table gives
    an empty result. Urls with a third of all pages meet in pre-aggregated steps only.
    """
    judged = with_rules(pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules, "url")
    edges = checkpoint(alias_edges(pages, url_col, html_col))
    out = judged.drop("html").withColumn("__key", alias_key(F.col("url")))
    if edges.isEmpty():
        spread = out.withColumn("__spread", F.lit(None).cast("string"))
    else:
        component = connected_components(edges, "a", "b")
        # A url's decision is that of its own rule: known for every node, a page or not.
        decided = with_rules(component.withColumn("url", F.concat(F.lit("u://"), "node")), rules, "url")
        verdicts = (
            decided.groupBy("component")
            .agg(F.max(F.col("__action") == "allow").alias("allowed"), F.max(F.col("__action") == "block").alias("blocked"))
            .select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("__spread"))
        )
        nodes = component.join(verdicts, "component").select(F.col("node").alias("__key"), "__spread")
        spread = out.join(nodes, "__key", "left")
    return spread.select(
        id_col,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__action", "__spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("__action").isNotNull(), "rule").when(F.col("__spread").isNotNull(), "alias").otherwise("default").alias("by"),
    )


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_redirect_equivalence": op3_redirect_equivalence}
SQL = {
    "op3_redirect_equivalence": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
links AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS raw
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
cut AS (SELECT url, regexp_replace(replace(raw, '&amp;', '&'), '(?s)#.*$', '') AS link, regexp_extract(regexp_replace(url, '(?s)[?#].*$', ''), '(?s)^.*?://[^/?#]*(?:.*/)?', 0) AS folder FROM links WHERE raw <> ''),
targets AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*', 0) || link
    WHEN link = '' THEN NULL
    ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || link END AS target
  FROM cut),
ends AS (SELECT unnest([url, target]) AS u, url, target FROM targets),
keys AS (
  SELECT DISTINCT u, CASE WHEN contains(u, '://') THEN translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) END END AS k
  FROM (SELECT u FROM ends UNION SELECT url FROM pages)),
edges AS (
  SELECT a.k AS a, b.k AS b FROM targets t JOIN keys a ON a.u = t.url JOIN keys b ON b.u = t.target WHERE a.k <> b.k
  UNION SELECT b.k, a.k FROM targets t JOIN keys a ON a.u = t.url JOIN keys b ON b.u = t.target WHERE a.k <> b.k),
reach(n, r) AS (SELECT a, a FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.n),
fits AS (
  SELECT n, first(action ORDER BY length(h || p) DESC, h || p) AS action
  FROM (SELECT DISTINCT n, regexp_extract(n, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(n, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach) x
  JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p) GROUP BY n),
spread AS (
  SELECT reach.n, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS v
  FROM reach LEFT JOIN fits ON fits.n = reach.r GROUP BY 1),
own AS (
  SELECT page_id, url, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT row_number() OVER () AS i, * FROM parts) x LEFT JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)
  GROUP BY i, page_id, url, host, path)
SELECT page_id, host, path, rule, coalesce(action, v, 'allow') AS verdict,
  CASE WHEN action IS NOT NULL THEN 'rule' WHEN v IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM own LEFT JOIN keys ON keys.u = own.url LEFT JOIN spread ON spread.n = keys.k
"""
}
