"""URL filters: rules by host and path, and blocks that follow redirects and canonical links.

A rule fits its host and all subdomains when the url's path starts with the rule's; the longest (host and path together) wins,
of equally long ones allow, then the least. A url without a rule takes the decision of its aliases: urls joined by
redirects (`meta http-equiv=refresh`, or rows of a redirect log) and canonical links (`link rel=canonical`) are one
connected component, and if a rule blocks any of its urls, linked ones that are no page included, the component's urls
are blocked. An explicit allow rule of a url comes before that; what nothing blocks is allowed.

Defined results: a null url or one without `://` has empty host and path and no rule, so it is allowed, and is no alias of
anything; null or empty html has no links; repeated rows are judged alike; scheme, fragment and the case of A-Z in hosts do
not tell aliases apart; empty tables give no rows; other columns are ignored. All of it is column functions and joins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rulespark.llm.common import ascii_lower, stored, taken_name
from rulespark.llm.graph import components
from rulespark.session import small_side

ALLOW, BLOCK = "allow", "block"
INLINE_RULES = 64  # up to here a list of rules is one expression; longer ones are a table and joined on (host, prefix)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Host, path and query: what makes two urls the same node. Null where there is no `://`."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    parts = F.split(path, "/", -1)
    step = lambda done, part: (
        F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part)))
    )
    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    dots = F.element_at(parts, -1).isin(".", "..")
    return F.when(F.contains(path, F.lit("/.")), F.concat_ws("/", F.when(dots, F.concat(walked, F.array(F.lit("")))).otherwise(walked))).otherwise(path)


def resolved(links: DataFrame) -> DataFrame:
    """(url, link) rows as (a, b): keys of the page's url and of the absolute url its link means; null for `mailto:` and the like."""
    cleaned = F.regexp_replace(F.trim(F.regexp_replace("link", r"[\x09\x0A\x0D]", "")), "(?i)&(?:amp|#38|#x26);", "&")
    path = path_of(F.col("url"))
    parts = links.select("url", cleaned.alias("link"), F.concat(F.lit("http://"), host_of(F.col("url"))).alias("site"), F.when(path == "", "/").otherwise(path).alias("path"))
    parts = parts.select("*", F.regexp_extract("link", "^([^?#]*)", 1).alias("own"), F.regexp_extract("link", "([?#].*)?$", 1).alias("query"))
    folder = F.regexp_extract("path", "(?s)^(.*/)", 1)
    parts = parts.select("*", F.when(F.col("own").startswith("/"), F.col("own")).otherwise(F.concat(folder, "own")).alias("full"))
    target = (
        F.when(F.col("link").rlike("^(?i:https?)://"), F.col("link"))
        .when(F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link"))
        .when(F.col("own") == "", F.concat("site", "path", "query"))
        .otherwise(F.concat("site", _without_dots(F.col("full")), "query"))
    )
    return parts.select("url", target.alias("target")).select(key_of(F.col("url")).alias("a"), key_of(F.col("target")).alias("b"))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if there is none."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def declared_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): keys of a page's url and of the url it redirects to or names as canonical."""
    text = F.regexp_replace(F.col(html), r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", "")
    tags = F.when(F.col(html).rlike("(?i)canonical|http-equiv"), F.regexp_extract_all(text, F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0)))
    each = pages.select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    named = each.select("url", *[_attribute(F.col("tag"), a).alias(a) for a in ("rel", "href", "http-equiv", "content")])
    canonical = F.lower("rel").rlike(r"(^|\s)canonical(\s|$)")
    target = F.regexp_extract("content", r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]+)", 1)
    link = F.when(canonical, F.col("href")).when(F.lower("http-equiv") == "refresh", target)
    return resolved(named.select("url", link.alias("link")).where("link <> ''"))


def _fit(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _rule(host: Column, path: Column, verdict: Column) -> Column:
    return F.struct(F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def _inline(df: DataFrame, rules: list[Rule], host: str, path: str, out: str) -> DataFrame:
    best = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict, r.host, r.path))
    found = F.lit(None)
    for rule in reversed(best):
        found = F.when(_fit(F.col(host), F.col(path), rule), _rule(F.lit(rule.host), F.lit(rule.path), F.lit(rule.verdict))).otherwise(found)
    return df.withColumn(out, found.cast("struct<rule:string,verdict:string>"))


def _joined(df: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Distinct (host, path) pairs meet rules on equal host suffix and equal path prefix, of the lengths that rules have."""
    rules = rules.select("host", "path", "verdict").distinct()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()]  # a url's length bounds them
    labels = F.split(F.col(host), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(F.col(path)))
    asked = df.select(host, path).distinct().withColumn("rule_host", F.explode(suffixes)).withColumn("n", F.explode(fitting))
    asked = asked.withColumn("rule_path", F.substring(F.col(path), F.lit(1), F.col("n")))
    met = asked.join(small_side(rules.withColumnsRenamed({"host": "rule_host", "path": "rule_path"})), ["rule_host", "rule_path"])
    order = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("n"), "verdict", "rule_host", "rule_path")
    best = met.groupBy(host, path).agg(F.min(order).alias("best"))
    best = best.select(host, path, _rule(F.col("best.rule_host"), F.col("best.rule_path"), F.col("best.verdict")).alias(out))
    return df.join(small_side(best), [host, path], "left")


def match_rules(df: DataFrame, rules: list[Rule] | DataFrame, host: str, path: str, out: str) -> DataFrame:
    """df with `out`, the winning (rule, verdict) or null."""
    if isinstance(rules, DataFrame):
        return _joined(df, rules, host, path, out)
    if len(rules) <= INLINE_RULES:
        return _inline(df, rules, host, path, out)
    return _joined(df, df.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), host, path, out)


def blocked_aliases(links: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """(key): every url of the components of `links` (a, b) that hold a url some rule blocks."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(ordered.where("a is not null and b is not null and a <> b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("key"))
    nodes = stored(components(edges).select(F.col("fp").alias("key"), "root"), "aliases")
    url = F.concat(F.lit("http://"), F.col("key"))
    judged = match_rules(nodes.select("key", "root", host_of(url).alias("host"), path_of(url).alias("path")), rules, "host", "path", "best")
    bad = judged.where(F.col("best.verdict") == BLOCK).select("root").distinct()
    return nodes.join(small_side(bad), "root", "left_semi").select("key")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, *, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages without their html, with host, path, rule and verdict (names that a page's own column has get a `_`).

    `redirects` adds edges of a crawl's redirect log: (source, target) absolute urls.
    """
    kept = [c for c in pages.columns if c not in (url, html)]
    names = taken_name(pages, "host", "path", "rule", "verdict", "found", "key", "blocked")
    host, path, rule, verdict, found, key, blocked = names
    links = declared_links(pages.select(url, html), url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(key_of(F.col("source")).alias("a"), key_of(F.col("target")).alias("b")))
    bad = stored(blocked_aliases(links, rules), "blocked").withColumnRenamed("key", key).withColumn(blocked, F.lit(True))
    parsed = pages.select(*kept, url, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path), key_of(F.col(url)).alias(key))
    own = match_rules(parsed, rules, host, path, found).join(small_side(bad), key, "left")
    decided = F.coalesce(F.col(found)["verdict"], F.when(F.col(blocked), F.lit(BLOCK)), F.lit(ALLOW))
    return own.select(*kept, url, host, path, F.col(found)["rule"].alias(rule), decided.alias(verdict))


def oracle(rules: list[Rule]) -> str:
    """DuckDB SQL for `judge` on a table `pages`: the same links, a recursive walk over them, the same rules."""
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda c: f"coalesce({lower(f"regexp_extract({c}, '://([^/?#]*)', 1)")}, '')"
    path = lambda c: f"coalesce(regexp_extract({c}, '://[^/?#]*([^?#]*)', 1), '')"
    rest = lambda c: f"regexp_extract({c}, '://[^/?#]*([^#]*)', 1)"
    key = lambda c: f"CASE WHEN contains({c}, '://') THEN {host(c)} || CASE WHEN starts_with({rest(c)}, '/') THEN '' ELSE '/' END || {rest(c)} END"

    def attribute(name: str) -> str:
        found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
        return "(" + " || ".join(f"regexp_extract(tag, '{found}', {i})" for i in (1, 2, 3)) + ")"

    def dots(c: str) -> str:
        segments = f"string_split({c}, '/')"
        walk = (
            f"list_reduce(list_transform({segments}, lambda s: [s]), lambda done, s: CASE WHEN s[1] = '.' THEN done "
            "WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE list_concat(done, s) END)"
        )
        return (
            f"CASE WHEN contains({c}, '/.') THEN array_to_string(list_concat({walk}, CASE WHEN {segments}[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') "
            f"ELSE {c} END"
        )

    table = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    best = lambda h, p: (
        "(SELECT min_by({rule: r.host || r.path, verdict: r.verdict}, (-len(r.host || r.path), r.verdict, r.host, r.path)) FROM rules r "
        f"WHERE ({h} = r.host OR ends_with({h}, '.' || r.host)) AND starts_with({p}, r.path))"
    )
    return rf"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {table}),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)', '', 'g'), '(?i)<(?:link|meta)\s[^>]*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
raw AS (
  SELECT url, CASE WHEN regexp_matches(lower({attribute("rel")}), '(^|\s)canonical(\s|$)') THEN {attribute("href")}
    WHEN lower({attribute("http-equiv")}) = 'refresh'
    THEN regexp_extract({attribute("content")}, '(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[''"]?([^''"]+)', 1) END AS link FROM tags),
cleaned AS (
  SELECT url, regexp_replace(trim(regexp_replace(link, '[\x09\x0A\x0D]', '', 'g'), ' '), '(?i)&(?:amp|#38|#x26);', '&', 'g') AS link
  FROM raw WHERE link <> ''),
parts AS (
  SELECT url, link, 'http://' || {host("url")} AS site, CASE WHEN {path("url")} = '' THEN '/' ELSE {path("url")} END AS path,
    regexp_extract(link, '^([^?#]*)', 1) AS own, link[len(regexp_extract(link, '^([^?#]*)', 1)) + 1:] AS query FROM cleaned),
targets AS (
  SELECT url, CASE WHEN regexp_matches(link, '^(?i:https?)://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN 'http:' || link WHEN own = '' THEN site || path || query
    WHEN starts_with(link, '/') THEN site || {dots("own")} || query
    ELSE site || {dots("(regexp_extract(path, '(?s)^(.*/)', 1) || own)")} || query END AS target FROM parts),
links AS (SELECT DISTINCT {key("url")} AS a, {key("target")} AS b FROM targets),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a),
nodes AS (SELECT DISTINCT a AS node FROM edges),
bad AS (SELECT node FROM nodes WHERE {best(host("('http://' || node)"), path("('http://' || node)"))}.verdict = '{BLOCK}'),
blocked AS (SELECT DISTINCT reach.node FROM reach JOIN bad ON other = bad.node),
judged AS (SELECT *, {best("j.host", "j.path")} AS best, coalesce(link_key IN (SELECT node FROM blocked), false) AS aliased
  FROM (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {key("url")} AS link_key FROM pages) j)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN aliased THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict FROM judged"""
