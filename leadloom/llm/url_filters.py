"""URL filters: rules by host and path, and block decisions that follow redirects and canonical links to aliases.

A url is judged by the longest rule that fits it.  Urls that redirect to one another or name one another as canonical are
one resource: connected components over these links are found in Spark, and a url without a rule of its own is blocked if
any url of its component is.  An allow rule that fits a url goes before what its aliases say, and so does a block rule.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, sized
from .components import components

#: (host, start of the path, verdict); a rule fits its host and all subdomains.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rules become one expression; longer lists belong into a table.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NOISE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)", re.I | re.S)
TAG = re.compile(r"""<(link|meta|base)\b((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
REFRESH = re.compile(r"""^[\s\d.]*[;,]\s*(?:url\s*=\s*)?["']?(.+?)["']?\s*$""", re.I | re.S)


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A digest of the url without its fragment, scheme and host in lower case, '/' for an empty path; null without a host."""
    whole = F.coalesce(url, F.lit(""))
    scheme = F.translate(F.regexp_extract(whole, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(whole, r"(?s)^[^#]*?(\?[^#]*)", 1)
    path = path_of(url)
    text = F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query)
    return F.when(host_of(url) != "", F.unhex(F.md5(text.cast("binary"))))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, allow before block in a tie; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        rule = rule.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == rule) | host.endswith("." + rule)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def links_of(page: str, url: str) -> list[str]:
    """Urls that a page redirects to by a refresh, or names as canonical, made absolute."""
    base, out = url, []
    for name, rest in (m.groups() for m in TAG.finditer(NOISE.sub(" ", page))):
        has = {k.lower(): entities.unescape(next(filter(None, v), "")).strip() for k, *v in ATTRIBUTE.findall(rest)}
        target = None
        if name.lower() == "base" and has.get("href"):
            base = _join(url, has["href"]) or url
        elif name.lower() == "link" and "canonical" in has.get("rel", "").lower().split():
            target = has.get("href")
        elif name.lower() == "meta" and has.get("http-equiv", "").lower() == "refresh":
            m = REFRESH.match(has.get("content", ""))
            target = m and m[1]
        if target and (joined := _join(base, target)):
            out.append(joined)
    return out


def _join(base: str, target: str) -> str | None:
    try:
        return urljoin(base, target)
    except ValueError:  # no url, as with a broken IPv6 host
        return None


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the redirects and canonical links in pages(url, html)."""
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv")).select("url", "html")

    def find(texts, batch):
        urls = batch.column("url").to_pylist()
        pairs = [(u, to) for u, t in zip(urls, texts) for to in links_of(t or "", u)]
        return {"from_url": pa.array([p[0] for p in pairs], pa.string()), "to_url": pa.array([p[1] for p in pairs], pa.string())}

    return map_texts(some, "html", "from_url string, to_url string", find)


def blocked_aliases(links: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """node of every url of links(from_url, to_url) that shares a component with a url that a rule blocks."""
    ends = links.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    rule = fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    blocked = ends.where(rule["verdict"] == "block").select(node_of(F.col("url")).alias("node")).distinct()
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null")
    roots = materialize(components(edges), "aliases")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    bad = roots.join(blocked, "node", "left_semi").select("root").distinct()
    return roots.join(bad, "root", "left_semi").select("node").distinct()


def url_filters(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of each page.

    `redirects`(from_url, to_url) are links beside those in the pages' html.  A url that no rule fits is blocked if an alias
    is, else allowed.  Null urls and urls without '://' have an empty host and path, no rule and no alias; null html has no
    links.  Repeated rows are all judged; of rules of one length an allow rule wins; other columns are not read; an empty
    table gives an empty result.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found = page_links(read)
    if redirects is not None:
        found = found.unionByName(redirects.select("from_url", "to_url"))
    links = materialize(found, "links")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = read.select("page_id", "url", host.alias("host"), path.alias("path"), fitting_rule(host, path, rules).alias("__rule"))
    verdict = F.col("__rule.verdict")
    if links.isEmpty():
        other = F.lit("allow")
    else:
        aliases = materialize(blocked_aliases(links, rules), "blocked").withColumnRenamed("node", "__bad")
        ruled, free = judged.where(verdict.isNotNull()).withColumn("__bad", F.lit(None).cast("binary")), judged.where(verdict.isNull())
        judged = ruled.unionByName(free.join(sized(aliases), node_of(F.col("url")) == F.col("__bad"), "left"))
        other = F.when(F.col("__bad").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(verdict, other).alias("verdict"))
