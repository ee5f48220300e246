"""URL filters that follow redirects.

Rules judge urls by host suffix and path prefix.  Urls that lead to each other
by redirect or canonical-link edges are one resource: a block reaches all its
aliases, unless an explicit allow among them comes first.  All of it is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import components

#: Characters of A-Z and a-z for ASCII-only lower-casing.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags: comments, scripts and styles, to the end of the page if not closed.  Each match ends, so a scan is linear.
_RAW = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)"
#: A whole tag (no ``<`` or ``>`` within), then its attributes: after white space or a slash a name, ``=``, a value.
_TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
_ATTRIBUTE = r"""(?s)[\s/]([^\s"'<>/=]+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'<>]+)"""
#: Seconds, then the target of a refresh.
_REFRESH = r"""(?is)^[\s\d.]*+[;,]?+\s*+url\s*+=\s*+["']?+\s*+([^"'\s]+)"""


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def resource(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, no fragment; null where it names no host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^\s*(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), path, query))


def _absolute(target: Column, url: Column) -> Column:
    """A link's target: absolute, scheme-relative, host-relative or relative to the page's path."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"(?s)^\s*(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path_of(url), target))
        .when((target != "") & ~target.startswith("#") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.concat(origin, folder, target))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if it has none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER))
    at = F.array_position(names, F.lit(name))
    value = F.get(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)), (at - 1).cast("int"))
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(at > 0, F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and refresh of a page, as written.

    Tags in comments, scripts and styles do not count.  ``rel`` is a list of
    words, of which one is ``canonical``.  A tag is isolated before its
    attributes are read, so hostile pages take time in proportion to their size.
    """
    found = pages.where("url is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    cleaned = F.regexp_replace("html", _RAW, " ")
    tags = found.select("url", F.explode(F.regexp_extract_all(cleaned, F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    words = F.split(F.translate(F.trim(_attribute(tag, "rel")), _UPPER, _LOWER), r"\s+")
    link = F.when(F.array_contains(words, "canonical"), _attribute(tag, "href"))
    refresh = F.translate(F.trim(_attribute(tag, "http-equiv")), _UPPER, _LOWER) == "refresh"
    meta = F.when(refresh, F.regexp_extract(_attribute(tag, "content"), _REFRESH, 1))
    return tags.select("url", F.when(tag.rlike("(?i)^<link"), link).otherwise(meta).alias("target")).where("target <> ''")


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct (a, b) between the resources of pages and the targets of their canonical links and refresh redirects."""
    rows = link_targets(pages)
    edges = rows.select(resource(F.col("url")).alias("a"), resource(_absolute(F.col("target"), F.col("url"))).alias("b"))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def _fits(host: str, path: str) -> Column:
    own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return own & F.startswith(F.col("path"), F.lit(path))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    ``rules``: (allow or block, host, path); a rule fits its host and all
    subdomains if the path starts with the rule's, and the longest that fits
    decides.  ``edges`` (a, b) are redirects between urls, such as a crawl's
    log; without it they come from the pages themselves.  A url without a rule
    is allowed if any alias is explicitly allowed, else blocked if any alias is
    blocked, else allowed.  Aliases count whether or not a page has their url.

    Null or hostless urls fit no rule, have no aliases and are allowed; repeated
    rows are judged alike; an empty table gives no rows.  The rules are a
    parameter and become one conditional expression.  Verdicts of components
    are aggregated before their shuffle; only linked resources take part.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(ordered):
        rule = F.when(_fits(host, path), F.lit(host + path)).otherwise(rule)
        verdict = F.when(_fits(host, path), F.lit(kind)).otherwise(verdict)
    url = F.col("url")
    judged = pages.select("page_id", url, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumns({"rule": rule, "own": verdict, "node": resource(url)})
    links = components(link_edges(pages) if edges is None else edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b")))
    members = links.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}).withColumn("own", verdict)
    decided = members.where("own is not null").groupBy("component").agg(F.min("own").alias("shared"))
    shared = links.join(decided, "component").select("node", "shared")
    out = judged.join(shared, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))
