"""URL filters: rules on hosts and paths, whose block decisions reach the aliases of a page."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_row, saved, unpacked_row
from .components import connected_components


class Rule(NamedTuple):
    """A host with a path prefix, and what it says."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _AZ, _az)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag; quoted or not."""
    value = F.regexp_extract(tag, f"(?is)\\b{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]+)", 1)
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` parts."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    last = F.element_at(parts, -1)
    drop = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", drop(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve_url(base: Column, target: Column) -> Column:
    """``target`` as named on a page at ``base``: one with a scheme stands by itself; ``//`` keeps the
    scheme of ``base``, ``/`` its host, ``?`` its path, ``#`` its query too, anything else goes into the
    folder of its path. Null where ``target`` is empty or of a scheme without ``//``."""
    scheme = F.regexp_extract(base, "^([^:/?#]+:)//", 1)
    site = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    query = F.regexp_extract(base, "^[^?#]*(\\?[^#]*)", 1)
    own = F.regexp_extract(target, "^[^?#]*", 0)
    rest = F.substr(target, F.length(own) + 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, _without_dots(own), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path, target))
        .when(F.startswith(target, F.lit("#")), F.concat(site, path, query, target))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest))
    )


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: a page's url and the url that it names as its own: a canonical link, a refresh to
    another url, or an ``og:url``. Relative ones are resolved against the page's url or its first
    ``base`` tag; a page whose url is not absolute names none, nor does a null page."""
    tags = F.regexp_extract_all(F.col(html), F.lit("(?is)<(?:link|meta|base)\\b[^>]*>"), F.lit(0))
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    bases = F.filter("_tags", lambda t: t.rlike("(?is)^<base\\b.*\\bhref\\s*="))
    tag = pages.where(F.col(url).contains("://")).select(F.col(url).alias("a"), tags.alias("_tags"))
    tag = tag.select("a", F.get(bases, F.lit(0)).alias("_named"), F.explode("_tags").alias("_t")).where(~F.col("_t").rlike("(?i)^<base"))
    tag = tag.select("a", "_t", F.coalesce(resolve_url(F.col("a"), plain(_attribute(F.col("_named"), "href"))), F.col("a")).alias("_base"))
    names = {"rel": "rel", "href": "href", "equiv": "http-equiv", "property": "property", "content": "content"}
    tag = tag.select("a", "_base", *(_attribute(F.col("_t"), name).alias(c) for c, name in names.items()))
    refresh = F.regexp_extract("content", "(?i)url\\s*=\\s*['\"]?([^'\"]+)", 1)
    to = (
        F.when(F.array_contains(F.split(F.lower("rel"), "\\s+"), "canonical"), F.col("href"))
        .when(F.lower("equiv") == "refresh", F.trim(refresh))
        .when(F.lower("property") == "og:url", F.col("content"))
    )
    return tag.select("a", "_base", plain(to).alias("_to")).select("a", resolve_url(F.col("_base"), F.col("_to")).alias("b")).where("b is not null")


def plain_url(url: Column) -> Column:
    """The form under which urls are the same page: host as above without ``www.``, the path
    without a closing slash, the query; neither the scheme nor what follows ``#`` counts."""
    query = F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1)
    return F.concat(F.regexp_replace(host_of(url), "^www\\.", ""), F.regexp_replace(path_of(url), "/$", ""), query)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The name or verdict of the longest rule that fits; null without one. Of rules of one length
    an allowing one goes first."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.verdict)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = out.when(fits, F.lit(getattr(rule, field)))
    return out


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
    spellings: bool = False,
) -> DataFrame:
    """Every row of ``pages`` with ``_host``, ``_path``, ``_rule`` and ``_verdict``.

    A url that a rule fits has that rule's verdict. Any other is judged by its aliases: urls that
    canonical links, refreshes and the table ``redirects`` (``a``, ``b``) join; with ``spellings`` also other
    spellings of one url (scheme, ``www.``, fragment, a closing slash). Of these connected components
    one with a url that a rule allows is allowed, else one with a url that a rule blocks is blocked; all
    else is allowed. Aliases that are no rows of ``pages`` count too.

    A null url, or one without ``://``, has an empty host and path, no aliases and is allowed unless
    a rule fits. Repeated rows are judged each. An empty table gives no rows. Columns of ``pages`` stay,
    whatever their names; only one that is called as an added one is replaced by it.
    """
    host, path = F.col("host"), F.col("path")
    node = plain_url if spellings else lambda u: u
    judged = packed_row(pages, url=F.col(url), host=host_of(F.col(url)), path=path_of(F.col(url)))
    judged = judged.withColumns({"rule": fitting_rule(host, path, rules, "name"), "own": fitting_rule(host, path, rules, "verdict"), "node": F.when(F.locate("://", F.col("url")) > 0, node(F.col("url")))})
    links = saved(alias_links(pages, url, html))
    if redirects is not None:
        links = links.unionByName(redirects.select("a", "b").where("a is not null and b is not null"))
    parts = connected_components(links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    ends = links.select("a").union(links.select("b")).toDF("u").distinct()
    rule = fitting_rule(host_of(F.col("u")), path_of(F.col("u")), rules, "verdict")
    said = ends.select(node(F.col("u")).alias("node"), rule.alias("own")).where("own is not null")
    part = F.coalesce("component", "node").alias("part")
    if spellings:  # pages of one form can be judged by different rules, linked or not
        said = said.unionByName(judged.select("node", "own").where("own is not null and node is not null")).distinct()
    # min: allow comes before block
    parted = said.join(parts, "node", "left").select("own", part).groupBy("part").agg(F.min("own").alias("said"))
    if spellings:
        of_node = judged.select("node").where("node is not null and own is null").distinct()
        of_node = of_node.join(parts, "node", "left").select("node", part)
    else:  # a url's rule is its own, so only ends of links can get another's verdict
        of_node = parts.select("node", F.col("component").alias("part"))
    of_node = of_node.join(parted, "part").select("node", "said")
    # rows without a node, or with a rule, have nothing to look for: they get keys that nothing has, each another
    none = F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))
    judged = judged.withColumn("node", F.when(F.col("own").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(none))
    judged = judged.join(of_node, "node", "left")
    return unpacked_row(judged, pages, _host="host", _path="path", _rule="rule", _verdict=F.coalesce("own", "said", F.lit("allow")))
