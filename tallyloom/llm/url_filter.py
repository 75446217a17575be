"""URL filtering with redirect equivalence, with DataFrame functions only.

Explicit rules decide a url; a block spreads over redirect and canonical links to the aliases that no rule names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import is_empty, materialize, tidy

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag ends at the next angle bracket of either kind, so that no scan goes beyond it; quantifiers give nothing back where several could match the same blanks.
_TAGS = r"(?i)<(?:link|meta)\b[^<>]*+>"
_CANONICAL = r"""(?is)^<link\b(?=[^>]*\srel\s*+=\s*+["']?canonical\b)[^>]*?\shref\s*+=\s*+["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)^<meta\b(?=[^>]*\shttp-equiv\s*+=\s*+["']?refresh\b)[^>]*?\scontent\s*+=\s*+["']?\s*+[\d.]*+\s*+[;,]?\s*+url\s*+=\s*+["']?([^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """A url's name in the link graph: host, path (a slash if empty) and query, without scheme and fragment; null if it has no ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    path = url_path(url)
    return F.when(url.contains("://"), F.concat(url_host(url), F.when(path == "", "/").otherwise(path), query))


def _without_dots(path: Column) -> Column:
    """A path from the root without its . and .. segments."""
    segments = F.slice(F.split(path, "/"), 2, F.lit(1 << 20))
    last = F.element_at(segments, -1)
    segments = F.when(last.isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)  # these name a folder
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _resolve(link: Column, base: Column) -> Column:
    """A link against the page's url: absolute, with its own host, from the root, from the page's folder, or a query; null for a
    mere fragment and for other schemes."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_path(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, _without_dots(F.when(link.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(alias, target) url pairs that the pages declare: all canonical links and refresh redirects."""
    declared = pages.select(F.col(url_col).alias("alias"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)canonical|refresh"))
    tags = declared.select("alias", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    targets = F.array(F.regexp_extract("tag", _CANONICAL, 1), F.regexp_extract("tag", _REFRESH, 1))
    found = tags.select("alias", F.explode(targets).alias("link")).filter("link <> ''")
    return found.select("alias", _resolve(F.col("link"), F.col("alias")).alias("target"))


def _fitting(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null. rules: (allow or block, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@tidy
def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict, component.

    rules is a configured list of (allow or block, host, path): a rule fits its host and all subdomains where the path
    starts with its own; the longest wins, allow on a tie. redirects has further (alias, target) urls. A url with a
    rule gets that verdict. Any other url that is linked, over any number of redirect and canonical links in either
    direction, to a url with a rule is allowed if one of those is allowed, else blocked if one is blocked; all other
    urls are allowed. component is the least member of a linked url's group, else null. Null urls, and urls without
    ://, have empty host and path, no rule and no links. Repeated rows are judged alike; other columns are ignored.
    """
    columns = [F.col(id_col).alias("id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else [])]
    pages = pages.select(*columns)
    links = page_links(pages) if html_col else None
    if redirects is not None:
        more = redirects.select("alias", "target")
        links = more if links is None else links.union(more)

    host, path = url_host(F.col("url")), url_path(F.col("url"))
    out = pages.select("id", host.alias("host"), path.alias("path"), _fitting(rules, host, path).alias("fit"), url_node(F.col("url")).alias("node"))
    component = F.lit(None).cast("string")
    spread = F.lit("allow")
    if links is not None:
        links = links.select(url_node(F.col("alias")).alias("a"), url_node(F.col("target")).alias("b"))
        links = materialize(links.filter("a <> b").distinct(), "links")
        if not is_empty(links):
            nodes = materialize(connected_components(links, "a", "b"), "aliases", keep=True)
            full = F.concat(F.lit("x://"), F.col("node"))
            verdict = _fitting(rules, url_host(full), url_path(full))["verdict"]
            judged = nodes.select("component", verdict.alias("v")).groupBy("component")
            judged = judged.agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
            known = nodes.join(judged, "component").select("node", "component", F.when(~F.coalesce("allowed", F.lit(False)) & F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("spread"))
            out = out.join(known, "node", "left")
            component, spread = F.col("component"), F.coalesce("spread", F.lit("allow"))
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", spread).alias("verdict"), component.alias("component")
    )
