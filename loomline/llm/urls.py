"""URL filter whose block decisions follow redirects and canonical links.

Rules name a host and a path prefix; a rule fits its host and all subdomains where the
url's path starts with the rule's, and the longest fitting rule wins. Pages are nodes
(url without fragment and without tracking parameters, host in lower case); a canonical
link, a meta refresh, or a row of a given redirect table is an edge. In each connected
component, a page without a rule of its own takes the component's verdict: allow if any
url in it is allowed by a rule (explicit allow has precedence), else block if any is
blocked, else the default.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule
and no edges, and gets the default; null html has no edges; equal urls are one node; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
REFRESH = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host in lower case, path, and the query without tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, rf"(?i)(^|&){TRACKING}=[^&]*", ""), "^&", "")
    node = F.concat(host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", node)


def split_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(action, host, path), longest first; ties in the order given."""
    parts = [(action, *rule.partition("/")[::2]) for action, rule in rules]
    return sorted(((a, h.lower(), "/" + p) for a, h, p in parts), key=lambda r: -len(r[1] + r[2]))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The winning rule and its action, null where none fits. For rule lists a plan can hold."""
    ordered = split_rules(rules)
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    none = F.lit(None).cast("string")
    rule = reduce(lambda rest, r: F.when(fits(r[1], r[2]), r[1] + r[2]).otherwise(rest), reversed(ordered), none)
    act = reduce(lambda rest, r: F.when(fits(r[1], r[2]), r[0]).otherwise(rest), reversed(ordered), none)
    return rule, act


def resolved(base: Column, target: Column) -> Column:
    """A link target as an absolute url, by the page's url."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    plain = F.regexp_replace(target, "&amp;", "&")
    return (
        F.when(plain.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), plain)
        .when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain))
        .when(plain.startswith("/"), F.concat(root, plain))
        .when(plain != "", F.concat(folder, plain))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes from canonical links and meta refreshes; urls as src_url, dst_url."""
    html = F.col("html")
    # A page that holds neither word skips both tag searches.
    link = F.when(html.rlike("(?i)canonical"), F.regexp_extract(F.regexp_extract(html, LINK_TAG, 0), HREF, 1))
    meta = F.when(html.rlike("(?i)http-equiv"), F.regexp_extract(F.regexp_extract(html, META_TAG, 0), REFRESH, 1))
    found = pages.select(F.col("url").alias("src_url"), F.array(link, meta).alias("to_"))
    found = found.select("src_url", F.explode(F.filter("to_", lambda t: t.isNotNull() & (t != ""))).alias("to_"))
    return found.select("src_url", resolved(F.col("src_url"), F.col("to_")).alias("dst_url"))


def url_verdicts(
    pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule, verdict, component (null without links), one row per page.

    redirects: optional (src, dst) urls besides those found in the html.
    """
    scratch = Scratch(pages.sparkSession)
    links = link_edges(pages.select("url", "html"))
    if redirects is not None:
        links = links.union(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    links = scratch.cut(
        links.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
        .where("src is not null and dst is not null and src != dst")
        .distinct(),
        "links",
    )
    labels = connected_components(links, "src", "dst", scratch)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, action = rule_columns(host_of(as_url), path_of(as_url), rules)
    judged = labels.withColumn("act_", action).groupBy("component")
    judged = judged.agg(F.bool_or(F.col("act_") == "allow").alias("any_allow"), F.bool_or(F.col("act_") == "block").alias("any_block"))
    by_node = labels.join(judged, "component").select(
        "node", "component", F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").alias("spread_")
    )
    by_node = scratch.last(by_node, "by-node")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, act = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("rule", rule).withColumn("act_", act).join(by_node, "node", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("act_", "spread_", F.lit(default)).alias("verdict"), "component")
