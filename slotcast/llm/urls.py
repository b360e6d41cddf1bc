r"""URL filters with redirect equivalence.

A rule is a host and a path prefix; it fits the host and its subdomains where
the path starts with the prefix, and the longest fitting rule decides. Pages
that name a canonical address or redirect elsewhere are aliases of the target:
aliases form connected components, worked out distributed. A page without a rule
of its own takes the decision of its component: allow if a rule allows any
member, block if a rule blocks one, allow otherwise. A page's own rule always
stands. Targets count as members even if they are no pages themselves.

An address is told apart by its host (A-Z lower-cased), path and query; scheme
and fragment play no part, and no path is the path ``/``. Targets may be relative
in any way: to the page, its folder, its host, its scheme, with dots, a query or a
fragment alone. Other schemes than ``name://`` lead to no address.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and no aliases, and is allowed; null html has no links; of equally long
fitting rules an allowing one wins; null ids and repeated rows are judged like
any other row; without rules all is allowed; an empty table gives an empty
result; only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.components import components
from slotcast.llm.store import settled, stored

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_LINK = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address_of(url: Column) -> Column:
    """What tells addresses apart; null where there is no host. An empty path is ``/``."""
    path, rest = path_of(url), F.regexp_extract(url, _PARTS, 3)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), rest))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments worked out: ``.`` goes, ``..`` goes
    with the segment before it, and either at the end leaves a folder."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda seen, p: F.when(p == ".", seen)
        .when(p == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1))))
        .otherwise(F.concat(seen, F.array(p))),
    )
    folder = F.when(last.isin(".", ".."), "/").otherwise("")
    plain = F.concat(F.array_join(kept, "/"), folder)
    return F.when(~path.rlike(r"(^|/)\.\.?(/|$)"), path).when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))


def absolute(target: Column, url: Column) -> Column:
    """A link target as it stands in the page at ``url``: references are resolved
    as the standard of addresses says (RFC 3986, section 5)."""
    scheme, host, path = F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url), path_of(url)
    own_query = F.regexp_extract(url, _PARTS, 3)
    to_path, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    merged = F.when(to_path.startswith("/"), to_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), to_path)
    )
    base = F.concat(scheme, host)
    relative = (
        F.when((to_path == "") & (query == ""), F.concat(base, path, own_query))
        .when(to_path == "", F.concat(base, path, query))
        .otherwise(F.concat(base, without_dots(merged), query))
    )
    whole = F.concat(
        F.regexp_extract(target, r"(?s)^([^:/?#]+://[^/?#]*)", 1),
        without_dots(path_of(target)), F.regexp_extract(target, _PARTS, 3),
    )
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), whole)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(relative)
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b) addresses that canonical links and redirects in the html of ``pages`` make equal."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(_LINK), 0)
    wanted = F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    tag = pages.filter(F.col("url").isNotNull()).select("url", F.explode(wanted).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).otherwise(
        F.regexp_extract("tag", _TARGET, 1)
    )
    links = tag.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")).filter(
        F.col("target") != ""
    )
    url = F.col("url")
    return links.select(address_of(url).alias("a"), address_of(absolute(F.col("target"), url)).alias("b"))


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with host and path) plus the longest fitting rule and its decision, or nulls.

    Rules meet distinct hosts, not rows: each host is looked up under all of its
    parent domains, and a row then picks from the rules of its host.
    """
    at = F.instr("rule", "/")
    rule = rules.select(
        F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("domain"),
        F.struct(F.length("rule").alias("length"), (F.col("verdict") == "allow").alias("allows"), "rule",
                 F.expr("substring(rule, instr(rule, '/'))").alias("path"), "verdict").alias("r"),
    ).filter(at > 0)
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    known = (
        rows.select("host").distinct().select("host", F.explode(domains).alias("domain")).join(rule, "domain")
        .groupBy("host").agg(F.collect_list("r").alias("rules"))
    )
    path = F.col("path")
    best = F.array_max(F.filter("rules", lambda r: path.startswith(r["path"])))
    return rows.join(known, "host", "left").withColumn("best", best).drop("rules")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` has rows (rule, verdict): ``host/prefix`` and allow or block.
    ``links`` (a, b), urls, are redirects known from elsewhere.
    """
    return settled(pages.sparkSession, lambda: _judged(pages, rules, links))


def _judged(pages: DataFrame, rules: DataFrame, links: DataFrame | None) -> DataFrame:
    url = F.col("url")
    edges = alias_links(pages)
    if links is not None:
        edges = edges.union(links.select(address_of(F.col("a")), address_of(F.col("b"))))
    edges = stored(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    members = components(edges)
    as_url = F.concat(F.lit("://"), "member")
    decided = with_rule(
        members.select("member", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules
    )
    classes = (
        decided.groupBy("component")
        .agg(F.bool_or(F.col("best.allows")).alias("allowed"), F.bool_or(~F.col("best.allows")).alias("blocked"))
        .select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared"))
        .filter(F.col("shared").isNotNull())
    )
    shared = stored(members.join(classes, "component").select(F.col("member").alias("address"), "shared"))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    return (
        with_rule(rows, rules).join(shared, "address", "left")
        .select(
            "page_id", "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.verdict"), "shared", F.lit("allow")).alias("verdict"),
        )
    )
