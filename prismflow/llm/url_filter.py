"""URL filter with redirect equivalence; DataFrame operations only.

Rules (verdict, host, path) fit a host and its subdomains where the url's path starts with the rule's;
the longest rule wins (then the longer host, then allow). Urls linked by a redirect or a canonical link
are aliases. An url without a rule takes its component's verdict: allow if some alias is explicitly
allowed, else block if some alias is blocked, else allow.

Aliases are nodes ``host + path + query``; the fragment does not count. All canonical links and refresh redirects of a page
count. Relative targets are resolved against the page, or its ``base`` element if that names a whole url; ``.`` and ``..``
are worked off; character references of the five reserved characters are decoded. Targets of other schemes without ``//`` (mail, scripts)
are no urls.

Defined results for odd input: a null url, or one without ``://``, has an empty host and path, no rule and
no aliases, and is allowed; null html has no links; of rules of equal length the one with the longer host counts, then allow;
urls and pages of any length are read whole; repeated rows are judged each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import skew
from prismflow.llm.components import connected_components

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lowered(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Alias key of an url; null for urls without a host."""
    key = F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(host_of(url) != "", key)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The winning rule as struct(rule, verdict), null if none fits. ``rules`` is a bounded, literal list."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        under = (host == rule_host) | host.endswith("." + rule_host)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(under & path.startswith(rule_path), value).otherwise(fits)
    return fits


def rules_joined(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins, for rule tables of any size: ``keys`` (host, path), ``rules`` (verdict, host, path)."""
    parts = F.split("host", r"\.")
    keys = keys.select("host", "path").distinct()
    tails = keys.select("host", "path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))).alias("tail"))
    named = rules.select(F.col("host").alias("tail"), F.col("path").alias("rule_path"), "verdict")
    found = tails.join(named, "tail").where(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.length("tail") + F.length("rule_path"), F.length("tail"), F.col("verdict") == "allow", "tail", "rule_path")
    return found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("tail", "rule_path").alias("rule"), "verdict"), order).alias("fit"))


#: What a link looks like: the attribute that makes it one, then its target, in either order.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*'?([^"'\s>]+)"""
BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Character references, the ampersand last.
REFERENCES = [("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&")]


def _decoded(text: Column) -> Column:
    for written, meant in REFERENCES:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def _without_dots(path: Column) -> Column:
    """An absolute path whose ``.`` and ``..`` are worked off."""
    parts = F.split(path, "/")
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(part)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    whole = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), whole).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The whole url that ``target`` means on a page at ``base``; null if it is none."""
    scheme, host = F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    here = F.concat(scheme, F.lit("://"), host)
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(here, path, target))
        .when(target.startswith("/"), F.concat(here, _without_dots(own), rest))
        .otherwise(F.concat(here, _without_dots(F.concat(folder, own)), rest))
    )


def links_in(html: Column, url: Column) -> Column:
    """Targets of canonical links and refresh redirects, resolved."""
    found = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), 1), F.regexp_extract_all(html, F.lit(REFRESH), 1))
    named = _decoded(F.regexp_extract(html, BASE, 1))
    base = F.when(named.contains("://"), named).otherwise(url)
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.filter(F.transform(found, lambda x: resolved(_decoded(x), base)), lambda x: x.isNotNull()))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (url, target) of all redirects and canonical links found in the pages."""
    found = pages.select(F.col(url_col).alias("page"), F.explode(links_in(F.col(html_col), F.col(url_col))).alias("target"))
    return found.select(F.col("page").alias("url"), "target").distinct()


def judged(pages: DataFrame, edges: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, host, path, rule (null if none fits), verdict. ``edges`` has (url, target)."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    ends = edges.select(F.explode(F.array("url", "target")).alias("end")).select(node_of(F.col("end")).alias("node"), rule_for(host_of(F.col("end")), path_of(F.col("end")), rules)["verdict"].alias("verdict"))
    links = storage.cut(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null").distinct())
    none = F.lit(None).cast("string")
    if not links.limit(1).count():
        inherited = rows.withColumn("inherited", none)
    else:
        members = connected_components(links, "a", "b")
        n = members.count()
        strength = F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1).otherwise(0))
        of = skew.lookup(ends.where("node is not null").distinct(), members, "node", "verdict", 2 * n).groupBy("component").agg(strength.alias("strongest"))
        named = skew.lookup(members, of, "component", "node", n).select("node", F.when(F.col("strongest") == 1, "block").otherwise("allow").alias("inherited"))
        known = rows.where("node is not null")
        inherited = skew.lookup(known, named, "node", "id", known.count(), "left").select(*rows.columns, "inherited").unionByName(rows.where("node is null").withColumn("inherited", none))
    verdict = F.coalesce(F.col("fit.verdict"), "inherited", F.lit("allow"))
    return inherited.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
