"""URL filter by redirect equivalence, by DataFrame functions alone.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts
with the rule's; the longest wins. Redirects (meta refresh) and canonical links join urls
into classes of aliases (connected components). A url that a rule blocks blocks its whole
class, be it a page or only the target of a link, but for urls that a rule allows: an explicit
allow goes before what is propagated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import LOWER, UPPER, pack, quoted, unpack, written
from siglake.llm.components import connected_components

#: The rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules up to this number are one array literal; above it they are joined by host suffix.
LITERAL_RULES = 64


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """A url without scheme and fragment, the host in lower case; empty if it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), F.when(rest == "", "/").otherwise(rest)))


def _fitting(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict)."""
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules])
    fits = F.filter(listed, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def _with_fit(rows: DataFrame, rules) -> DataFrame:
    """rows(host, path, ...) with fit, the longest rule that fits."""
    if not rules:
        return rows.withColumn("fit", F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    if len(rules) <= LITERAL_RULES:
        return rows.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules))
    listed = rows.sparkSession.createDataFrame([(h, p, v, len(h) + len(p)) for h, p, v in rules], "rh string, rp string, rv string, length int")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.concat_ws(".", F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\.")))))
    hosts = rows.select("host", "path").distinct()
    best = hosts.select("host", "path", F.explode(suffixes).alias("rh")).join(listed, "rh").where("startswith(path, rp)")
    best = best.groupBy("host", "path").agg(F.max(F.struct("length", F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))).alias("fit"))
    return rows.join(best, ["host", "path"], "left")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a canonical link or a meta refresh joins; relative targets are resolved."""
    page, body = F.col(quoted(url)), F.col(quoted(html))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    tagged = pages.where(F.lower(body).rlike(r"canonical|http-equiv")).select(page.alias("url"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    found = tagged.withColumn("to", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))).where("to <> ''")
    base = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    full = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to")))
        .when(F.startswith("to", F.lit("/")), F.concat(base, F.col("to")))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), F.col("to")))
    )
    return found.select(url_node(F.col("url")).alias("a"), url_node(full).alias("b")).where("a is not null and b is not null").distinct()


def judge_urls(pages: DataFrame, rules=RULES, *, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (allow or block).

    Nulls: a null url, or one without `://`, has empty host and path, fits no rule, has no
    aliases and is allowed. A null html has no links. Repeated rows are judged alike. An empty
    table gives an empty result. Input columns named like an output column give way to it.
    """
    page = F.col(quoted(url))
    judged = pack(pages, url_host(page).alias("host"), url_path(page).alias("path"), url_node(page).alias("node"))
    judged = _with_fit(judged, rules)
    own = F.col("fit.verdict")
    edges = written(alias_edges(pages, url, html), "aliases")
    if edges.isEmpty():
        out = judged.withColumn("verdict", F.coalesce(own, F.lit("allow")))
    else:
        classes = written(connected_components(edges), "classes")
        # every node of a class is judged, also a target that isn't a page
        node = F.concat(F.lit("http://"), "node")
        blocked = _with_fit(classes.select("root", url_host(node).alias("host"), url_path(node).alias("path")), rules).where(own == "block").select("root").distinct()
        spread = classes.join(blocked, "root").select("node", F.lit("block").alias("spread"))
        out = judged.join(spread, "node", "left").withColumn("verdict", F.coalesce(own, F.col("spread"), F.lit("allow")))
    return unpack(out.withColumn("rule", F.col("fit.rule")), ["host", "path", "rule", "verdict"])
