"""URL filters with DataFrame functions only: rules of host and path, and block decisions that follow redirects.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins (ties: the
longer host, then allow). A url without a rule takes the decision of its equivalence class: the urls connected by
redirects (meta refresh) and canonical links of the pages. In a class an explicitly allowed url has precedence over
blocked ones; a class without rules is allowed.

A target is resolved against the page's <base>, else its url: absolute ones stay as they are, those with another
scheme than one of hosts (mailto:) are no edges, all others take the scheme, host, path or folder they lack.

Defined results: a null url and one without "://" have empty host and path and no rule, and are allowed; links to
nothing, to the page itself, from null urls and in comments or scripts are no edges; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, lower_ascii

#: Where a tag is none: comments, scripts and the like.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp)\b[^>]*>.*?(?:</\1\s*>|\z)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
#: The content of a refresh: seconds, then the target, with or without url=.
REFRESH_CONTENT = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?+[\"']?([^\"'\s>;]+)"
BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved(base: Column, to: Column) -> Column:
    """The address that a reference names on a page of address base; null if it has none."""
    root = F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, "^[^:/?#]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    path = F.regexp_extract(to, "^[^?#]*", 0)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.array_append(a, s))
    parts = F.aggregate(F.split(F.regexp_replace(F.substr(path, F.lit(2)), r"(^|/)(\.\.?)$", "$1$2/"), "/"), F.array().cast("array<string>"), step)
    plain = F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)
    below = F.concat(root, plain, F.regexp_extract(to, "(?s)[?#].*", 0))
    out = F.when(to.rlike("(?i)^[a-z][a-z0-9+.-]*://"), to).when(to.rlike("(?i)^[a-z][a-z0-9+.-]*:") | (to == "") | to.startswith("#"), None)
    out = out.when(to.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]*:", 0), to)).when(to.startswith("/"), below)
    return out.when(root == "", None).when(to.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), to)).otherwise(below)


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and the url it names as its redirect target or canonical address."""
    tags = F.filter(F.regexp_extract_all(F.col("html"), F.lit(TAG), 0), lambda t: t.rlike(CANONICAL) | t.rlike(REFRESH))
    to = F.regexp_replace(F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract("tag", REFRESH_CONTENT, 1), F.lit("")), F.regexp_extract("tag", REFRESH_TO, 1))), "&amp;", "&")
    shown = pages.where(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("a"), F.regexp_replace(html, HIDDEN, "").alias("html"))
    marked = shown.select("a", F.regexp_replace(F.regexp_extract("html", BASE, 1), "&amp;", "&").alias("base"), F.explode(tags).alias("tag"))
    named = marked.select("a", F.coalesce(resolved(F.col("a"), F.col("base")), F.col("a")).alias("base"), to.alias("to"))
    return named.select("a", resolved(F.col("base"), F.col("to")).alias("b")).where("a is not null and b is not null and b <> '' and a <> b")


def judged(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with host, path, rule and rule_verdict. rules: host, path, verdict.

    Rules are looked up once for each distinct host, by its suffixes, and the hosts' rules are joined back.
    """
    with_parts = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    labels = F.split("host", "[.]")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = with_parts.select("host").where("host <> ''").distinct().select("host", F.explode(suffix).alias("rule_host"))
    own = rules.select(F.col("host").alias("rule_host"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"), (F.col("verdict") == "allow").alias("allow"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict")).alias("r"))
    per_host = hosts.join(own, "rule_host").groupBy("host").agg(F.collect_set("r").alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r.rule_path)))
    return with_parts.join(per_host, "host", "left").withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.rule_verdict")).drop("_rules", "_best")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, path, rule, verdict, component (of urls with edges, else null) for each row of pages."""
    edges = edges_of(pages, url, html) if edges is None else edges
    members = components(edges, "a", "b")
    known = judged(members.withColumnRenamed("node", "url"), rules)
    said = known.groupBy("component").agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocks"))
    classes = members.join(said, "component").select(F.col("node").alias("_url"), "component", "allows", "blocks")
    out = judged(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), rules)
    follow = F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow")
    return out.join(classes, F.col("url") == F.col("_url"), "left").select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", follow).alias("verdict"), "component")
