"""URL filters that see through aliases: redirect equivalence over pages.

A rule is a verdict, allow or block, for "host/path": it fits its host and all subdomains of it where
the URL's path starts with the rule's. The longest fitting rule decides (ties: the longer host, which
cannot be equal as well).

A URL without a rule takes the verdict of its aliases. Two URLs are aliases if a page says so: by a
canonical link, by a meta refresh, or by a table of redirects. Aliases are transitive, so the classes are
the connected components of that graph, found by joins and minima. A class is blocked if some URL of it is
blocked by a rule and none is allowed by one: explicit allows go before blocks, and a URL's own rule goes
before its class. Aliases need not be pages themselves.

In the graph a URL is its host, path and query; the scheme and the fragment, which no rule sees, don't
count, an empty path is "/", and dot segments are resolved. Tags are found in one pass over the page, in which
comments, scripts, styles, titles and text areas are passed over; Python only reads those that tell an alias.
"""

from __future__ import annotations

import html
import re
import string
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import drop_table, materialize, text_batches
from ridgeline.llm.components import components

_RAW = r"<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\b|\z)" for x in ("script", "style", "textarea", "title"))
#: Tags that tell aliases, and what is skipped on the way to them, in order. Every way through ends, at the text's end if need be.
TAGS = rf"(?is){_RAW}|<(?:link|meta|base)\b(?:[^'\x22>]|\x22[^\x22]*(?:\x22|\z)|'[^']*(?:'|\z))*+(?:>|\z)"
_ATTRIBUTE = re.compile(r"""(?<![^\s"'>/=])([^\s"'>/=]++)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.A)
_REFRESH = re.compile(r"""[\s0-9.]*[;,\s]\s*url\s*=\s*["']?([^"']*)""", re.I | re.A)


def _lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    """The host with A-Z lower-cased (with a port or user, if there is one); empty for null or no ://."""
    return F.coalesce(_lowered(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """The path, without query and fragment; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain_path(p: Column) -> Column:
    """A path that begins with "/", without dot segments."""
    p = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    parts = F.split(F.substr(p, F.lit(2)), "/")

    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    clean = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end), "/"))
    return F.when(F.contains(p, F.lit("/.")), clean).otherwise(p)


def alias_key(url: Column) -> Column:
    """What a URL is in the alias graph: host, path and query. Null for null or no ://."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(_rest(url).isNotNull(), F.concat(host(url), _plain_path(path(url)), query))


def resolved(base: str, href: str) -> str | None:
    """The http(s) URL that href, as written in a page at base, stands for; None for other schemes and what is no URL."""
    try:
        out = urljoin(base, html.unescape(href).strip("\x20\t\n\r\f"))
    except ValueError:
        return None
    return out if out.lower().startswith(("http://", "https://")) else None


def _attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        value = m[2][1:-1] if m[2][0] in "\"'" else m[2]
        out.setdefault(m[1].lower(), value)
    return out


def target(url: str, base: str | None, tag: str) -> str | None:
    """The URL that a link or meta tag of a page says is the page's own, or None. base is the page's base tag."""
    own = _attributes(tag)
    if tag[:5].lower() == "<link":
        href = own.get("href") if "canonical" in own.get("rel", "").lower().split() else None
    else:
        found = _REFRESH.match(own.get("content", "")) if own.get("http-equiv", "").lower() == "refresh" else None
        href = found[1] if found and found[1] else None
    if href is None:
        return None
    return resolved((resolved(url, _attributes(base).get("href", "")) if base else None) or url, href)


def _targets(url: str, base: str, tag: str) -> Column:
    @F.pandas_udf("string")
    def found(urls: pd.Series, bases: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([target(*x) for x in zip(urls, bases.astype(object).where(bases.notna(), None), tags, strict=True)], dtype=object)

    return found(url, base, tag)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): pairs of different alias keys that pages(url, html) say are one. A page without html or a key says nothing.

    Tags are cut out in the JVM; Python sees only the tags that tell an alias, with the page's URL and base tag.
    """
    text_batches(pages.sparkSession)
    held = pages.where(F.rlike("html", F.lit("(?i)canonical|refresh")) & (F.instr("url", "://") > 0))
    held = held.select("url", F.filter(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0)), lambda t: F.rlike(t, F.lit(r"(?is)^<(?:link|meta|base)\b.*>\z"))).alias("tags"))
    base = F.get(F.filter("tags", lambda t: F.rlike(t, F.lit(r"(?is)^<base\b.*href"))), 0)
    told = F.filter("tags", lambda t: F.rlike(t, F.lit("(?is)^<link.*canonical|^<meta.*refresh")))
    held = held.select("url", base.alias("base"), F.explode(told).alias("tag"))
    said = held.select("url", _targets("url", "base", "tag").alias("target")).where("target is not null")
    return said.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b")).where("a <> b")


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """(a, b) of a table of redirects(url, target) as a crawler notes them, both whole URLs; rows with nulls or without :// say nothing."""
    return redirects.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b")).where("a <> b")


def _split(rule: str) -> tuple[str, str]:
    name, slash, rest = rule.partition("/")
    return name.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), slash + rest


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. rules: (verdict, "host/path"), a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(dict.fromkeys(rules), key=lambda r: (len(r[1]), len(_split(r[1])[0]))):
        name, start = _split(rule)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ruled(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """urls(host, path, ...) with a column __rule, struct(rule, verdict) or null.

    A list becomes one expression. A table of rules(verdict, rule) of any size is joined: the distinct hosts and
    paths look their domains up, then those prefixes of the path that are as long as some rule of that domain.
    """
    if isinstance(rules, list):
        return urls.withColumn("__rule", rule_of(rules, F.col("host"), F.col("path")))
    cut = F.instr("rule", "/")
    own = rules.where("rule is not null and verdict is not null").select(
        "verdict", "rule", _lowered(F.when(cut > 0, F.substr("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))).alias("__domain"), F.when(cut > 0, F.substr("rule", cut)).otherwise("").alias("__start")
    )
    own = own.groupBy("__domain", "__start").agg(F.min(F.struct("verdict", "rule")).alias("__own"))  # the same rule twice: allow wins
    sizes = own.groupBy("__domain").agg(F.collect_set(F.length("__start")).alias("__sizes"))
    some = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = some.withColumn("__domain", F.explode(domains)).join(sizes, "__domain")
    wide = wide.withColumn("__size", F.explode("__sizes")).where("__size <= length(path)").withColumn("__start", F.expr("substr(path, 1, __size)"))
    order = F.struct(F.length("__own.rule"), F.length("__domain"))
    best = wide.join(own, ["__domain", "__start"]).groupBy("host", "path").agg(F.max_by(F.struct("__own.rule", "__own.verdict"), order).alias("__rule"))
    return urls.join(best, ["host", "path"], "left")


def blocked_aliases(edges: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(alias, component) of all URLs whose class has a URL blocked by a rule and none allowed by one."""
    classes = components(edges).select(F.col("node").alias("alias"), "component")
    url = F.concat(F.lit("://"), F.col("alias"))
    known = ruled(classes.select("component", host(url).alias("host"), path(url).alias("path")), rules).where("__rule is not null")
    judged = known.groupBy("component").agg(F.min("__rule.verdict").alias("verdict"))  # "allow" comes first
    return classes.join(judged.where("verdict = 'block'"), "component").select("alias", "component")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Every row of pages(page_id, url, html) as page_id, host, path, rule, verdict and alias_of, the class it was blocked with.

    verdict is allow or block: the rule's, else block for a URL of a blocked class, else allow. Null URLs and those
    without :// have an empty host and path, no rule and no aliases: they are allowed. Null or empty html tells no
    aliases; html of any length is read whole, once. Repeated rows are judged alike, an empty table gives no rows;
    other columns are not read.
    """
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("alias"))
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirect_edges(redirects))
    edges = materialize(edges.distinct(), "aliases")
    blocked = materialize(blocked_aliases(edges, rules), "blocked")
    drop_table(edges)
    out = ruled(urls, rules).join(blocked.withColumnRenamed("component", "alias_of"), "alias", "left")
    inherited = F.when(F.col("alias_of").isNotNull(), "block").otherwise("allow")
    alias_of = F.when(F.col("__rule").isNull(), F.col("alias_of"))
    return out.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", inherited).alias("verdict"), alias_of.alias("alias_of"))
