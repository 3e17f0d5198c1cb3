"""URL filters: host and path rules, extended to aliases by redirects and canonical links.

A rule fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule decides. Urls that redirect to one another or
name one another as canonical form an equivalence class (a connected
component of the link graph). A url without a rule of its own follows its
class: an explicit allow anywhere in it wins, then a block, then the default.
Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.skew import join_to_unique, join_to_wide
from graphloom.llm.staging import Staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number (a few MB) are broadcast; more are joined through a shuffle.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


def address(url: Column) -> Column:
    """The node of the link graph: host, path without dot segments, and query, without scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), without_dots(path_of(url)), query))


def _target(base: Column, link: Column) -> Column:
    """``link`` as a full url, seen from the page ``base``."""
    origin = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^.*/", 0), F.lit("")), F.lit("/"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#") | (link == ""), base)
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .otherwise(F.concat(origin, folder, link))
    )


# possessive throughout, so that no text makes the matcher recurse or go back
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript)\b.*?(?:</\1\b|\z)"
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def visible_markup(html: Column) -> Column:
    """``html`` without comments and without what is text to a browser: scripts, styles and the like."""
    return F.regexp_replace(html, _HIDDEN, " ")


def _tags(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(visible_markup(html), F.lit(rf"(?is)<{tag}(?=[\s/]){_INSIDE}>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, entities decoded; null or empty without it."""
    every = F.regexp_extract_all(tag, F.lit(r"""[^\s=>"'/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""), F.lit(0))
    named = F.filter(every, lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(named, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1)
    return decoded(F.trim(F.regexp_replace(value, r"""^["']|["']$""", "")))


_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """``text`` with its numeric entities and the basic named ones decoded, each once."""

    def char(entity: Column) -> Column:
        hexed = F.regexp_extract(entity, r"^&#[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(entity, r"^&#0*(\d{1,7});", 1)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(made == "&", "\x01").otherwise(made)  # an ampersand that begins no entity

    entities = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX]0*[0-9a-fA-F]{1,6}|0*\d{1,7});"), F.lit(0)))
    out = F.aggregate(entities, text, lambda done, x: F.replace(done, x, char(x)))
    for name, value in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.when(text.contains("&"), F.replace(out, F.lit("\x01"), F.lit("&"))).otherwise(text)


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) of the pages' first canonical links and first refresh redirects.

    ``rel`` is a list of words in any order and case. Links in comments,
    scripts and other places that a browser does not read as markup do not
    count; entities in addresses are decoded. Null urls and pages, pages
    without such a link, and links without an address give no row; repeated
    rows repeat theirs; an empty table gives an empty one.
    """
    url, html = F.col(url_col), F.col(html_col)
    may = lambda word: F.lower(html).contains(word)
    is_canonical = lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")
    is_refresh = lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"
    first = lambda tag, fits: F.get(F.filter(_tags(html, tag), fits), F.lit(0))
    canonical = F.when(may("canonical"), _attribute(first("link", is_canonical), "href"))
    refresh = F.when(may("refresh"), F.trim(F.regexp_extract(_attribute(first("meta", is_refresh), "content"), r"""(?is)^[^;,]*+[;,]\s*+(?:url\s*=\s*)?["']?([^"']*)""", 1)))
    both = pages.select(url.alias("from_url"), F.explode(F.array(canonical, refresh)).alias("_link")).filter("from_url IS NOT NULL AND _link <> ''")
    return both.select("from_url", _target(F.col("from_url"), F.col("_link")).alias("to_url"))


def _suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct (host, path) of ``urls`` with ``rule`` and ``rule_verdict`` of the longest rule that fits.

    Only pairs with a rule are returned. ``rules``: host, path, verdict; a rule
    given twice with both verdicts counts as an allow.
    """
    named = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("_host"), F.col("path").alias("_path"), F.concat("host", "path").alias("rule"), (F.col("verdict") == "allow").alias("_allow")
    )
    candidates = urls.select("host", "path").distinct().withColumn("_host", F.explode(_suffixes(F.col("host"))))
    if named.count() <= BROADCAST_RULES:
        fitting = candidates.join(F.broadcast(named), "_host")
    else:
        # most urls share a suffix such as ``com``: rows of those are dealt over several tasks
        candidates = Staged(candidates.join(named.select("_host").distinct(), "_host", "left_semi"), "candidates").df
        weights = candidates.groupBy("_host").agg(F.count("*").alias("_w"))
        fitting = join_to_wide(candidates, max(1, candidates.count()), Staged(named.join(weights, "_host"), "rules").df, ["_host"], "_w")
    fitting = fitting.filter(F.col("path").startswith(F.col("_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), "_allow", "rule")).alias("best")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best._allow"), "allow").otherwise("block").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, via.

    ``rules``: host, path, verdict (allow or block). ``redirects``: optional
    table from_url, to_url; canonical links and refresh redirects are taken
    from ``html_col`` unless it is None. ``via`` is rule, alias or default.
    A url named only as a target takes part with its own rule. A null url, or
    one without ``://``, has empty host and path, no rule and the default
    verdict. Repeated rows stay and get equal verdicts; other columns are not
    read; an empty table gives an empty one.
    """
    url = F.col(url_col)
    rows = Staged(pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("_node")), "urls")
    sources = [page_links(pages, url_col=url_col, html_col=html_col)] if html_col else []
    sources += [redirects.select("from_url", "to_url")] if redirects is not None else []
    nodes_at = lambda c: F.struct(address(F.col(c)).alias("node"), host_of(F.col(c)).alias("host"), without_dots(path_of(F.col(c))).alias("path"))
    ruled = Staged(match_rules(rows.df, rules), "ruled")
    verdicts = None
    if sources:
        every = sources[0]
        for x in sources[1:]:
            every = every.unionByName(x)
        edges = Staged(every.select(nodes_at("from_url").alias("a"), nodes_at("to_url").alias("b")).filter("a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node").distinct(), "links")
        if not edges.df.isEmpty():
            verdicts = _class_verdicts(edges.df, rows.df, rules)
    total = max(1, rows.df.count())
    # pages of one address share host and path, so a popular address is the only kind of hot key
    counted = Staged(rows.df.groupBy("host", "path").agg(F.count("*").alias("_n")).join(ruled.df, ["host", "path"], "left"), "rules")
    out = join_to_unique(rows.df, total, counted.df, ["host", "path"], "_n").drop("_n")
    if verdicts is not None:
        per_node = Staged(rows.df.filter("_node IS NOT NULL").groupBy("_node").agg(F.count("*").alias("_n")).join(verdicts.withColumnRenamed("node", "_node"), "_node"), "aliases")
        with_class = join_to_unique(out, total, per_node.df, ["_node"], "_n", "left")
    else:
        with_class = out.withColumn("class_verdict", F.lit(None).cast("string"))
    return with_class.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "class_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("class_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def _class_verdicts(edges: DataFrame, rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, class_verdict) for each address that has links; null where no member of its class has a rule."""
    ends = Staged(edges.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").distinct(), "ends")
    ruled = match_rules(ends.df, rules)
    classes = Staged(connected_components(edges.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))), "classes")
    said = ends.df.join(ruled, ["host", "path"]).join(classes.df, "node").groupBy("component").agg(F.min("rule_verdict").alias("class_verdict"))  # allow sorts before block
    sizes = classes.df.groupBy("component").agg(F.count("*").alias("_n"))
    lookup = Staged(sizes.join(said, "component", "left"), "class-verdicts")
    return join_to_unique(classes.df, max(1, classes.df.count()), lookup.df, ["component"], "_n").select("node", "class_verdict")
