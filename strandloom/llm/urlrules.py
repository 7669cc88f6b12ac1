"""URL rules whose block decisions reach aliases: pages linked by redirects and canonical links are one resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import connected_components
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, scratch

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: So many rules are an expression, tried on each url; more are a table that urls are joined to.
LITERAL_RULES = 32
#: Character references by name that occur in urls; those by number are all decoded.
REFERENCES = {
    "amp": "&", "AMP": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "colon": ":", "sol": "/", "quest": "?", "equals": "=", "num": "#", "semi": ";", "period": ".", "percnt": "%", "plus": "+", "comma": ",", "lowbar": "_", "excl": "!", "lpar": "(", "rpar": ")", "ast": "*", "dollar": "$", "commat": "@", "Tab": "\t", "NewLine": "\n",
}
#: A path with segments to resolve.
DOTS = r"/\.\.?(/|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_of(url: Column) -> Column:
    """What a url names when it is fetched: no fragment, scheme and host in lower case; null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def best_rule(host: Column, path: Column, rules) -> Column:
    """Struct (length, allow, rule) of the longest rule that fits (of equally long ones an allow), else null."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def with_rule(rows: DataFrame, rules) -> DataFrame:
    """``rows`` (with host and path) and ``best``, the struct of ``best_rule``; ``rules`` is a list, or a table of verdict, host, path.

    A long list is a table. Distinct urls are joined to it twice, by the last labels of their host (no more than a rule has)
    and then by host and the beginnings of the path that are as long as a path of that host's rules; both joins split what
    many urls share.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= LITERAL_RULES:
            return rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max(F.col("verdict") == "allow").alias("allow"))
    rules = materialize(rules, "url-rules")
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)).alias("n")).first()["n"]
    urls = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("urls")).withColumn("url_id", F.monotonically_increasing_id()), "url-distinct")
    parts = F.split("host", r"\.")
    last = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    ends = materialize(urls.select("url_id", "path", F.explode(last).alias("rule_host")), "url-ends")
    sizes = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    sizes = sizes.join(ends.groupBy("rule_host").agg(F.count("*").alias("n")), "rule_host")
    found = heavy_split_join(ends, sizes, "rule_host", "n", ends.count()).where("sizes is not null")
    found = found.select("url_id", "path", "rule_host", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    found = materialize(found.select("url_id", F.struct("rule_host", F.substring("path", F.lit(1), F.col("size")).alias("rule_path")).alias("rule")), "url-tries")
    told = rules.select(F.struct("rule_host", "rule_path").alias("rule"), "allow").join(found.groupBy("rule").agg(F.count("*").alias("n")), "rule")
    found = heavy_split_join(found, told, "rule", "n", found.count()).where("allow is not null")
    text = F.concat("rule.rule_host", "rule.rule_path")
    best = found.groupBy("url_id").agg(F.max(F.struct(F.length(text).alias("length"), "allow", text.alias("rule"))).alias("best"))
    best = urls.join(best, "url_id").select(F.struct("host", "path").alias("url_"), "urls", "best")
    best = materialize(best, "url-best", keep=True)
    out = heavy_split_join(rows.withColumn("url_", F.struct("host", "path")), best, "url_", "urls", rows.count())
    return out.select(*rows.columns, "best")


def _unescaped(value: Column) -> Column:
    """An attribute's value with its character references decoded, in one pass: ``&amp;lt;`` is ``&lt;``."""
    parts = F.regexp_extract_all(value, F.lit(r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z]+);|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for name, c in REFERENCES.items() for x in (f"&{name};", c)])

    def one(part: Column) -> Column:
        code = F.when(F.regexp_like(part, F.lit(r"^&#[0-9]+;$")), F.conv(F.regexp_extract(part, r"([0-9]+)", 1), 10, 16))
        code = code.when(F.regexp_like(part, F.lit(r"^&#[xX][0-9A-Fa-f]+;$")), F.upper(F.regexp_extract(part, r"[xX]([0-9A-Fa-f]+)", 1)))
        code = F.lpad(code, 8, "0")
        sound = code.between("00000001", "0000D7FF") | code.between("0000E000", "0010FFFF")
        return F.when(sound, F.decode(F.unhex(code), "UTF-32")).otherwise(F.coalesce(F.try_element_at(names, part), part))

    return F.trim(F.array_join(F.transform(parts, one), ""))


def _attributes(tag: Column) -> Column:
    """The attributes of a tag as (name, value) in order, names in lower case; quoted values are taken whole."""
    found = F.regexp_extract_all(tag, F.lit(r"(?is)[^\s\"'<>/=]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"), F.lit(0))
    value = r"(?is)=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))"
    return F.transform(found, lambda a: F.struct(F.lower(F.trim(F.substring_index(a, "=", 1))).alias("name"), F.concat(*(F.regexp_extract(a, value, k) for k in (1, 2, 3))).alias("value")))


def _attribute(attributes: Column, name: str) -> Column:
    """The decoded value of the first attribute of that name; null without it."""
    return _unescaped(F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"])


def _refresh_url(content: Column) -> Column:
    """The url in the content of a refresh: it goes on to its closing quote, or to a blank; ``;`` is part of it."""
    url = F.trim(F.concat(*(F.regexp_extract(content, r"(?is)\burl\s*=\s*(?:\"\s*([^\"]*)|'\s*([^']*)|([^\"'\s]+))", k) for k in (1, 2, 3))))
    return F.when(url != "", url)


def page_links(html: Column) -> Column:
    """(base, hrefs) of a page: where its relative links begin (null: at its url), and its canonical links and refreshes.

    Comments, and what scripts, styles, text areas, titles and templates hold, are no part of the page's tags; one that isn't
    closed goes on to the end. A ``>`` within quotes doesn't end a tag, and an attribute counts by its own name only.
    """
    hidden = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|xmp)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
    tags = F.regexp_extract_all(F.regexp_replace(html, hidden, " "), F.lit(r"(?is)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    told = F.transform(tags, lambda t: F.struct(F.lower(F.substring(t, 2, 4)).alias("tag"), _attributes(t).alias("at")))
    canonical = F.filter(told, lambda t: (t["tag"] == "link") & F.array_contains(F.split(F.lower(F.coalesce(_attribute(t["at"], "rel"), F.lit(""))), r"\s+"), "canonical"))
    refresh = F.filter(told, lambda t: (t["tag"] == "meta") & (F.lower(_attribute(t["at"], "http-equiv")) == "refresh"))
    bases = F.filter(F.transform(told, lambda t: F.when(t["tag"] == "base", _attribute(t["at"], "href"))), lambda h: h.isNotNull())
    hrefs = F.concat(F.transform(canonical, lambda t: _attribute(t["at"], "href")), F.transform(refresh, lambda t: _refresh_url(_attribute(t["at"], "content"))))
    return F.struct(F.get(bases, F.lit(0)).alias("base"), F.filter(hrefs, lambda h: h.isNotNull()).alias("hrefs"))


def _without_dots(url: Column) -> Column:
    """A url with the ``.`` and ``..`` segments of its path resolved (RFC 3986, 5.2.4)."""
    head, tail = F.regexp_extract(url, r"^([^:]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[^?#]*([\s\S]*)", 1)
    parts = F.split(path_of(url), "/")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(F.regexp_like(path_of(url), F.lit(DOTS)), F.concat(head, F.lit("/"), F.array_join(kept, "/"), end, tail)).otherwise(url)


def _absolute(base: Column, href: Column) -> Column:
    """``href`` of a page at ``base``."""
    origin = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return _without_dots(
        F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.substring_index(base, "://", 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.regexp_like(href, F.lit(r"^([?#]|$)")) | F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame | None:
    """(source, target) resources: the canonical links and refreshes of each page's html, and a url with and without dot segments.

    Character references of the links are decoded, and relative links resolved against the page's base. None where no page has a tag that could be a
    link, nor a url with dots: this is looked up first, and nothing is written then.
    """
    url, html = F.col(url_col), F.col(html_col)
    named = pages.where(F.contains(url, F.lit("://"))).select(url.alias("url"), html.alias("html"))
    dotted = F.regexp_like(path_of(F.col("url")), F.lit(DOTS))
    tagged = F.coalesce(F.regexp_like("html", F.lit(r"(?i)<(?:link|meta)\b")), F.lit(False))
    if named.where(dotted | tagged).isEmpty():
        return None
    found = named.where(tagged).select("url", page_links(F.col("html")).alias("links"))
    found = materialize(found.select("url", F.col("links.base").alias("base"), F.explode("links.hrefs").alias("href")), "url-links")
    found = materialize(found.select(resource_of(F.col("url")).alias("source"), "base", "href"), "url-sources")
    begun = found.withColumn("begin", F.when(F.col("base").isNotNull(), _absolute(F.col("source"), F.col("base"))))
    begun = materialize(begun.select("source", F.coalesce("begin", "source").alias("begin"), "href"), "url-begins")  # written, as plans grow with each step inlined
    linked = materialize(begun.select("source", _absolute(F.col("begin"), F.col("href")).alias("url")), "url-targets")
    linked = linked.select("source", resource_of(F.col("url")).alias("target")).where("target is not null")
    dots = named.where(dotted).select(resource_of(F.col("url")).alias("source"))
    return linked.unionByName(dots.select("source", _without_dots(F.col("source")).alias("target")).where("target is not null"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, resource) of every page.

    A page's own longest rule decides. Else its aliases do, over the components of redirects (an optional table of
    source, target urls) and of the links in the html: if any alias has an allow rule, the page is allowed; else if any
    has a block rule, it is blocked; without a rule it is allowed. A null url, or one without ``://``, has an empty host
    and path, no aliases, and is allowed. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are left out. ``rules`` is a list of (verdict, host, path) or a table of them. Everything runs as DataFrame
    operations; hubs cost a partial minimum per task.
    """
    with scratch(pages.sparkSession):
        return _judged(pages, rules, redirects, id_col, url_col, html_col)


def _judged(pages: DataFrame, rules, redirects: DataFrame | None, id_col: str, url_col: str, html_col: str) -> DataFrame:
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), resource_of(F.col("url")).alias("resource"))
    own = with_rule(own, rules)
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select(*(_without_dots(resource_of(F.col(c))).alias(c) for c in ("source", "target")))
        edges = given if edges is None else edges.unionByName(given)
    told = F.when(F.col("best.allow"), "allow").when(F.col("best").isNotNull(), "block")
    nodes = None if edges is None else connected_components(edges.where("source <> target"), "source", "target")
    if nodes is None or nodes.isEmpty():
        verdict = F.coalesce(told, F.lit("allow"))
        return own.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "resource")
    nodes = nodes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    rated = materialize(with_rule(nodes, rules).select("node", "component", F.col("best.allow").alias("allows")), "url-rated")
    fate = rated.groupBy("component").agg(F.max("allows").alias("any_allow"), F.count("*").alias("n")).where("any_allow is not null")
    alias = heavy_split_join(rated, fate, "component", "n", rated.count()).where("any_allow is not null")
    alias = alias.select(F.col("node").alias("resource"), F.when(F.col("any_allow"), "allow").otherwise("block").alias("inherited"))
    alias = materialize(alias.join(own.groupBy("resource").agg(F.count("*").alias("pages_")), "resource"), "url-alias", keep=True)
    own = heavy_split_join(own, alias, "resource", "pages_", pages.count())
    verdict = F.coalesce(told, F.col("inherited"), F.lit("allow"))
    return own.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "resource")
