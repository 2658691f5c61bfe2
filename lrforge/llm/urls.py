"""URL rules and their spread over redirect and canonical-link aliases, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm.common import as_table, named, read
from lrforge.llm.graph import connected_components

#: (verdict, host, path): fits the host and its subdomains where the path starts with path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a browser reads as no tag, tags of links with their attributes (2,000 names and gaps at most), and one attribute.
NOISE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
TAG = r"""(?i)<(?:link|meta|base)(?=[\s/])(?:[\s/]++|[^\s"'<>/=]++(?:\s*+=\s*+""" + VALUE + r""")?+){0,2000}+>"""
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*""" + VALUE + ")?"
TO_URL = r"""(?is)^[^;,]*[;,\s]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))"""
NAMED = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    Length is that of host and path together; of equally long ones the first in
    text order is taken. rules is a policy of the caller's, a list in his program.
    """
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def plain_path(path: Column) -> Column:
    """A path without . and .. segments; / for an empty one."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x))
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    folded = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path == "", F.lit("/")).when(path.contains("/."), folded).otherwise(path)


def node_of(url: Column) -> Column:
    """The resource that a URL names: scheme and host lower-cased, no . and .. segments, no fragment, spaces as %20; an empty path is /."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.replace(F.concat(scheme, F.lit("://"), host_of(url), plain_path(path_of(url)), query), F.lit(" "), F.lit("%20")))


def resolve(base: Column, link: Column) -> Column:
    """A link against a URL: absolute, scheme-relative, rooted, a query, relative to the folder, or the URL itself for a fragment or nothing.

    Null for schemes without //, such as mailto, and where the URL is none.
    """
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(~base.contains("://"), F.lit(None))
        .when((link == "") | link.startswith("#"), base)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, folder, link))
    )


def with_attributes(tags: DataFrame, tag: str, names: list[str]) -> DataFrame:
    """Adds the values of a tag's first attributes of these names, quoted or bare, with entities decoded and white space trimmed; null without one.

    Step by step, so that each expression is computed once and named by those that use it.
    """
    found = tags.withColumn("_attributes", F.regexp_extract_all(F.regexp_replace(tag, "^<[A-Za-z]+", ""), F.lit(ATTRIBUTE), F.lit(0)))
    first = lambda name: F.get(F.filter("_attributes", lambda x: x.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    found = found.withColumns({n: F.regexp_replace(first(n), r"(?s)^[^=]*=\s*", "") for n in names}).drop("_attributes")
    found = found.withColumns({n: F.regexp_replace(F.col(f"`{n}`"), r"""(?s)^(["'])(.*)\1$""", "$2") for n in names})
    found = found.withColumns({n: decoded(F.col(f"`{n}`")) for n in names})
    return found.withColumns({n: F.regexp_replace(F.regexp_replace(F.col(f"`{n}`"), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "") for n in names})


def decoded(value: Column) -> Column:
    """Entities of ASCII characters by number, and the five named ones of XML, once each. value is a column by name."""
    parts = F.split(value, r"&#(?=0*[0-9]{1,3};|[xX]0*[0-7]?[0-9a-fA-F];)")

    def character(part: Column) -> Column:
        number = F.regexp_extract(part, "^[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(part.rlike("^[xX]"), F.conv(number, 16, 10)).otherwise(number).cast("int")
        rest = F.regexp_replace(part, "(?s)^[^;]*;", "")
        return F.when(code == 38, F.concat(F.lit("&amp;"), rest)).when(code < 128, F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("&#"), part))

    out = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(character(x))), "")
    for name, c in NAMED:
        out = F.regexp_replace(out, f"(?i)&{name};", c)
    return F.when(value.contains("&"), out).otherwise(value)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) nodes of all canonical links and meta refreshes of a page, the redirects that it states itself.

    Comments, scripts, styles, titles and text areas hold no links. Addresses are resolved
    against the page's first <base href>, if it has one. A link to the page itself, a
    fragment of it, or with a scheme without // is none. Null addresses and pages give none.
    """
    some = pages.select(named(url_col).alias("url"), named(html_col).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    # Tags, attributes and targets are written between the steps: filters would be pushed through all of them otherwise, each expression into the next.
    tags = as_table(some.select("url", F.regexp_extract_all(F.regexp_replace("html", NOISE, " "), F.lit(TAG), F.lit(0)).alias("tags")), "url-tags")
    based = with_attributes(tags.withColumn("first_base", F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base")), F.lit(0))), "first_base", ["href"])
    each = based.select("url", F.coalesce(resolve(F.col("url"), F.col("href")), F.col("url")).alias("base"), F.explode("tags").alias("tag"))
    each = as_table(with_attributes(each, "tag", ["rel", "href", "http-equiv", "content"]).withColumnRenamed("http-equiv", "equiv"), "url-links")
    refresh = F.trim(F.concat(*[F.regexp_extract("content", TO_URL, i) for i in (1, 2, 3)]))
    link = F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical"), F.col("href"))
    link = link.when(F.col("tag").rlike("(?i)^<meta") & (F.lower("equiv") == "refresh") & F.col("content").rlike(TO_URL), refresh)
    found = each.select("url", "base", link.alias("link"))
    found = as_table(found.select("url", resolve(F.col("base"), F.col("link")).alias("target")), "url-targets")
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Returns id_col, host, path, rule, verdict, component for every page.

    A URL's own rule decides first. A URL without one takes the decision of its
    aliases: of all URLs that redirects (columns from_url, to_url), meta refreshes
    and canonical links connect with it, an explicit allow comes before a block;
    without either it is allowed. component is the smallest node of the aliases,
    null if there are none. Null urls, and those without ://, have no host, no
    rule and no alias, and are allowed; null html has no links. Repeated rows are
    each returned; an empty table gives no rows; other columns are not looked at,
    whatever their names. redirects is a table of any size.
    """
    edges = None
    if html_col:
        edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a <> b")
        edges = more if edges is None else edges.union(more)
    judged = pages.select(named(id_col).alias("_id"), named(url_col).alias("_url")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    judged = judged.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("_url")))
    if edges is None:
        judged = judged.withColumn("component", F.lit(None).cast("string")).withColumn("shared", F.lit(None).cast("string"))
    else:
        nodes = connected_components(edges)
        ruled = nodes.withColumn("own", matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
        shared = ruled.groupBy("component").agg(F.min("own.verdict").alias("shared"))  # "allow" sorts before "block"
        judged = judged.join(as_table(nodes.join(shared, "component"), "url-aliases"), "node", "left")
    verdict = F.coalesce("own.verdict", "shared", F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("component")


def planted_aliases(pages: DataFrame) -> DataFrame:
    """Pages with links put into their html, by page_id modulo 10.

    Canonical hubs of their top-level domain and first folder (1, 6), with an apostrophe and a space in their name (7); a
    sibling by a relative path (2); two links in one page (3); a refresh to the page without its query (4);
    links that count for nothing: in a comment, to a fragment, to a mail address (5); links by a base (8).
    """
    host, path, k = host_of(F.col("url")), path_of(F.col("url")), F.pmod("page_id", F.lit(10))
    top, first = F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(path, "^/([^/]*)", 1)
    hub = F.concat(F.lit("HTTP://Hub."), top, F.lit("/de/"), first, F.lit("?a=1&amp;b=2#top"))
    canonical = lambda link: F.concat(F.lit('<link rel="canonical" href="'), link, F.lit('">'))
    planted = (
        F.when(k.isin(1, 6), canonical(hub))
        .when(k == 2, canonical(F.lit("./x/../sibling")))
        .when(k == 3, F.concat(canonical(F.concat(F.lit("//one."), top, F.lit("/"))), canonical(hub)))
        .when(k == 4, F.concat(F.lit("<META content='0; URL="), F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("' HTTP-EQUIV = refresh>")))
        .when(k == 5, F.concat(F.lit("<!-- "), canonical(hub), F.lit(" -->"), canonical(F.lit("#")), canonical(F.lit("mailto:x@y"))))
        .when(k == 7, F.concat(F.lit('<link title="rel=x" href="http://quote.'), top, F.lit("/de/it's a b/"), first, F.lit('" rel="alternate canonical">')))
        .when(k == 8, F.concat(F.lit("<base href='http://base."), top, F.lit("/de/x/y'><link href=../z rel=canonical>")))
        .otherwise("")
    )
    return pages.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), planted).alias("html"))


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(planted_aliases(read(spark, sf_dir, "pages").select("page_id", "url", "html")))


def _sql_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _sql_host(url: str) -> str:
    return _sql_lower(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")


def _sql_path(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_node(url: str) -> str:
    path = _sql_path(url)
    folded = f"list_reduce(list_prepend('', string_split({path}, '/')[2:]), lambda done, x: CASE x WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)"
    folded = f"{folded} || CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"
    plain = f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {folded} ELSE {path} END"
    return rf"CASE WHEN contains({url}, '://') THEN replace({_sql_lower(f"regexp_extract({url}, '(?s)^(.*?)://', 1)")} || '://' || {_sql_host(url)} || {plain} || regexp_extract({url}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), ' ', '%20') END"


def _sql_attribute(name: str) -> str:
    """Value of a tag's attribute in three readings, by its quotes."""
    one = "''"  # a quote within SQL text
    begin = rf'(?is)[\s"{one}]{name}\s*=\s*'
    double, single, bare = f'{begin}"([^"]*)', f"{begin}{one}([^{one}]*)", rf"{begin}([^\s>]+)"
    return f"trim(CASE WHEN regexp_matches(tag, '{double}') THEN regexp_extract(tag, '{double}', 1) WHEN regexp_matches(tag, '{single}') THEN regexp_extract(tag, '{single}', 1) ELSE nullif(regexp_extract(tag, '{bare}', 1), '') END)"


def _sql_resolve(base: str, link: str) -> str:
    return rf"""CASE WHEN {link} IS NULL THEN NULL WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains({base}, '://') THEN NULL
    WHEN {link} = '' OR starts_with({link}, '#') THEN {base}
    WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^(.*?://)', 1) || substr({link}, 3)
    WHEN starts_with({link}, '/') THEN regexp_extract({base}, '^(.*?://[^/?#]*)', 1) || {link}
    WHEN starts_with({link}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {link}
    ELSE regexp_extract({base}, '^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({_sql_path(base)}, '^(.*/)', 1), ''), '/') || {link} END"""


def _sql_rule(host: str, path: str, what: int) -> str:
    cases = [(f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')", (h + p, v)[what]) for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in cases) + " END"


def _sql(pages: str, more: str) -> str:
    return rf"""
WITH RECURSIVE given AS ({pages}),
tagged AS (
  SELECT page_id, url, unnest(list_filter(list_transform(string_split(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', ' ', 'g'), '<'), lambda t: ' ' || t), lambda t: regexp_matches(t, '(?i)^ (link|meta|base)\s'))) AS tag
  FROM given WHERE regexp_matches(html, '(?i)canonical|refresh')),
told AS (
  SELECT page_id, url, lower(regexp_extract(tag, '^ (\w+)', 1)) AS kind, {_sql_attribute("href")} AS href, lower({_sql_attribute("rel")}) AS rel, lower({_sql_attribute("http-equiv")}) AS equiv, {_sql_attribute("content")} AS content FROM tagged),
bases AS (SELECT page_id, url, any_value(href) AS base_href FROM told WHERE kind = 'base' AND href IS NOT NULL GROUP BY page_id, url),
links AS (
  SELECT t.url, coalesce({_sql_resolve("t.url", "base_href")}, t.url) AS base, regexp_replace(
    CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(rel, '\s+'), 'canonical') THEN href WHEN kind = 'meta' AND equiv = 'refresh' THEN nullif(regexp_extract(content, '(?i)url\s*=\s*["'']?([^"'']*)', 1), '') END, '&(amp|#38|#x26);', '&', 'gi') AS link
  FROM told t LEFT JOIN bases b ON b.page_id = t.page_id AND b.url = t.url),
whole AS (SELECT url, {_sql_resolve("base", "link")} AS to_url FROM links WHERE link IS NOT NULL),
edges AS (SELECT DISTINCT {_sql_node("url")} AS a, {_sql_node("to_url")} AS b FROM whole),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
aliases AS (
  SELECT node, min(other) AS component, min({_sql_rule(_sql_host("other"), _sql_path("other"), 1)}) AS shared FROM reach GROUP BY node),
urls AS (SELECT page_id, coalesce({_sql_host("url")}, '') AS host, coalesce({_sql_path("url")}, '') AS path, {_sql_node("url")} AS node FROM given)
SELECT page_id, host, path, {_sql_rule("host", "path", 0)} AS rule,
       coalesce({_sql_rule("host", "path", 1)}, shared, 'allow') AS verdict{more}
FROM urls LEFT JOIN aliases USING (node)
"""


_TOP, _FIRST = f"regexp_extract({_sql_host('url')}, '([^.]*)$', 1)", f"regexp_extract({_sql_path('url')}, '^/([^/]*)', 1)"
_HUB = f"'HTTP://Hub.' || {_TOP} || '/de/' || {_FIRST} || '?a=1&amp;b=2#top'"
OP9_SQL = _sql("SELECT page_id, url, html FROM pages", "")
ALIASES_SQL = _sql(
    f"""SELECT page_id, url, coalesce(html, '') || CASE page_id % 10 WHEN 1 THEN '<link rel="canonical" href="' || {_HUB} || '">' WHEN 6 THEN '<link rel="canonical" href="' || {_HUB} || '">' WHEN 2 THEN '<link rel="canonical" href="./x/../sibling">'
    WHEN 3 THEN '<link rel="canonical" href="//one.' || {_TOP} || '/"><link rel="canonical" href="' || {_HUB} || '">' WHEN 4 THEN '<META content=''0; URL=' || regexp_extract(url, '^([^?#]*)', 1) || ''' HTTP-EQUIV = refresh>'
    WHEN 5 THEN '<!-- <link rel="canonical" href="' || {_HUB} || '"> --><link rel="canonical" href="#"><link rel="canonical" href="mailto:x@y">'
    WHEN 7 THEN '<link title="rel=x" href="http://quote.' || {_TOP} || '/de/it''s a b/' || {_FIRST} || '" rel="alternate canonical">' WHEN 8 THEN '<base href=''http://base.' || {_TOP} || '/de/x/y''><link href=../z rel=canonical>' ELSE '' END AS html FROM pages""",
    ", component",
)
