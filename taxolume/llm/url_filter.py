"""URL filters with redirect equivalence.

Rules name a host, with all its subdomains, and a path prefix; the longest one that fits decides a URL. URLs that
redirect to each other, or name each other as canonical, are aliases: connected components over those edges carry
decisions to aliases that no rule fits. URLs are the same node if they differ in the case of scheme and host or in a
fragment only. In a component with an allowed member an undecided alias is allowed, otherwise
one with a blocked member is blocked; a URL's own rule always wins. DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolume.operators.components import connected_components
from taxolume.storage import Scratch, join_hot

#: Bytes of decided aliases up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: The rules as verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A page's meta and link tags. Nothing between < and > is given back, so a page is read once, whatever is in it.
TAGS = r"(?i)<(?:meta|link)\s([^<>]*+)>"
#: What a tag says, anywhere among its attributes.
IS_REFRESH, IS_CANONICAL = r"""(?i)(?:^|[\s"'])http-equiv\s*+=\s*+["']?refresh(?:["'\s/]|$)""", r"""(?i)(?:^|[\s"'])rel\s*+=\s*+["']?canonical(?:["'\s/]|$)"""
#: The value of content, and the target in it; the value of href.
CONTENT = r"""(?i)(?:^|[\s"'])content\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s"']\S*+))"""
TARGET = r"""(?i)(?:^|[\s;,])url\s*+=\s*+["']?([^"'\s]++)"""
HREF = r"""(?i)(?:^|[\s"'])href\s*+=\s*+["']?([^"'\s]++)"""


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, in lower case; empty without one or for a null url."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def normalised(url: Column) -> Column:
    """The url with its scheme and host in lower case and without its fragment; user and password, path and query stay
    as they are. What has no scheme stays as it is."""
    at = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)([^#]*)(?s:.*)$"
    part = [F.regexp_extract(url, at, i) for i in range(1, 5)]
    return F.when(url.rlike(at), F.concat(lower_ascii(part[0]), part[1], lower_ascii(part[2]), part[3])).otherwise(url)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does; of equal lengths an allow comes first.

    Rules are a stated, short list, so that they are tests in a projection.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):  # the later one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): pages' urls and what they redirect to or call canonical, all links of a page, both normalised. Relative
    targets are resolved by site root or directory; a target without a host or of a fragment only and a page without a
    url give no edge. Tags are cut out first, in time that grows with the page's length; attributes are looked for
    inside each, in any order. A tag whose attributes hold < or > is not read."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    tags = F.when(h.rlike("(?i)http-equiv|canonical"), F.regexp_extract_all(h, F.lit(TAGS), F.lit(1)))
    tags = F.filter(tags, lambda t: t.rlike(IS_REFRESH) | t.rlike(IS_CANONICAL))
    found = pages.filter(u.isNotNull() & h.isNotNull()).select(u.alias("a"), F.explode(tags).alias("tag"))
    content = F.concat(*[F.coalesce(F.regexp_extract("tag", CONTENT, i), F.lit("")) for i in (1, 2, 3)])
    says = F.array(F.when(F.col("tag").rlike(IS_REFRESH), F.regexp_extract(content, TARGET, 1)), F.when(F.col("tag").rlike(IS_CANONICAL), F.regexp_extract("tag", HREF, 1)))
    found = found.select(normalised(F.col("a")).alias("a"), F.explode(says).alias("t")).filter("t <> '' and t not like '#%'")
    # An explode of one element computes what the next step uses many times once.
    root = F.regexp_extract("a", r"^(?s:.*?)://[^/?#]*", 0)
    found = found.select("a", "t", F.explode(F.array(F.struct(root.alias("root"), F.regexp_replace(path(F.col("a")), "/[^/]*$", "").alias("folder")))).alias("at"))
    whole = F.when(F.col("t").contains("://"), F.col("t")).when(F.startswith("t", F.lit("//")), F.concat(F.regexp_extract("a", "^[^:]*:", 0), F.col("t"))).when(F.startswith("t", F.lit("/")), F.concat("at.root", F.col("t"))).otherwise(F.concat("at.root", "at.folder", F.lit("/"), F.col("t")))
    found = found.select("a", F.explode(F.array(whole)).alias("w")).select("a", F.explode(F.array(normalised(F.col("w")))).alias("b"))
    return found.filter("a <> b and b like '%://%'")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """For each row of pages: key, host, path, rule (null if none fits) and verdict.

    edges (a, b) add redirects known from elsewhere, as from a crawl's 3xx records; those in the pages' html always
    count. A URL that no rule and no alias decides gets `default`. Null urls have empty host and path and no aliases.
    All rows stay, repeated urls included; aliases need not be pages themselves: rules are applied to them too. Very
    long pages are read whole, in time that grows with their length. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    where = F.struct(host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    rows = pages.select(F.col(f"`{key}`").alias(key), normalised(F.col(f"`{url}`")).alias("_url"), where.alias("_w"))
    rows = rows.withColumn("_r", rule_of(F.col("_w.host"), F.col("_w.path"), rules))
    found = alias_edges(pages, url, html)
    if edges is not None:
        found = found.union(edges.select(normalised(F.col("a")), normalised(F.col("b"))))
    store = Scratch(pages.sparkSession, "aliases")
    same = connected_components(found, into=store)
    nodes = same.withColumn("r", rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"])
    says = nodes.groupBy("component").agg(F.max(F.col("r") == "allow").alias("allow"), F.max(F.col("r") == "block").alias("block"))
    says = says.select("component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("says")).filter("says is not null")
    told = store.put(join_hot(nodes.filter("r is null"), says, "component", F.xxhash64("node")).select(F.col("node").alias("_url"), "says"))
    store.drop(same)
    open_ = rows.filter("_r is null and _url is not null")
    few = (told.agg(F.sum(F.octet_length("_url") + 8)).first()[0] or 0) <= BROADCAST_BYTES
    open_ = open_.join(F.broadcast(told), "_url", "left") if few else join_hot(open_, told, "_url", F.xxhash64(key), how="left")
    done = rows.filter("_r is not null or _url is null").withColumn("says", F.lit(None).cast("string"))
    out = done.unionByName(open_)
    return out.select(key, F.col("_w.host").alias("host"), F.col("_w.path").alias("path"), F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "says", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rules as rows."""
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


#: The same rows for pages without redirects and canonical links, as the test tables are.
SQL = r"""
WITH w AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM w JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT w.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM w LEFT JOIN fit ON w.page_id = fit.page_id
"""
